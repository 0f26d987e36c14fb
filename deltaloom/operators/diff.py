"""Differences of two snapshots: files, objects, typed fields, and the facts that follow from them.

All differences are full outer equi-joins; columns are compared null-safely.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import sqltext


def _sides(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join with columns keys, old_<value>, new_<value>, in_old and in_new; null keys match null keys."""
    left = old.select(*[F.col(k).alias(f"l_{k}") for k in keys], *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("in_old"))
    right = new.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("in_new"))
    on = reduce(lambda a, b: a & b, [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys])
    joined = left.join(right, on, "full_outer")
    return joined.select(
        *[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys],
        *[f"old_{v}" for v in values],
        *[f"new_{v}" for v in values],
        F.coalesce("in_old", F.lit(False)).alias("in_old"),
        F.coalesce("in_new", F.lit(False)).alias("in_new"),
    )


def changed(values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")) for v in values])


def status() -> Column:
    return F.when(~F.col("in_old"), "A").when(~F.col("in_new"), "D").otherwise("M")


def operation() -> Column:
    return F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "removed").otherwise("modified")


def file_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Files that are added (A), deleted (D) or modified (M); no rename detection."""
    return _sides(old, new, keys, values).where(~F.col("in_old") | ~F.col("in_new") | changed(values)).select(*keys, status().alias("status"), *[f"old_{v}" for v in values], *[f"new_{v}" for v in values])


def signatures(parts: DataFrame, key: str, parts_of: list[Column]) -> DataFrame:
    """One digest for each key over the ordered multiset of its parts."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts_of])
    return parts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(text)), "\x1e").alias("listed"), F.count("*").alias("parts")).select(key, F.sha2("listed", 256).alias("signature"), "parts")


def object_diff(old: DataFrame, new: DataFrame, key: str, parts_of: list[Column]) -> DataFrame:
    """Objects whose multiset of parts differs, with operation."""
    sides = _sides(signatures(old, key, parts_of), signatures(new, key, parts_of), [key], ["signature", "parts"])
    return sides.where(~F.col("old_signature").eqNullSafe(F.col("new_signature"))).select(key, operation().alias("operation"), "old_parts", "new_parts")


def unpivot(df: DataFrame, key: str, families: dict[str, str]) -> DataFrame:
    """Wide rows to fields (key, family, value) as text, nulls left out; ``families`` maps column to family."""
    pairs = [F.struct(F.lit(f).alias("family"), F.col(c).cast("string").alias("value")) for c, f in families.items()]
    return df.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.family", "x.value").where("value IS NOT NULL")


def field_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Fields (columns keys and value) that differ: before, after, action."""
    sides = _sides(old, new, keys, ["value"]).where(changed(["value"]))
    return sides.select(*keys, F.col("old_value").alias("before"), F.col("new_value").alias("after"), operation().alias("action"))


def facts(
    old_objects: DataFrame,
    new_objects: DataFrame,
    old_fields: DataFrame,
    new_fields: DataFrame,
    families: DataFrame,
    key: str = "object_key",
    path: str = "component",
    add_or_remove: list[str] | None = None,
) -> DataFrame:
    """One row for each fact of a change.

    Objects on one side give a presence fact, and their fields as context.  Fields without a family
    in the catalogue (family, category, may_modify) are no facts.  Families in ``add_or_remove``
    (raw definitions) say nothing while the component survives.  A changed field of a family that
    cannot be modified is a removal and an addition.  Objects with diagnostics (column
    ``diagnostics``, a list) have no facts at all.
    """
    objects = _sides(old_objects, new_objects, [key], ["diagnostics"])
    clean = objects.where((F.coalesce(F.size("old_diagnostics"), F.lit(0)) <= 0) & (F.coalesce(F.size("new_diagnostics"), F.lit(0)) <= 0)).select(key, "in_old", "in_new")
    presence = clean.where("NOT (in_old AND in_new)").select(
        key,
        F.lit("common.object.presence").alias("family"),
        F.lit("").alias(path),
        F.when(F.col("in_old"), "removed").otherwise("added").alias("action"),
        F.lit("presence").alias("category"),
        F.when(F.col("in_old"), "present").otherwise("absent_in_snapshot").alias("before_state"),
        F.lit(None).cast("string").alias("before"),
        F.when(F.col("in_new"), "present").otherwise("absent_in_snapshot").alias("after_state"),
        F.lit(None).cast("string").alias("after"),
        F.lit(False).alias("context_only"),
    )
    sides = _sides(old_fields, new_fields, [key, "family", path], ["value"]).where(changed(["value"])).drop("in_old", "in_new")
    known = sides.join(clean, key).join(F.broadcast(families), "family")  # the catalogue has a fixed number of families
    context = ~(F.col("in_old") & F.col("in_new"))
    both = F.col("old_value").isNotNull() & F.col("new_value").isNotNull()
    kept = known.where(context | ~(both & F.col("family").isin(add_or_remove or [])))
    action = F.when(context, F.when(F.col("in_old"), "removed").otherwise("added")).when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("modified")
    split = ~context & both & ~F.col("may_modify")
    null = F.lit(None).cast("string")
    whole = F.struct(action.alias("action"), F.col("old_value").alias("before"), F.col("new_value").alias("after"))
    removal, addition = F.struct(F.lit("removed").alias("action"), F.col("old_value").alias("before"), null.alias("after")), F.struct(F.lit("added").alias("action"), null.alias("before"), F.col("new_value").alias("after"))
    rows = kept.withColumn("context_only", context).withColumn("x", F.explode(F.when(split, F.array(removal, addition)).otherwise(F.array(whole))))

    def state(value: str, there: str) -> Column:
        return F.when(~F.col(there), "not_applicable").when(F.col(value).isNull(), "not_in_source").otherwise("present")

    changes = rows.select(
        key, "family", path, "x.action", "category", state("x.before", "in_old").alias("before_state"), "x.before", state("x.after", "in_new").alias("after_state"), "x.after", "context_only"
    )
    return presence.unionByName(changes)


def without_unresolved(fields: DataFrame, unresolved: DataFrame, key: str = "object_key", path: str = "component") -> DataFrame:
    """Fields less the column fields of unresolved columns (key, path): the one diagnostic that blocks columns alone."""
    doubt = unresolved.select(F.col(key).alias("key_"), F.col(path).alias("path_"))
    return fields.join(doubt, (F.col(key) == F.col("key_")) & (F.col(path) == F.col("path_")) & F.col("family").startswith("table.column."), "left_anti")


def overload_groups(signatures_: DataFrame, key: str = "object_key", name: str = "name") -> DataFrame:
    """(key, name, signatures) of routines with several signatures: the sorted set as JSON."""
    grouped = signatures_.groupBy(key, name).agg(F.array_sort(F.collect_set("signature")).alias("s"), F.count("*").alias("n"))
    return grouped.where("n > 1").select(key, name, F.to_json("s").alias("signatures"))


def uncovered(families: DataFrame, covered: DataFrame, on: list[str]) -> DataFrame:
    """Families that no fact covers."""
    return families.join(covered.select(*on).distinct(), on, "left_anti")


def text_facts(sides: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """source.text or source.format for objects whose text differs."""
    kind = sqltext.text_change(F.col(old), F.col(new))
    return sides.where(F.col(old).isNotNull() & F.col(new).isNotNull()).select(key, F.when(kind == "format_only", "common.source.format").when(kind == "structural_or_logic", "common.source.text").alias("family")).where("family IS NOT NULL")


def format_overrides(all_facts: DataFrame, format_only: DataFrame, key: str = "object_key") -> DataFrame:
    """Facts less those of objects of which only white space changed."""
    return all_facts.join(format_only.select(key), key, "left_anti")


def reordered(old: DataFrame, new: DataFrame, file: str, key: str, place: str) -> DataFrame:
    """Keys whose ordinal changed in files that have the same two or more unique keys on both sides."""

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy(file).orderBy(place, key)
        return df.select(file, key, F.row_number().over(order).alias("ordinal"))

    def keys(df: DataFrame) -> DataFrame:
        return df.groupBy(file).agg(F.array_sort(F.collect_list(key)).alias("keys"), F.countDistinct(key).alias("n"))

    sides = keys(old).join(keys(new).withColumnsRenamed({"keys": "new_keys", "n": "new_n"}), file)
    same = sides.where("keys = new_keys AND n >= 2 AND size(keys) = n").select(file)
    both = ranked(old).withColumnRenamed("ordinal", "old_ordinal").join(ranked(new).withColumnRenamed("ordinal", "new_ordinal"), [file, key])
    return both.where("old_ordinal <> new_ordinal").join(same, file, "left_semi")


def moved(old: DataFrame, new: DataFrame, key: str, path: str) -> DataFrame:
    """Objects that are in another file."""
    sides = _sides(old, new, [key], [path])
    return sides.where(F.col("in_old") & F.col("in_new") & changed([path])).select(key, F.col(f"old_{path}").alias("before"), F.col(f"new_{path}").alias("after"))


def conflicts(definitions: DataFrame, key: str, text: Column) -> DataFrame:
    """Keys defined several times with texts that differ in more than white space."""
    return definitions.groupBy(key).agg(F.count("*").alias("definitions"), F.countDistinct(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " ")).alias("texts")).where("texts > 1")


def compared(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Per-field comparison of two evaluations: rows (key, field, before, after) that differ, one-sided keys included."""
    sides = _sides(left, right, [key], values)
    pairs = [F.struct(F.lit(v).alias("field"), F.col(f"old_{v}").cast("string").alias("before"), F.col(f"new_{v}").cast("string").alias("after")) for v in values]
    return sides.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.field", "x.before", "x.after").where("NOT before <=> after")
