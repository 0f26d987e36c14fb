"""The whole analysis: two snapshots of files to objects, facts, risk, checks and a validated report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.extract import objects as extract
from deltaloom.extract import replay
from deltaloom.functions import identity, sqltext
from deltaloom.operators import diff, graph, rollup, scan
from deltaloom.plans import families
from deltaloom.state.cache import checkpointed


@dataclass
class Analysis:
    """Lazy tables of one analysis; definitions and facts are written once, as several results read them."""

    files: DataFrame
    contexts: DataFrame  # statements of files without definitions, and why they are not taken
    objects: DataFrame
    facts: DataFrame
    edges: DataFrame
    risk: DataFrame
    checks: DataFrame
    report: DataFrame


def definitions(files: DataFrame, default_schema: str | None = None) -> DataFrame:
    """Definitions of a snapshot (path, raw), one for each object key: the last by path and place."""
    found = scan.occurrences(scan.decoded(files), default_schema)
    return found.withColumn("definition", F.col("object_key"))


def last_of_each(found: DataFrame) -> DataFrame:
    columns = [c for c in found.columns if c != "object_key"]
    return found.groupBy("object_key").agg(*[F.max_by(c, F.struct("path", "ordinal")).alias(c) for c in columns])


def flawed(files: DataFrame) -> DataFrame:
    """Paths of files that are not UTF-8 or have something unterminated: what they define is not known for sure."""
    return scan.decoded(files).where(F.col("text").isNull() | (F.size(sqltext.mask_diagnostics(F.col("text"))) > 0)).select("path").distinct()


def diagnostics(found: DataFrame) -> DataFrame:
    """Rows (object_key, code) of a snapshot's definitions: unterminated texts, conflicts, secrets, and routines that are not extracted."""
    text = replay.with_statements(F.col("fragment"), F.col("context"))
    kinds = found.where(F.col("object_type").isin("PACKAGE_SPEC", "PACKAGE_BODY", "PROCEDURE", "FUNCTION"))
    # each text by itself; a package without routines is no failure, and overloads are facts
    of_routines = F.array(F.when(F.octet_length("fragment") > extract.PACKAGE_BYTES, "PACKAGE_EXTRACTION_SIZE_LIMIT").when(text.rlike(extract.WRAPPED), "WRAPPED_SOURCE_OPAQUE"))
    codes = found.select("object_key", F.explode(sqltext.mask_diagnostics(text)).alias("code"))
    codes = codes.unionByName(kinds.select("object_key", F.explode(of_routines).alias("code")).where("code IS NOT NULL"))
    codes = codes.unionByName(diff.conflicts(found, "object_key", F.col("fragment")).select("object_key", F.lit("CONFLICTING_DEFINITIONS").alias("code")))
    return codes.unionByName(found.where(sqltext.secret_index(text).isNotNull()).select("object_key", F.lit("SECRET_IN_MANDATORY_SOURCE").alias("code"))).distinct()


def order_facts(old_files: DataFrame, new_files: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (object_key, before, after): places of definitions that changed places in files that are fully read and have the same definitions."""
    several = [d.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path") for d in (old, new)]
    several = checkpointed(several[0].join(several[1], "path", "left_semi"))
    if several.isEmpty():
        return several.select(F.col("path").alias("object_key"), F.lit("").alias("before"), F.lit("").alias("after"))
    old_files, new_files, old, new = (df.join(several, "path", "left_semi") for df in (old_files, new_files, old, new))
    whole = [scan.file_inventory(f).where("parse_status = 'parsed'").select("path") for f in (old_files, new_files)]
    sides = [d.join(w, "path", "left_semi").select("path", "object_key", "ordinal") for d, w in zip((old, new), whole)]
    moved = diff.reordered(*sides, "path", "object_key", "ordinal")
    return moved.select("object_key", F.col("old_ordinal").cast("string").alias("before"), F.col("new_ordinal").cast("string").alias("after"))


def analyse(old_files: DataFrame, new_files: DataFrame, default_schema: str | None = None, most_bytes: int | None = None) -> Analysis:
    """Compare two snapshots of files (path, raw).

    Only definitions whose text differs, or that other statements are for, or that changed places in their file, are extracted: the
    cheap object difference comes first, over all definitions of a key, and prunes what the extractors
    see.  Tables are as ALTER TABLE and COMMENT ON leave them, in the same file and in files of such
    statements alone.  Objects with diagnostics have no facts; where only single columns are in doubt, those
    columns have none.  ``most_bytes`` is a budget for a definition's text with its statements.
    """
    files_ = (old_files, new_files)
    raw = [checkpointed(definitions(f, default_schema)) for f in files_]
    with_context = [replay.with_contexts(d, scan.decoded(f).select("path", "text"), default_schema, replay.MOST) for d, f in zip(raw, files_)]
    found = [d if said.isEmpty() else checkpointed(d) for d, said in with_context]
    contexts = with_context[0][1].withColumn("side", F.lit("before")).unionByName(with_context[1][1].withColumn("side", F.lit("after")))
    old, new = (checkpointed(last_of_each(d)) for d in found)
    file_changes = diff.file_diff(*(f.select("path", F.sha2("raw", 256).alias("sha256")) for f in files_), ["path"], ["sha256"])
    taken = F.to_json(F.transform("context", lambda x: F.struct(x["path"], x["sha256"])))
    differ = diff.object_diff(*found, "object_key", [F.col("path"), F.col("fragment_sha256"), taken])
    edited = file_changes.where("status = 'M'").select("path")
    places = checkpointed(order_facts(*(f.join(edited, "path", "left_semi") for f in files_), *(d.join(edited, "path", "left_semi") for d in found)))
    once = F.lit(1).cast("long")
    only_moved = places.join(differ, "object_key", "left_anti").select("object_key", F.lit("modified").alias("operation"), once.alias("old_parts"), once.alias("new_parts"))
    changed = checkpointed(differ.unionByName(only_moved))
    own = [d.join(changed.select("object_key"), "object_key", "left_semi") for d in found]
    old_changed, new_changed = (d.join(changed.select("object_key"), "object_key", "left_semi") for d in (old, new))
    sides, doubts = [], []
    for d in (old_changed, new_changed):
        rows = d.select("definition", "object_type", replay.with_statements(F.col("fragment"), F.col("context")).alias("fragment"), "trigger_state")
        typed_rows, said = extract.fields_and_diagnostics(rows)
        sides.append(checkpointed(typed_rows.withColumnRenamed("definition", "object_key")))
        doubts.append(said.withColumnRenamed("definition", "object_key"))
    doubt = checkpointed(doubts[0].unionByName(doubts[1]).distinct())
    codes = diagnostics(own[0]).unionByName(diagnostics(own[1])).unionByName(doubt.select("object_key", "code"))
    for side, files, operation in ((own[1], old_files, "added"), (own[0], new_files, "removed")):
        alone = side.join(changed.where(F.col("operation") == operation), "object_key", "left_semi")
        codes = codes.unionByName(alone.join(flawed(files), "path", "left_semi").select("object_key", F.lit("INCOMPLETE_SOURCE_INVENTORY").alias("code")))
    if most_bytes is not None:
        for side in own:
            text = replay.with_statements(F.col("fragment"), F.col("context"))
            codes = codes.unionByName(side.where(F.octet_length(text) > most_bytes).select("object_key", F.lit("MANDATORY_CONTEXT_EXCEEDS_BUDGET").alias("code")))
    said_of = checkpointed(codes.groupBy("object_key").agg(F.array_sort(F.collect_set("code")).alias("diagnostics")))
    both = changed.where("operation = 'modified'").select("object_key")
    columns_only = said_of.where(F.col("diagnostics") == F.array(F.lit(replay.PARTIAL))).join(both, "object_key", "left_semi").select("object_key")
    blocked = checkpointed(said_of.join(columns_only, "object_key", "left_anti"))
    in_doubt = doubt.where(F.col("code") == replay.PARTIAL).join(columns_only, "object_key", "left_semi").select("object_key", "component").distinct()
    sides = [diff.without_unresolved(s, in_doubt) for s in sides]
    known = families.table(changed.sparkSession)
    gates = [d.select("object_key").join(blocked, "object_key", "left") for d in (old_changed, new_changed)]
    typed = diff.facts(*gates, *(s.drop("object_type") for s in sides), known, add_or_remove=families.ADD_OR_REMOVE)
    texts = old_changed.select("object_key", F.col("fragment").alias("b")).join(new_changed.select("object_key", F.col("fragment").alias("a")), "object_key")
    contextual = old_changed.unionByName(new_changed).where("size(context) > 0").select("object_key")
    format_only = texts.where(sqltext.only_white_space_differs(F.col("b"), F.col("a")) & (F.col("a") != F.col("b"))).join(contextual, "object_key", "left_anti").select("object_key")
    typed = checkpointed(diff.format_overrides(typed, format_only))
    silent = diff.text_facts(texts, "object_key", "b", "a").join(typed.select("object_key").distinct(), "object_key", "left_anti")
    silent = silent.join(format_only.withColumn("format_only", F.lit(True)), "object_key", "left").select("object_key", F.when(F.col("format_only"), "common.source.format").otherwise(F.col("family")).alias("family"))
    moves = diff.moved(old_changed, new_changed, "object_key", "path").select("object_key", F.lit("common.source.path").alias("family"), "before", "after")
    text_rows = silent.withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")}).unionByName(moves)
    text_rows = text_rows.unionByName(places.select("object_key", F.lit("common.source.occurrence_order").alias("family"), "before", "after"))
    text_rows = text_rows.join(blocked, "object_key", "left_anti")
    text_rows = text_rows.select(
        "object_key", "family", F.lit("").alias("component"), F.lit("modified").alias("action"), F.when(F.col("family") == "common.source.path", "relocation").when(F.col("family").isin("common.source.format", "common.source.occurrence_order"), "presentation").otherwise("source_text").alias("category"),
        F.lit("present").alias("before_state"), "before", F.lit("present").alias("after_state"), "after", F.lit(False).alias("context_only"),
    )
    facts = checkpointed(typed.unionByName(text_rows).withColumn("fact_id", identity.fact_id(F.col("object_key"), F.col("family"), F.array("component", "action"))))
    kinds = old_changed.select("object_key", "object_type").union(new_changed.select("object_key", "object_type")).distinct()
    said = F.coalesce("diagnostics", F.array().cast("array<string>"))
    has = lambda code: F.array_contains(said, code)
    status = rollup.status_of(has("INCOMPLETE_SOURCE_INVENTORY"), has("CONFLICTING_DEFINITIONS"), has("SECRET_IN_MANDATORY_SOURCE"), has("MANDATORY_CONTEXT_EXCEEDS_BUDGET"))
    status = F.when((status == "ready") & (F.size(said) > 0), "unresolved").otherwise(status)
    operation = F.when(has("INCOMPLETE_SOURCE_INVENTORY"), "unknown").otherwise(F.col("operation"))
    objects = checkpointed(changed.join(kinds, "object_key").join(said_of, "object_key", "left").select("object_key", "object_type", operation.alias("operation"), status.alias("status"), said.alias("diagnostics")))
    edges = graph.edges(new.select("object_key", "object_type", "schema_name", "name", F.col("fragment").alias("source")))
    risk = rollup.object_risk(facts, objects.withColumn("status", F.when(F.col("status") == "ready", "ready").otherwise("unresolved")))
    named = facts.groupBy("object_key").agg(F.array_sort(F.collect_set("family")).alias("families"))
    checks = rollup.recommended_checks(objects, named)
    report = objects.join(risk.drop("object_type"), "object_key").join(named, "object_key", "left").withColumn("pattern", rollup.pattern_label(F.coalesce("families", F.array().cast("array<string>"))))
    return Analysis(file_changes, contexts, objects, facts, edges, risk, checks, report)


def document(spark: SparkSession, a: Analysis, base: str, target: str) -> DataFrame:
    """The report as one JSON row a changed object, values redacted, in the order of risk and name."""
    shown = lambda c: sqltext.redacted(F.col(c)).alias(c)
    listed = a.facts.groupBy("object_key").agg(F.sort_array(F.collect_list(F.struct("family", "component", "action", shown("before"), shown("after")))).alias("facts"))
    rows = a.report.join(listed, "object_key", "left")
    rank = F.array_position(F.array(*[F.lit(x) for x in rollup.LEVELS]), F.col("level"))
    return rows.orderBy(F.desc(rank), "object_key").select(F.to_json(F.struct(F.lit(base).alias("base"), F.lit(target).alias("target"), "object_key", "object_type", "operation", "level", "reason", "pattern", "facts")).alias("value"))
