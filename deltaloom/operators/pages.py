"""Pages behind cursors that are bound to what was asked, and receipts: a few bounded lookups planned for every changed object."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import identity
from deltaloom.operators import scan

#: Why a cursor is refused.
INVALID, FOREIGN = "CURSOR_INVALID", "CURSOR_FOREIGN"


class Refused(ValueError):
    """A cursor that can't be read, or that belongs to another revision, scope, query or order."""


@dataclass
class Page:
    rows: DataFrame
    next: str | None


def binding(revision: str, scope: str, query: dict) -> str:
    """A digest of what a cursor belongs to."""
    return hashlib.sha256(json.dumps([revision, scope, query], sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def _encoded(after: list[str | None], bound: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"after": after, "bound": bound}, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def _decoded(cursor: str, bound: str, n: int) -> list[str | None]:
    try:
        value = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, UnicodeError, binascii.Error) as error:
        raise Refused(INVALID) from error
    if not isinstance(value, dict) or set(value) != {"after", "bound"} or not isinstance(value["after"], list) or len(value["after"]) != n or not all(x is None or isinstance(x, str) for x in value["after"]):
        raise Refused(INVALID)
    if value["bound"] != bound:
        raise Refused(FOREIGN)
    return value["after"]


def after(order: list[tuple[str, bool]], values: list[Column]) -> Column:
    """Rows behind the given values in an order of (column, descending); nulls come first, or last where descending."""
    either = F.lit(False)
    for k, ((name, descending), value) in enumerate(zip(order, values)):
        column = F.col(name)
        behind = F.when(value.isNull(), F.lit(False)).otherwise(column.isNull() | (column < value)) if descending else F.when(value.isNull(), column.isNotNull()).otherwise(column > value)
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(v) for (n, _), v in zip(order[:k], values[:k])], F.lit(True))
        either = either | (same & F.coalesce(behind, F.lit(False)))
    return either


def bound_page(df: DataFrame, order: list[tuple[str, bool]], size: int, revision: str, scope: str, query: dict, cursor: str | None = None) -> Page:
    """The next ``size`` rows in an order of (column, descending) that no two rows share, and the cursor behind them.

    A cursor holds the last row's place in the order, so rows that come or go before it move no later
    page, and no row before it is sorted; it holds a digest of revision, scope, query and order, and is
    refused for any other.  A page is read whole by the driver: it is as large as was asked.
    """
    bound = binding(revision, scope, {"query": query, "order": [list(o) for o in order]})
    rows = df
    if cursor is not None:
        kinds = dict(df.dtypes)
        values = [F.lit(v).cast(kinds[name]) for (name, _), v in zip(order, _decoded(cursor, bound, len(order)))]
        rows = df.where(after(order, values))
    sort = [F.col(n).desc_nulls_last() if descending else F.col(n).asc_nulls_first() for n, descending in order]
    keys = [F.col(n).cast("string").alias(f"key_{i}") for i, (n, _) in enumerate(order)]
    got = rows.select(F.struct(*df.columns).alias("row"), *keys, *[F.col(n).alias(f"sort_{i}") for i, (n, _) in enumerate(order)])
    sort = [F.col(f"sort_{i}").desc_nulls_last() if descending else F.col(f"sort_{i}").asc_nulls_first() for i, (_, descending) in enumerate(order)]
    got = got.orderBy(*sort).limit(size + 1).select("row", *[f"key_{i}" for i in range(len(order))]).collect()
    page = df.sparkSession.createDataFrame([tuple(r.row) for r in got[:size]], df.schema)
    more = len(got) > size and size > 0
    return Page(page, _encoded([got[size - 1][f"key_{i}"] for i in range(len(order))], bound) if more else None)


#: The lookups of an object, in the order of their calls, and rows of each at most.
TOOLS = ("get_diff", "read_source_base", "read_source_target", "find_references_base", "find_references_target", "get_history")
MOST_LINES, MOST_REFERENCES, MOST_EVENTS = 200, 50, 20


def _capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """(object_key, items, complete): the first ``most`` items of each object, and whether those are all."""
    by = Window.partitionBy("object_key")
    ranked = rows.withColumn("n_", F.row_number().over(by.orderBy(*order))).where(F.col("n_") <= most + 1)
    return ranked.groupBy("object_key").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("n_") <= most, F.struct("n_", "item")))), lambda x: x["item"]).alias("items"), (F.max("n_") <= most).alias("complete"))


def _referenced(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(object_key, path, line_no, line) of lines that have an object's name as a word: one equi-join on words."""
    lines = scan.lines(files)
    words = lines.select("path", "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("line"), F.lit("[A-Z0-9_$#]+"), F.lit(0)))).alias("word"))
    return words.join(symbols, "word").select("object_key", "path", "line_no", "line")


def receipts(objects: DataFrame, old_files: DataFrame, new_files: DataFrame, events: DataFrame, base: str, target: str, scope: str) -> DataFrame:
    """Six lookups at most for every changed object, as one union: what changed, its text and who names it on both sides, its history.

    ``objects`` has object_key, raw_name and, of each side where the object is, a path with first and last line (old_path,
    old_first, old_last, new_path, ...); files have path and text, events path, sha and position.  Rows:
    object_key, call_number, tool_name, revision, scope, arguments (JSON) and their digest, items, complete.
    Each lookup runs once for all objects; its items are capped per object before they are gathered.
    """
    plain = objects.where(F.col("raw_name").rlike(identity.PLAIN_NAME)).select("object_key", F.upper("raw_name").alias("word"))
    path = F.coalesce("old_path", "new_path")
    both = objects.where("old_path IS NOT NULL AND new_path IS NOT NULL")
    digest = lambda files, name: files.select(F.col("path").alias("path_"), F.sha2("text", 256).alias(name))
    met = both.join(digest(old_files, "old_sha"), F.col("old_path") == F.col("path_"), "left").drop("path_").join(digest(new_files, "new_sha"), F.col("old_path") == F.col("path_"), "left").drop("path_")
    status = F.when(F.col("new_sha").isNull(), "D").when(F.col("old_sha") == F.col("new_sha"), "=").otherwise("M")
    difference = met.select("object_key", F.array(F.concat_ws(" ", status, "old_path", "old_sha", "new_sha")).alias("items"), F.lit(True).alias("complete"))

    def source(side: str, files: DataFrame) -> DataFrame:
        asked = objects.where(F.col(f"{side}_path").isNotNull()).select("object_key", F.col(f"{side}_path").alias("path"), F.col(f"{side}_first").alias("first"), F.col(f"{side}_last").alias("last"))
        lines = scan.lines(files.join(asked.select("path").distinct(), "path", "left_semi"))
        inside = lines.join(asked, "path").where(F.col("line_no").between(F.col("first"), F.col("last")))
        return _capped(inside.select("object_key", "line_no", F.col("line").alias("item")), [F.col("line_no")], MOST_LINES)

    def references(files: DataFrame) -> DataFrame:
        item = F.concat_ws(":", "path", F.col("line_no").cast("string"), F.substring("line", 1, 200))
        found = _capped(_referenced(plain, files).select("object_key", "path", "line_no", item.alias("item")), [F.col("path"), F.col("line_no")], MOST_REFERENCES)
        none = plain.select("object_key").distinct().join(found, "object_key", "left")
        return none.select("object_key", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("complete", F.lit(True)).alias("complete"))

    asked = objects.select("object_key", path.alias("path"))
    told = _capped(events.join(asked, "path").select("object_key", "position", F.col("sha").alias("item")), [F.desc("position"), F.col("item")], MOST_EVENTS)
    told = asked.select("object_key").distinct().join(told, "object_key", "left").select("object_key", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("complete", F.lit(True)).alias("complete"))
    parts = [difference, source("old", old_files), source("new", new_files), references(old_files), references(new_files), told]
    revisions = [target, base, target, base, target, target]
    named = [p.select("object_key", F.lit(k).alias("tool"), F.lit(r).alias("revision"), "items", "complete") for k, (p, r) in enumerate(zip(parts, revisions))]
    rows = reduce(lambda a, b: a.unionByName(b), named).join(objects.select("object_key", "raw_name", "old_path", "old_first", "old_last", "new_path", "new_first", "new_last"), "object_key")
    of_side = lambda a, b: F.when(F.col("tool") == 1, F.col(a)).when(F.col("tool") == 2, F.col(b))
    arguments = F.to_json(F.struct(of_side("old_last", "new_last").alias("end_line"), F.when(F.col("tool").isin(0, 5), path).otherwise(of_side("old_path", "new_path")).alias("path"), "revision", of_side("old_first", "new_first").alias("start_line"), F.when(F.col("tool").isin(3, 4), F.col("raw_name")).alias("symbol")))
    tool = F.regexp_replace(F.element_at(F.array(*[F.lit(x) for x in TOOLS]), F.col("tool") + 1), "_(base|target)$", "")
    number = F.row_number().over(Window.partitionBy("object_key").orderBy("tool"))
    return rows.select("object_key", number.alias("call_number"), tool.alias("tool_name"), "revision", F.lit(scope).alias("scope"), arguments.alias("arguments"), F.sha2(arguments, 256).alias("arguments_digest"), "items", "complete")
