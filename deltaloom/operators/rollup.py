"""Aggregations and rule tables of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions import identity

#: Risk levels from least to most.
LEVELS = ["unknown", "low", "medium", "high", "critical"]
#: Families (or their prefixes, ending in a dot) and the risk level of a change in them, first match wins.
RISK_RULES = [
    ("package_spec.routine.signature", "critical"),
    ("sequence.sequence_property.increment_by", "critical"),
    ("sequence.sequence_property.cycle", "critical"),
    ("sequence.sequence_property.cache", "critical"),
    ("table.column.data_type", "high"),
    ("table.column.length", "high"),
    ("table.column.nullable", "high"),
    ("table.constraint.reference", "high"),
    ("common.source.", "low"),
]
#: Family prefixes and the check to prepare before a deployment.
CHECK_RULES = [
    ("table.column.data_type", "COLUMN_COMPATIBILITY_CHECK"),
    ("table.column.length", "COLUMN_COMPATIBILITY_CHECK"),
    ("table.column.precision", "COLUMN_COMPATIBILITY_CHECK"),
    ("table.column.scale", "COLUMN_COMPATIBILITY_CHECK"),
    ("table.constraint.", "CONSTRAINT_DATA_CHECK"),
    ("index.", "INDEX_PLAN_CHECK"),
    ("view.", "CONSUMER_REGRESSION_CHECK"),
    ("package_", "CONSUMER_REGRESSION_CHECK"),
]


def counts_over(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of a column's values: the domain's values with zeros, then other values."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{column} string, rank int")
    found = df.groupBy(column).count()
    return fixed.join(found, column, "full_outer").select(column, F.coalesce("count", F.lit(0)).cast("long").alias("n"), F.coalesce("rank", F.lit(len(domain))).alias("rank"))


def direction(before: Column, after: Column) -> Column:
    """forward, backward or other, for integers of any length."""
    sign = identity.big_integer_sign(before, after)
    return F.when(sign == 1, "forward").when(sign == -1, "backward").otherwise("other")


def multi_counts(df: DataFrame, columns: list[str], measures: list[Column]) -> DataFrame:
    """Counters by each column alone and over all, in one pass (grouping sets)."""
    sets = [[F.col(c)] for c in columns] + [[]]
    grouped = df.groupingSets(sets, *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id().cast("long").alias("grouping"), *measures)


def quality(blocked: Column, limited: Column) -> Column:
    """Aggregate: blocked if any row is, else limited if any is, else complete."""
    return F.when(F.bool_or(blocked), "blocked").when(F.bool_or(limited), "limited").otherwise("complete")


def object_risk(facts: DataFrame, objects: DataFrame, key: str = "object_key", ignore_context: bool = False) -> DataFrame:
    """(key, object_type, level, reason) of each object (key, object_type, operation, status)."""
    if ignore_context:
        facts = facts.where("NOT context_only")
    level = F.lit("medium")
    for family, value in reversed(RISK_RULES):
        level = F.when(F.col("family").startswith(family) if family.endswith(".") else F.col("family") == family, value).otherwise(level)
    kinds = (F.col("family") == "table.constraint.kind") & F.upper(F.concat_ws(" ", "before", "after")).rlike("PRIMARY|FOREIGN|UNIQUE")
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.when(kinds, "critical").otherwise(level))
    worst = facts.groupBy(key).agg(F.max(rank).alias("rank"))
    joined = objects.join(worst, key, "left")
    unknown = (F.col("status") == "unresolved") | F.col("operation").isin("removed", "unknown", "relocated")
    rank = F.when(unknown, 1).otherwise(F.coalesce("rank", F.when(F.col("operation").isin("added", "modified"), 3).otherwise(1)))
    name = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank.cast("int"))
    return joined.select(key, "object_type", name.alias("level"), F.when(unknown, "removed_or_unresolved_object").when(name == "unknown", "insufficient_context").otherwise(F.concat(name, F.lit("_source_rule"))).alias("reason"))


def overall_risk(levels: DataFrame, edges: Column) -> DataFrame:
    """One row: the highest level, raised by one step at most where there are many edges; never to critical."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    base = levels.agg(F.coalesce(F.max(rank), F.lit(1)).alias("r"), F.max(edges).alias("edges"))
    raised = F.when((F.col("r") == 2) & (F.col("edges") >= 2), 3).when((F.col("r") == 3) & (F.col("edges") >= 4), 4).otherwise(F.col("r"))
    return base.select(F.element_at(F.array(*[F.lit(x) for x in LEVELS]), raised.cast("int")).alias("level"), "edges")


def risk_basis(levels: DataFrame) -> DataFrame:
    """Distinct object types of each level, sorted, as text."""
    return levels.groupBy("level").agg(F.array_join(F.array_sort(F.collect_set("object_type")), ",").alias("types"))


def deployment_checks(facts: DataFrame, limit: int = 200) -> DataFrame:
    """(object_key, family, component, code) of facts that call for a check, the first ``limit`` in order."""
    code = F.when((F.col("family") == "table.column.nullable") & (F.col("after") == "NOT NULL"), "NULL_DATA_CHECK")
    for prefix, value in CHECK_RULES:
        code = code.when(F.col("family").startswith(prefix), value)
    return facts.select("object_key", "family", "component", code.alias("code")).where("code IS NOT NULL").orderBy("object_key", "family", "component").limit(limit)


def recommended_checks(objects: DataFrame, families: DataFrame, most: int = 6) -> DataFrame:
    """(object_key, rank, code): at most six distinct prompts by type, operation and changed families.

    ``families`` has (object_key, families): the sorted set of the object's changed families.
    """
    rows = objects.join(families, "object_key", "left")
    has = lambda prefix: F.coalesce(F.exists("families", lambda x: x.startswith(prefix)), F.lit(False))
    kind, op = F.col("object_type"), F.col("operation")
    table = kind == "TABLE"
    package = kind.isin("PACKAGE_SPEC", "PACKAGE_BODY")
    known = table | package | kind.isin("INDEX", "VIEW", "SEQUENCE")
    rules = [
        (op.isin("added", "removed"), "SOURCE_REFERENCES"),
        (table & ((op == "modified") | has("table.column.")), "COLUMN_CONTRACT"),
        (table & has("table.constraint."), "CONSTRAINT_REFERENCES"),
        (table & has("table.table_property."), "MANUAL_SOURCE_REVIEW"),
        (kind == "INDEX", "INDEX_DEFINITION"),
        (kind == "VIEW", "QUERY_DEFINITION"),
        (package, "CALL_SIGNATURE"),
        (package & has("package_body.body_property.dynamic_sql_profile"), "DYNAMIC_SQL_REVIEW"),
        (kind == "SEQUENCE", "SEQUENCE_DEFINITION"),
        (~known, "MANUAL_SOURCE_REVIEW"),
    ]
    codes = F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))), 1, most)
    return rows.select("object_key", F.posexplode(codes).alias("rank", "code"))


def pattern_label(families: Column) -> Column:
    """A technical pattern where one family alone changed; else structured, text or unknown. ``families``: a set."""
    one = F.size(families) == 1
    return (
        F.when(F.size(families) == 0, "unknown")
        .when(one & F.array_contains(families, "sequence.sequence_property.start_with"), "start_value_only")
        .when(one & F.array_contains(families, "common.source.format"), "format_only")
        .when(one & F.array_contains(families, "common.source.path"), "moved_only")
        .when(F.forall(families, lambda x: x.startswith("common.source.")), "text")
        .otherwise("structured")
    )


def coverage(resolved: Column, limited: Column) -> Column:
    return F.when(~resolved, "unresolved").when(limited, "limited").otherwise("verified")


def status_of(scope_incomplete: Column, conflict: Column, secret: Column, too_large: Column) -> Column:
    """Why an object isn't analysed, first reason first."""
    return F.when(scope_incomplete, "INCOMPLETE_SOURCE_INVENTORY").when(conflict, "CONFLICTING_DEFINITIONS").when(secret, "SECRET_IN_MANDATORY_SOURCE").when(too_large, "MANDATORY_CONTEXT_EXCEEDS_BUDGET").otherwise("ready")


def levels_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(LEVELS)], "level string, rank int")
