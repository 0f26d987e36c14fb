"""Integrity rules: each gives the rows that break it, so a valid report gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("subject"))


def dangling(references: DataFrame, registry: DataFrame, on: list[str], rule: str, subject: Column) -> DataFrame:
    """References without a row in the registry (null keys are dangling)."""
    return references.join(registry.select(*on).distinct(), on, "left_anti").select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))


def broken(df: DataFrame, holds: Column, rule: str, subject: Column) -> DataFrame:
    """Rows for which a condition isn't true."""
    return df.where(~F.coalesce(holds, F.lit(False))).select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))


def not_subset(df: DataFrame, part: str, whole: str, rule: str, subject: Column) -> DataFrame:
    """Rows whose list ``part`` has members that ``whole`` lacks."""
    return broken(df, F.size(F.array_except(part, whole)) == 0, rule, subject)


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_violations(evidence: DataFrame, objects: DataFrame, facts: DataFrame, families: DataFrame) -> DataFrame:
    """All rules over a report's tables.

    evidence: evidence_id, object_key, start_line, end_line, start_byte, end_byte_exclusive;
    objects: object_key, object_type; facts: fact_id, object_key, family, action, evidence_ids;
    families: family, object_type, action.
    """
    used = facts.select("fact_id", "object_key", F.explode("evidence_ids").alias("evidence_id"))
    typed = facts.join(objects, "object_key")
    return violations(
        duplicates(evidence, "evidence_id", "V1"),
        duplicates(objects, "object_key", "V2"),
        dangling(used, evidence, ["evidence_id", "object_key"], "V3", F.col("fact_id")),
        dangling(typed, families, ["family", "object_type", "action"], "V4", F.col("fact_id")),
        dangling(facts, objects, ["object_key"], "V5", F.col("fact_id")),
        broken(evidence, (F.col("start_line") <= F.col("end_line")) & (F.col("start_byte") <= F.col("end_byte_exclusive")), "V8", F.col("evidence_id")),
    )


def response_violations(units: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that name no unit, another digest, or evidence that the unit didn't give."""
    joined = responses.join(units.select("unit_id", F.col("digest").alias("unit_digest"), F.col("evidence_ids").alias("unit_evidence")), "unit_id", "left")
    return violations(
        broken(joined, F.col("unit_digest").isNotNull(), "V7_UNIT", F.col("unit_id")),
        broken(joined.where("unit_digest IS NOT NULL"), F.col("digest") == F.col("unit_digest"), "V7_DIGEST", F.col("unit_id")),
        broken(joined.where("unit_digest IS NOT NULL"), F.size(F.array_except("evidence_ids", "unit_evidence")) == 0, "V7_EVIDENCE", F.col("unit_id")),
    )


def run_violations(runs: DataFrame) -> DataFrame:
    """Runs whose counts don't add up, whose times aren't in order, or that are blocked and yet eligible for a commit."""
    counts = F.col("analyzed_objects") + F.col("limited_objects") + F.col("unresolved_objects") == F.col("history_known_objects")
    times = (F.col("planned_at") <= F.col("analysis_started_at")) & (F.col("analysis_started_at") <= F.col("analysis_completed_at"))
    return violations(
        broken(runs, times, "V6_TIMES", F.col("run_id")),
        broken(runs, counts, "V6_COUNTS", F.col("run_id")),
        broken(runs, ~((F.col("quality") == "blocked") & F.col("automatic_commit_eligible")), "V6_COMMIT", F.col("run_id")),
    )


def side_violations(facts: DataFrame, objects: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts whose evidence isn't their object's, or is of the other snapshot.

    facts: fact_id, object_key, before_ids, after_ids (lists); objects: object_key, evidence_ids; registry: evidence_id, side (base,
    target or both).  Every list is met by an equi-join on its ids, so a registry of any size is shuffled once.
    """
    sides = facts.select("fact_id", "object_key", F.explode(F.array(F.struct(F.lit("base").alias("expected"), F.col("before_ids").alias("ids")), F.struct(F.lit("target").alias("expected"), F.col("after_ids").alias("ids")))).alias("s"))
    used = sides.select("fact_id", "object_key", "s.expected", F.explode("s.ids").alias("evidence_id"))
    own = objects.select("object_key", F.explode("evidence_ids").alias("evidence_id")).distinct()
    met = used.join(registry.select("evidence_id", "side"), "evidence_id", "left")
    return violations(
        dangling(used, own, ["object_key", "evidence_id"], "V5_OWNER", F.col("fact_id")).distinct(),
        broken(met, F.col("side").isin("both") | (F.col("side") == F.col("expected")), "V5_SIDE", F.col("fact_id")).distinct(),
    )
