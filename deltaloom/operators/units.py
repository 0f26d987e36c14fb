"""Inputs for reviews of changed objects, and the shaping of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import sqltext


def unit_inputs(facts: DataFrame, evidence: DataFrame, most_facts: int = 200, most_evidence: int = 128) -> DataFrame:
    """(object_key, facts, evidence, digest): verified facts, and the evidence that they use and the object owns.

    Values with secrets are replaced; the digest is over canonical JSON.
    """
    numbered = facts.where("verification = 'verified'").withColumn("n", F.row_number().over(Window.partitionBy("object_key").orderBy("family", "component", "fact_id"))).where(F.col("n") <= most_facts)
    shown = lambda c: F.when(sqltext.secret_index(F.col(c)).isNotNull(), "(redacted)").otherwise(F.col(c)).alias(c)
    listed = numbered.groupBy("object_key").agg(F.sort_array(F.collect_list(F.struct("n", "fact_id", "family", "component", "action", shown("before"), shown("after")))).alias("facts"))
    used = numbered.select("object_key", F.explode("evidence_ids").alias("evidence_id")).distinct()
    owned = evidence.join(used, ["object_key", "evidence_id"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("object_key").orderBy("evidence_id"))).where(F.col("n") <= most_evidence)
    shown_evidence = owned.groupBy("object_key").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence"))
    joined = listed.join(shown_evidence, "object_key", "left")
    return joined.withColumn("digest", F.sha2(F.to_json(F.struct("evidence", "facts", "object_key"), {"ignoreNullFields": "false"}), 256))


def provable(comments: DataFrame, facts: DataFrame) -> DataFrame:
    """Comments that say exactly what the one fact they cite says."""
    text = F.concat_ws(" ", "family", F.nullif("component", F.lit("")), "action", F.concat(F.lit("from "), "before"), F.concat(F.lit("to "), "after"))
    return comments.join(facts.select("fact_id", text.alias("proof")), "fact_id").where("comment = proof").drop("proof")


def comment_rows(explanations: DataFrame, findings: DataFrame, most: int = 6) -> DataFrame:
    """Explanations, then findings, of each unit: the first six."""
    both = explanations.withColumn("kind", F.lit(0)).unionByName(findings.withColumn("kind", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("unit_id").orderBy("kind", "n"))).where(F.col("rank") <= most)


def aggregate_input(objects: DataFrame, threshold: int = 40, listed: int = 10) -> DataFrame | None:
    """Counts by type and operation and the first objects by priority, or nothing up to the threshold."""
    if objects.limit(threshold + 1).count() <= threshold:
        return None
    counts = objects.groupBy("object_type", "operation").agg(F.count("*").alias("n"))
    first = objects.orderBy("priority", "name").limit(listed)
    return counts.withColumn("what", F.lit("count")).select("what", "object_type", "operation", F.col("n").cast("string").alias("value")).unionByName(
        first.select(F.lit("object").alias("what"), "object_type", "operation", F.col("name").alias("value"))
    )


def rubric(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, passed): a finding is there as expected, uses the target evidence, and isn't graver than allowed."""
    seen = findings.groupBy("case_id").agg(F.lit(True).alias("found"), F.flatten(F.collect_list("evidence_ids")).alias("used"), F.max("severity").alias("severity"))
    joined = cases.join(seen, "case_id", "left")
    found = F.coalesce("found", F.lit(False))
    right = ~found | (F.array_contains("used", F.col("target_evidence")) & (F.col("severity") <= F.col("max_severity")))
    return joined.select("case_id", ((found == F.col("expect_finding")) & F.coalesce(right, F.lit(False))).alias("passed"))


def evidence_ids(documents: DataFrame, key: str = "unit_id") -> DataFrame:
    """(key, evidence_id): the distinct ids that review inputs name, in the registry, on both sides of facts, in receipts and in their items.

    ``documents`` has evidence_registry (structs with evidence_id), facts (structs with before.evidence_ids and after.evidence_ids)
    and research_receipts (structs with evidence_ids and items with evidence_id).
    """
    none = F.array().cast("array<string>")
    lists = [
        F.transform("evidence_registry", lambda e: e["evidence_id"]),
        F.flatten(F.transform("facts", lambda f: F.coalesce(f["before"]["evidence_ids"], none))),
        F.flatten(F.transform("facts", lambda f: F.coalesce(f["after"]["evidence_ids"], none))),
        F.flatten(F.transform("research_receipts", lambda r: F.coalesce(r["evidence_ids"], none))),
        F.flatten(F.transform("research_receipts", lambda r: F.coalesce(F.transform(r["items"], lambda i: i["evidence_id"]), none))),
    ]
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, none) for x in lists])))
    return documents.select(key, F.explode(every).alias("evidence_id")).where("evidence_id IS NOT NULL").distinct()
