"""Connected components of an edge table, by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import storage


def components(edges: DataFrame, a: str = "a", b: str = "b", written: Callable[[DataFrame, str], DataFrame] = storage.written) -> DataFrame:
    """(node, comp) for every node of the edges; comp is the smallest node that edges lead to.

    Each round takes the least label of the neighbours and then the label of that label, so that
    paths shorten by more than half; labels are written after each round.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).union(edges.select(F.col(b).alias("node"), F.col(a).alias("next")))
    both = written(both.distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("next"), F.col("comp").alias("near")), "next").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = lower.join(jump, "comp").select("node", F.least("comp", "far").alias("comp"), (F.least("comp", "far") != F.col("old")).alias("changed"))
        after = written(after, "labels")
        labels = after.select("node", "comp")
        if not after.where("changed").limit(1).count():
            return labels
