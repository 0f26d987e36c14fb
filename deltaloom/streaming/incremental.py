"""Incremental runs: new commits or files are taken as a stream that ends when all are processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import scan


def available_now(spark: SparkSession, source: str, schema: str, checkpoint: str, apply, format: str = "parquet") -> None:
    """Give each batch of new files in ``source`` to ``apply(batch, id)`` once; Spark's checkpoint holds what was taken."""
    stream = spark.readStream.schema(schema).format(format).load(source)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def scanned_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Append the definitions of new file rows (path, raw) to a table, each batch under its number, so a repeated batch replaces itself."""

    def apply(batch: DataFrame, number: int) -> None:
        found = scan.occurrences(scan.decoded(batch)).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    available_now(spark, source, "path string, raw binary", checkpoint, apply)
