"""Content-addressed results, resuming, retention and hash-chained journals, as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import ranking


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the folder in spark.checkpoint.dir and read again; where it is unset, to a new one, on a single machine only."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remaining(units: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Units without a result of the same digest."""
    return units.join(done.select(*on).distinct(), on, "left_anti")


def expired(df: DataFrame, at: str, protected: DataFrame, key: str, days: int) -> DataFrame:
    """Rows older than so many days before the newest, less the protected ones."""
    newest = df.agg(F.max(at).alias("newest"))  # one row
    old = df.join(F.broadcast(newest), F.col(at) < F.col("newest") - F.expr(f"INTERVAL {days} DAYS")).drop("newest")
    return old.join(protected.select(key), key, "left_anti")


def upserted(cache: DataFrame | None, results: DataFrame, key: str) -> DataFrame:
    """Results that the cache lacks, to be appended; a key is kept once."""
    new = results.dropDuplicates([key])
    return new if cache is None else new.join(cache.select(key), key, "left_anti")


def through_cache(spark: SparkSession, path: str, inputs: DataFrame, compute, key: str, version: str) -> DataFrame:
    """Results of ``compute`` for all inputs by content key and version; only keys not stored yet are computed."""
    unique = inputs.dropDuplicates([key])
    try:
        stored = spark.read.parquet(path).where(F.col("version") == version)
    except Exception as error:  # the first run has no cache
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = None
    todo = unique if stored is None else unique.join(stored.select(key), key, "left_anti")
    compute(todo).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    done = spark.read.parquet(path).where(F.col("version") == version).drop("version")
    return done.join(inputs.select(key).distinct(), key, "left_semi")


def chained(rows: DataFrame, scope: str, sequence: str, content: str) -> DataFrame:
    """Journal rows with record_sha256 over sequence and content, and the one before as previous_record_sha256."""
    from pyspark.sql import Window

    digest = F.sha2(F.concat_ws("|", F.col(scope).cast("string"), F.col(sequence).cast("string"), F.col(content)), 256)
    rows = rows.withColumn("record_sha256", digest)
    return rows.withColumn("previous_record_sha256", F.lag("record_sha256").over(Window.partitionBy(scope).orderBy(sequence)))


def journal_breaks(journal: DataFrame, scope: str, sequence: str, content: str) -> DataFrame:
    """Journal rows with a gap, a wrong digest or a wrong previous digest."""
    links = ranking.chain_breaks(journal, [scope], sequence, "record_sha256", "previous_record_sha256").select(*journal.columns)
    digest = F.sha2(F.concat_ws("|", F.col(scope).cast("string"), F.col(sequence).cast("string"), F.col(content)), 256)
    return links.union(journal.where(F.col("record_sha256") != digest)).distinct()


def applied(spark: SparkSession, path: str, plan: DataFrame, protected: DataFrame, key: str, at: str, days: int, partition: str, now=None) -> DataFrame:
    """Delete the rows of a partitioned table that a plan names, if they may still go; the plan's rows with removed.

    ``plan`` has the key, and bytes if sizes were planned.  A row that has become protected since, is young again, isn't
    there any more or has another size stays.  Only partitions that lose rows are written anew, beside the table, and then put in place one
    by one; a row leaves with its partition, so a crash leaves each partition old or new, and the plan can be applied again.
    """
    stored = spark.read.parquet(path)
    newest = F.lit(now) if now is not None else F.lit(stored.agg(F.max(at)).first()[0])
    old = F.col(at) < newest - F.expr(f"INTERVAL {days} DAYS")
    due = plan.select(key, *([F.col("bytes").alias("planned_bytes")] if "bytes" in plan.columns else []))
    goes = stored.join(due, key).where(old).join(protected.select(key), key, "left_anti")
    if "bytes" in plan.columns:
        goes = goes.where("bytes <=> planned_bytes").drop("planned_bytes")
    goes = checkpointed(goes.select(key, partition).distinct())
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}.kept-{uuid.uuid4().hex}"
    touched = [r[0] for r in goes.select(partition).distinct().collect()]  # names of partitions
    if touched:
        kept = stored.join(goes.select(partition).distinct(), partition, "left_semi").join(goes.select(key), key, "left_anti")
        kept.write.partitionBy(partition).parquet(aside)
    for value in touched:
        name = f"{partition}={value}"
        new, own, before = jvm(f"{aside}/{name}"), jvm(f"{path.rstrip('/')}/{name}"), jvm(f"{path.rstrip('/')}/_{name}.old")
        system.rename(own, before)
        if system.exists(new):
            system.rename(new, own)
        system.delete(before, True)
    system.delete(jvm(aside), True)
    return plan.join(goes.select(key).withColumn("removed", F.lit(True)), key, "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
