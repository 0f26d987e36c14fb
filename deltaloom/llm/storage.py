"""Places for tables between stages, in the folder that all executors share; joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many rows are broadcast; more are joined by a shuffle.
SMALL = 500_000
#: Rows of a batch of texts.
BATCH_ROWS = 1_000
#: Keys with more than one in so many of all rows are hot; there are at most so many of them, and they are broadcast.
HOT_KEYS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python ``BATCH_ROWS`` rows at a time from now on, a few megabytes on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that was made by ``new_path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of one computation, in one folder that goes when its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_path(spark, name), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return written(df, name, f"{self.folder}/{self.n}-{name}")

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """The result, written outside the folder, which is deleted."""
        out = written(df, name)
        removed(self.spark, self.folder)
        return out


def sized(df: DataFrame, n: int | None = None) -> DataFrame:
    """The table, to be broadcast if it has at most ``SMALL`` rows (n, or counted)."""
    return F.broadcast(df) if (df.count() if n is None else n) <= SMALL else df


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n_column: str, n_rows: int, least: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row a key and in ``n_column`` how many rows have the key.

    Hot keys, of which there are at most ``HOT_KEYS``, are broadcast; only rows of other keys are shuffled.
    """
    hot = F.col(n_column) > max(least, n_rows // HOT_KEYS)
    many, few = table.where(hot).drop(n_column), table.where(~hot).drop(n_column)
    if many.isEmpty():
        return rows.join(few, keys, "left")
    many = F.broadcast(many)
    return rows.join(many, keys).unionByName(rows.join(many.select(*keys), keys, "left_anti").join(few, keys, "left"))


def spread(rows: DataFrame, table: DataFrame, key: str, table_key: str, other: str, n_rows: int, least: int = 256) -> DataFrame:
    """``rows`` joined with ``table`` on ``key`` = ``table_key``; rows of a hot key are dealt by ``other``.

    Each part of a hot key has about ``least`` rows, or more where there would be over ``HOT_KEYS`` hot
    keys; the table's row of that key is repeated for each part.
    """
    most = max(least, n_rows // HOT_KEYS)
    hot = rows.groupBy(key).count().where(F.col("count") > most).select(F.col(key).alias("hot_key"), F.ceil(F.col("count") / most).cast("int").alias("parts"))
    hot = F.broadcast(hot)
    dealt = rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("hot_key", "parts")
    copies = table.join(hot, F.col(table_key) == F.col("hot_key"), "left").withColumn("part_of", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hot_key", "parts")
    return dealt.join(copies, (F.col(key) == F.col(table_key)) & (F.col("part") == F.col("part_of"))).drop("part", "part_of", table_key)


def id_bounds(ids: DataFrame, range_rows: int, most: int, fewest: int = 1) -> tuple[np.ndarray, int | None, int]:
    """Bounds that cut the rows (one column, an id) to ranges of about ``range_rows`` rows; the least id; and the rows without one.

    A bound is an id, the first of its range; the least id is none.  Beyond ``most`` ranges, ranges
    have more rows; below ``fewest``, they have fewer, though not under 256.  The driver gets some forty ids a range, those whose hash is lowest.
    """
    name = ids.columns[0]
    least, n, known = ids.agg(F.min(name), F.count("*"), F.count(name)).first()
    ranges = min(most, max(known // range_rows + 1, min(fewest, known // 256 + 1)))
    share = 40 * ranges / max(known, 1)
    chosen = ids.where(F.col(name).isNotNull())
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64(name), F.lit(1 << 40)) < int(share * (1 << 40)))
    values = np.sort(chosen.toArrow().column(0).to_numpy()) if known else np.zeros(0, np.int64)
    at = np.arange(1, ranges) * len(values) // ranges
    bounds = np.unique(values[at]) if len(values) else values
    return bounds[bounds > least] if known else bounds, least, n - known


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of some string or binary columns, null as 0."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()[0]


def crc32_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
