"""Snapshots from folders and ZIP corpora, and file sinks that are replaced as a whole."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = "archive string, member string, size long, raw binary, problem string"
MEMBER_BYTES, MEMBERS = 64 << 20, 100_000


def folder(spark: SparkSession, path: str, pattern: str = "*.sql") -> DataFrame:
    """(path, oid, size, raw) of the files below a folder; oid is git's blob id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    head = F.concat(F.lit("blob "), F.col("length").cast("string")).cast("binary")
    oid = F.sha1(F.concat(head, F.unhex(F.lit("00")), F.col("content")))
    return files.select(F.col("path"), oid.alias("oid"), F.col("length").alias("size"), F.col("content").alias("raw"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            with zipfile.ZipFile(io.BytesIO(content.as_buffer().to_pybytes())) as archive:
                for n, info in enumerate(archive.infolist()):
                    if info.is_dir():
                        continue
                    name = info.filename.replace("\\", "/")
                    unsafe = name.startswith("/") or ".." in name.split("/") or ":" in name.split("/")[0]
                    problem = "UNSAFE_PATH" if unsafe else "TOO_LARGE" if info.file_size > MEMBER_BYTES else "TOO_MANY" if n >= MEMBERS else None
                    raw = None if problem else archive.read(info)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([info.file_size], pa.int64()), pa.array([raw], pa.binary()), pa.array([problem], pa.string())], names=["archive", "member", "size", "raw", "problem"])


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, raw, problem) of ZIP files; members that break a rule have a problem and no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_members, MEMBER)


def verified(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Members (archive, member) whose size or hash isn't that of the manifest, or that only one side has."""
    now = members.select("archive", "member", F.col("size").alias("now_size"), F.sha2("raw", 256).alias("now_sha256"))
    joined = manifest.join(now, ["archive", "member"], "full_outer")
    return joined.where(~F.col("size").eqNullSafe(F.col("now_size")) | ~F.col("sha256").eqNullSafe(F.col("now_sha256")))


def replaced(df: DataFrame, path: str, format: str = "json") -> None:
    """Write to a folder beside, move the old rows away and the new ones into place, and delete the old.

    Between the two renames readers find no folder; after a crash there, ``restored`` brings the old rows
    back.  Where readers must always find a whole version, use ``state.publish``.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    restored(spark, path)
    df.write.mode("overwrite").format(format).save(f"{path}.new")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(jvm(path)) and not system.rename(jvm(path), jvm(f"{path}.old")):
        raise OSError(f"{path} was not moved")
    if not system.rename(jvm(f"{path}.new"), jvm(path)):
        raise OSError(f"{path}.new was not moved to {path}")
    system.delete(jvm(f"{path}.old"), True)


def restored(spark: SparkSession, path: str) -> None:
    """Bring back what a crash of ``replaced`` left moved away, or delete what it left behind."""
    path = path.rstrip("/")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(jvm(f"{path}.old")):
        if system.exists(jvm(path)):
            system.delete(jvm(f"{path}.old"), True)
        elif not system.rename(jvm(f"{path}.old"), jvm(path)):
            raise OSError(f"{path}.old was not moved to {path}")


def archived_report(report: DataFrame, root: str) -> None:
    """Append report rows (year, day, repo, branch, range_id, digest, content), partitioned; equal rows are kept once.

    A row of a known range with another digest is refused: the archive is immutable.
    """
    spark = report.sparkSession
    keys = ["year", "day", "repo", "branch", "range_id"]
    try:
        stored = spark.read.schema(report.schema).parquet(root).select(*keys, F.col("digest").alias("stored"))
        clash = report.join(stored, keys).where("digest <> stored").limit(1).count()
        if clash:
            raise ValueError("the archive has another report for this range")
        report = report.join(stored, keys, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    report.write.mode("append").partitionBy("year", "day", "repo", "branch").parquet(root)


def found_report(spark: SparkSession, root: str, day: str, repo: str, branch: str, digest: str) -> DataFrame:
    """The archived report of a day, repository, branch and digest; partitions are pruned first."""
    rows = spark.read.parquet(root).where((F.col("day") == day) & (F.col("repo") == repo) & (F.col("branch") == branch))
    return rows.where(F.col("digest") == digest).orderBy("range_id").limit(1)
