"""Git repositories as Spark data sources: trees, blobs and commits, read from a local clone.

Register with ``register(spark)``; then ``spark.read.format("git_tree").option("repo", path)
.option("revision", sha).load()``.  Blobs are read in parallel: object ids are dealt to partitions
and each partition runs one batch process.
"""

from __future__ import annotations

import base64
import os
import subprocess
import threading
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TREE = "revision string, mode string, kind string, oid string, path binary, path_b64 string, path_display string"
COMMITS = "sha string, parents array<string>, author_at timestamp, committer_at timestamp, position int, subject string"
CHANGES = "sha string, parent string, position int, old_mode string, new_mode string, old_oid string, new_oid string, status string, path_b64 string, path_display string"
BLOB = "oid string, size long, raw binary"
#: At most so many bytes of a blob are read; larger ones have raw null.
BLOB_BYTES = 64 << 20


def records(repo: str, *args: str, end: bytes) -> Iterator[bytes]:
    """What a git command prints, read as a stream and cut at a separator."""
    process = subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE)
    rest = b""
    try:
        while chunk := process.stdout.read(1 << 20):
            *whole, rest = (rest + chunk).split(end)
            yield from whole
        if rest.strip():
            yield rest
    finally:
        process.stdout.close()
        code = process.wait()
    if code:
        raise subprocess.CalledProcessError(code, ["git", *args])


class Subtree(InputPartition):
    """A folder at the top of a tree, or (None) the files there."""

    def __init__(self, path: bytes | None):
        self.path = path


class TreeReader(DataSourceReader):
    """One partition a folder at the top of the tree, and one for the files beside them."""

    def __init__(self, options: dict):
        self.repo, self.revision = options["repo"], options.get("revision", "HEAD")

    def partitions(self) -> list[InputPartition]:
        top = [x.split(b"\t", 1) for x in records(self.repo, "ls-tree", "-z", "--full-tree", self.revision, end=b"\0") if x]
        return [Subtree(None), *[Subtree(path) for head, path in top if head.split()[1] == b"tree"]]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        """One row an entry; paths are bytes."""
        inside = [] if partition.path is None else ["-r", f"{self.revision}:{os.fsdecode(partition.path)}"]
        for entry in records(self.repo, "ls-tree", "-z", "--full-tree", *(inside or [self.revision]), end=b"\0"):
            if not entry:
                continue
            head, path = entry.split(b"\t", 1)
            mode, kind, oid = head.decode().split()
            if partition.path is None and kind == "tree":
                continue
            if partition.path is not None:
                path = partition.path + b"/" + path
            yield self.revision, mode, kind, oid, path, base64.b64encode(path).decode(), path.decode("utf-8", "backslashreplace")


class CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.revision, self.most = options["repo"], options.get("revision", "HEAD"), options.get("maximum")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Commits reachable from the revision, oldest first; with a ``maximum``, the newest, one more than that at most."""
        bound = [f"--max-count={int(self.most) + 1}"] if self.most else []
        shown = records(self.repo, "log", "--topo-order", "--reverse", *bound, "--format=%H%x1f%P%x1f%aI%x1f%cI%x1f%s%x1e", self.revision, end=b"\x1e")
        rows = (r.decode("utf-8", "replace").strip("\n").split("\x1f") for r in shown if r.strip())
        for position, (sha, parents, author, committer, subject) in enumerate(rows):
            yield sha, parents.split(), datetime.fromisoformat(author), datetime.fromisoformat(committer), position, subject[:500]


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return COMMITS

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitTree)
    spark.dataSource.register(GitCommits)


def tree(spark: SparkSession, repo: str, revision: str) -> DataFrame:
    return spark.read.format("git_tree").option("repo", repo).option("revision", revision).load()


def commits(spark: SparkSession, repo: str, revision: str, maximum: int | None = 250) -> DataFrame:
    """Commits of a history, all of them if ``maximum`` is None."""
    reader = spark.read.format("git_commits").option("repo", repo).option("revision", revision)
    return (reader if maximum is None else reader.option("maximum", str(maximum))).load()


def _blobs(batches: Iterator[pa.RecordBatch], repo: str, most: int) -> Iterator[pa.RecordBatch]:
    """One ``cat-file`` process a partition; sizes are checked before contents are kept."""
    process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    try:
        for batch in batches:
            for oid in batch.column(0).to_pylist():
                process.stdin.write(oid.encode() + b"\n")
                process.stdin.flush()
                head = process.stdout.readline().split()
                if len(head) != 3 or head[1] != b"blob":
                    raise ValueError(f"no blob {oid}")
                size = int(head[2])
                content = process.stdout.read(size)
                if len(content) != size or process.stdout.read(1) != b"\n":
                    raise ValueError(f"blob {oid} was cut short")
                yield pa.RecordBatch.from_arrays([pa.array([oid]), pa.array([size], pa.int64()), pa.array([content if size <= most else None], pa.binary())], names=["oid", "size", "raw"])
    finally:
        process.stdin.close()
        process.wait()


def blobs(oids: DataFrame, repo: str, partitions: int = 8, most: int = BLOB_BYTES) -> DataFrame:
    """(oid, size, raw) of the distinct object ids; the clone must be reachable from the executors."""
    unique = oids.select("oid").distinct().repartition(partitions, "oid")
    return unique.mapInArrow(lambda batches: _blobs(batches, repo, most), BLOB)


def _changes(batches: Iterator[pa.RecordBatch], repo: str) -> Iterator[pa.RecordBatch]:
    """Rows (sha, parent) to the files that each commit changed: one ``diff-tree`` process a batch of commits, read as a stream."""
    columns = [c.split()[0] for c in CHANGES.split(", ")]
    kinds = [pa.int32() if c == "position" else pa.string() for c in columns]
    for batch in batches:
        parent_of = dict(zip(*(c.to_pylist() for c in batch.columns)))
        process = subprocess.Popen(["git", "-C", repo, "diff-tree", "--stdin", "--always", "-r", "-z", "--raw", "--root", "--full-index", "--no-renames"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        asked = "".join(f"{sha} {parent}\n" if parent else f"{sha}\n" for sha, parent in parent_of.items()).encode()

        def ask(process=process, asked=asked) -> None:
            process.stdin.write(asked)
            process.stdin.close()

        asking = threading.Thread(target=ask)
        asking.start()
        rows, sha, position, head, rest, seen = [], None, 0, None, b"", 0
        while chunk := process.stdout.read(1 << 16):
            *whole, rest = (rest + chunk).split(b"\0")
            for field in whole:
                if head is not None:
                    old_mode, new_mode, old, new, status = head.lstrip(b":").decode().split()
                    rows.append((sha, parent_of[sha], position, old_mode, new_mode, old, new, status[0], base64.b64encode(field).decode(), field.decode("utf-8", "backslashreplace")))
                    head, position = None, position + 1
                elif field.startswith(b":"):
                    head = field
                else:
                    sha, position, seen = field.decode().strip(), 0, seen + 1
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)
                rows = []
        asking.join()
        process.stdout.close()
        if process.wait() or seen != len(parent_of):
            raise ValueError(f"{len(parent_of) - seen} of {len(parent_of)} commits were not compared")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)


def changes(commits_: DataFrame, repo: str, partitions: int = 8) -> DataFrame:
    """The files that each commit (sha, parents) changed against its first parent, or, without one, brought in; no renames.

    Commits are dealt to partitions; position is a file's place in its commit.  The clone must be reachable from the executors.
    """
    pairs = commits_.select("sha", F.get("parents", F.lit(0)).alias("parent")).distinct().repartition(partitions, "sha")
    return pairs.mapInArrow(lambda batches: _changes(batches, repo), CHANGES)


def snapshot(spark: SparkSession, repo: str, revision: str, scope: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Files (revision, path, path_b64, oid, raw) of a revision: scope, mode and kind are filtered before any blob is read.

    ``only`` (path_b64) prunes to changed paths.
    """
    from deltaloom.plans.history import in_scope

    entries = tree(spark, repo, revision).where("kind = 'blob' AND mode NOT IN ('120000', '160000')").withColumn("path_text", F.col("path_display"))
    entries = in_scope(entries, scope or [], "path_text")
    if only is not None:
        entries = entries.join(only.select("path_b64").distinct(), "path_b64", "left_semi")
    return entries.join(blobs(entries, repo), "oid").select("revision", F.col("path_display").alias("path"), "path_b64", "oid", "size", "raw")


def raw_delta(raw: bytes) -> list[tuple]:
    """Rows of ``git diff --raw -z`` output: old mode, new mode, old oid, new oid, status, path, second path or None."""
    fields = raw.split(b"\0")
    rows, at = [], 0
    while at < len(fields) and fields[at]:
        old_mode, new_mode, old, new, status = fields[at].lstrip(b":").decode().split()
        pair = status[0] in "RC"
        rows.append((old_mode, new_mode, old, new, status[0], fields[at + 1], fields[at + 2] if pair else None))
        at += 3 if pair else 2
    return rows
