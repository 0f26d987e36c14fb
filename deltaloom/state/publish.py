"""Results that readers see whole or not at all: staged tables, a manifest of digests, one pointer, then the checkpoint.

A version is a folder of tables.  It is staged, its files are listed with their sizes and SHA-256 (one row a
file, hashed where Spark reads them), and then one small pointer file of the next generation is made,
which fails if another writer has made it.  Readers take the newest whole pointer and hold the files
against the manifest by a full join.  A run's checkpoint moves last, and only to what its pointer names.
A crash anywhere leaves the old version current, or the new one whole; ``recovered`` finishes the rest.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.state.store import Conflict, Store

MANIFEST = "file string, bytes long, sha256 string"
#: What can be wrong with a published file.
MISSING, EXTRA, SIZE, HASH = "ARTIFACT_FILE_MISSING", "ARTIFACT_FILE_EXTRA", "ARTIFACT_SIZE_MISMATCH", "ARTIFACT_HASH_MISMATCH"


class Broken(Exception):
    """A published version isn't what its manifest says."""


@dataclass(frozen=True)
class Pointer:
    """What is current: generation, version, the run that made it, its target, its quality, and the manifest's digest."""

    generation: int
    version: str
    run: str | None
    target: str | None
    quality: str
    tables: dict[str, str]
    manifest_sha256: str

    def text(self) -> str:
        body = json.dumps(self.__dict__, sort_keys=True, separators=(",", ":"))
        return f"{hashlib.sha256(body.encode()).hexdigest()} {body}\n"

    @classmethod
    def parse(cls, text: str) -> Pointer | None:
        """None for a pointer that was not written to its end."""
        digest, _, body = text.rstrip("\n").partition(" ")
        if hashlib.sha256(body.encode()).hexdigest() != digest:
            return None
        return cls(**json.loads(body))


class _Folder:
    """A folder that all executors and the driver share, by Spark's own file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        at = self.path(f"{self.root}/{below}")
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def created(self, name: str, text: str) -> bool:
        """Make a file; False if there is one."""
        at = self.path(f"{self.root}/{name}")
        if self.system.exists(at):
            return False
        try:
            out = self.system.create(at, False)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        return "".join(r.value for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())  # one small file

    def deleted(self, name: str) -> None:
        self.system.delete(self.path(f"{self.root}/{name}"), True)


def pointers(spark: SparkSession, root: str) -> list[Pointer]:
    """The whole pointers, oldest first; those that a crash cut off are left out."""
    folder = _Folder(spark, root)
    found = [Pointer.parse(folder.text(f"pointers/{n}")) for n in folder.names("pointers") if not n.startswith((".", "_"))]
    return [p for p in found if p]


def current(spark: SparkSession, root: str) -> Pointer | None:
    found = pointers(spark, root)
    return found[-1] if found else None


def _taken(folder: _Folder) -> int:
    """The last generation that a pointer file has, whole or not."""
    return max((int(n) for n in folder.names("pointers") if n.isdigit()), default=0)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the data files below a folder, by their place in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.select(place.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def staged(outputs: dict[str, DataFrame], root: str, version: str, formats: dict[str, str] | None = None, most_rows: int = 1_000_000) -> None:
    """Write the tables of a version, and its manifest; nothing points to it yet.

    ``most_rows`` bounds the rows of a file, as files are hashed whole.  An unfinished stage of the same version is replaced.
    """
    spark = next(iter(outputs.values())).sparkSession
    at = f"{root.rstrip('/')}/versions/{version}"
    _Folder(spark, root).deleted(f"versions/{version}")
    for name, df in outputs.items():
        df.write.format((formats or {}).get(name, "parquet")).option("maxRecordsPerFile", most_rows).save(f"{at}/tables/{name}")
    listed(spark, f"{at}/tables").write.parquet(f"{at}/manifest")


def manifest_digest(manifest: DataFrame) -> str:
    """One digest of a manifest, whatever the order of its rows: of the sums of 16-hex-digit parts of the rows' digests, and their number."""
    row = F.sha2(F.concat_ws("\x1f", "file", F.col("bytes").cast("string"), "sha256"), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    got = manifest.agg(F.count("*").cast("string"), *[part(k) for k in range(4)]).first()
    return hashlib.sha256("|".join(x or "" for x in got).encode()).hexdigest()


def pointed(spark: SparkSession, root: str, version: str, tables: dict[str, str], expected: int | None = None, run: str | None = None, target: str | None = None, quality: str = "ready") -> Pointer:
    """Make a staged version current; ``expected`` is the generation that the writer has seen (None: the newest)."""
    folder = _Folder(spark, root)
    last = _taken(folder)
    if expected is not None and (now := current(spark, root)) is not None and now.generation != expected:
        raise Conflict(f"generation {now.generation} is current, not {expected}")
    made = Pointer(last + 1, version, run, target, quality, tables, manifest_digest(spark.read.schema(MANIFEST).parquet(f"{folder.root}/versions/{version}/manifest")))
    if not folder.created(f"pointers/{made.generation:020d}", made.text()):
        raise Conflict(f"generation {made.generation} was taken by another writer")
    return made


def problems(spark: SparkSession, root: str, pointer: Pointer) -> DataFrame:
    """(file, code) of files of a version that are missing, too many, or not what the manifest says."""
    at = f"{root.rstrip('/')}/versions/{pointer.version}"
    manifest = spark.read.schema(MANIFEST).parquet(f"{at}/manifest")
    now = listed(spark, f"{at}/tables").select("file", F.col("bytes").alias("now_bytes"), F.col("sha256").alias("now_sha256"))
    code = F.when(F.col("now_sha256").isNull(), MISSING).when(F.col("sha256").isNull(), EXTRA).when(F.col("bytes") != F.col("now_bytes"), SIZE).when(F.col("sha256") != F.col("now_sha256"), HASH)
    return manifest.join(now, "file", "full_outer").select("file", code.alias("code")).where("code IS NOT NULL")


def consumed(spark: SparkSession, root: str, pointer: Pointer | None = None) -> dict[str, DataFrame]:
    """The tables of the current (or a given) version, once its files are what the manifest says; else ``Broken``."""
    pointer = pointer or current(spark, root)
    if pointer is None:
        raise Broken("nothing is published")
    at = f"{root.rstrip('/')}/versions/{pointer.version}"
    if manifest_digest(spark.read.schema(MANIFEST).parquet(f"{at}/manifest")) != pointer.manifest_sha256:
        raise Broken("ARTIFACT_MANIFEST_HASH_MISMATCH")
    wrong = problems(spark, root, pointer).orderBy("file").limit(5).collect()
    if wrong:
        raise Broken(", ".join(f"{r.code}:{r.file}" for r in wrong))
    return {name: spark.read.format(kind).load(f"{at}/tables/{name}") for name, kind in pointer.tables.items()}


def published(outputs: dict[str, DataFrame], root: str, version: str, formats: dict[str, str] | None = None, **how) -> Pointer:
    """Stage and point."""
    spark = next(iter(outputs.values())).sparkSession
    tables = {name: (formats or {}).get(name, "parquet") for name in outputs}
    staged(outputs, root, version, formats)
    return pointed(spark, root, version, tables, **how)


def finalised(spark: SparkSession, store: Store, scope: str, root: str, run: str) -> str:
    """Move the checkpoint of a run to its target if what it published is whole; its status.

    A run of blocked quality ends as review_required; one that has published nothing stays as it is.
    A second call does nothing.
    """
    mine = [p for p in pointers(spark, root) if p.run == run]
    if not mine:
        return "running"
    consumed(spark, root, mine[-1])
    if mine[-1].quality == "blocked":
        store.close(run, "review_required")
        return "review_required"
    if store.base(scope) != mine[-1].target:
        store.advance(run)
    return "committed"


def recovered(spark: SparkSession, store: Store, scope: str, root: str) -> str | None:
    """After a crash: finish the newest run that has a pointer and whose checkpoint didn't move; its status."""
    last = current(spark, root)
    if last is None or last.run is None or store.base(scope) == last.target:
        return None
    try:
        return finalised(spark, store, scope, root, last.run)
    except Conflict:  # the run was ended otherwise
        return None


def cleaned(spark: SparkSession, root: str, keep: int = 2, unfinished: bool = False) -> list[str]:
    """Delete versions that none of the last ``keep`` pointers names; staged ones that nothing ever named only if asked to."""
    folder = _Folder(spark, root)
    found = pointers(spark, root)
    kept, named = {p.version for p in found[-keep:]}, {p.version for p in found}
    gone = [v for v in folder.names("versions") if v not in kept and (v in named or unfinished)]
    for version in gone:
        folder.deleted(f"versions/{version}")
    return gone
