"""Token ids in ORC: integer run-length encoded lists, row indexes, Bloom filters on document ids.

``write_tokens`` encodes documents and writes them in ascending document id, one sorted range of
ids to a file, so that stripe and row-group statistics and the Bloom filters prune lookups by
document id, and readers take stripes in parallel.  ``read_tokens`` gives the rows back with each
document's place in the whole stream; ``lookup`` reads single documents.

Defined results: null text is empty text (the end id alone); null document ids come first; rows of
equal id are ordered by their text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm import arrays, bpe
from deltaloom.llm.storage import id_bounds, small_batches

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: Documents of one file, about (fewer where there would be fewer files than cores), and files at most; a file is written as a stream.
FILE_ROWS, FILES = 20_000, 100_000


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    known, specials = bpe.remembered(path, "ids"), tuple(bpe.specials_of(path))
    begun = 0
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(1)):
            starts, doc = bpe.pretokens(data, offs, specials)
            at, size = known.resolve(data, starts, lambda pieces: bpe.library_ids(path, pieces))
            # the ids of all pieces in order, with room for the end id after each document
            n = b - a
            per_doc = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(per_doc + 1)))
            out = np.full(bounds[-1], end_id, np.int32)
            room = np.ones(bounds[-1], bool)
            room[bounds[1:] - 1] = False
            out[room] = known.pool[arrays.ranges(at, size)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, n).cast(pa.int64()),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(begun + bounds[:-1]),
                    pa.array(per_doc + 1),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out)),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            begun += int(bounds[-1])


def write_tokens(
    documents: DataFrame, path: str, vocabulary_path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", file_rows: int = FILE_ROWS
) -> None:
    """Encode every text with the tokenizers library, append ``end_id``, and write sorted ORC files.

    One range shuffle of (id, text), its bounds taken from the ids alone; encoding happens behind it,
    so token ids are never shuffled.  A pre-token is encoded by the library once for each worker that meets it, as pre-tokens are
    encoded independently of each other.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    bounds, _, _ = id_bounds(rows.select("doc_id"), file_rows, FILES, documents.sparkSession.sparkContext.defaultParallelism)

    @F.pandas_udf("int")
    def file_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    placed = rows.withColumn("file", file_of(F.coalesce("doc_id", F.lit(-(1 << 63))))).repartitionById(len(bounds) + 1, "file").select("doc_id", "text")
    sorted_rows = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        sorted_rows.mapInArrow(lambda batches: _encode(batches, vocabulary_path, end_id), SCHEMA)
        .write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "2000")
        .option("orc.stripe.size", str(16 << 20))
        .option("orc.encoding.strategy", "COMPRESSION")
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of written documents.

    The files' totals are summed from the n_tokens column alone; a document's start is its file's
    start plus its stored place in the file.
    """
    stored = spark.read.schema(SCHEMA).orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # one row for each file
    return stored.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; ORC statistics and Bloom filters skip the other stripes."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offs = lists.offsets.to_numpy()
        raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        lengths = np.diff(offs).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per written document: doc_id, start, n_tokens and the CRC-32 of its ids as little-endian unsigned 32-bit."""
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
