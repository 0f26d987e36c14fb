"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its s-mers' hashes is that of the first or the
last of them: whether it is one depends on its own letters alone, so equal passages have equal
anchors wherever they stand.  The second, third ... occurrence of an anchor counts as an anchor of
its own, so that repetitive text has as many anchors as other text.  A text shorter than k is one
anchor.  A fingerprint holds the number of anchors and those of smallest hash with their places:
``KEPT`` of them, or all.  The likeness of two fingerprints is the Jaccard similarity of their anchor
sets (an estimate where not all anchors are kept; its standard error is at most 1 / (2 sqrt(KEPT))),
of which shared anchors count only as far as they stand in the same order in both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import arrays
from deltaloom.llm.storage import id_bounds, small_batches

K, S = 10, 4
#: Anchors that a fingerprint keeps; None for all.
KEPT = 64
#: Rows of a sorted range of documents, about, and ranges at most; ranges are read as streams.
RANGE_ROWS, RANGES = 2_000, 100_000
#: Stands for a null id, in whole numbers.
LEAST = -(1 << 63)
U = np.uint64

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Fingerprint:
    """Number of distinct anchors, the smallest anchor hashes in order, and their places (code points)."""

    __slots__ = ("count", "hashes", "places")

    def __init__(self, count: int, hashes: np.ndarray, places: np.ndarray):
        self.count, self.hashes, self.places = count, hashes, places

    def text(self) -> str:
        """8 hex digits for the count, and 8 + 8 for each kept anchor's hash and place."""
        return f"{self.count & 0xFFFFFFFF:08x}" + np.column_stack((self.hashes, self.places)).astype(">u4").tobytes().hex()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        both = np.frombuffer(bytes.fromhex(text[8:]), ">u4").reshape(-1, 2)
        return cls(int(text[:8], 16), both[:, 0].astype(np.uint32), both[:, 1].astype(np.uint32))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1; two texts without anchors (both empty) are alike."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    # the smallest anchors of the union are known as far as the shorter of the cut fingerprints reaches
    known = min([len(f.hashes) for f in (a, b) if f.count > len(f.hashes)], default=len(a.hashes) + len(b.hashes))
    union = np.union1d(a.hashes, b.hashes)[:known]
    shared, at, bt = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    inside = shared <= union[-1]
    return longest_rise(b.places[bt[inside]][np.argsort(a.places[at[inside]], kind="stable")]) / len(union)


def longest_rise(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    from bisect import bisect_left

    ends: list[int] = []
    for x in values.tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, places and documents of the anchors of a block; a text shorter than ``K`` is an anchor itself."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.append(lead, len(data))
    first = np.searchsorted(lead, offs)
    n_chars = np.diff(first)
    hashes, places, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(lead)
    inner = K - S + 1
    if n >= K:
        up, down = arrays._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(arrays.BYTE_VALUES[data] * up[: len(data)], out=total[1:])
        m = n - S + 1
        at = ends[:m]
        value = (total[ends[S : S + m]] - total[at]) * down[at]
        value ^= value >> U(29)
        value *= U(0xD6E8FEB86659FD93)
        value ^= value >> U(32)
        least, width = value, 1
        while width * 2 <= inner:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: n - K + 1], least[inner - width : inner - width + n - K + 1])
        closed = (least == value[: n - K + 1]) | (least == value[inner - 1 :])
        outside = np.zeros(n + 1, np.int32)  # k-mers that reach into the next document
        np.add.at(outside, np.maximum(first[1:] - K + 1, first[:-1]), 1)
        np.add.at(outside, first[1:], -1)
        closed &= np.cumsum(outside)[: n - K + 1] == 0
        at = np.flatnonzero(closed)
        hashes.append(arrays.mix64((total[ends[at + K]] - total[ends[at]]) * down[ends[at]]))
        doc = np.searchsorted(first, at, "right") - 1
        docs.append(doc)
        places.append(at - first[doc])
    short = np.flatnonzero((n_chars > 0) & (n_chars < K))
    if len(short):
        hashes.append(arrays.mix64(arrays.span_hashes(data, offs[short], offs[short + 1]) + U(5)))
        places.append(np.zeros(len(short), np.int64))
        docs.append(short)
    hashes, places, docs = np.concatenate(hashes), np.concatenate(places), np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return hashes[order], places[order], docs[order]


def fingerprints(texts: pa.Array, kept: int | None = KEPT) -> list[Fingerprint]:
    out = []
    for a, b, data, offs in arrays.blocks(texts):
        hashes, places, docs = anchors(data, offs)
        _, first = arrays.counts_by_doc(docs, b - a)
        for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
            order = np.argsort(hashes[x:y], kind="stable")
            value = hashes[x:y][order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            rank = np.arange(len(value)) - np.flatnonzero(new)[np.cumsum(new) - 1]  # 0 for a first occurrence
            value, at = np.unique((arrays.mix64(value + rank.astype(U)) >> U(32)).astype(np.uint32), return_index=True)
            at = order[at]
            out.append(Fingerprint(len(value), value[:kept], (places[x:y][at[:kept]] & 0xFFFFFFFF).astype(np.uint32)))
    return out


def char_starts(raw: bytes) -> np.ndarray:
    return np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)


def edited(raw: bytes, next_raw: bytes) -> tuple[bytes, int]:
    """The text with its last quarter of code points replaced by the next text's first ones; and its code points."""
    own = char_starts(raw)
    cut = len(own) // 4
    if not cut:
        return raw, len(own)
    # the next text's first ``cut`` code points end within 4 * cut bytes
    starts = char_starts(next_raw[: 4 * cut + 4])
    head = next_raw[: starts[cut]] if cut < len(starts) else next_raw
    return raw[: own[len(own) - cut]] + head, len(own)


def _pairs(batches: Iterator[pa.RecordBatch], kept: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (range, look, doc_id, text), sorted, each range ended by a look-ahead row, to the rows' results."""
    held = None  # the row before: range, doc_id, text, fingerprint
    over = None  # a range whose look-ahead row is already seen
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            ranges, looks, ids = (part.column(i).to_pylist() for i in range(3))
            raws = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(3).cast(pa.large_binary())]
            prints = fingerprints(pa.array(raws, pa.large_binary()), kept)
            rows = []
            for r, look, doc_id, raw, fp in zip(ranges, looks, ids, raws, prints):
                if r == over:
                    continue
                if held is not None and held[0] == r:
                    rows.append((*held[1:], raw, fp))
                held = (r, doc_id, raw, fp)
                if look:
                    held, over = None, r
            if not rows:
                continue
            made = [edited(raw, next_raw) for _, raw, _, next_raw, _ in rows]
            made_prints = fingerprints(pa.array([x for x, _ in made], pa.large_binary()), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in rows], pa.int64()),
                    pa.array([n for _, n in made], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _ in made], pa.string()),
                    pa.array([x[2].text() for x in rows], pa.string()),
                    pa.array([fp.text() for fp in made_prints], pa.string()),
                    pa.array([likeness(x[2], fp) for x, fp in zip(rows, made_prints)], pa.float64()),
                    pa.array([likeness(x[2], x[4]) for x in rows], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def document_fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", range_rows: int = RANGE_ROWS, kept: int | None = KEPT) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and its likeness to that and to the next document.

    Documents are dealt to ranges of ids, one a partition, each with the first document of the next
    range (after the last: of the first) as a look-ahead row, so that every document meets its
    successor with one shuffle and without a global order in one task.  Bounds come from the ids
    alone; texts are read once.

    Defined results: null text is empty text, without anchors; rows of equal id are ordered by text;
    null ids come before all others; the only document of a table is its own successor; texts of
    less than K code points have one anchor, the whole text; an empty table gives an empty table;
    extra columns are ignored.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    small_batches(documents.sparkSession)
    bounds, least, nulls = id_bounds(rows.select("doc_id"), range_rows, RANGES)  # each bound is the first id of a range

    @F.pandas_udf("range int, leads boolean")
    def placed(ids: pd.Series) -> pd.DataFrame:
        known = ids.to_numpy()
        at = np.searchsorted(bounds, known, "right")
        leads = (at > 0) & (np.append(bounds, 0)[at - 1] == known)
        return pd.DataFrame({"range": at.astype(np.int32), "leads": leads})

    if not nulls:
        is_first = F.col("doc_id") == F.lit(least)
    else:
        is_first = F.col("doc_id").isNull() & (F.col("text") == F.lit(rows.where("doc_id IS NULL").agg(F.min("text")).first()[0]))
    own = F.struct(F.col("at.range").alias("r"), F.lit(0).alias("look"))
    ahead = F.when(F.col("at.leads"), F.struct((F.col("at.range") - 1).alias("r"), F.lit(1).alias("look")))
    wrapped = F.when(is_first, F.struct(F.lit(len(bounds)).alias("r"), F.lit(1).alias("look")))
    rows = rows.withColumn("at", placed(F.coalesce("doc_id", F.lit(LEAST)))).select(F.explode(F.array_compact(F.array(own, ahead, wrapped))).alias("to"), "doc_id", "text")
    dealt = rows.select("to.r", "to.look", "doc_id", "text").repartitionById(len(bounds) + 1, "r").sortWithinPartitions("r", "look", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(lambda batches: _pairs(batches, kept), SCHEMA)
