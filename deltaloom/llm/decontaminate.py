"""Benchmark decontamination by latent semantic retrieval.

Texts are cut to overlapping windows of words.  Windows and benchmark passages are TF-IDF vectors
over 2**BITS hashed words (document frequencies from all passages of all documents), projected to the
leading right singular vectors of the matrix of all passages of all documents and the benchmark, which
a randomised SVD finds in a few passes of distributed products.  Windows whose cosine with a benchmark passage in that latent space reaches
``COSINE`` are candidates; these are verified by the longest common subsequence of words, and where
that alone does not decide (paraphrases), by the answer words.

The benchmark is the stated query set.  Its passages are a table of their own, dealt to blocks of
bounded size; a task holds one block at a time and searches a few megabytes of text for each in turn,
so one scan of the documents serves ``SCAN`` blocks.  A candidate whose stretch of text has too few of
the passage's words for such a subsequence is not verified; those words are counted for all windows
at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import arrays
from deltaloom.llm.storage import small_batches, written

BITS = 14
#: Dimensions of the latent space, extra directions of the random start, and products A'(A Q) over all passages.
RANK, EXTRA, POWERS = 64, 8, 2
#: Window lengths in words; a window starts each quarter of its length.  Longer benchmark passages are cut.
LENGTHS = (32, 64)
#: Overlapping passages of LENGTHS[0] words of a longer item start each so many words.
STRIDE = 16
#: Passages that ``sampled_passages`` draws, about; no model is fitted on them.
SAMPLE = 16_000
COSINE = 0.42
#: A passage is found if so much of it is a common subsequence; or less, if so many of its answer words are there too.
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.5, 0.8
#: Without answers, the rarest words of a passage are its answer words.
ANSWER_WORDS = 5
#: Benchmark words of a block, and blocks that one scan of the documents searches for.
BLOCK_WORDS, SCAN = 16 << 10, 32
#: Bytes of text that a task searches for all blocks before it reads on, and words of a text searched at a time.
TEXT_BYTES, SEGMENT = 8 << 20, 1 << 16
#: Words that two segments of a text share: the longest window with its margins on both sides, and its grid.
OVERLAP = 2 * LENGTHS[-1]
#: Passages of a row of the written passages; entries (word and passage) that a task multiplies at a time; row blocks in which products are added up.
ROW_PASSAGES, ENTRIES, ROW_BLOCKS = 64, 1 << 19, 16
#: Bits of a word's hash that name its slot in the table of a block's words; passages whose words are counted at a time; bytes of rows that are added up at a time.
SLOT_BITS, COLUMNS, CACHED = 16, 1024, 1 << 18
#: Entries of a row or column that are multiplied as one small matrix, and so many matrices at a time.
WIDTH, MATRICES = 32, 256
U = np.uint64

_INSIDE = np.zeros(256, bool)
_INSIDE[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (A-Z lower-cased) and documents of the words: runs of letters, digits and non-ASCII signs."""
    data = arrays.ASCII_LOWER[data]
    starts, ends, doc = arrays.spans(_INSIDE[data], offs)
    return arrays.span_hashes(data, starts, ends), doc


def bucket(word: np.ndarray) -> np.ndarray:
    return (word >> U(64 - BITS)).astype(np.int64)


def _passages(count: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word's passage (runs of LENGTHS[0] words of a document), and passages of each document."""
    cuts = -(-count // LENGTHS[0])
    return (np.arange(len(doc)) - first[doc]) // LENGTHS[0] + np.concatenate(([0], np.cumsum(cuts)[:-1]))[doc], cuts


def _entries(passage: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """Passages (their numbers from 0 on, for each word) as rows of ``ROW_PASSAGES``: different buckets of each passage, the buckets, and how often each is there."""
    own, times = np.unique(passage << BITS | bucket(word), return_counts=True)
    sizes = np.bincount(own >> BITS)
    cut = np.arange(0, len(sizes) + ROW_PASSAGES, ROW_PASSAGES).clip(max=len(sizes))
    cut = np.unique(cut)
    at = np.concatenate(([0], np.cumsum(sizes)))[cut]
    column = lambda values, offs: pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(values)])
    return pa.RecordBatch.from_arrays([column(sizes.astype(np.uint8), cut), column((own & (1 << BITS) - 1).astype(np.uint16), 2 * at), column(times.astype(np.uint8), at)], names=["sizes", "buckets", "times"])


def _text_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays.keep_memory()
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(0)):
            word, doc = words_of(data, offs)
            if len(word):
                yield _entries(_passages(*arrays.counts_by_doc(doc, b - a), doc)[0], word)


def _list_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        offs = lists.offsets.to_numpy()
        word = lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].view(U)
        if len(word):
            yield _entries(np.repeat(np.arange(len(lists)), np.diff(offs)), word)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that have a word of each bucket, and (bucket -1) all passages, added up over the task."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for sizes, buckets in zip(batch.column(0), batch.column(1)):
            total += np.bincount(np.frombuffer(buckets.as_buffer(), np.uint16), minlength=1 << BITS)
            n += sizes.as_buffer().size
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])


def idf(entries: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse passage frequency of each bucket, and the number of passages; the driver gets at most 2**BITS + 1 sums."""
    table = entries.select("sizes", "buckets").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    seen = np.zeros(1 << BITS)
    seen[at[at >= 0]] = n[at >= 0]
    passages = int(n[at < 0].sum())
    return np.log((passages + 1) / (seen + 1)) + 1e-3, passages


def cuts(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the passages of an item of n words.

    An item over the longest window is cut evenly, and once more to overlapping passages with the tail.
    Any run of 35 words of it has 26 words or more, over ``VERBATIM``, of one of the latter: of 16 starts
    in turn one is at most 6 words before the run's, or at most 9 behind it.
    """
    if n <= LENGTHS[-1]:
        return [(0, n)] if n else []
    parts = -(-n // LENGTHS[-1])
    even = [n * i // parts for i in range(parts + 1)]
    starts = [*range(0, n - LENGTHS[0], STRIDE), n - LENGTHS[0]]
    return [*zip(even[:-1], even[1:]), *[(a, a + LENGTHS[0]) for a in starts]]


def _cut_items(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (item, text, answer or null) to passages (item, number, words, answer words)."""
    for batch in batches:
        items, number, words, answers = [], [], [], []
        for item, word, asked in zip(batch.column(0).to_pylist(), _split(batch.column(1)), _split(batch.column(2))):
            for k, (a, b) in enumerate(cuts(len(word))):
                rare = word[a:b][np.argsort(-weights[bucket(word[a:b])], kind="stable")[:ANSWER_WORDS]]
                items.append(item)
                number.append(k)
                words.append(word[a:b].view(np.int64))
                answers.append(np.unique(asked if len(asked) else rare).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(number, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(answers, pa.list_(pa.int64()))], names=["item", "number", "words", "answer"]
        )


def _split(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for a, b, data, offs in arrays.blocks(texts.cast(pa.large_string())):
        word, doc = words_of(data, offs)
        first = arrays.counts_by_doc(doc, b - a)[1]
        out += [word[x:y] for x, y in zip(first[:-1], first[1:])]
    return out


def passages_of(benchmark: DataFrame, weights: np.ndarray, item_column: str, item_text: str, answer_column: str | None) -> tuple[DataFrame, int]:
    """Written passages (item, number, words, answer, block) of the items that have an id and a text; and the number of blocks."""
    answer = F.col(answer_column).cast("string") if answer_column else F.lit(None).cast("string")
    rows = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).cast("string").alias("t"), answer.alias("a")).where("item IS NOT NULL AND t IS NOT NULL")
    cut = written(rows.mapInArrow(lambda batches: _cut_items(batches, weights), "item long, number int, words array<long>, answer array<long>"), "passages")
    n = (cut.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS + 1
    return cut.withColumn("block", F.pmod(F.xxhash64("item", "number", "words"), F.lit(n)).cast("int")), n


def _sums(key: np.ndarray, other: np.ndarray, value: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """For each key (ascending) the sum of value * table[other]: n rows, as products of small matrices of ``WIDTH`` entries."""
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(np.append(starts, len(key)))
    groups = -(-size // WIDTH)
    first = np.concatenate(([0], np.cumsum(groups)))
    slot = np.arange(len(key)) + np.repeat(first[:-1] * WIDTH - starts, size)
    at, factor = np.zeros(first[-1] * WIDTH, np.int64), np.zeros(first[-1] * WIDTH, np.float32)
    at[slot], factor[slot] = other, value
    at, factor = at.reshape(-1, WIDTH), factor.reshape(-1, 1, WIDTH)
    got = np.empty((len(at), 1, table.shape[1]), np.float32)
    rows = np.empty((MATRICES, WIDTH, table.shape[1]), np.float32)
    for a in range(0, len(at), MATRICES):
        b = min(a + MATRICES, len(at))
        np.take(table, at[a:b], axis=0, out=rows[: b - a], mode="clip")
        np.matmul(factor[a:b], rows[: b - a], out=got[a:b])
    got, out, alone = got[:, 0], np.zeros((n, table.shape[1]), np.float32), groups == 1
    out[key[starts[alone]]] = got[first[:-1][alone]]
    for k in np.flatnonzero(~alone).tolist():
        out[key[starts[k]]] = got[first[k] : first[k + 1]].sum(axis=0)
    return out


def gram_product(row: np.ndarray, column: np.ndarray, value: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right) for a sparse A with entries by ascending row."""
    if not len(row):
        return np.zeros(right.shape, np.float32)
    middle = _sums(row, column, value, right, int(row[-1]) + 1)
    order = np.argsort(column.astype(np.uint16), kind="stable")
    return _sums(column[order], row[order], value[order], middle, len(right))


def _sample(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Of texts' passages, the words of those whose hash is below a share of all."""
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(0)):
            word, doc = words_of(data, offs)
            count, first = arrays.counts_by_doc(doc, b - a)
            passage, _ = _passages(count, first, doc)
            starts = np.flatnonzero(np.diff(passage, prepend=-1))
            ends = np.append(starts[1:], len(word))
            place = arrays.mix64(word[starts] + (starts - first[doc[starts]]).astype(U)) if len(word) else np.zeros(0, U)
            kept = (place >> U(11)).astype(float) < share * (1 << 53)
            lists = [word[x:y].view(np.int64) for x, y in zip(starts[kept].tolist(), ends[kept].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64()))], names=["words"])


def sampled_passages(documents: DataFrame, passages: int, id_column: str, text_column: str) -> DataFrame:
    """About ``SAMPLE`` passages (words) from anywhere in the texts: one in a few of those of four times as many."""
    of_documents = min(1.0, 4 * SAMPLE / max(passages, 1))
    of_passages = min(1.0, SAMPLE / max(passages * of_documents, 1))
    place = F.pmod(F.xxhash64(id_column, text_column), F.lit(1 << 30)) / float(1 << 30)  # so that rows of one id, or of none, are not all drawn
    return documents.where(place < of_documents).select(text_column).mapInArrow(lambda batches: _sample(batches, of_passages), "words array<long>")


def _products(batches: Iterator[pa.RecordBatch], right: Broadcast, weights: np.ndarray, scale: float) -> Iterator[pa.RecordBatch]:
    """Written passages to their part of A'(A right) (unit TF-IDF rows, times scale), in row blocks."""
    arrays.keep_memory()
    total = np.zeros(right.value.shape, np.float64)

    def multiplied(rows: list[tuple[np.ndarray, ...]]) -> None:
        sizes, column, times = (np.concatenate(x) for x in zip(*rows))
        row, column = np.repeat(np.arange(len(sizes)), sizes), column.astype(np.int64)
        value = times * weights[column]
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(sizes)))
        np.add(total, gram_product(row, column, (value / np.maximum(norm, 1e-12)[row]).astype(np.float32), right.value), out=total)

    rows, n = [], 0
    for batch in batches:
        for each in zip(*batch.columns):
            rows.append(tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(each, (np.uint8, np.uint16, np.uint8))))
            n += len(rows[-1][1])
            if n >= ENTRIES:
                multiplied(rows)
                rows, n = [], 0
    if rows:
        multiplied(rows)
    blocks = np.split((total * scale).astype(np.float32), ROW_BLOCKS)
    arrays.give_back()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(ROW_BLOCKS, dtype=np.int32)), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "product"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(raw.as_buffer(), np.float32)
            sums[k] = sums[k] + part if k in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "product"])


def singular_vectors(parts: list[tuple[DataFrame, int]], weights: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the passages of several tables (entries, and their number), all tables weighed alike.

    Halko, Martinsson and Tropp's randomised range finder with power iterations: each step is one
    distributed product A'(A Q) over all passages, whose parts are added up on the executors in
    ``ROW_BLOCKS`` blocks of rows; the driver gets the one sum, 2**BITS rows of RANK + EXTRA numbers.  The
    vectors are those of the Nystroem approximation that the last product gives (Tropp, Yurtsever, Udell
    and Cevher), which is as near as one power iteration more.
    """
    context = parts[0][0].sparkSession.sparkContext
    right = np.linalg.qr(np.random.default_rng(11).standard_normal((1 << BITS, RANK + EXTRA)))[0].astype(np.float32)
    for step in range(POWERS):
        shared = context.broadcast(right)
        products = None
        for entries, n in parts:
            own = entries.mapInArrow(lambda batches, q=shared, c=1 / max(n, 1): _products(batches, q, weights, c), "block int, product binary")
            products = own if products is None else products.union(own)
        got = products.repartition(ROW_BLOCKS, "block").mapInArrow(_added, "block int, product binary").toArrow()
        shared.destroy()
        total = np.zeros((ROW_BLOCKS, right.size // ROW_BLOCKS), np.float32)
        for k, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
            total[k] = np.frombuffer(raw, np.float32)
        total = total.reshape(right.shape)
        if step < POWERS - 1:
            right = np.linalg.qr(total)[0]
    right, total = right.astype(np.float64), total.astype(np.float64)
    shift = 1e-6 * np.linalg.norm(total)  # keeps the core positive; it is taken off no value, as only the vectors are used
    total = total + shift * right
    core = right.T @ total
    values, turn = np.linalg.eigh((core + core.T) / 2)
    half = turn / np.sqrt(np.maximum(values, shift / 2))
    return np.linalg.svd(total @ half, full_matrices=False)[0][:, :RANK].astype(np.float32)


def common_subsequences(masks: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences, by bits, for all rows at once.

    ``masks[r, t]`` has the places (bits, 64 at most) in row r's passage of the t-th word of its
    stretch of text; ``length`` is the passages' number of words.
    """
    row = np.full(len(masks), ~U(0))
    hit, more = np.empty_like(row), np.empty_like(row)
    for t in range(masks.shape[1]):
        np.bitwise_and(row, masks[:, t], out=hit)
        np.add(row, hit, out=more)
        np.subtract(row, hit, out=row)
        np.bitwise_or(row, more, out=row)
    return np.bitwise_count(~row & (~U(0) >> (U(64) - length.astype(U)))).astype(np.int64)


def _piece_sums(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each piece (a column of places in the table) the sum of the table's rows, in the table's type; and one more row of zeros."""
    step, n = at.shape
    out = np.empty((n + 1, table.shape[1]), table.dtype)
    out[n] = 0
    size = max(1, CACHED // (table.shape[1] * table.itemsize))
    rows = np.empty((size, table.shape[1]), table.dtype)
    for a in range(0, n, size):
        part = out[a : min(a + size, n)]
        np.take(table, at[0, a : a + size], axis=0, out=part, mode="clip")
        for each in at[1:, a : a + size]:
            part += np.take(table, each, axis=0, out=rows[: len(part)], mode="clip")
    return out


def _runs(sums: np.ndarray, left: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Sums of 1, 2, 4, ... ``longest`` pieces from each piece on, or of the ``left`` ones up to its document's end; each with the row of zeros."""
    out, n, wide = {1: sums}, len(left), 1
    while wide < longest:
        one, cut = out[wide], max(n - wide, 0)
        two = np.empty_like(one)
        np.add(one[:cut], one[wide : wide + cut], out=two[:cut])
        two[cut:] = one[cut:]
        short = np.flatnonzero(left <= wide)
        two[short] = one[short]
        wide *= 2
        out[wide] = two
    return out


@dataclass
class Passage:
    """A part of a benchmark item: its words in order, and the words its answer check asks for."""

    item: int
    words: np.ndarray
    answer: set[int]


class Search:
    """A block of benchmark passages ready to be searched for in texts."""

    def __init__(self, passages: list[Passage], scaled: np.ndarray):
        self.scaled = scaled
        self.vocabulary = np.unique(np.concatenate([p.words for p in passages]))
        slot = (self.vocabulary >> U(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.searchsorted(slot, np.arange(1 << SLOT_BITS)).astype(np.int32)  # each slot's first word of the vocabulary
        self.in_slot = int(np.bincount(slot).max())
        self.groups = []
        for k, length in enumerate(LENGTHS):
            least = LENGTHS[k - 1] if k else 0
            own = [p for p in passages if least < len(p.words) <= length]
            if own:
                latent = np.stack([self.scaled[bucket(p.words)].sum(axis=0) for p in own])
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                places = np.zeros((len(own), len(self.vocabulary) + 1), U)  # passages by words (and any other)
                for j, p in enumerate(own):
                    np.bitwise_or.at(places[j], np.searchsorted(self.vocabulary, p.words), U(1) << np.arange(len(p.words), dtype=U))
                has = np.ascontiguousarray((places > 0).T.astype(np.uint8))
                self.groups.append((length, own, latent.astype(np.float32), places, has, np.array([len(p.words) for p in own])))

    def known(self, word: np.ndarray) -> np.ndarray:
        """Numbers of the words in the vocabulary; its length for any other word."""
        at = self.slots[(word >> U(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        out = np.full(len(word), len(self.vocabulary))
        for k in range(self.in_slot):
            there = np.minimum(at + k, len(self.vocabulary) - 1)
            np.copyto(out, there, where=self.vocabulary[there] == word)
        return out

    def candidates(self, word: np.ndarray, known: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window length: (group, documents, window starts, passages) of the pairs to verify, by passage."""
        step = LENGTHS[0] // 4
        count = np.diff(first)
        pieces = -(-count // step)  # runs of ``step`` words of each document
        piece_first = np.concatenate(([0], np.cumsum(pieces)))
        n = int(piece_first[-1])
        if not n:
            return
        doc = np.repeat(np.arange(len(count)), pieces)
        place = np.arange(n) - piece_first[doc]
        left = pieces[doc] - place
        starts = first[doc] + place * step
        there = starts + np.arange(step)[:, None]
        ends = np.flatnonzero(left == 1)  # only the last piece of a document has fewer words
        there[:, ends] = np.where(there[:, ends] < first[doc[ends] + 1], there[:, ends], len(word))
        latent_runs = _runs(_piece_sums(self.scaled, np.append(bucket(word), 1 << BITS)[there]), left, LENGTHS[-1] // step)
        there = known[there]
        for g, (length, own, latent, _, has, size) in enumerate(self.groups):
            wide, margin = length // step, length // 4 // step
            hop = max(1, margin)
            chosen = np.flatnonzero((place % hop == 0) & ((left > wide - hop) | (place == 0)))
            window = latent_runs[wide][chosen]
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
            before, behind = np.where(place[chosen] >= margin, chosen - margin, n), np.where(left[chosen] > wide, chosen + wide, n)
            least = np.ceil(PARAPHRASE * size).astype(np.uint8)
            for j in range(0, len(own), COLUMNS):
                columns = slice(j, j + COLUMNS)
                shared = _runs(_piece_sums(np.ascontiguousarray(has[:, columns]), there), left, wide)  # words of each run that each passage has
                for i in range(0, len(chosen), 4096):
                    rows = slice(i, i + 4096)
                    close = window[rows] @ latent[columns].T >= COSINE
                    close &= shared[wide][chosen[rows]] + shared[margin][before[rows]] + shared[margin][behind[rows]] >= least[columns]
                    q, w = np.divmod(np.flatnonzero(close.T), len(close))
                    if len(q):
                        yield g, doc[chosen[w + i]], starts[chosen[w + i]], q + j

    def found(self, word: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(document, item) to the largest common share of a passage and the word that its stretch starts at.

        A single long text is searched in segments, each of which begins on the windows' grid and holds
        the last windows of the one before whole.
        """
        if len(first) > 2 or len(word) <= SEGMENT:
            return self.found_at_once(word, first)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for a in range(0, len(word) - OVERLAP, SEGMENT - OVERLAP):
            part = word[a : a + SEGMENT]
            for key, (share, at) in self.found_at_once(part, np.array([0, len(part)])).items():
                if key not in best or share > best[key][0]:
                    best[key] = (share, at + a)
        return best

    def found_at_once(self, word: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        best: dict[tuple[int, int], tuple[float, int]] = {}
        known = np.append(self.known(word), len(self.vocabulary))  # and no word
        for g, docs, starts, queries in self.candidates(word, known, first):
            length, own, _, places, _, size = self.groups[g]
            margin = length // 4
            for i in range(0, len(docs), 4096):
                d, q = docs[i : i + 4096], queries[i : i + 4096]
                a, b = np.maximum(first[d], starts[i : i + 4096] - margin), np.minimum(first[d + 1], starts[i : i + 4096] + length + margin)
                masks = np.empty((length + 2 * margin, len(d)), U)
                flat, row, at, place = places.reshape(-1), q * places.shape[1], a.copy(), np.empty_like(a)
                for t in range(len(masks)):  # words beyond the text are none, and those beyond the stretch are taken out below
                    np.take(known, at, out=place, mode="clip")
                    place += row
                    np.take(flat, place, out=masks[t], mode="clip")
                    at += 1
                short = np.flatnonzero(b - a < len(masks))
                masks[:, short] *= np.arange(len(masks))[:, None] < (b - a)[short]
                share = common_subsequences(masks.T, size[q]) / size[q]
                hits = np.flatnonzero(share >= PARAPHRASE)
                for r in hits[np.lexsort((q[hits], a[hits]))].tolist():
                    p, key = own[q[r]], (int(d[r]), own[q[r]].item)
                    if share[r] < VERBATIM and len(p.answer.intersection(word[a[r] : b[r]].tolist())) < ANSWER * len(p.answer):
                        continue
                    if key not in best or share[r] > best[key][0]:
                        best[key] = (float(share[r]), int(a[r] - first[d[r]]))
        return best


def _found(batches: Iterator[pa.RecordBatch], column: int, blocks: Broadcast, scaled: Broadcast) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Each batch with what ``Search.found`` gives for its rows, of all blocks; one block is ready at a time."""
    arrays.keep_memory()
    ready: tuple[int, Search] | None = None

    def searched(group: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        nonlocal ready
        bests: list[dict] = [{} for _ in group]
        for k, (items, sizes, words, answer_sizes, answers) in enumerate(blocks.value):
            if ready is None or ready[0] != k:
                ready = None
                parts = zip(items.tolist(), np.split(words, np.cumsum(sizes)[:-1]), np.split(answers, np.cumsum(answer_sizes)[:-1]))
                ready = k, Search([Passage(item, w, set(x.tolist())) for item, w, x in parts], scaled.value)
            for batch, best in zip(group, bests):
                for a, b, data, offs in arrays.blocks(batch.column(column)):
                    word, doc = words_of(data, offs)
                    first = arrays.counts_by_doc(doc, b - a)[1]
                    for (d, item), (share, at) in ready[1].found(word, first).items():
                        if share > best.get((a + d, item), (0.0, 0))[0]:
                            best[a + d, item] = (share, at)
        yield from zip(group, bests)

    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.column(column).nbytes
        if len(blocks.value) == 1 or size >= TEXT_BYTES:
            yield from searched(group)
            group, size = [], 0
    yield from searched(group)


def _rows(batches: Iterator[pa.RecordBatch], blocks: Broadcast, scaled: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch, best in _found(batches, 1, blocks, scaled):
        rows = [(d, item, share, at) for (d, item), (share, at) in sorted(best.items())]
        ids = batch.column(0).cast(pa.int64()).take(pa.array([r[0] for r in rows], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]], names=["doc_id", "item_id", "share", "near_word"])


def _clean_rows(batches: Iterator[pa.RecordBatch], blocks: Broadcast, scaled: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch, best in _found(batches, 0, blocks, scaled):
        keep = np.ones(batch.num_rows, bool)
        keep[[d for d, _ in best]] = False
        yield batch.filter(pa.array(keep))


def _scans(documents: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str, answer_column: str | None) -> tuple[list[Broadcast], Broadcast | None]:
    """Broadcast blocks of passages, for each scan of the documents; and the broadcast latent vectors of the buckets."""
    spark = documents.sparkSession
    small_batches(spark)
    binary = "sizes binary, buckets binary, times binary"
    entries = written(documents.select(text_column).mapInArrow(_text_entries, binary), "entries")
    weights, n_passages = idf(entries)
    passages, n_blocks = passages_of(benchmark, weights, item_column, item_text, answer_column)
    if passages.isEmpty():
        return [], None
    asked = written(passages.select("words").mapInArrow(_list_entries, binary), "entries")
    vectors = singular_vectors([(entries, n_passages), (asked, passages.count())], weights)
    scaled = np.vstack((vectors * weights[:, None].astype(np.float32), np.zeros((1, vectors.shape[1]), np.float32)))  # and no word
    scans = []
    for low in range(0, n_blocks, SCAN):
        rows = passages.where((F.col("block") >= low) & (F.col("block") < low + SCAN)).orderBy("block", "item", "number").toArrow().combine_chunks()
        block = rows.column("block").to_numpy()
        blocks = []
        for k in np.unique(block):
            own = rows.slice(int(np.searchsorted(block, k)), int((block == k).sum())).combine_chunks()
            lists = [own.column(c).combine_chunks() for c in ("words", "answer")]
            flat = [x for one in lists for x in (np.diff(one.offsets.to_numpy()), one.flatten().to_numpy().view(U))]
            blocks.append((own.column("item").to_numpy(), *flat))
        if blocks:
            scans.append(spark.sparkContext.broadcast(blocks))
    return scans, spark.sparkContext.broadcast(scaled)


def contaminated(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", answer_column: str | None = None
) -> DataFrame:
    """Rows (doc_id, item_id, share, near_word): documents in which a benchmark item's passage was found.

    share is the largest part of a passage that is a common subsequence with a stretch of the text,
    near_word the first word of that stretch.  Documents without a row are clean.

    Defined results: null or wordless texts and items are found nowhere and contain nothing; there is
    one row for a doc_id and an item, of the largest share (of equal ones, the first word); rows with
    null ids are reported as one id, null; items without an id are not searched; an empty table gives
    an empty table; extra columns are ignored.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scans, scaled = _scans(documents, benchmark, id_column, text_column, item_column, item_text, answer_column)
    schema = "doc_id long, item_id long, share double, near_word long"
    if not scans:
        return documents.sparkSession.createDataFrame([], schema)
    out = None
    for blocks in scans:
        found = rows.mapInArrow(lambda batches, b=blocks: _rows(batches, b, scaled), schema)
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", (-F.col("near_word")).alias("at"))).alias("best"))
    best = written(best.select("doc_id", "item_id", "best.share", (-F.col("best.at")).alias("near_word")), "found")
    for shared in (*scans, scaled):
        shared.destroy()
    return best


def clean(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", answer_column: str | None = None) -> DataFrame:
    """The documents in which no benchmark item was found, all columns kept; a filter, without a join or a shuffle.

    Defined results: rows with null or wordless texts stay; rows with null ids are judged by their
    texts like others; repeated rows stay or go together; with an empty
    benchmark all stay; an empty table gives an empty table; column names may clash with any used here.
    """
    own = documents.columns
    rows = documents.select(F.col(f"`{text_column}`").cast("string").alias("text__"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    scans, scaled = _scans(documents, benchmark, id_column, text_column, item_column, item_text, answer_column)
    for blocks in scans:
        rows = rows.mapInArrow(lambda batches, b=blocks: _clean_rows(batches, b, scaled), rows.schema)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
