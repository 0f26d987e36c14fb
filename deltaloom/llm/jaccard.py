"""Set-similarity self-join of word shingles by parity sketches.

A document's set is its distinct shingles.  Sets of like size (a size band) are cut by a hash into
chunks, and of each chunk the *parity sketch* is taken: every shingle toggles bits of it, so the sketch
depends on the set alone, shingles that two sets share cancel in the XOR of their sketches, and the
Hamming distance of two sketches is bounded by the size of their symmetric difference.  Two sets whose
Jaccard similarity reaches the threshold differ in at most D = (a+b)(1-t)/(1+t) shingles; a band has
more than D chunks, so (pigeonhole) some chunk of theirs has no differing shingle and equal sketches.
Equal chunk sketches are found by one shuffle on their hash, and candidates are verified on the sets.

*No link is lost.*  A chunk without shingles has no sketch, so a band has ``slack`` chunks over D + 1:
of two sets, one of which has at most ``slack`` empty chunks, D + 1 chunks or more have shingles of
either, of which at most D differ.  Sets with more empty chunks are cut anew by another hash as well,
up to ``SEEDS`` times; those that have too many each time share one key of their band.

Sets are named by 128 bits, of which rows of chunks carry the first half (sets that share it are all
candidates); a link is verified on 64-bit names of shingles.

Equal sets are one class from the start, in which no pairs are made.  Within the sets of a chunk, each
is first paired with one pivot; only for chunks whose sets are then not all connected, the remaining
pairs are taken, each in about one of the chunks that its sets share (``LEAST_KEYS``).  A pair is
verified on its sets only if its sizes and the Hamming distance of its whole sketches allow the
similarity.  Thus large groups of near copies make few pairs, and few sets are shuffled.  Hot chunks,
pivots and sets are split by salting.

Texts are read to find the sets, once more to cut them to chunks (so that chunks are not stored), and
those of candidates once more to verify them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import arrays
from deltaloom.llm.graph import components
from deltaloom.llm.storage import Scratch, looked_up, sized, small_batches, spread

#: Longs of a set's whole parity sketch, for the Hamming test: a power of two, so many at least, and a bit for each shingle.
LONGS = 8
#: How often a set with many empty chunks is cut.
SEEDS = 3
#: Chunk keys that more than about so many sets share are split by salting; found on one set in SAMPLE.
HOT = 131_072
SAMPLE = 64
SALTS = 64
#: Of its keys whose sets are not all connected, a set carries so many, the least, to meet a partner in few of those they share.
LEAST_KEYS = 8
#: Sets of a task that it remembers having given keys for.
REMEMBERED = 1_000_000

PROFILE = "doc_id long, n int, set_id struct<a:long,b:long>, sketch array<long>, keys array<long>"
SET = "set_id struct<a:long,b:long>, homes array<struct<a:long,b:long>>, elements array<long>"
U = np.uint64


@lru_cache(16)
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least sizes of the size bands, chunks that each band's sets are cut into, and how many of them may be empty.

    Band k serves pairs whose larger set is in [low[k], low[k+1]); the smaller has num/den of it at least.
    Where no two different sets of a band can be alike, it has no chunks.
    """
    low, chunks, slack = [1], [], []
    while low[-1] < 1 << 31:
        low.append(max(low[-1] + 1, -(-low[-1] * den // num)))
        top, least = low[-1] - 1, -(-low[-2] * num // den)
        differ = 2 * top * (den - num) // (den + num)
        empty = 1 + int(2 * (differ + 1) * math.exp(-least / (differ + 1)))
        chunks.append(differ + 1 + empty if differ else 0)
        slack.append(empty)
    return np.array(low[:-1]), np.array(chunks), np.array(slack)


def set_names(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each document's set, as two longs."""
    size = arrays.mix64(np.diff(first).astype(U))
    names = []
    for seed in (U(0), U(0xA5A3564E27F8865B)):
        total = np.concatenate(([U(0)], np.cumsum(arrays.mix64(values ^ seed))))
        names.append(arrays.mix64((total[first[1:]] - total[first[:-1]]) ^ size).view(np.int64))
    return names[0], names[1]


def chunk_keys(values: np.ndarray, first: np.ndarray, wanted: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chunk sketches of the wanted documents, and the document of each, in document order."""
    low, chunks, slack = bands(num, den)
    n = np.diff(first)
    own = np.searchsorted(low, n, "right") - 1
    got, got_doc = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for step in (0, 1):  # a document's own band, and the next if a partner may be there
        band = own + step
        fits = wanted & (n > 0) & (n * den >= low[np.maximum(band, 0)] * num)
        for k in np.unique(band[fits]).tolist():
            c = int(chunks[k])
            docs = np.flatnonzero(fits & (band == k))
            for seed in range(SEEDS if c else 0):
                sizes = n[docs]
                element = values[arrays.ranges(first[docs], sizes)]
                mixed = arrays.mix64(element ^ arrays.mix64(np.array([k * SEEDS + seed + 1], U)))
                chunk = (((mixed >> U(32)) * U(c)) >> U(32)).astype(np.int64) + np.repeat(np.arange(len(docs)) * c, sizes)
                sketch = np.zeros(len(docs) * c, U)
                np.bitwise_xor.at(sketch, chunk, arrays.mix64(mixed | U(1)))
                full = np.zeros(len(docs) * c, bool)
                full[chunk] = True
                at = np.flatnonzero(full)
                got.append(arrays.mix64(sketch[at] + arrays.mix64((at % c).astype(U) + U((k * SEEDS + seed + 1) << 32))))
                got_doc.append(docs[at // c])
                docs = docs[c - full.reshape(len(docs), c).sum(axis=1) > slack[k]]
                if not len(docs):
                    break
            if c and len(docs):
                got.append(np.full(len(docs), arrays.mix64(np.array([k], U))[0]))
                got_doc.append(docs)
    keys, doc = np.concatenate(got), np.concatenate(got_doc)
    order = np.argsort(doc, kind="stable")
    return keys[order].view(np.int64), doc[order]


def whole_sketches(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketches of the documents' whole sets, end to end, and where each begins.

    A sketch has a power of two of longs, as many bits as the set has shingles and 64 * LONGS at least: a
    sketch much smaller than its set is half full whatever the set, and tells nothing.  The half of it
    folded on the other by XOR is the set's sketch of half the length.
    """
    n = np.diff(first)
    longs = LONGS << np.ceil(np.log2(np.maximum(n, 1) / (64 * LONGS))).astype(np.int64).clip(0)
    bounds = np.concatenate(([0], np.cumsum(longs)))
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros(bounds[-1], U)
    at = bounds[doc] + ((values >> U(6)) % longs[doc].astype(U)).astype(np.int64)
    np.bitwise_xor.at(out, at, U(1) << (values & U(63)))
    return out, bounds


def _sets(data: np.ndarray, offs: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    word, doc = arrays.words(arrays.ASCII_LOWER[data], offs)
    got, got_doc = arrays.shingles(word, doc, len(offs) - 1, n_words)
    return arrays.sets_by_doc(got, got_doc, len(offs) - 1)


def _struct(a: np.ndarray, b: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"], mask=None if null is None else pa.array(null))


class _Seen:
    """Which sets of documents with an id are new to this task, as far as it remembers."""

    def __init__(self):
        self.names: set[tuple[int, int]] = set()

    def new(self, names: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        if len(self.names) > REMEMBERED:
            self.names.clear()
        out = np.zeros(len(wanted), bool)
        for i in np.flatnonzero(wanted).tolist():
            name = (int(names[0][i]), int(names[1][i]))
            if name not in self.names:
                self.names.add(name)
                out[i] = True
        return out


def _profiles(batches: Iterator[pa.RecordBatch], n_words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to their sets' sizes, names and sketches, and chunk keys of one set in SAMPLE."""
    seen = _Seen()
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(1)):
            values, first = _sets(data, offs, n_words)
            names, sizes = set_names(values, first), np.diff(first)
            ids = batch.column(0).slice(a, b - a).cast(pa.int64())
            sampled = seen.new(names, ids.is_valid().to_numpy(zero_copy_only=False) & (names[0] % SAMPLE == 0))
            keys, doc = chunk_keys(values, first, sampled, num, den)
            bounds = arrays.counts_by_doc(doc, b - a)[1]
            longs, begin = whole_sketches(values, first)
            sketches = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(longs.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes.astype(np.int32)), _struct(*names, sizes == 0), sketches, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys))],
                names=["doc_id", "n", "set_id", "sketch", "keys"],
            )


def _chunks(batches: Iterator[pa.RecordBatch], n_words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (chunk key, first half of the set's name), once for equal sets as far as the task remembers."""
    seen = _Seen()
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(1)):
            values, first = _sets(data, offs, n_words)
            names = set_names(values, first)
            wanted = batch.column(0).slice(a, b - a).is_valid().to_numpy(zero_copy_only=False) & (np.diff(first) > 0)
            keys, doc = chunk_keys(values, first, seen.new(names, wanted), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names[0][doc])], names=["key", "a"])


def _wanted_sets(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (set_id, text, homes) to the sets of those names, once a task for repeated rows."""
    seen = _Seen()
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(1)):
            values, first = _sets(data, offs, n_words)
            ids = batch.column(0).slice(a, b - a)
            names = set_names(values, first)
            asked = [x.to_numpy(zero_copy_only=False) for x in ids.flatten()]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
            keep = seen.new(names, (names[0] == asked[0]) & (names[1] == asked[1]))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(a, b - a), lists], names=["set_id", "homes", "elements"]).filter(pa.array(keep))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, a), sorted, to (key, salt, a, pivot) of keys with two sets at least; salted keys wholly.

    The pivot is the key's first set.  A key of one set is held back until its second set comes.
    """
    last = None  # the row before: key, salt, a
    pivot = 0
    alone = False  # the pivot of the key under way is not given yet
    for batch in batches:
        k, s, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        new[0] = last is None or (k[0], s[0]) != last[:2]
        fresh = new.copy()
        fresh[1:] |= a[1:] != a[:-1]
        fresh[0] |= last is None or a[0] != last[2]
        heads = np.flatnonzero(new)
        goes_on = not new[0]  # the first run began in a batch before
        if goes_on:
            heads = np.concatenate(([0], heads))
        run = np.cumsum(new) - (0 if goes_on else 1)
        pivots = a[heads].copy()
        if goes_on:
            pivots[0] = pivot
        more = np.bincount(run[fresh & ~new], minlength=len(heads)) > 0
        give = (fresh & ~new) | (new & (more[run] | (s > 0)))
        parts = [k[give], s[give], a[give], pivots[run[give]]]
        if goes_on and more[0] and alone:
            parts = [np.concatenate(([x], p)) for x, p in zip((*last[:2], pivot, pivot), parts)]
        if goes_on and len(heads) == 1:
            alone = alone and not more[0]
        else:
            alone = not more[-1] and s[-1] == 0
        last, pivot = (k[-1], s[-1], a[-1]), int(pivots[-1])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], names=["key", "salt", "a", "pivot"])


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n_words: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of set ids whose sets, each from the text of one of its documents, reach the similarity.

    The second set of a pair stays where it is, and the first travels to it straight from its text; a
    set of many pairs is joined in parts.
    """
    n = pairs.count()
    # the set of more pairs is the one that stays: so no set has more than sqrt(2 n) others to travel to
    many = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "degrees")
    degree = lambda c: many.select("id", F.col("n").alias(c))
    pairs = spread(spread(pairs, degree("n_a"), "a", "id", "b", n), degree("n_b"), "b", "id", "a", n)
    turned = F.col("n_a") > F.col("n_b")
    pairs = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    pairs = scratch.written(pairs, "turned")
    asked = pairs.select(F.col("a").alias("set_id"), F.col("b").alias("home")).union(pairs.select("b", "b").distinct())
    asked = asked.join(nodes.select("set_id", "id"), "set_id").select("set_id", "home", F.col("id").alias("doc_id"))
    asked = scratch.written(asked.groupBy("doc_id", "set_id").agg(F.collect_list("home").alias("homes")), "asked")
    found = texts.join(sized(asked), "doc_id").select("set_id", "text", "homes").mapInArrow(lambda b: _wanted_sets(b, n_words), SET)
    sets = found.select("set_id", F.explode("homes").alias("home"), "elements")
    sets = scratch.written(sets, "sets")
    first = sets.where("set_id <> home").select(F.col("set_id").alias("a"), F.col("home").alias("b"), F.col("elements").alias("x"))
    second = sets.where("set_id = home").dropDuplicates(["home"]).select(F.col("home").alias("id"), F.col("elements").alias("y"))
    both = spread(first, second, "b", "id", "a", n)
    shared = F.size(F.array_intersect("x", "y"))
    return scratch.written(both.where(shared * (den + num) >= num * (F.size("x") + F.size("y"))).select("a", "b").distinct(), "links")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def _near(num: int, den: int) -> Column:
    """Whether sizes and whole sketches (size1, sketch1 and size2, sketch2) allow the similarity.

    Sets of fitting sizes have sketches of equal length, or one of twice the other's, which is folded.
    """
    one, two = F.col("sketch1"), F.col("sketch2")
    short = F.least(F.size(one), F.size(two))
    xor = lambda x, y: x.bitwiseXOR(y)
    cut = lambda s: F.when(F.size(s) == short, s).otherwise(F.zip_with(F.slice(s, F.lit(1), short), F.slice(s, short + 1, short), xor))
    wide = F.aggregate(F.zip_with(cut(one), cut(two), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)
    least = sum(F.bit_count(one[i].bitwiseXOR(two[i])) for i in range(LONGS))
    apart = F.when((F.size(one) == LONGS) & (F.size(two) == LONGS), least).otherwise(wide)
    sizes = (F.col("size1") * den >= F.col("size2") * num) & (F.col("size2") * den >= F.col("size1") * num)
    return sizes & (apart * (den + num) <= (F.col("size1") + F.col("size2")) * (den - num))


def _remaining(member: DataFrame, mixed: DataFrame, labelled: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a key and that sizes and sketches allow, most of them once.

    ``mixed`` has the keys of several components, the largest of these (top) and in how many parts the
    sets outside it meet all sets of the key; ``member`` has the keys' sets.  Two sets of different
    components meet once in each such key that they share, as one of them is outside.  Each carries
    its ``LEAST_KEYS`` least keys, and where a lesser key is among both sets' they have met there.
    """
    member = member.join(mixed, "key")
    least = member.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LEAST_KEYS).alias("keys"))
    member = member.join(least.join(labelled.select("set_id", "size", "sketch"), "set_id"), "set_id")
    columns = ("set_id", "comp", "size", "sketch", "keys")
    one = member.where("comp <> top").select("key", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{c}1") for c in columns])
    two = member.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (F.col("comp") == F.col("top")).alias("inside"), *[F.col(c).alias(f"{c}2") for c in columns])
    met = (F.col("one.key") == F.col("two.key")) & (F.col("one.part") == F.col("two.part")) & (F.col("comp1") != F.col("comp2"))
    once = F.col("inside") | (F.col("set_id1") < F.col("set_id2"))  # two sets outside meet from both sides
    here = F.coalesce(F.array_min(F.array_intersect("keys1", "keys2")) >= F.col("one.key"), F.lit(True))
    joined = one.alias("one").join(two.alias("two"), met & once & _near(num, den) & here)
    return joined.select(F.least("set_id1", "set_id2").alias("a"), F.greatest("set_id1", "set_id2").alias("b"))


def jaccard_join(documents: DataFrame, n_words: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and n_spanning_links of its set.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of shingles of
    ``n_words`` words (words: runs of non-white-space, A-Z lower-cased; a shorter text is one shingle).
    component_id is the smallest doc_id that links lead to.  n_spanning_links counts the links of the
    document's set that were verified: they connect each component; links to copies, and links
    between sets that others connect already, are not among them.

    Defined results: null or wordless texts have no shingles, link with nothing and are their own
    component; repeated rows are in one component; a null doc_id is never the smallest, and a set
    whose documents all have null ids links only with equal sets (component_id null there);
    an empty table gives an empty table; extra columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "jaccard")
    small_batches(documents.sparkSession)
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    profiles = scratch.written(texts.mapInArrow(lambda b: _profiles(b, n_words, num, den), PROFILE), "profiles")
    of_sets = profiles.where("set_id IS NOT NULL").groupBy("set_id")
    nodes = scratch.written(of_sets.agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("n").alias("size"), F.first("sketch").alias("sketch")), "nodes")

    sampled = profiles.select(F.explode("keys").alias("key"), "set_id")
    hot = scratch.written(sampled.groupBy("key").agg(F.count_distinct("set_id").alias("n")).where(F.col("n") >= HOT // SAMPLE).select("key"), "hot")
    some_hot = hot.count()
    rows, salt = texts.mapInArrow(lambda b: _chunks(b, n_words, num, den), "key long, a long"), F.lit(0)
    if some_hot:
        rows = rows.join(sized(hot.select("key", F.lit(True).alias("is_hot")), some_hot), "key", "left")
        rows = rows.withColumn("salt", F.when(F.col("is_hot"), F.pmod("a", F.lit(SALTS)) + 1).otherwise(0)).repartition("key", "salt")
        salt = F.col("salt")
    else:
        rows = rows.repartition("key")
    # few different pivots for all keys of a group: the set of least hash, by one of four hashes
    dealt = rows.select("key", salt.cast("long").alias("salt"), "a").sortWithinPartitions("key", "salt", F.xxhash64("a", F.col("key").bitwiseAND(F.lit(3))), "a")
    shared = scratch.written(dealt.mapInArrow(_stars, "key long, salt long, a long, pivot long"), "shared")

    first = _pairs(shared, "a", "pivot")
    if some_hot:
        pivots = shared.where("salt > 0").select("key", "pivot").distinct()
        tops = pivots.groupBy("key").agg(F.min("pivot").alias("top"))
        first = first.union(_pairs(pivots.join(tops, "key"), "pivot", "top")).distinct()
    first = scratch.written(first, "candidates")
    n = first.count()
    side = lambda i: nodes.select(F.col("set_id.a").alias("half"), *[F.col(c).alias(f"{c}{i}") for c in ("set_id", "size", "sketch")])
    first = spread(spread(first, side(1), "a", "half", "b", n), side(2), "b", "half", "a", n).where(_near(num, den))
    first = scratch.written(_pairs(first, "set_id1", "set_id2"), "pairs")
    links = _verified(first, nodes, texts, n_words, num, den, scratch)
    comps = components(links, written=scratch.written)

    # keys whose sets are not all connected: the rest of the pairs
    labelled = nodes.join(comps.withColumnRenamed("node", "set_id"), "set_id", "left").select(F.col("set_id.a").alias("a"), "set_id", F.coalesce("comp", "set_id").alias("comp"), "size", "sketch")
    labelled = scratch.written(labelled, "labelled")
    member = scratch.written(shared.select("key", "a").distinct().join(labelled.select("a", "set_id", "comp"), "a").drop("a"), "members")
    per = member.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("outside")).where("parts > 1")
    mixed = scratch.written(mixed.select("key", "top", F.ceil(F.col("outside") / 256).cast("int").alias("parts")), "mixed")
    rest = _remaining(member, mixed, labelled, num, den).distinct().join(first, ["a", "b"], "left_anti")
    rest = scratch.written(rest, "pairs")
    if not rest.isEmpty():
        links = links.union(_verified(rest, nodes, texts, n_words, num, den, scratch))
        comps = components(links, written=scratch.written)

    ends = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    smallest = comps.join(nodes.select(F.col("set_id").alias("node"), "id"), "node").groupBy("comp").agg(F.min("id").alias("least"))
    linked = comps.join(smallest, "comp").select(F.col("node").alias("set_id"), "least").join(ends, "set_id")
    named = nodes.join(linked, "set_id", "left").select("set_id", "copies", F.coalesce("least", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = scratch.written(named, "named")
    empty = profiles.where("set_id IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("n_links"))
    full = looked_up(profiles.where("set_id IS NOT NULL").select("doc_id", "n", "set_id"), named, ["set_id"], "copies", profiles.count())
    result = full.select("doc_id", "n", "component", "n_links").union(empty).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.col("n_links").alias("n_spanning_links")
    )
    return scratch.result(result, "groups")


def one_of_each_group(documents: DataFrame, n_words: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with the smallest id of their group.

    Defined results: rows without an id stay; of repeated rows (equal id and text) one stays; an id
    that is the smallest of one group stays in another, too, if it has several texts; rows without
    words stay; an empty table gives an empty table; all columns are kept.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "groups")
    found = jaccard_join(documents, n_words, num, den, id_column, text_column)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("n"))
    goes = scratch.written(ids.where("NOT stays").select(F.col("doc_id").alias(id_column)), "goes")
    again = scratch.written(ids.where("stays AND n > 1").select(F.col("doc_id").alias(id_column)), "again")
    stay = documents.join(sized(goes), id_column, "left_anti")
    if not again.isEmpty():
        again = sized(again)
        stay = stay.join(again, id_column, "left_anti").unionByName(stay.join(again, id_column, "left_semi").dropDuplicates([id_column, text_column]))
    return stay.select(documents.columns)
