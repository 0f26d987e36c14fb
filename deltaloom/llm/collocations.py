"""Collocations: phrases whose words stand together far more often than their parts would, per language.

Phrases are counted by pivots.  The pivot of a phrase is its rarest word (the first of the largest in
an order of words that all tasks share), so each phrase has one.  Around every word of a piece the
longest run is cut out in which it is the rarest, at most ``most - 1`` words to either side: that
fragment holds every phrase of which this occurrence is the pivot, and nothing of the other words.
Equal fragments are counted before they are shuffled, fragments go to their pivot's partition, and
there they are taken apart and counted; no other partition has the same phrase, so nothing is
shuffled again.  A pivot with more than one in ``HEAVY`` of all words has its phrases dealt one by one
to parts, each phrase to one part.

The order has the ``LISTED`` most frequent words by frequency (the only thing that is broadcast); rarer
words follow by a hash.  Any order gives each phrase one pivot, so counts are exact with any list.
Words below the least count are cut out where the list has all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm import arrays
from deltaloom.llm.storage import Scratch, sized, small_batches

#: Words of a phrase at most, its least count, phrases of a language that are returned, and hundredths of a phrase's occurrences inside a longer one that drop it.
MOST, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: (language, word) pairs that are ordered by frequency, at most.
LISTED = 1 << 19
#: A pivot with more than one in so many of all words is dealt to parts.
HEAVY = 512
#: Distinct rows that a task counts before it gives them out.
HELD = 1 << 20
#: What ends a piece, and what separates words.
ENDS, BLANKS = arrays.byte_table(b".,;:!?\n\x0b\x0c\r"), arrays.byte_table(b" \t")
#: Comes after all words: such words are cut out.
LAST = np.iinfo(np.int64).max
U = np.uint64

WORDS = "lang string, word string, n long"
FRAGMENTS = "route long, lang string, at int, fragment string, n long"


@dataclass
class Pieces:
    """The words of a block with one blank behind each, and which of them go on in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    goes_on: np.ndarray  # word i and word i + 1 are in one piece; one entry less than words

    @classmethod
    def of(cls, data: np.ndarray, offs: np.ndarray) -> Pieces:
        data = arrays.ASCII_LOWER[data]
        ends_here = ENDS[data]
        starts, ends, doc = arrays.spans(~(ends_here | BLANKS[data]), offs)
        piece = np.concatenate(([0], np.cumsum(ends_here)))[starts]
        sizes = ends - starts + 1
        close = np.append(data, np.uint8(32))[arrays.ranges(starts, sizes)]
        after = np.cumsum(sizes)
        close[after - 1] = 32
        return cls(close, after - sizes, after - 1, doc, (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1]))

    def texts(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The runs of words from ``first`` to ``last``."""
        a, b = self.starts[first], self.ends[last]
        bounds = np.concatenate(([0], np.cumsum(b - a)))
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data[arrays.ranges(a, b - a)])))


def tallied(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with equal keys as one, n summed; at most about ``HELD`` of them are held."""
    held, rows = [], 0

    def summed() -> pa.Table:
        got = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return got.rename_columns([*keys, "n"]) if got.column_names[-1] == "n_sum" else got.select([*keys, "n_sum"]).rename_columns([*keys, "n"])

    for table in tables:
        held.append(table)
        rows += len(table)
        if rows > HELD:
            held = [summed()]
            rows = len(held[0])
            if rows > HELD // 2:
                yield from held[0].combine_chunks().to_batches(max_chunksize=100_000)
                held, rows = [], 0
                arrays.give_back()
    if held:
        yield from summed().combine_chunks().to_batches(max_chunksize=100_000)


def _langs(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0).cast(pa.string())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, word, n)."""

    def tables() -> Iterator[pa.Table]:
        for batch in batches:
            for a, b, data, offs in arrays.blocks(batch.column(1)):
                p = Pieces.of(data, offs)
                every = np.arange(len(p.starts))
                yield pa.table({"lang": _langs(batch).slice(a, b - a).take(pa.array(p.doc)), "word": p.texts(every, every), "n": pa.array(np.ones(len(every), np.int64))})

    return tallied(tables(), ["lang", "word"])


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A 64-bit key of each (language, word); ``lang`` has the hashes of the languages."""
    return arrays.mix64(arrays.span_hashes(data, starts, ends) ^ arrays.mix64(lang))


def text_hashes(texts: pa.Array) -> np.ndarray:
    out = [np.zeros(0, U)]
    for _, _, data, offs in arrays.blocks(texts):
        out.append(arrays.span_hashes(data, offs[:-1], offs[1:]))
    return np.concatenate(out)


@dataclass
class Order:
    """Keys of the listed words, sorted; their ranks, 0 for the most frequent; parts that a pivot is dealt to; whether every frequent word is listed."""

    keys: np.ndarray
    ranks: np.ndarray
    parts: np.ndarray
    whole: bool

    @classmethod
    def of(cls, listed: pa.Table, total: int, whole: bool) -> Order:
        """From rows (lang, word, f)."""
        listed = listed.combine_chunks()
        get = lambda c: listed[c].chunk(0) if listed[c].num_chunks else pa.array([], listed[c].type)
        keys = arrays.mix64(text_hashes(get("word")) ^ arrays.mix64(text_hashes(get("lang"))))
        f = get("f").to_numpy(zero_copy_only=False)
        order = np.lexsort((keys, -f))
        ranks = np.empty(len(keys), np.int64)
        ranks[order] = np.arange(len(keys))
        parts = np.where(f * HEAVY > total, f * HEAVY // max(total, 1) + 1, 1)
        by_key = np.argsort(keys)
        return cls(keys[by_key], ranks[by_key], parts[by_key], whole)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand in the order, and the parts of each as a pivot."""
        rare = np.full(len(keys), LAST) if self.whole else (len(self.keys) + (keys >> U(8)).astype(np.int64))
        if not len(self.keys):
            return rare, np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ranks[at], rare), np.where(known, self.parts[at], 1)


def reach(place: np.ndarray, goes_on: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left come before each word in the order, and to the right before it or level with it, without a gap."""
    n = len(place)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    so_far, ahead = np.ones(n, bool), np.ones(n, bool)
    for d in range(1, min(most, n)):
        near = np.zeros(n, bool)
        near[d:] = so_far[d:] & goes_on[: n - d] & (place[:-d] < place[d:])
        so_far = near
        left += near
        near = np.zeros(n, bool)
        near[:-d] = ahead[:-d] & goes_on[d - 1 :] & (place[d:] <= place[:-d])
        ahead = near
        right += near
    return left, right


def _fragments(batches: Iterator[pa.RecordBatch], order: Order, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (route, lang, at, fragment, n): where to, the pivot's place in the fragment, or -1 for a phrase of a heavy pivot."""

    def tables() -> Iterator[pa.Table]:
        for batch in batches:
            hashes = text_hashes(_langs(batch))
            for a, b, data, offs in arrays.blocks(batch.column(1)):
                p = Pieces.of(data, offs)
                if not len(p.starts):
                    continue
                keys = word_keys(p.data, p.starts, p.ends, hashes[a:b][p.doc])
                place, parts = order.places(keys)
                left, right = reach(place, p.goes_on, most)
                owns = (place < LAST) & (left + right > 0)
                light = np.flatnonzero(owns & (parts == 1))
                first, last, at, route, pivot = [light - left[light]], [light + right[light]], [left[light]], [keys[light]], [light]
                heavy = owns & (parts > 1)
                for x in range(most):
                    for y in range(most - x):
                        i = np.flatnonzero(heavy & (left >= x) & (right >= y)) if x + y else light[:0]
                        own = arrays.span_hashes(p.data, p.starts[i - x], p.ends[i + y]) if len(i) else keys[:0]
                        first.append(i - x)
                        last.append(i + y)
                        at.append(np.full(len(i), -1))
                        route.append(arrays.mix64(keys[i] + U(1) + own % parts[i].astype(U)))
                        pivot.append(i)
                doc = p.doc[np.concatenate(pivot)]
                yield pa.table({
                    "route": pa.array(np.concatenate(route).view(np.int64)),
                    "lang": _langs(batch).slice(a, b - a).take(pa.array(doc)),
                    "at": pa.array(np.concatenate(at).astype(np.int32)),
                    "fragment": p.texts(np.concatenate(first), np.concatenate(last)),
                    "n": pa.array(np.ones(len(doc), np.int64)),
                })

    return tallied(tables(), ["route", "lang", "at", "fragment"])


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of rows (lang, text)."""
    return rows.mapInArrow(_words, WORDS).groupBy("lang", "word").agg(F.sum("n").alias("f"))


def order_of(words: DataFrame, least: int, listed: int) -> Order:
    frequent = words.where(F.col("f") >= least)
    n, total = words.agg(F.count_if(F.col("f") >= least), F.coalesce(F.sum("f"), F.lit(0))).first()
    chosen = frequent if n <= listed else frequent.orderBy(F.desc("f"), "lang", "word").limit(listed)
    return Order.of(chosen.select("lang", "word", "f").toArrow(), total, n <= listed)


def phrase_counts(rows: DataFrame, words: DataFrame, most: int = MOST, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """(lang, phrase, a) of the phrases of 2 to ``most`` words that rows (lang, text) have ``least`` times at least."""
    order = rows.sparkSession.sparkContext.broadcast(order_of(words, least, listed))
    found = rows.mapInArrow(lambda batches: _fragments(batches, order.value, most), FRAGMENTS).repartition("route")
    found = found.withColumn("words", F.split("fragment", " ", -1))
    right = F.size("words") - 1 - F.col("at")
    owned = [
        F.when((F.col("at") >= x) & (right >= y), F.array_join(F.slice("words", F.col("at") - x + 1, F.lit(x + y + 1)), " "))
        for x in range(most) for y in range(most - x) if x + y
    ]
    phrases = F.array(F.when(F.col("at") < 0, F.col("fragment")), *owned)
    # a phrase has one route, so its partition has all of it
    mined = found.select("route", "lang", F.explode(phrases).alias("phrase"), "n").where("phrase IS NOT NULL").groupBy("route", "lang", "phrase").agg(F.sum("n").alias("a"))
    return mined.where(F.col("a") >= least).select("lang", "phrase", "a")


def part(phrase: str, begin, length) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), begin, length), " ")


def collocations(
    documents: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, inside: int = INSIDE, lang_column: str = "lang", text_column: str = "text", listed: int = LISTED
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score.

    Texts are lower-cased (A-Z), cut to pieces at ``. , ; : ! ?`` and line ends, and those to words at
    blanks and tabs.  a is how often a phrase of 2 to ``most`` words stands in pieces, overlaps
    included; n counts the language's words.  Cutting a phrase in two, l and r are the counts of the
    parts and the score is floor(1000000 a a / (l r)), in exact decimals; the cut of least score counts,
    of several the first.  A phrase goes if ``inside`` hundredths of its occurrences are as many as
    those of a longer counted phrase that has its words side by side.

    Defined results: a null language is ``und``; null, empty and wordless texts have no words; repeated
    rows count again; texts of any length are read whole; an empty table gives an empty table; extra
    columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "collocations")
    small_batches(documents.sparkSession)
    rows = documents.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    words = scratch.written(word_counts(rows), "words")
    found = scratch.written(phrase_counts(rows, words, most, least, listed), "phrases")
    n_words = F.size(F.split("phrase", " ", -1))

    units = words.where(F.col("f") >= least).select("lang", F.col("word").alias("unit"), "f").union(found.where(n_words < most).select("lang", "phrase", "a"))
    cuts = found.withColumn("size", n_words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part("phrase", F.lit(1), F.col("k")).alias("first"), part("phrase", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(units.select("lang", F.col("unit").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(units.select("lang", F.col("unit").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(1000000 AS DECIMAL(38, 0)) * a * a) div (CAST(l AS DECIMAL(38, 0)) * r)")
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    spans = [(b, size) for size in range(2, most) for b in range(1, most - size + 2)]
    parts = F.array(*[F.when(n_words >= b + size - 1, F.when(n_words > size, part("phrase", F.lit(b), F.lit(size)))) for b, size in spans]) if spans else F.array().cast("array<string>")
    longer = found.select("lang", F.explode(F.array_distinct(F.array_compact(parts))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * inside, F.lit(True)))

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = stay.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    totals = scratch.written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    out = ranked.join(sized(totals), "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    return scratch.result(out, "collocations")


def oracle_sql(least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> str:
    """The same for phrases of two and three words in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    score = "(1000000::HUGEINT * a * a) // (l::HUGEINT * r)"
    return f"""WITH p AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, words FROM (SELECT coalesce(lang, 'und') AS lang,
        regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words FROM documents)),
      u AS (SELECT lang, piece, unnest(words) AS w, unnest(range(len(words))) AS i FROM p),
      v AS MATERIALIZED (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
      one AS MATERIALIZED (SELECT lang, w AS phrase, count(*) AS f FROM v GROUP BY ALL),
      two AS MATERIALIZED (SELECT lang, w, w2, w || ' ' || w2 AS phrase, count(*) AS a FROM v WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
      three AS MATERIALIZED (SELECT lang, w, w2, w3, w || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS a FROM v WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
      units AS (SELECT lang, phrase, f FROM one UNION ALL SELECT lang, phrase, a FROM two),
      cuts AS (SELECT lang, phrase, a, 1 AS k, w AS first, w2 AS rest FROM two
        UNION ALL SELECT lang, phrase, a, 1, w, w2 || ' ' || w3 FROM three UNION ALL SELECT lang, phrase, a, 2, w || ' ' || w2, w3 FROM three),
      scored AS (SELECT *, {score} AS score FROM (SELECT c.*, x.f AS l, y.f AS r FROM cuts c JOIN units x ON x.lang = c.lang AND x.phrase = c.first JOIN units y ON y.lang = c.lang AND y.phrase = c.rest)),
      best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w || ' ' || w2 AS phrase, a FROM three UNION ALL SELECT lang, w2 || ' ' || w3, a FROM three) GROUP BY ALL),
      stay AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE coalesce(longer * 100 < a * {inside}, true))
    SELECT s.lang, rank, s.phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM stay s JOIN (SELECT lang, sum(f) AS n FROM one GROUP BY lang) t USING (lang) WHERE rank <= {top}"""
