"""Language identification, word first: known words by their log frequency in each language, other
words by their longest known character n-grams.

The model has every word and n-gram that the training sample has twice, with one entry for each language
that has it; the sample's documents are bounded by parameters, and so is the model, however many
languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import arrays
from deltaloom.llm.storage import crc32_of_id, sized, small_batches

#: Training documents of a language, about: those whose ids hash lowest; and of all languages.
SAMPLE, SAMPLE_OF_ALL = 4000, 40_000
LONGEST = 4
#: Numbers (words x languages) that are in memory at a time, about.
CELLS = 1 << 21
#: Words seen less often are unknown words; they teach n-grams only.
LEAST = 2

_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(97, 123)) + list(range(128, 256))] = True


def _spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return arrays.spans(_LETTERS[data], offs)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' character n-grams and the number of the word of each; words start and end with a mark."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    lead = np.append(lead, len(data))
    first, last = np.searchsorted(lead, starts), np.searchsorted(lead, ends)
    n_chars = last - first
    got, word = [], []
    inner = np.maximum(n_chars - size + 1, 0)
    at = arrays.ranges(first, inner)
    got.append(arrays.span_hashes(data, lead[at], lead[at + size]) if len(at) else np.zeros(0, np.uint64))
    word.append(np.repeat(np.arange(len(starts)), inner))
    if size > 1:  # with the mark before or after the word
        has = np.flatnonzero(n_chars >= size - 1)
        if len(has):
            got.append(arrays.mix64(arrays.span_hashes(data, lead[first[has]], lead[first[has] + size - 1]) + np.uint64(1)))
            got.append(arrays.mix64(arrays.span_hashes(data, lead[last[has] - size + 1], lead[last[has]]) + np.uint64(2)))
            word += [has, has]
    return np.concatenate(got), np.concatenate(word)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language number, text) to (n-gram length or 0 for words, hash, language number, count), added up a batch."""
    for batch in batches:
        for a, b, data, offs in arrays.blocks(pc.utf8_lower(batch.column(1).cast(pa.large_string()))):
            lang = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            starts, ends, doc = _spans(data, offs)
            if not len(starts):
                continue
            of_word = lang[doc]
            for size in range(LONGEST + 1):
                value, word = (arrays.span_hashes(data, starts, ends), np.arange(len(starts))) if size == 0 else grams(data, starts, ends, size)
                for k in np.unique(of_word).tolist():
                    own, count = np.unique(value[of_word[word] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), size, np.int32)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), k, np.int32)), pa.array(count.astype(np.int64))],
                        names=["size", "value", "lang", "count"],
                    )


@dataclass
class Model:
    """For words (0) and each n-gram length: sorted hashes, log frequencies of what a language doesn't have, and what is added to those of what it has.

    The entries of hash i are those from first[i] to first[i + 1]: language numbers and what is added.
    """

    languages: list[str]
    prior: np.ndarray
    known: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    lang: dict[int, np.ndarray]
    added: dict[int, np.ndarray]

    def find(self, size: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.known[size]
        if not len(known):
            return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        return at, known[at] == value

    def sums(self, size: int, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Sums of the log frequencies (n x languages) of the hashes ``at``, by rows."""
        wide = len(self.languages)
        out = np.bincount(row, minlength=n)[:, None] * self.base[size]
        count = self.first[size][at + 1] - self.first[size][at]
        entry = arrays.ranges(self.first[size][at], count)
        cell = np.repeat(row, count) * wide + self.lang[size][entry]
        return out + np.bincount(cell, weights=self.added[size][entry], minlength=n * wide).reshape(n, wide)

    def word_logs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log frequencies (words x languages); a word without any known n-gram says nothing (0)."""
        each = np.zeros((len(starts), len(self.languages)))
        at, hit = self.find(0, arrays.span_hashes(data, starts, ends))
        each[hit] = self.sums(0, at[hit], np.arange(int(hit.sum())), int(hit.sum()))
        left = np.flatnonzero(~hit)
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            gram, word = grams(data, starts[left], ends[left], size)
            at, hit = self.find(size, gram)
            count = np.bincount(word[hit], minlength=len(left))
            each[left] = self.sums(size, at[hit], word[hit], len(left)) / np.maximum(count, 1)[:, None]
            left = left[count == 0]
        return each

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each document; different words are looked up a portion at a time."""
        n, wide = len(offs) - 1, len(self.languages)
        starts, ends, doc = _spans(data, offs)
        _, where, word = np.unique(arrays.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        pair, count = np.unique(doc * len(where) + word, return_counts=True)  # each document's different words
        doc_of, word_of = (pair // len(where), pair % len(where)) if len(pair) else (pair, pair)
        order = np.argsort(word_of, kind="stable")
        doc_of, word_of, count = doc_of[order], word_of[order], count[order]
        total = np.zeros((n, wide))
        portion = max(1, CELLS // wide)
        for low in range(0, len(where), portion):
            logs = self.word_logs(data, starts[where[low : low + portion]], ends[where[low : low + portion]])
            a, b = np.searchsorted(word_of, (low, low + portion))
            for k in range(wide):
                total[:, k] += np.bincount(doc_of[a:b], weights=count[a:b] * logs[word_of[a:b] - low, k], minlength=n)
        mean = (total + self.prior) / np.sqrt(np.bincount(doc, minlength=n) + 1.0)[:, None]
        mean -= mean.max(axis=1, keepdims=True)
        share = np.exp(mean)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(n), best]


def train(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, languages: int | None = None, sample_of_all: int = SAMPLE_OF_ALL
) -> Model:
    """Learn from about ``sample`` documents of each language, those whose ids hash lowest; of all languages, or of the ``languages`` of most documents.

    Of many languages each has an equal part of ``sample_of_all`` documents.  The driver gets one row a
    language, and for each word and n-gram that the sample has ``LEAST`` times its count in each
    language that has it; both are bounded by the parameters.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts_ = rows.groupBy("lang").count()
    many = {r[0]: r[1] for r in (counts_ if languages is None else counts_.orderBy(F.desc("count"), "lang").limit(languages)).collect()}
    names = sorted(many)
    if not names:
        return Model([], np.zeros(0), {}, {}, {}, {}, {})
    sample = min(sample, max(1, sample_of_all // len(names)))
    shares = documents.sparkSession.createDataFrame([(lang, i, min(1.0, sample / many[lang])) for i, lang in enumerate(names)], "lang string, n int, share double")
    # a language of which all documents are taken needs no place; else an id, or all rows of a repeated one, has one
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(sized(shares, len(names)), "lang").where(place < F.col("share")).select("n", "text")
    counted = chosen.mapInArrow(_count, "size int, value long, lang int, count long").groupBy("size", "value", "lang").agg(F.sum("count").alias("count"))
    per_value = counted.groupBy("size", "value").agg(F.collect_list(F.struct("lang", "count")).alias("counts"), F.sum("count").alias("total"))  # one entry a language
    table = per_value.where(F.col("total") >= LEAST).select("size", "value", F.explode("counts").alias("x")).select("size", "value", "x.lang", "x.count").toArrow()
    of_size, values, langs, counts = (table.column(i).to_numpy() for i in range(4))
    known, base, first, lang_of, added = {}, {}, {}, {}, {}
    for size in range(LONGEST + 1):
        own = of_size == size
        known[size], at = np.unique(values[own].view(np.uint64), return_inverse=True)
        order = np.lexsort((langs[own], at))
        first[size] = np.searchsorted(at[order], np.arange(len(known[size]) + 1))
        lang_of[size] = langs[own][order].astype(np.int32)
        added[size] = np.log(2.0 * counts[own][order] + 1).astype(np.float32)  # log((count + 0.5) / 0.5)
        total = np.bincount(langs[own], weights=counts[own], minlength=len(names))
        base[size] = np.log(0.5 / (total + 0.5 * (len(known[size]) + 1)))
    size = np.array([many[x] for x in names], float)
    return Model(names, np.log(size / size.sum()), known, base, first, lang_of, added)


def _predict(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model = shared.value
    names = np.array([*model.languages, "und"], object)
    for batch in batches:
        column = batch.column(1).cast(pa.large_string())
        has = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False) & bool(model.languages)
        best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        if model.languages:
            for _, _, data, offs in arrays.blocks(pc.utf8_lower(column)):
                x, y = model.predict(data, offs)
                best.append(x)
                score.append(y)
        else:
            best, score = [np.zeros(len(has), np.int64)], [np.zeros(len(has))]
        best = np.where(has, np.concatenate(best), len(model.languages))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(has, np.concatenate(score), 0.0))], names=["doc_id", "lang_pred", "score"]
        )


def languages_of(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, languages: int | None = None, sample_of_all: int = SAMPLE_OF_ALL
) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score (0 to 1).

    Only rows whose crc32(id as text) mod 3 is not 1 and whose lang is not null train (see ``train``).

    Defined results: ``und`` with score 0 for null texts, texts without a letter, and where nothing
    can be learned; a text whose words are all unlike anything learned gets the commonest language;
    ties go to the language first in order; repeated rows are each predicted; a null id is not held
    out and does not train; an empty table gives an empty table; extra columns are ignored.
    """
    held = F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(3)) == 1, F.lit(False))
    model = train(documents.where(F.pmod(crc32_of_id(id_column), F.lit(3)) != 1), id_column, text_column, lang_column, sample, languages, sample_of_all)
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    got = rows.mapInArrow(lambda batches: _predict(batches, shared), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")
