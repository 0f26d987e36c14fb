"""Quality scores by naive-Bayes support vectors.

Binary n-gram indicators are scaled by the log-count ratios of the two classes, and a linear model
with hinge loss is fitted on them by dual coordinate descent; a held-back part of the training rows
calibrates its margin to a probability.  The model is two numbers and one weight for each of
2**BITS hashed n-grams, whatever the size of the input.

The n-grams are single tokens and pairs of tokens (runs of letters, digits or other signs, case kept) and runs of
three and five token shapes (lower, Capital, UPPER, mixed, digits, the signs themselves, or "as the
word before").
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import arrays
from deltaloom.llm.storage import crc32_of_id, small_batches

BITS = 18
#: Labelled rows that a model is fitted on at most: those whose ids hash lowest.
SAMPLE = 6000
#: One training row in so many calibrates instead.
HOLD = 4

_LOWER, _UPPER, _DIGIT, _SIGN = 1, 2, 3, 4
_KINDS = np.full(256, _SIGN, np.uint8)
_KINDS[list(range(97, 123)) + list(range(128, 256))] = _LOWER
_KINDS[65:91] = _UPPER
_KINDS[48:58] = _DIGIT
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_RUNS = np.array([0, 1, 1, 2, 3], np.uint8)
U = np.uint64


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each document of a block, end to end, and where each document's begin."""
    n_docs = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    kind = _KINDS[data]
    run = _RUNS[kind]
    start = np.ones(len(data) + 1, bool)
    start[1:-1] = run[1:] != run[:-1]
    start[offs] = True
    bounds = np.flatnonzero(start)
    begin, end = bounds[:-1], bounds[1:]
    token = run[begin] > 0
    begin, end = begin[token], end[token]
    doc = np.searchsorted(offs, begin, "right") - 1
    word = arrays.span_hashes(data, begin, end)
    upper = np.concatenate(([0], np.cumsum(kind == _UPPER)))
    capitals, letters = upper[end] - upper[begin], run[begin] == 1
    shape = np.where(run[begin] == 2, U(5), word)
    shape[letters] = 4
    shape[letters & (capitals == 0)] = 1
    shape[letters & (capitals == 1) & (kind[begin] == _UPPER)] = 2
    shape[letters & (capitals > 1) & (capitals * 2 > end - begin)] = 3
    at = np.flatnonzero(letters)  # a word like the word before it
    again = at[1:][(word[at[1:]] == word[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])]
    shape[again] = 6
    found, found_doc = [word], [doc]
    for values, size, seed in ((word, 2, 11), (shape, 3, 13), (shape, 5, 17)):
        m = len(values) - size + 1
        if m <= 0:
            continue
        total = np.full(m, seed, U)
        for j in range(size):
            total = total * U(0x9E3779B97F4A7C15) + values[j : j + m]
        same = doc[:m] == doc[size - 1 :]
        found.append(arrays.mix64(total[same]))
        found_doc.append(doc[:m][same])
    value, doc = np.concatenate(found), np.concatenate(found_doc)
    order = np.argsort(doc, kind="stable")
    return arrays.sets_by_doc((value[order] >> U(64 - BITS)).astype(np.int64), doc[order], n_docs)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), margin = sum of weights of a text's n-grams / sqrt(their number)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[at])))
        size = np.diff(first)
        margin = (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(size, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit(at: np.ndarray, first: np.ndarray, label: np.ndarray, hold: np.ndarray, cost: float = 4.0, rounds: int = 8) -> Model:
    """Fit on the rows that aren't held, calibrate on the held ones (on all where too few are held)."""
    size = 1 << BITS
    at = at.astype(np.int64)
    rows = [at[a:b] for a, b in zip(first[:-1], first[1:])]
    y = np.where(label == 1, 1.0, -1.0)
    train = np.flatnonzero(~hold)
    if not len(train) or len(set(y[train])) < 2:
        share = (float((label == 1).sum()) + 1) / (len(label) + 2)
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    good, bad = np.ones(size), np.ones(size)
    for i in train:
        (good if y[i] > 0 else bad)[rows[i]] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    scaled = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = [float(x @ x) + 1 for x in scaled]
    most = {s: cost * len(train) / (2 * max(1, int((y[train] == s).sum()))) for s in (1.0, -1.0)}
    weight, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(train):
            r, x = rows[i], scaled[i]
            gradient = y[i] * (float(weight[r] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[y[i]])
            step = (new - alpha[i]) * y[i]
            if step:
                weight[r] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    model = Model(weight * ratio, bias, 1.0, 0.0)
    check = np.flatnonzero(hold) if hold.sum() >= 50 and len(set(y[hold])) == 2 else np.arange(len(rows))
    margin = np.array([float(model.weights[rows[i]].sum()) / np.sqrt(max(len(rows[i]), 1)) + bias for i in check])
    model.slope, model.offset = calibrate(margin, y[check])
    return model


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's logistic fit with his smoothed targets, by Newton steps."""
    up, down = float((y > 0).sum()), float((y < 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack((margin, np.ones_like(margin)))
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, sizes, label, hold = [], [], [], []
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(0)):
            at, first = features(data, offs)
            parts.append(at.astype(np.int32))
            sizes.append(np.diff(first))
            label.append(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False))
            hold.append(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False))
    if not parts:
        parts, sizes, label, hold = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, int)], [np.zeros(0, bool)]
    first = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    model = fit(np.concatenate(parts), first, np.concatenate(label), np.concatenate(hold).astype(bool))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([[model.bias, model.slope, model.offset]])], names=["weights", "rest"]
    )


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, those whose ids hash lowest; one task fits, as the sample is bounded.

    Rows without an id or label are no training rows, nor are labels without a document; of an id with several
    labels the smallest counts, of one with several texts the first in order.
    """
    small_batches(documents.sparkSession)
    there = documents.select(F.col(id_column).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    chosen = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .join(there, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    hold = F.pmod(F.xxhash64("doc_id", F.lit("hold")), F.lit(HOLD)) == 0
    # at most ``sample`` rows are broadcast; a repeated id is one row before it is shuffled
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    one = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label", hold.alias("hold"))
    got = one.mapInArrow(_fit_task, "weights binary, rest array<double>").first()
    if got is None:  # no labelled rows
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 0.0)
    return Model(np.frombuffer(bytes(got[0]), np.float32).astype(np.float64), *got[1])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    at = -1
    for batch in batches:
        at = batch.schema.get_field_index("text__")
        scores = [np.zeros(0)]
        for _, _, data, offs in arrays.blocks(batch.column(at)):
            scores.append(model.scores(*features(data, offs)))
        rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
        names = [batch.schema.names[i] for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(scores))], names=[*names, "score"])


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row; null text is scored as empty text."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text__"))
    return rows.mapInArrow(lambda batches: _score(batches, model), "doc_id long, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 if score >= 0.5).

    Only rows whose crc32(id as text) mod 3 is not 1 train; the others are held out.

    Defined results: null and empty texts have no n-grams and get the bias alone; with no labelled
    rows, or rows of one label only, every score is that label's smoothed share; repeated rows are
    each scored; a null id is not held out; an empty table gives an empty table; extra columns are ignored.
    """
    held = F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(3)) == 1, F.lit(False))
    model = train(documents, labels.where(F.pmod(crc32_of_id(id_column), F.lit(3)) != 1), id_column, text_column, label_column, sample)
    return score(documents, model, id_column, text_column).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected (score >= 0.5), all columns kept; fitted on all labelled rows' sample."""
    model = train(documents, labels, id_column, text_column, sample=sample)
    own = documents.columns
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]
    rows = documents.select(*numbered, F.col(text_column).alias("text__"))
    schema = rows.drop("text__").withColumn("score", F.lit(0.0)).schema
    scored = rows.mapInArrow(lambda batches: _score(batches, model), schema)
    return scored.where("score >= 0.5").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
