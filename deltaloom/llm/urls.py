"""URL filtering: rules by host and path first, a character language-model ratio for the rest.

Two interpolated variable-order Markov models over URL characters, one of URLs that rules allow and
one of URLs that rules block, score a URL by the difference of its log-likelihoods divided by its
length; the cut is calibrated on URLs that were held back from training.

Characters are mapped to ``ALPHABET`` symbols and contexts are at most ``ORDER`` long, so the counts
of all URLs of the input sum up to at most 2 * len(ALPHABET)**(ORDER + 1) numbers (5.7 million, 90 MB),
however large the input is; contexts of two symbols or more that were seen once only are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import arrays

#: Symbols: end of URL, any other byte, digits, letters, and signs of their own.
ALPHABET = "$*0abcdefghijklmnopqrstuvwxyz/.-_?&=:%#~+"
ORDER = 3
#: One rule-judged URL in so many is held back for calibration.
HOLD = 5
#: Calibration bins of the score.
BINS, WIDTH = 4001, 0.005

_CODE = np.ones(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
_CODE[ord("$")] = _CODE[ord("*")] = 1
_CODE[48:58] = 2
_CODE[65:91] = _CODE[97:123]
_N = len(ALPHABET)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null where none does; rules are (verdict, host/path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _codes(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the number of (context, symbol) at each position; and the URL of each position.

    Every URL ends with the end symbol; contexts do not reach before a URL's start, where the end symbol stands.
    """
    n = len(offs) - 1
    sizes = np.diff(offs) + 1
    first = np.concatenate(([0], np.cumsum(sizes)))
    symbol = np.zeros(first[-1], np.int64)
    at = np.ones(first[-1], bool)
    at[first[1:] - 1] = False
    symbol[at] = _CODE[data]
    url = np.repeat(np.arange(n), sizes)
    place = np.arange(first[-1]) - first[url]
    codes, code, scale = [symbol], symbol.copy(), _N
    for order in range(1, ORDER + 1):
        before = np.zeros_like(symbol)
        before[order:] = symbol[:-order] if order else symbol
        before[place < order] = 0
        code = code + before * scale
        scale *= _N
        codes.append(code)
    return codes, url


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, url) to (class, order, code, count), added up over the task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for a, b, data, offs in arrays.blocks(batch.column(1)):
            label = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            codes, url = _codes(data, offs)
            for k in (0, 1):
                own = label[url] == k
                for order in range(ORDER + 1):
                    at = sums.setdefault((k, order), np.zeros(_N ** (order + 1), np.int64))
                    value, count = np.unique(codes[order][own], return_counts=True)
                    at[value] += count
    for (k, order), count in sums.items():
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), order, np.int32)), pa.array(at), pa.array(count[at])], names=["class", "order", "code", "count"]
        )


class Markov:
    """Log probabilities of symbols after their longest seen context, smoothed by Witten and Bell's interpolation."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.codes, self.probs, self.contexts, self.weights = {}, {}, {}, {}
        for order in range(ORDER + 1):
            code, count = counts.get(order, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            rank = np.argsort(code)
            code, count = code[rank], count[rank].astype(float)
            # a code is symbol + N * (last before + N * (one before it ...)): its context is code // N
            context, at = np.unique(code // _N, return_inverse=True)
            total = np.bincount(at, weights=count, minlength=len(context))
            kinds = np.bincount(at, minlength=len(context)).astype(float)
            lower = self.prob(order - 1, code % _N**order) if order else np.full(len(code), 1 / _N)
            self.codes[order], self.contexts[order] = code, context
            self.probs[order] = (count + kinds[at] * lower) / (total + kinds)[at] if len(code) else np.zeros(0)
            self.weights[order] = kinds / (total + kinds) if len(context) else np.zeros(0)

    def prob(self, order: int, code: np.ndarray) -> np.ndarray:
        if order < 0:
            return np.full(len(code), 1 / _N)
        known, contexts = self.codes[order], self.contexts[order]
        if not len(known):
            return self.prob(order - 1, code % _N ** max(order, 1)) if order else np.full(len(code), 1 / _N)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[at] == code
        out = np.where(hit, self.probs[order][at], 0.0)
        miss = np.flatnonzero(~hit)
        if len(miss):
            lower = self.prob(order - 1, code[miss] % _N**order) if order else np.full(len(miss), 1 / _N)
            c = code[miss] // _N
            at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            out[miss] = np.where(contexts[at] == c, self.weights[order][at], 1.0) * lower
        return out


@dataclass
class Ratio:
    """The two models and the calibrated cut; URLs at or above the cut are allowed."""

    allowed: Markov
    blocked: Markov
    cut: float = 0.0

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        codes, url = _codes(data, offs)
        diff = np.log(self.allowed.prob(ORDER, codes[ORDER])) - np.log(self.blocked.prob(ORDER, codes[ORDER]))
        return np.bincount(url, weights=diff, minlength=len(offs) - 1) / (np.diff(offs) + 1)


def train(judged: DataFrame) -> Ratio:
    """From rows (url, allow boolean): count all that are not held back, then set the cut on the held ones.

    The cut is where the shares of wrongly blocked and wrongly allowed held URLs add up to the least;
    of several such cuts the one nearest 0.  Without held URLs of both kinds it is 0.
    """
    hold = F.pmod(F.xxhash64("url"), F.lit(HOLD)) == 0
    rows = judged.select(F.col("allow").cast("int").alias("class"), "url")
    counted = rows.where(~hold).mapInArrow(_count, "class int, order int, code long, count long")
    summed = counted.groupBy("class", "order", "code").agg(F.sum("count").alias("count"))
    # the counts of a context, one for each symbol at most, stand or go together
    contexts = summed.groupBy("class", "order", F.floor(F.col("code") / _N)).agg(F.sum("count").alias("total"), F.collect_list(F.struct("code", "count")).alias("own"))
    seen = contexts.where((F.col("order") < 2) | (F.col("total") > 1)).select("class", "order", F.explode("own").alias("x"))
    table = seen.select("class", "order", "x.code", "x.count").toArrow()
    kind, order, code, count = (table.column(i).to_numpy() for i in range(4))
    models = [Markov({o: (code[at], count[at]) for o in range(ORDER + 1) for at in [(kind == k) & (order == o)]}) for k in (0, 1)]
    ratio = Ratio(models[1], models[0])
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("score") / WIDTH) + BINS // 2))
    held = _scored(rows.where(hold), ratio, "class int, score double").groupBy("class", bin_of.alias("bin")).count().collect()
    found = np.zeros((2, BINS + 1))
    for r in held:
        found[r[0], r[1]] = r[2]
    if (found.sum(axis=1) > 0).all():
        wrong = np.concatenate(([0], np.cumsum(found[1])))[: BINS + 1] / found[1].sum() + 1 - np.concatenate(([0], np.cumsum(found[0])))[: BINS + 1] / found[0].sum()
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        ratio.cut = float((best[np.abs(best - BINS // 2).argmin()] - BINS // 2) * WIDTH)
    return ratio


def _scored(rows: DataFrame, model: Ratio, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            scores = [ratio.scores(data, offs) for _, _, data, offs in arrays.blocks(batch.column(last))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(last)], pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*batch.schema.names[:last], "score"])

    return rows.mapInArrow(task, schema)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and score (of the method; for all rows).

    ``rules`` are (allow or block, host/path).  A rule fits its host and all subdomains if the path
    starts with the rule's; the longest wins.  Rows without a rule are judged by the language models,
    which learn from the rows that have one.

    Defined results: a null URL, or one without ``://``, has empty host and path, no rule, and is
    scored as its whole text (null: empty text); without rows of both verdicts the models are flat,
    scores are 0 and the verdict is allow; repeated rows are each judged and counted; an empty table
    gives an empty table; extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "url")
    rows = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("found"), "url")
    rows = rows.select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("by_rule"), "url")
    ratio = train(rows.where("by_rule IS NOT NULL").select("url", (F.col("by_rule") == "allow").alias("allow")))
    if not (len(ratio.allowed.codes[0]) and len(ratio.blocked.codes[0])):
        ratio = Ratio(Markov({}), Markov({}))
    scored = _scored(rows, ratio, "page_id long, host string, path string, rule string, by_rule string, score double")
    by_method = F.when(F.col("score") >= ratio.cut, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "score")
