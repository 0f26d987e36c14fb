import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from deltaloom.llm import collocations


def brute(rows, most=3, least=10, top=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= inside * found[p[i : i + size]]:
                        dropped.add(p[i : i + size])
        ranked = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def texts(seed):
    """A few words in many orders, hot words and phrases, nulls, ends and blanks of all kinds, copies and one long text."""
    r = random.Random(seed)
    words = ["The", "of", "AND", "a", "b", "c", "New", "york", "city", "é", "中", "x-y", "\x00", " ", "hot"]
    weights = [30, 20, 10, 5, 5, 4, 3, 3, 3, 2, 2, 1, 1, 1, 60]
    rows = []
    for i in range(120):
        got = []
        for _ in range(r.choice([0, 1, 2, 30, 90])):
            got += r.choice([["New", "York"], ["new", "york", "City"], ["hot", "hot"]]) if r.random() < 0.3 else r.choices(words, weights)
            got[-1] += r.choice(["", "", "", "", "", ".", ", ", "\n", "\r\n", "\t"])
        rows.append((r.choice(["en", "en", "de", None, "und", ""]), r.choice([" ", "  "]).join(got)))
    rows += [rows[3]] * 15 + [("en", None), (None, ""), ("de", " \t.\n"), ("en", "the hot city " * 60_000), ("fr", "lonely words only once"), ("fr", "y " * 11)]
    return rows


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, "p", 1, 2, 3) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, a long, rank long, n long")
    return sorted(tuple(x) for x in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize("options", [{}, {"listed": 4}, {"listed": 0, "least": 2}, {"most": 4, "least": 3, "top": 7}, {"most": 2}])
def test_collocations_are_brute_force(spark, options):
    rows = texts(len(options))
    assert got(spark, rows, **options) == brute(rows, **{k: v for k, v in options.items() if k != "listed"})


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [("en", "a b " * 4)]) == []


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT 4000000000000L a, 5000000000000L l, 6000000000000L r").selectExpr("(CAST(1000000 AS DECIMAL(38, 0)) * a * a) div (CAST(l AS DECIMAL(38, 0)) * r) AS s").first()
    assert row.s == 10**6 * 4 * 4 // 30


def test_every_phrase_has_one_pivot():
    """Each occurrence of each phrase is in one fragment, also where words are level in the order."""
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 30))
        place, goes_on = r.integers(0, 4, n), r.random(n - 1) < 0.8
        left, right = collocations.reach(place, goes_on, 3)
        owned = Counter((i - x, i + y) for i in range(n) for x in range(left[i] + 1) for y in range(right[i] + 1) if 0 < x + y < 3)
        want = {(i, j) for i in range(n) for j in range(i + 1, min(i + 3, n)) if goes_on[i:j].all()}
        assert set(owned) == want and set(owned.values()) <= {1}


def test_tallies_give_out_and_go_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "HELD", 10)
    r = random.Random(1)
    keys = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)]
    tables = (pa.table({"k": keys[i : i + 7], "n": [1] * len(keys[i : i + 7])}) for i in range(0, 500, 7))
    total = Counter()
    for batch in collocations.tallied(tables, ["k"]):
        for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist()):
            total[k] += n
    assert total == Counter(keys)
