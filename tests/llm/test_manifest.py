import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from deltaloom.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        out.append((run[: at % 3], run[at % 3 + 1 :]))
        at //= 3
    return out


def expected(rows):
    """rows (doc_id, source, lang, n_chars, text) to the query's rows, by the definition."""
    by = {}
    for r in rows:
        changed = r if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else (*r[:4], r[4].replace("\n", ""))
        by.setdefault(r[1], []).append((r[0], leaf(r), leaf(changed)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    trees = {s: tree([x[1] for x in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, own, now) in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            folded = now
            for before, after in steps:
                folded = h(*before, folded, *after)
            proof = h(*[x for before, after in steps for x in before + after])
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, row long")
    made = manifest.verified(docs, {"text": manifest.tampered_text()})
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_is_the_definition(spark, monkeypatch, levels):
    """Trees of one block and of many, of all small sizes; nulls, ties, repeated rows, long texts."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    r = random.Random(levels)
    rows = []
    for s, n in zip(["b", None, "a", "é", "", "hot", *[f"s{i}" for i in range(14)]], [1, 2, 3, 4, 9, 95, *range(5, 19)]):
        rows += [(r.randrange(10**6), s, r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", "a\nb\n", "x" * 10, "é\n"])) for _ in range(n)]
    rows += [(7, "a", "en", 1, "tie\n"), (7, "a", "en", 1, "tie\n"), (7, "a", "de", 1, "t"), (None, "a", None, None, None), (None, "a", None, None, "n\n"), (-5, "hot", "", 0, "line\n" * 200_000)]
    assert got(spark, rows) == expected(rows)


def test_small_tables(spark):
    assert got(spark, []) == []
    for rows in ([(1, "s", "en", 3, "a\nb")], [(2, None, None, None, None)], [(2, "s", "en", 1, "\n"), (4, "t", "en", 1, "\n")]):
        assert got(spark, rows) == expected(rows)


def test_every_changed_field_shows(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made, root = manifest.manifest(docs, {"lang": F.when(F.col("doc_id") == 5, "de").otherwise(F.col("lang"))})
    assert {r.doc_id for r in made.collect() if r.folded_root != root} == {5}
    again, same = manifest.manifest(docs.orderBy(F.desc("doc_id")).repartition(3))
    assert same == root and all(r.folded_root == root for r in again.collect())
