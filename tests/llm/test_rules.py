import re
from collections import Counter

import duckdb
import pandas as pd

from deltaloom.llm import rules

WORD = r"[^\x20\x09-\x0D]+"


def measured(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines), len(re.findall("[A-Z]{2,}", text)))


def texts(prose):
    base = prose(60, 1)
    eight = "one two three four five six seven eight"
    return [
        None, "", " \t\r\n\x0b\x0c", "one", base, prose(7000, 2), base + " " + base, f"{eight} x {eight} {eight}", f"{eight} {eight[4:]} one " * 3,
        " ".join("a" * 19), " ".join("a" * 20), "la " * 500, "A B\nA B\n\nA B \r\nA B\r\n", "é中😀 " * 30, "## $$ || <b> 100% &" * 10, "SHOUT NOW " * 30, "\n".join([base] * 5), "x y z",
        "w" * 1_500_000, "\n" * 1000, " ".join(f"w{i % 977}" for i in range(200_000)),
    ]


def test_measures_are_brute_force(spark, documents, prose):
    rows = [(k, t, None, None) for k, t in enumerate(texts(prose))] + [(None, "a b", "en", "s"), (4, texts(prose)[4], "en", "s")]
    found = rules.ledger(documents(rows)).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), *[r[m] for m in rules.MEASURES]) for r in found) == sorted((-1 if i is None else i, *measured(t)) for i, t, _, _ in rows)
    for r in found:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert bool(r.failed & 3) == base


def test_verdicts_and_sql(spark, documents, prose, odd_rows):
    docs = documents([(k, t, None, None) for k, t in enumerate(texts(prose))] + odd_rows)
    found = rules.judged(rules.ledger(docs)).toPandas()
    assert not (found.kept & found.base_failed).any() and found.kept.any()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(rules.oracle_sql()).df()
    order = ["doc_id", *rules.MEASURES]
    pd.testing.assert_frame_equal(found.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)
    assert rules.judged(rules.ledger(documents([]))).count() == 0


def test_policies_and_ablations(spark, documents, prose):
    rows = [(k, t, None, f"s{k % 2}") for k, t in enumerate(texts(prose))]
    stored = rules.stored(documents(rows))
    all_rows = stored.collect()
    policies = {"base": ("few_words", "repeated_words"), "no_shouts": ("few_words", "shouting"), "none": ()}
    found = {(r.policy, r.rule): r for r in rules.ablations(stored, policies).collect()}
    assert set(found) == {(p, r) for p, rs in policies.items() for r in (None, *rs)}
    for (p, rule), r in found.items():
        whole, without = rules.mask(policies[p]), rules.mask(tuple(x for x in policies[p] if x != rule))
        passing = [x for x in all_rows if not x.failed & without]
        assert (r.kept, r.kept_words) == (len(passing), sum(x.n_words for x in passing))
        assert r.gained == (sum(x.failed & whole == rules.bit(rule) for x in all_rows) if rule else 0)
        assert r.gained == r.kept - found[p, None].kept
        assert r.failing == (sum(bool(x.failed & rules.bit(rule)) for x in all_rows) if rule else 0)
    ever = 0
    for x in all_rows:
        ever |= x.failed
    assert found["none", None].ever == ever and found["none", None].kept == len(rows)
    assert all(r.kept for r in rules.judged(stored, "none", {"none": ()}).where("NOT base_failed").collect())
    by = rules.judged(stored).groupBy("only_rule").count().collect()
    assert sum(r["count"] for r in by) == len(rows)


def test_main_path_is_native(documents, prose):
    plan = rules.judged(rules.ledger(documents([(1, prose(9, 1), None, None)])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
