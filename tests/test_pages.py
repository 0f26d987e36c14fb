import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import canonical
from deltaloom.operators import pages, units, validate
from deltaloom.state import cache

ORDER = [("price", True), ("day", False), ("id", False)]


def rows_of(spark, n=60):
    return spark.createDataFrame([(i, None if i % 7 == 0 else float(i % 5) / 3, None if i % 4 == 0 else datetime.date(2020, 1, 1 + i % 3)) for i in range(n)], "id int, price double, day date")


def walk(df, size, **ask):
    out, cursor = [], None
    while True:
        page = pages.bound_page(df, ORDER, size, **ask, cursor=cursor)
        out.append([r.id for r in page.rows.collect()])
        cursor = page.next
        if cursor is None:
            return out


def test_pages_are_the_order(spark):
    df, ask = rows_of(spark), {"revision": "r", "scope": "s", "query": {"q": 1}}
    want = [r.id for r in df.orderBy(F.col("price").desc_nulls_last(), F.col("day").asc_nulls_first(), "id").collect()]
    got = walk(df, 7, **ask)
    assert [x for p in got for x in p] == want and [len(p) for p in got] == [7] * 8 + [4]
    assert walk(df, 60, **ask) == [want] and walk(df.where("false"), 5, **ask) == [[]]


def test_pages_stay_and_foreign_cursors_are_refused(spark):
    df, ask = rows_of(spark), {"revision": "r", "scope": "s", "query": {"q": 1}}
    first = pages.bound_page(df, ORDER, 10, **ask)
    second = [r.id for r in pages.bound_page(df, ORDER, 10, **ask, cursor=first.next).rows.collect()]
    seen = [r.id for r in first.rows.collect()]
    fewer = df.where(~F.col("id").isin(seen[:5])).union(spark.createDataFrame([(1000, 9.0, None)], df.schema))
    assert [r.id for r in pages.bound_page(fewer, ORDER, 10, **ask, cursor=first.next).rows.collect()] == second
    for other in ({"revision": "r2"}, {"scope": "s2"}, {"query": {"q": 2}}):
        with pytest.raises(pages.Refused, match=pages.FOREIGN):
            pages.bound_page(df, ORDER, 10, **(ask | other), cursor=first.next)
    with pytest.raises(pages.Refused, match=pages.FOREIGN):
        pages.bound_page(df, [("price", False), *ORDER[1:]], 10, **ask, cursor=first.next)
    for bad in ("", "x", "e30", first.next[:-3], "W10"):
        with pytest.raises(pages.Refused, match="CURSOR"):
            pages.bound_page(df, ORDER, 10, **ask, cursor=bad)


def test_receipts(spark):
    objects = spark.createDataFrame(
        [("T", "t", "a.sql", 1, 2, "a.sql", 1, 3), ("GONE", "gone", "g.sql", 1, 1, None, None, None), ("NEW", "brand new", None, None, None, "n.sql", 1, 1)],
        "object_key string, raw_name string, old_path string, old_first int, old_last int, new_path string, new_first int, new_last int",
    )
    old = spark.createDataFrame([("a.sql", "one t\ntwo\nthree"), ("g.sql", "gone"), ("u.sql", "x.gone, T.t\nnot tt\n")], "path string, text string")
    new = spark.createDataFrame([("a.sql", "one\ntwo t\nthree"), ("n.sql", "new"), ("u.sql", "still gone\n" * 60)], "path string, text string")
    events = spark.createDataFrame([("a.sql", f"c{i:02}", i) for i in range(30)] + [("n.sql", "c1", 1)], "path string, sha string, position int")
    got = {}
    for r in pages.receipts(objects, old, new, events, "B", "N", "s").orderBy("object_key", "call_number").collect():
        got.setdefault(r.object_key, []).append((r.call_number, r.tool_name, r.revision, len(r["items"]), r.complete))
        assert hashlib.sha256(r.arguments.encode()).hexdigest() == r.arguments_digest and json.loads(r.arguments)["revision"] == r.revision
    assert got == {
        "T": [(1, "get_diff", "N", 1, True), (2, "read_source", "B", 2, True), (3, "read_source", "N", 3, True), (4, "find_references", "B", 2, True), (5, "find_references", "N", 1, True), (6, "get_history", "N", 20, False)],
        "GONE": [(1, "read_source", "B", 1, True), (2, "find_references", "B", 2, True), (3, "find_references", "N", 50, False), (4, "get_history", "N", 0, True)],
        "NEW": [(1, "read_source", "N", 1, True), (2, "get_history", "N", 1, True)],
    }


def test_canonical_documents(spark):
    documents = [
        {"unit_id": "u", "evidence_registry": [{"evidence_id": "e1", "b": 1}], "facts": [{"before": {"evidence_ids": ["e2"]}, "after": {"evidence_ids": ["e1", "e3"]}}, {"before": None, "after": None}],
         "research_receipts": [{"elapsed_ms": 5, "evidence_ids": ["e4"], "items": [{"evidence_id": "e5", "elapsed_ms": 1}, {"evidence_id": None, "elapsed_ms": None}]}], "z": {"b": "é", "a": None}},
        {"unit_id": "v", "evidence_registry": None, "facts": [], "research_receipts": None, "z": None},
    ]
    schema = "unit_id string, z struct<b:string,a:int>, facts array<struct<before:struct<evidence_ids:array<string>>,after:struct<evidence_ids:array<string>>>>, research_receipts array<struct<elapsed_ms:int,items:array<struct<evidence_id:string,elapsed_ms:int>>,evidence_ids:array<string>>>, evidence_registry array<struct<evidence_id:string,b:int>>"
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(d) for d in documents]))

    def without(x):
        return [without(i) for i in x] if isinstance(x, list) else {k: without(v) for k, v in x.items() if k != "elapsed_ms"} if isinstance(x, dict) else x

    whole = F.struct(*df.columns)
    got = df.select("unit_id", canonical.text_of(whole, df.schema).alias("text"), canonical.digest_of(whole, df.schema).alias("digest")).collect()
    for r, d in zip(sorted(got, key=lambda r: r.unit_id), documents):
        dumps = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r.text == dumps(d) and r.digest == hashlib.sha256(dumps(without(d)).encode()).hexdigest()
    assert {(r.unit_id, r.evidence_id) for r in units.evidence_ids(df).collect()} == {("u", f"e{i}") for i in range(1, 6)}


def test_strict_json(spark):
    texts = ['{"a":1,"b":"x"}', '{"b":null,"a":2}', '{"a":1}', '{"a":1,"b":"x","c":2}', '{"a":"one","b":"x"}', "[1]", "{", "", None, '{"a":1,"b":"x"} tail', '{"a":1,"b":"x"} {}', '{"a":1,"b":"x"},{"a":1,"b":"x"}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.strict(F.col("t"), "struct<a:int,b:string>").alias("x")).collect()
    assert [r.x and tuple(r.x) for r in got] == [(1, "x"), (2, None), *[None] * 10]


def test_durations(spark):
    got = spark.createDataFrame([(0,), (499,), (500,), (61_000,), (3_600_000,), (3_725_499,), (None,)], "m long").select(canonical.duration(F.col("m")).alias("d")).collect()
    assert [r.d for r in got] == ["0 s", "0 s", "1 s", "1 min 1 s", "1 h", "1 h 2 min 5 s", None]


def test_run_and_side_rules(spark):
    runs = spark.createDataFrame([("ok", 1, 2, 3, 6, 1, 2, 3, "complete", True), ("c", 1, 2, 3, 7, 1, 2, 3, "blocked", False), ("t", 0, 0, 0, 0, 2, 1, 3, "limited", True), ("b", 0, 0, 0, 0, 1, 1, 1, "blocked", True)],
        "run_id string, analyzed_objects int, limited_objects int, unresolved_objects int, history_known_objects int, planned_at int, analysis_started_at int, analysis_completed_at int, quality string, automatic_commit_eligible boolean")
    assert {tuple(r) for r in validate.run_violations(runs).collect()} == {("V6_COUNTS", "c"), ("V6_TIMES", "t"), ("V6_COMMIT", "b")}
    facts = spark.createDataFrame([("f1", "o", ["b", "x"], ["t"]), ("f2", "o", ["t"], []), ("f3", "o", [], ["q"]), ("f4", "p", ["b"], None)], "fact_id string, object_key string, before_ids array<string>, after_ids array<string>")
    objects = spark.createDataFrame([("o", ["b", "x", "t"]), ("p", [])], "object_key string, evidence_ids array<string>")
    registry = spark.createDataFrame([("b", "base"), ("t", "target"), ("x", "both")], "evidence_id string, side string")
    assert {tuple(r) for r in validate.side_violations(facts, objects, registry).collect()} == {("V5_SIDE", "f2"), ("V5_SIDE", "f3"), ("V5_OWNER", "f3"), ("V5_OWNER", "f4")}


def test_cleanup_is_checked_again(spark, scratch):
    day = lambda n: datetime.datetime(2020, 1, n)
    rows = [(f"k{i}", f"p{i % 3}", day(1 + i), 10 * i) for i in range(12)]
    path = f"file://{scratch}/table"
    spark.createDataFrame(rows, "key string, part string, at timestamp, bytes int").write.partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    none = stored.select("key").where("false")
    plan = cache.checkpointed(cache.expired(stored, "at", none, "key", 4).select("key", "bytes"))
    assert plan.count() == 7
    plan = cache.checkpointed(plan.withColumn("bytes", F.when(F.col("key") == "k2", 1).otherwise(F.col("bytes"))).union(spark.createDataFrame([("k11", 110), ("nothing", 5)], "key string, bytes int")))
    protected = spark.createDataFrame([("k0",)], "key string")  # since the plan was made
    done = {r.key: r.removed for r in cache.applied(spark, path, plan, protected, "key", "at", 4, "part").collect()}
    assert {k for k, v in done.items() if v} == {"k1", "k3", "k4", "k5", "k6"} and set(done) == {f"k{i}" for i in range(7)} | {"k11", "nothing"}
    left = spark.read.parquet(path)
    assert {r.key for r in left.collect()} == {"k0", "k2", *[f"k{i}" for i in range(7, 12)]} and set(left.columns) == {"key", "part", "at", "bytes"}
    assert not any(r.removed for r in cache.applied(spark, path, plan, protected, "key", "at", 4, "part").collect())
