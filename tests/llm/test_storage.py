from pyspark.sql import functions as F

from deltaloom.llm import storage, warc
from deltaloom.llm.storage import new_path
from tests.llm.test_pages import PAGES, expected, pages


def test_hot_keys_are_looked_up_like_others(spark):
    rows = spark.createDataFrame([(i, i % 3 if i > 5 else 9, i % 3) for i in range(40)] + [(99, 77, None)], "id long, a int, b int")
    table = rows.where("a <> 77").groupBy("a").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    want = sorted(map(tuple, rows.join(table.drop("n"), "a", "left").select("id", "a", "least").collect()), key=str)
    for least in (1, 6, 11, 1000):
        got = storage.looked_up(rows, table, ["a"], "n", 41, least).select("id", "a", "least").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_spread_is_a_join(spark):
    rows = spark.createDataFrame([("x" if i % 4 else f"y{i}", i) for i in range(60)], "k string, v int")
    table = spark.createDataFrame([("x", 1), ("y0", 2), ("y4", 3), ("z", 4)], "key string, w int")
    want = sorted((k, v, w) for k, v in map(tuple, rows.collect()) for key, w in map(tuple, table.collect()) if k == key)
    got = storage.spread(rows, table, "k", "key", "v", 60, least=7)
    assert sorted((r.k, r.v, r.w) for r in got.collect()) == want


def test_bounds_of_ids(spark):
    ids = spark.createDataFrame([(i // 2,) for i in range(100)] + [(None,)], "id long")
    bounds, least, nulls = storage.id_bounds(ids, 10, 100)
    assert (least, nulls) == (0, 1) and 5 <= len(bounds) <= 11 and bounds.min() > 0
    assert storage.id_bounds(ids.where("id IS NULL"), 10, 100)[1:] == (None, 1)


def test_payloads_beyond_a_broadcast(spark, monkeypatch):
    """Hot payloads are dealt by id, others meet their original in the file of their digest; and records of 16 MB."""
    monkeypatch.setattr(warc, "SMALL", 0)
    rows = [*PAGES, (20, "http://a/b", "y" * (17 << 20)), (21, "http://a/c", "y" * (17 << 20))]
    got = warc.archived(pages(spark, rows), new_path(spark, "warc")).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == expected(rows)


def test_ranges_are_as_many_as_cores(spark):
    ids = spark.range(10_000).toDF("id")
    assert len(storage.id_bounds(ids, 20_000, 100)[0]) == 0
    assert len(storage.id_bounds(ids, 20_000, 100, 8)[0]) == 7
    assert len(storage.id_bounds(ids.where("id < 600"), 20_000, 100, 8)[0]) == 2
    assert len(storage.id_bounds(ids, 1_000, 5, 3)[0]) == 4 and len(storage.id_bounds(ids.where("false"), 1_000, 5, 8)[0]) == 0
