import base64
import gzip
import hashlib

import numpy as np

from deltaloom.llm import urls, warc
from deltaloom.llm.queries import URL_RULES
from deltaloom.llm.storage import new_path

PAGES = [
    (1, "https://a.example.com/en/1", "<p>one</p>"),
    (2, "http://www.Example.COM/en/2?x=1", "<p>one</p>"),
    (3, "http://x.net/fr/a#b", "<p>é😀</p>"),
    (4, "http://x.net", None),
    (5, None, ""),
    (6, "no scheme", "<p>one</p>"),
    (None, "http://y.org/en/", "<p>one</p>"),
    (7, "ftp://evilexample.com/en/3", "\r\n\r\nWARC/1.0\r\n"),
    (8, "http://net/es/", "x" * 200_000),
    (8, "http://net/es/", "x" * 200_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, k int")


def test_rules(spark):
    got = {(r.page_id, r.host): r for r in urls.url_verdicts(pages(spark), URL_RULES).collect()}
    said = {k[0]: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert said[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert said[2] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert said[3] == ("x.net", "/fr/a", "net/fr/", "block")
    assert said[4][:3] == ("x.net", "", None) and said[5][:3] == ("", "", None) and said[6][:3] == ("", "", None)
    assert said[7] == ("evilexample.com", "/en/3", "com/", "allow")
    assert said[8][2:] == ("net/es/", "block")
    assert urls.url_verdicts(pages(spark, []), URL_RULES).count() == 0


def test_method_learns(spark):
    rows = [(i, f"http://site{i % 9}.com/buy/{i}" if i % 2 else f"http://casino-win{i % 9}.net/es/{i}", "") for i in range(200)]
    rows += [(1000 + i, f"http://casino-win{i}.org/x/{i}" if i % 2 else f"http://site{i}.org/buy/{i}", "") for i in range(20)]
    got = {r.page_id: r for r in urls.url_verdicts(pages(spark, rows), URL_RULES).collect()}
    assert all(got[1000 + i].verdict == ("block" if i % 2 else "allow") for i in range(20))


def test_probabilities_sum_to_one():
    codes, _ = urls._codes(np.frombuffer(b"abcabcabd", np.uint8), np.array([0, 9]))
    model = urls.Markov({o: np.unique(codes[o], return_counts=True) for o in range(urls.ORDER + 1)})
    for context in (codes[3][4] // urls._N, 7):
        total = model.prob(urls.ORDER, context * urls._N + np.arange(urls._N)).sum()
        assert abs(total - 1) < 1e-9


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[digest(h)] = max(i, last.get(digest(h), i))
    out = []
    for i, _, h in rows:
        to = last.get(digest(h))
        first = to is None or i == to
        out.append((i or -1, len((h or "").encode()), digest(h), "response" if first else "revisit", -1 if first else to))
    return sorted(out)


def test_archives(spark):
    folder = new_path(spark, "warc")
    got = warc.archived(pages(spark), folder).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == expected(PAGES)
    # any gzip reader can read the archives, as a whole and member by member
    index = spark.read.parquet(f"{folder}/index").collect()
    files = {r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/archives").collect()}
    records = sum(len(list(warc.split_records(gzip.decompress(c)))) for c in files.values() if c)
    assert records == len(index) == len(PAGES)
    for r in index:
        raw = gzip.decompress(files[r.archive][r["at"] : r["at"] + r.length])
        assert len(raw) == r.record_bytes and raw.startswith(b"WARC/1.1\r\n")
    assert warc.archived(pages(spark, []), new_path(spark, "warc")).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = warc.archived(pages(spark), new_path(spark, "warc"), least_bytes=1000).collect()
    assert [r.record_type for r in got] == ["response"] * len(PAGES)


def test_inflate_takes_one_stream_or_many():
    one = gzip.compress(b"a" * 1000)
    assert warc.inflate(one) == b"a" * 1000 and warc.inflate(one + b"\0\0" + warc.member(b"bc")) == b"a" * 1000 + b"bc"
