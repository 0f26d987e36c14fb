"""The corpus pipeline, stage by stage, against plain versions of the stages, on rows with odd values."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from deltaloom.llm import arrays, mixing, quality  # noqa: E402
from deltaloom.llm.storage import written  # noqa: E402
from tests.llm.test_documents import brute_components  # noqa: E402


@pytest.fixture
def folder(spark, documents, prose, odd_rows, scratch):
    items = [(k, prose(24 + k, 4000 + k)[:-1]) for k in range(8)]
    rows = [(1000 + k if i is not None else None, t, la, s) for k, (i, t, la, s) in enumerate(odd_rows)]
    labels = []
    for i in range(160):
        text = prose(40 + i % 50, i)
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 5 == 1 and i > 20:
            text = rows[-1][1] + " one more"
        elif i % 5 == 3:
            text = text + "\n" + items[i % 8][1]
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4 // 2}"))
        labels.append((i, int(i % 5 > 0), 0))
    rows.append((7, rows[12 + 7][1], "en", "s1"))  # a repeated row
    documents(rows).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    return scratch, items


def tuples(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r[:1]) + tuple(x or "" for x in r[1:]))


def test_stages(spark, folder):
    folder, items = folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]

    got = written(stages["quality classifier"](spark, docs, folder), "stage")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = {t: model.scores(*quality.features(d, o))[0] for _, t, _, _ in tuples(docs) for _, _, d, o in arrays.blocks(pa.array([t], pa.string()))}
    assert by_id(tuples(got)) == by_id([r for r in tuples(docs) if score[r[1]] >= 0.5]) and got.columns == columns
    assert not any(r[0] is not None and r[0] < 1000 and r[0] % 5 == 0 for r in tuples(got)) and any(r[0] is None for r in tuples(got))

    before = tuples(got)
    got = written(stages["n-gram Jaccard join"](spark, got, folder), "stage")
    least = [c for _, _, c in brute_components(before, 5, 80, 100)]
    keep = {i for i, _, c in brute_components(before, 5, 80, 100) if i == c}
    assert by_id(tuples(got)) == by_id([r for r in dict.fromkeys(before) if r[0] is None or r[0] in keep]) and got.columns == columns and len(keep) < len(set(least) | {r[0] for r in before})

    before = tuples(got)
    got = written(stages["benchmark decontamination"](spark, got, folder), "stage")
    assert by_id(tuples(got)) == by_id([r for r in before if not any(t in (r[1] or "") for _, t in items)]) and got.columns == columns and len(before) > got.count() > 0

    before = written(got, "stage")
    got = written(stages["mixing sources to target weights"](spark, got, folder), "stage")
    with duckdb.connect() as db:
        db.register("documents", before.toArrow())
        kept = [r[0] for r in db.execute(f"SELECT doc_id FROM ({mixing.oracle_sql()}) WHERE kept").fetchall()]
    assert sorted((r[0] is not None, r[0] or 0) for r in tuples(got)) == sorted((i is not None, i or 0) for i in kept) and got.columns == columns and 0 < len(kept) < before.count()

    rows = by_id(tuples(got))
    result = stages["token-ID / binary output"](spark, got, folder).orderBy("start").collect()
    library, start = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    for x, (i, t, _, _) in zip(result, rows, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, result), key=str)


def test_stages_of_nothing(spark, folder):
    folder, _ = folder
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
