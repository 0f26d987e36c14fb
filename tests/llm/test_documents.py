import hashlib
import random
import re
import zlib

import pytest

from deltaloom.llm import decontaminate, jaccard, language, mixing, quality, syncmers


def brute_components(rows, n_words, num, den):
    sets = []
    for _, t, _, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + n_words]) for i in range(len(w) - n_words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, len(sets[i]), least.get(find(i), -1)) for i, r in enumerate(rows))


@pytest.mark.parametrize("n_words, num", [(3, 90), (5, 80)])
def test_jaccard_is_brute_force(spark, documents, prose, odd_rows, n_words, num):
    r = random.Random(n_words)
    rows = list(odd_rows)
    for k in range(12):
        base = prose(r.choice([4, 12, 40, 150, 400]), 100 + k).split()
        for _ in range(r.choice([1, 2, 6])):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                words[r.randrange(len(words))] = r.choice(["Zed", "yak", "Xor"])
            rows.append((100 + len(rows), " ".join(words).upper() if r.random() < 0.2 else "  ".join(words), "en", "s"))
    got = jaccard.jaccard_join(documents(rows), n_words, num, 100).collect()
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_shingles, x.component_id if x.component_id is not None else -1) for x in got) == brute_components(rows, n_words, num, 100)


def test_jaccard_of_nothing(spark, documents):
    assert jaccard.jaccard_join(documents([])).count() == 0


def test_hot_chunks_are_salted(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    base = prose(200, 5).split()
    rows = []
    for i in range(40):
        words = list(base)
        words[i * 4] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "s"))
    got = jaccard.jaccard_join(documents(rows), 3, 90, 100).collect()
    assert {x.component_id for x in got} == {0}


def test_remaining_pairs_meet_about_once(spark, documents, prose, monkeypatch):
    """Texts that are just not alike share many chunks; their pairs are not made in each of them, and no rounds are written."""
    base, r, rows, made, tables = prose(400, 6).split(), random.Random(7), [], [], []
    for i in range(24):
        words = list(base)
        for j in r.sample(range(len(words)), 5):
            words[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(words), "en", "s"))
    remaining, written = jaccard._remaining, jaccard.Scratch.written
    monkeypatch.setattr(jaccard, "_remaining", lambda *a: made.append(remaining(*a)) or made[-1].cache())
    monkeypatch.setattr(jaccard.Scratch, "written", lambda self, df, name: tables.append(name) or written(self, df, name))
    got = jaccard.jaccard_join(documents(rows), 5, 80, 100).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(rows, 5, 80, 100)
    pairs = made[0].distinct().count()
    assert pairs > 40 and made[0].count() <= 2 * pairs
    assert len([t for t in tables if t == "turned"]) <= 2 and len(tables) < 40


def test_one_stays(spark, documents, odd_rows):
    docs = documents(odd_rows)
    got = jaccard.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_fingerprints(spark, documents, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    got = syncmers.document_fingerprints(documents(odd_rows), range_rows=3).collect()
    assert len(got) == len(odd_rows)
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    seen = {}
    for k, (i, t, _, _) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        text = (t[: len(t) - cut] + following[:cut]) if cut else t
        seen.setdefault(i, []).append((len(t), hashlib.sha256(text.encode()).hexdigest()))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in seen[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    of = {r.doc_id: r for r in got}
    assert of[5].fingerprint == of[6].fingerprint and of[4].near_edited > 0.4 > of[4].near_next
    assert rows and syncmers.document_fingerprints(documents([])).count() == 0
    assert syncmers.document_fingerprints(documents([(1, "only one text here", None, None)])).first().near_next == 1.0


def test_fingerprint_text_round_trip(prose):
    import pyarrow as pa

    a, b = syncmers.fingerprints(pa.array([prose(200, 1), prose(200, 2)]))
    again = syncmers.Fingerprint.parse(a.text())
    assert again.text() == a.text() and syncmers.likeness(a, again) == 1.0 and syncmers.likeness(a, b) < 0.2


def labelled(spark, prose):
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = prose(60, 1000 + i)
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, "en", "s"))
        labels.append((i, 0 if bad else 1))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality(spark, documents, prose, odd_rows):
    rows, labels = labelled(spark, prose)
    got = {r.doc_id: r for r in quality.quality_scores(documents(rows), labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.predicted == (0 if r.doc_id % 4 == 0 else 1) for r in held)
    odd = quality.quality_scores(documents(rows + [(1000 + k, t, la, s) for k, (_, t, la, s) in enumerate(odd_rows)]), labels).collect()
    assert len(odd) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    kept = quality.accepted(documents(rows), labels)
    assert kept.columns == documents(rows).columns and all(r.doc_id % 4 for r in kept.collect()) and kept.count() == 120
    none = labels.where("false")
    assert {r.score for r in quality.quality_scores(documents(odd_rows), none).collect()} == {0.5}
    assert quality.quality_scores(documents([]), labels).count() == 0


def test_language(spark, documents, prose, odd_rows):
    rows = []
    for i in range(80):
        text = prose(40, 2000 + i)
        rows.append((i, text if i % 2 else " ".join("sch" + w[::-1] + "ü" for w in text.split()), "en" if i % 2 else "de", "s"))
    got = language.languages_of(documents(rows)).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got) and any(r.held_out for r in got)
    odd = {r.doc_id: r for r in language.languages_of(documents([(1000 + k, t, None, s) for k, (_, t, _, s) in enumerate(odd_rows)] + rows)).collect()}
    for k, (_, t, _, _) in enumerate(odd_rows):
        has = any(c.isalpha() for c in t or "")
        assert (odd[1000 + k].lang_pred == "und") == (not has), t
    assert {r.lang_pred for r in language.languages_of(documents([(1, "abc", None, "s")])).collect()} == {"und"}
    assert language.languages_of(documents([])).count() == 0


def test_many_languages_are_all_learned(spark, documents, prose):
    """600 languages of a few documents each, in a model that grows with its entries and not with languages times words."""
    r = random.Random(6)
    words = {k: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12)] for k in range(600)}
    rows = [(i, " ".join(r.choice(words[i % 600]) for _ in range(15)), f"l{i % 600:03}", "s") for i in range(3000)]
    got = language.languages_of(documents(rows)).collect()
    learned = {f"l{i % 600:03}" for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {x.lang_pred for x in got} == learned and len(learned) > 590 and sum(x.lang_pred == f"l{x.doc_id % 600:03}" for x in got) > 0.99 * len(got)
    model = language.train(documents(rows))
    assert sum(map(len, model.lang.values())) < 3 * sum(map(len, model.known.values())) < 10**6
    assert len({x.lang_pred for x in language.languages_of(documents(rows), languages=5).collect()}) <= 5


def test_one_document_an_id_trains(spark, documents, prose):
    """Labels without documents use up no sample, and an id with very many rows is one training row."""
    rows, labels = labelled(spark, prose)
    absent = spark.createDataFrame([(10**6 + i, i % 2) for i in range(5000)], "doc_id long, quality int")
    few = quality.train(documents(rows), labels.union(absent), sample=160)
    alone = quality.train(documents(rows), labels, sample=160)
    assert (few.weights == alone.weights).all() and few.bias == alone.bias and few.slope == alone.slope
    many = quality.train(documents(rows + [rows[0]] * 10_000), labels, sample=160)
    assert (many.weights == alone.weights).all() and many.offset == alone.offset


def test_passages_without_ids_are_sampled_like_others(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "SAMPLE", 100)
    texts = [(None if i % 2 else i, prose(40, 7000 + i), "en", "s") for i in range(2000)]
    same = [(7, t, la, s) for _, t, la, s in texts]
    for rows in (texts, same):
        n = decontaminate.sampled_passages(documents(rows), 4000, "doc_id", "text").count()
        assert 30 < n < 300


def mixing_rows(prose, odd_rows):
    """Rows whose languages occur in all large sources, so that shares of both can be set."""
    rows = [(i, prose(30, i), "en" if i % 4 else "de", f"s{min(i % 7, 2)}") for i in range(300)]
    return rows + [(1000 + k, t, la, s) for k, (_, t, la, s) in enumerate(odd_rows) if s != "c"]


def test_mixing(spark, documents, prose, odd_rows):
    rows = mixing_rows(prose, odd_rows)
    docs = documents(rows)
    targets = {"source": {"s0": 0.4, "s1": 0.3}, "lang": 0.5, "topic": 1.0}
    cells, total, off = mixing.raked(mixing.with_cells(docs, None, "text"), targets)
    assert off <= mixing.TOLERANCE
    by = cells.groupBy("cell_source").agg({"w": "sum"}).collect()
    share = {r[0]: r[1] / total for r in by}
    assert abs(share["s0"] - 0.4) < 1e-6 and abs(share["s1"] - 0.3) < 1e-6
    got = mixing.mixed(docs, targets, keep=0.5, strict=True).collect()
    expected = sum(r.p * r.n_tokens for r in got)
    assert len(got) == len(rows) and abs(expected / total - 0.5) < 0.02
    kept = sum(r.n_tokens for r in got if r.kept)
    assert 0.3 < kept / total < 0.7 and {r.residual for r in got} == {off}
    assert mixing.sampled(docs).columns == docs.columns
    empty = mixing.mixed(documents([]), strict=True)
    assert empty.count() == 0 and set(empty.columns) == set(got[0].asDict())


def test_mixing_out_of_reach(spark, documents, prose, odd_rows):
    """Languages that only one small source has can't have a larger share than that source."""
    rows = mixing_rows(prose, odd_rows) + [(2000 + k, t, la, s) for k, (_, t, la, s) in enumerate(odd_rows) if s == "c"]
    targets = {"source": {"s0": 0.4, "s1": 0.3}, "lang": 0.5, "topic": 1.0}
    with pytest.warns(UserWarning, match="targets are not met"):
        got = mixing.mixed(documents(rows), targets, keep=0.5).collect()
    residual = got[0].residual
    assert mixing.TOLERANCE < residual < 1 and len(got) == len(rows) and all(0 <= r.p <= 1 and r.weight >= 0 for r in got)
    total = sum(r.n_tokens for r in got)
    by, seen = {}, {}
    for r in got:  # the dimension that is scaled last is met
        by[r.cell_topic] = by.get(r.cell_topic, 0) + r.weight * r.n_tokens
        seen[r.cell_topic] = seen.get(r.cell_topic, 0) + r.n_tokens
    assert all(abs(by[t] - seen[t]) < 1e-6 * total for t in by)
    with pytest.raises(ValueError, match="targets are not met"):
        mixing.mixed(documents(rows), targets, strict=True)


@pytest.mark.parametrize("arrays", [mixing.ARRAYS, 0])
def test_mixing_as_arrays_and_as_a_table_is_its_sql(spark, documents, prose, odd_rows, monkeypatch, arrays):
    import duckdb

    monkeypatch.setattr(mixing, "ARRAYS", arrays)
    docs = documents(mixing_rows(prose, odd_rows))
    got = {r.doc_id: r for r in mixing.mixed(docs, strict=True).collect()}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    want = con.sql(mixing.oracle_sql()).fetchall()
    assert len(want) == docs.count()
    for doc_id, source, lang, topic, n, weight, p, kept in want:
        r = got[doc_id]
        assert (r.cell_source, r.cell_lang, r.cell_topic, r.n_tokens, round(r.weight, 6), round(r.p, 6), r.kept) == (source, lang, topic, n, weight, p, kept)


def test_decontamination(spark, documents, prose, odd_rows):
    items = [(k, prose(18 + 5 * k, 5000 + k)) for k in range(10)]
    benchmark = spark.createDataFrame([*items, (None, "x y"), (99, None), (98, "")], "item_id long, text string")
    rows = [(i, prose(150, 6000 + i), "en", "s") for i in range(40)]
    planted = {}
    for i in range(10):
        words = rows[i][1].split()
        at = 13 * i
        rows[i] = (i, " ".join(words[:at] + [items[i][1].upper() if i % 2 else items[i][1]] + words[at:]), "en", "s")
        planted[i] = i
    rows += [(1000 + k, t, la, s) for k, (_, t, la, s) in enumerate(odd_rows)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows), benchmark).collect()}
    assert got == set(planted.items())
    left = decontaminate.clean(documents(rows), benchmark)
    assert left.columns == documents(rows).columns and sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in rows if r[0] not in planted)
    assert decontaminate.contaminated(documents([]), benchmark).count() == 0
    assert decontaminate.contaminated(documents(rows), benchmark.where("false")).count() == 0


def test_long_items_are_brute_force(spark, documents, prose):
    import numpy as np

    def longest_run(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    r = random.Random(5)
    items = [(k, prose(n, 8000 + k)[:-1]) for k, n in enumerate((65, 79, 100, 128, 129, 177, 300))]
    rows = []
    for k, text in items:
        words = text.split()
        n = len(words)
        middle = [(n - m) // 2 for m in (35, 50)]
        quotes = [(0, n), (0, 35), (n - 35, n), (middle[0], middle[0] + 35), (middle[1], middle[1] + 50), (n // 3, n // 3 + 10)]
        quotes += [(a := r.randrange(n - 34), a + 35) for _ in range(8)]
        for a, b in quotes:
            rest = prose(120, 9000 + len(rows)).split()
            at = r.randrange(len(rest))
            rows.append((len(rows), " ".join(rest[:at] + words[a:b] + rest[at:]), "en", "s"))
    rows.append((len(rows), " ".join(prose(60, 1).split() + items[2][1].split()[25:75] + prose(60, 2).split()), "en", "s"))
    want = {(d, k) for d, t, _, _ in rows for k, text in items if longest_run(t.replace(".", "").split(), text.split()) >= 35}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id) for x in decontaminate.contaminated(documents(rows), benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 13 * len(items) + 1
    for n in range(65, 301):
        parts = np.array([c for c in decontaminate.cuts(n) if c[1] - c[0] == 32])
        for a in range(n - 34):
            assert (np.minimum(parts[:, 1], a + 35) - np.maximum(parts[:, 0], a)).max() >= 26


def test_paraphrase_needs_its_answer(spark, documents, prose):
    words = prose(40, 77).split()
    item = spark.createDataFrame([(1, " ".join(words), "rareanswer")], "item_id long, text string, answer string")
    loose = [w if k % 3 else "other" + str(k) for k, w in enumerate(words)]
    rows = [(1, " ".join(loose), "en", "s"), (2, " ".join(loose[:20] + ["rareanswer"] + loose[20:]), "en", "s"), (3, prose(60, 78), "en", "s")]
    rows += [(100 + i, prose(120, 900 + i), "en", "s") for i in range(40)]
    got = decontaminate.contaminated(documents(rows), item, answer_column="answer").collect()
    assert {r.doc_id for r in got} == {2}


def test_common_subsequences():
    import numpy as np

    r = random.Random(3)
    for n in (1, 5, 63, 64):
        a, b = [r.randrange(6) for _ in range(40)], [r.randrange(6) for _ in range(n)]
        places = {}
        for i, w in enumerate(b):
            places[w] = places.get(w, 0) | 1 << i
        table = [[0] * (n + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = np.array([[places.get(x, 0) for x in a]], np.uint64)
        assert decontaminate.common_subsequences(masks, np.array([n])).tolist() == [table[-1][-1]]
