"""Operators that SQL cannot express, held against plain versions of their definitions."""

import ctypes
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import arrays, decontaminate, jaccard, language, quality, syncmers, urls

MASK = (1 << 64) - 1


# -- n-gram Jaccard join


@pytest.mark.parametrize("num", [80, 90])
def test_every_band_shares_a_chunk_at_the_threshold(num):
    """Pairs just at the threshold, of all sizes that a band serves, have a chunk key in common."""
    low, chunks, _ = jaccard.bands(num, 100)
    rng = np.random.default_rng(num)
    seen = 0
    for k in range(len(low)):
        if low[k] > 6000:
            break
        top = int(low[k + 1]) - 1
        for larger in {int(low[k]), (int(low[k]) + top) // 2, top}:
            smaller = {larger, -(-larger * num // 100), (larger - -(-larger * num // 100)) // 2 + -(-larger * num // 100)}
            for other in smaller:
                common = next((c for c in range(other + 1) if 100 * c >= num * (larger + other - c)), None)
                if common is None or (larger == other == common):
                    continue
                for _ in range(40 if larger < 100 else 4):
                    pool = np.unique(rng.integers(0, 1 << 63, 2 * (larger + other), dtype=np.uint64))
                    rng.shuffle(pool)
                    a, b = np.sort(pool[:larger]), np.sort(np.concatenate((pool[:common], pool[larger : larger + other - common])))
                    keys, doc = jaccard.chunk_keys(np.concatenate((a, b)), np.array([0, larger, larger + other]), np.ones(2, bool), num, 100)
                    assert set(keys[doc == 0].tolist()) & set(keys[doc == 1].tolist()), (k, larger, other)
                    seen += 1
    assert seen > 1000


def test_sketches_bound_differences(spark):
    """The Hamming distance of two sets' sketches, folded to one length, is at most their symmetric difference, and near it."""
    rng = np.random.default_rng(8)
    rows, want = [], []
    for n, other, common in [(1, 1, 1), (3, 4, 3), (500, 512, 500), (500, 600, 495), (512, 513, 512), (1000, 1030, 900), (1024, 1100, 300), (5000, 5900, 4990), (9000, 8000, 10), (70_000, 66_000, 65_000)]:
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + other), dtype=np.uint64))
        rng.shuffle(pool)
        a, b = pool[:n], np.concatenate((pool[:common], pool[n : n + other - common]))
        longs, begin = jaccard.whole_sketches(np.concatenate((a, b)), np.array([0, n, n + other]))
        assert all(64 * x >= m and x >= jaccard.LONGS for x, m in zip(np.diff(begin), (n, other)))
        one, two = (longs[x:y].view(np.int64).tolist() for x, y in zip(begin[:-1], begin[1:]))
        short = min(len(one), len(two))
        folded = [[s[i] ^ (s[i + short] if len(s) > short else 0) for i in range(short)] for s in (one, two)]
        apart, differ = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & MASK).bit_count() for x, y in zip(*folded)), n + other - 2 * common
        assert apart <= differ and (differ > n or apart >= differ * 0.6)
        rows.append((n, one, other, two))
        want.append(min(n, other) * 100 >= 80 * max(n, other) and apart * 180 <= (n + other) * 20)
    got = spark.createDataFrame(rows, "size1 int, sketch1 array<long>, size2 int, sketch2 array<long>").select(jaccard._near(80, 100).alias("x")).collect()
    assert [r.x for r in got] == want and True in want and False in want


def test_sets_with_empty_chunks_meet(monkeypatch):
    """Where too many chunks are empty each time, the band's common key is left."""
    monkeypatch.setattr(jaccard, "bands", lambda num, den: (np.array([1, 100]), np.array([50, 50]), np.array([0, 0])))
    keys, doc = jaccard.chunk_keys(np.arange(8, dtype=np.uint64) << np.uint64(40), np.array([0, 4, 8]), np.ones(2, bool), 80, 100)
    assert set(keys[doc == 0].tolist()) & set(keys[doc == 1].tolist())


def test_stars_over_batches():
    """Pivots are the same however rows are cut to batches."""
    rows = sorted((r.randrange(30), r.choice([0, 0, 0, 1]), r.randrange(8)) for r in [random.Random(4)] for _ in range(200))
    groups = defaultdict(list)
    for k, s, a in rows:
        groups[k, s].append(a)
    want = sorted((k, s, a, v[0]) for (k, s), v in groups.items() for a in set(v) if len(set(v)) > 1 or s)
    for size in (1, 2, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[j : j + size]], pa.int64()) for i in range(3)], names=["key", "salt", "a"]) for j in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in jaccard._stars(iter(batches)) for x in b.to_pylist()]
        assert sorted(set(got)) == want


def test_crowded_keys_and_hot_sets(spark, documents, prose, monkeypatch):
    """Many documents share a passage, and a third of all rows are copies of one text."""
    from deltaloom.llm import storage

    monkeypatch.setattr(storage, "HOT_KEYS", 1)
    shared = prose(50, 1)
    rows = [(i, f"{shared} {prose(12, 100 + i)}", "en", "s") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", "en", "s") for i in range(20)] + [(200 + i, rows[0][1], "en", "s") for i in range(40)]
    from tests.llm.test_documents import brute_components

    got = jaccard.jaccard_join(documents(rows), 5, 80, 100).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(rows, 5, 80, 100)


# -- URL filter


def markov(counted, order, context, symbol, n):
    """Witten and Bell's interpolation by its definition; contexts of two symbols or more seen once are unknown."""
    lower = markov(counted, order - 1, context[1:], symbol, n) if order else 1 / n
    own = counted[order].get(context, {})
    total, kinds = sum(own.values()), len(own)
    if not total or (order >= 2 and total < 2):
        return lower
    return (own.get(symbol, 0) + kinds * lower) / (total + kinds)


def test_url_scores_are_the_definition_s(spark):
    r = random.Random(9)
    rows = [(i, f"http://{'site' if i % 3 else 'casino'}{r.randrange(9)}.{'com/buy' if i % 3 else 'net/es'}/{r.randrange(99)}" + "?q=é" * (i % 7 == 0), "") for i in range(150)]
    rows += [(1000, None, ""), (1001, "", ""), (1002, "http://casino4.org/x", ""), (1003, "no scheme", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("allow", "com/"), ("block", "net/es/")]
    got = {x.page_id: x for x in urls.url_verdicts(pages, rules).collect()}
    held = {x.url for x in pages.where(F.pmod(F.xxhash64("url"), F.lit(urls.HOLD)) == 0).collect()}
    counts = {c: [defaultdict(Counter) for _ in range(urls.ORDER + 1)] for c in ("allow", "block")}
    walk = lambda url: [(tuple(([0] * urls.ORDER + [int(urls._CODE[b]) for b in url.encode()])[i : i + urls.ORDER]), s) for i, s in enumerate([*(int(urls._CODE[b]) for b in url.encode()), 0])]
    by_rule = {i: "allow" if ".com/" in u else "block" for i, u, _ in rows[:150]}
    for i, u, _ in rows[:150]:
        if u not in held:
            for context, s in walk(u):
                for order in range(urls.ORDER + 1):
                    counts[by_rule[i]][order][context[urls.ORDER - order :]][s] += 1
    score = {}
    for i, u, _ in rows:
        parts = walk(u or "")
        score[i] = sum(math.log(markov(counts["allow"], urls.ORDER, c, s, urls._N)) - math.log(markov(counts["block"], urls.ORDER, c, s, urls._N)) for c, s in parts) / len(parts)
        assert abs(score[i] - got[i].score) < 1e-9
    # the cut: the bin edge that errs least on held URLs, nearest to 0
    bins = {i: max(0, min(urls.BINS - 1, math.floor(score[i] / urls.WIDTH) + urls.BINS // 2)) for i, u, _ in rows[:150] if u in held}
    sizes = Counter(by_rule[i] for i in bins)
    wrong = [sum(by_rule[i] == "allow" and b < e for i, b in bins.items()) / sizes["allow"] + sum(by_rule[i] == "block" and b >= e for i, b in bins.items()) / sizes["block"] for e in range(urls.BINS + 1)]
    edge = min((e for e in range(urls.BINS + 1) if wrong[e] <= min(wrong) + 1e-12), key=lambda e: abs(e - urls.BINS // 2))
    cut = (edge - urls.BINS // 2) * urls.WIDTH
    for i, _, _ in rows:
        assert got[i].verdict == (by_rule.get(i) or ("allow" if score[i] >= cut else "block"))


# -- benchmark decontamination


def changed(words, share, r):
    return [f"other{r.randrange(10**6)}" if r.random() < share else w for w in words]


def test_recall_of_candidates_and_paraphrases(spark, documents, prose, monkeypatch):
    """Against all windows, verified without the latent search: passages whole, reworded by a fifth and by two fifths."""
    r = random.Random(8)
    items = [(k, prose(r.choice([16, 24, 40, 60]), 7000 + k)[:-1]) for k in range(30)]
    rows, planted = [], {}
    for i in range(240):
        rest = prose(r.choice([40, 200]), 20_000 + i).split()
        if i % 2:
            k = r.randrange(30)
            at = r.randrange(len(rest))
            planted[i] = k, (0, 0.2, 0.4)[i // 2 % 3]
            rest[at:at] = changed(items[k][1].split(), planted[i][1], r)
        rows.append((i, " ".join(rest), "en", "s"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    scans, scaled = decontaminate._scans(docs, benchmark, "doc_id", "text", "item_id", "text", None)
    table = pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows])], names=["text"])

    def found():
        return {(rows[d][0], item) for _, best in decontaminate._found(iter([table]), 0, scans[0], scaled) for d, item in best}

    with_search = found()
    assert with_search == {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "COSINE", -2.0)
    everything = found()
    assert with_search <= everything and len(with_search) >= 0.95 * len(everything)
    verbatim = {(i, k) for i, (k, share) in planted.items() if share == 0}
    assert verbatim <= with_search
    assert {d for d, _ in with_search} <= set(planted)


def test_many_blocks_long_texts_and_several_scans(spark, documents, prose, monkeypatch):
    """The same rows however the benchmark is cut to blocks and scans; a text over a segment is searched whole."""
    items = [(k, prose(30, 500 + k)[:-1]) for k in range(12)]
    long = prose(3000, 1).split()
    for k in range(12):
        long[200 * k + 57 : 200 * k + 57] = items[k][1].split()
    rows = [(i, prose(60, 900 + i) + " " + items[i % 12][1], "en", "s") for i in range(12)] + [(50, " ".join(long), "en", "s"), (None, items[3][1], "en", "s"), (60, prose(50, 3), "en", "s")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    want = {(i, i % 12) for i in range(12)} | {(50, k) for k in range(12)} | {(None, 3)}
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, benchmark).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 70)
    monkeypatch.setattr(decontaminate, "SCAN", 2)
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    assert [x.doc_id for x in decontaminate.clean(docs, benchmark).collect()] == [60]
    scans, scaled = decontaminate._scans(docs, benchmark, "doc_id", "text", "item_id", "text", None)
    assert len(scans) > 1
    monkeypatch.setattr(decontaminate, "SEGMENT", 512)
    table = pa.RecordBatch.from_arrays([pa.array([" ".join(long)])], names=["text"])
    assert {item for blocks in scans for _, best in decontaminate._found(iter([table]), 0, blocks, scaled) for _, item in best} == set(range(12))


def test_search_meets_every_pair_by_plain_counts(prose):
    """Candidates are the pairs of a window and a passage with the cosine and the words, by passage; common shares are those of plain loops."""
    r = random.Random(4)
    hashes = lambda texts: [list(w) for w in decontaminate._split(pa.array(texts))]
    asked = hashes([prose(n, 300 + n) for n in (1, 3, 8, 20, 31, 32, 33, 40, 63, 64)])
    scaled = np.vstack((np.random.default_rng(3).standard_normal((1 << decontaminate.BITS, 8)), np.zeros(8))).astype(np.float32)
    search = decontaminate.Search([decontaminate.Passage(k, np.array(w, np.uint64), set()) for k, w in enumerate(asked)], scaled)
    texts = hashes([prose(n, 400 + n) for n in (1, 7, 8, 9, 31, 32, 33, 47, 64, 65, 100, 257)]) + [[]]
    for text in texts[8:12]:
        w = r.choice(asked)
        at = r.randrange(len(text))
        text[at:at] = w
    word, first = np.array(sum(texts, []), np.uint64), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    known = search.known(word)
    assert known.tolist() == [int(np.flatnonzero(search.vocabulary == w)[0]) if w in search.vocabulary else len(search.vocabulary) for w in word]

    want = set()
    for g, (length, own, latent, *_) in enumerate(search.groups):
        hop, margin = length // 4, length // 4
        for d, text in enumerate(texts):
            for at in range(0, len(text), hop):
                if at and at > 8 * -(-len(text) // 8) + hop - 8 - length:
                    continue
                window = scaled[decontaminate.bucket(np.array(text[at : at + length], np.uint64))].sum(axis=0)
                stretch = text[max(at - margin, 0) : 8 * -(-(at + length + margin) // 8)]
                for q, p in enumerate(own):
                    cosine = float(window @ latent[q]) / float(np.linalg.norm(window))
                    assert abs(cosine - decontaminate.COSINE) > 1e-5
                    if cosine >= decontaminate.COSINE and sum(w in p.words for w in stretch) >= decontaminate.PARAPHRASE * len(p.words):
                        want.add((g, d, int(first[d]) + at, q))
    got = []
    for g, docs, starts, queries in search.candidates(word, np.append(known, len(search.vocabulary)), first):
        assert (np.diff(queries) >= 0).all()
        got += zip([g] * len(docs), docs.tolist(), starts.tolist(), queries.tolist())
    assert len(got) == len(set(got)) and set(got) == want and {g for g, *_ in want} == {0, 1}


def test_blocks_fault_in_no_new_memory(spark, documents, prose):
    """A worker that searches one block after the other keeps its memory: page faults stay far below the bytes that its arrays take."""
    import resource

    try:
        ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        pytest.skip("another C library")
    benchmark = spark.createDataFrame([(k, prose(r, 60 + k)) for k, r in enumerate([20, 30, 50] * 20)], "item_id long, text string")
    scans, scaled = decontaminate._scans(documents([(1, prose(500, 1), "en", "s")]), benchmark, "doc_id", "text", "item_id", "text", None)
    blocks = scans[0]

    def faults(batches):
        for batch in batches:
            for _ in range(2):
                before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
                assert [found.num_rows for found, _ in decontaminate._found(iter([batch]), 0, blocks, scaled)] == [batch.num_rows]
                faulted = (resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) * resource.getpagesize()
            yield pa.RecordBatch.from_pydict({"faulted": [faulted], "size": [batch.nbytes]})

    texts = documents([(i, prose(2000, i % 20), "en", "s") for i in range(800)]).select("text").coalesce(1)
    got = texts.mapInArrow(faults, "faulted long, size long").collect()
    assert sum(x.faulted for x in got) < 4 * sum(x.size for x in got), got


# -- fingerprints


def smer(raw):
    """The hash that orders s-mers, by whole numbers."""
    x = sum(int(arrays.BYTE_VALUES[b]) * pow(arrays._BASE, i, 1 << 64) for i, b in enumerate(raw)) & MASK
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def closed_syncmers(text):
    """(k-mer, occurrence) to place, by the definition."""
    k, s = syncmers.K, syncmers.S
    if len(text) < k:
        return {(text, 0): 0} if text else {}
    out, seen = {}, Counter()
    for i in range(len(text) - k + 1):
        order = [smer(text[i + j : i + j + s].encode()) for j in range(k - s + 1)]
        if min(order) in (order[0], order[-1]):
            out[text[i : i + k], seen[text[i : i + k]]] = i
            seen[text[i : i + k]] += 1
    return out


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    rising = [b[x] for x in sorted(a.keys() & b.keys(), key=a.get)]
    best = []
    for x in rising:
        at = next((i for i, y in enumerate(best) if y >= x), len(best))
        best[at : at + 1] = [x]
    return len(best) / len(a.keys() | b.keys())


def test_fingerprints_are_the_definition_s(spark, documents, prose):
    texts = [prose(40, 1), prose(3, 2), "", "short", "aaaa" * 20, "é中😀 " * 12 + prose(20, 3), prose(22, 4)[:127], prose(22, 4)[:129], "x", "-" * 9, "0123456789", prose(300, 5)]
    rows = [(i, t or None, "en", "s") for i, t in enumerate(texts)]
    anchors = [closed_syncmers(t) for t in texts]
    for x in syncmers.document_fingerprints(documents(rows), range_rows=3, kept=None).collect():
        i, text, following = x.doc_id, texts[x.doc_id], texts[(x.doc_id + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut] if cut else text
        assert int(x.fingerprint[:8], 16) == len(anchors[i]) == (len(x.fingerprint) - 8) // 16
        assert sorted(syncmers.Fingerprint.parse(x.fingerprint).places.tolist()) == sorted(anchors[i].values())
        assert x.near_edited == pytest.approx(likeness(anchors[i], closed_syncmers(edited))), text
        assert x.near_next == pytest.approx(likeness(anchors[i], anchors[(i + 1) % len(texts)]))


def test_kept_anchors_estimate_likeness(prose):
    """No switch at any length, and an error as stated."""
    off = []
    for n in [*range(8, 40), *range(100, 400, 10)]:
        a = prose(n, n)
        b = a[: len(a) * 3 // 4] + prose(n, 1000 + n)[: len(a) // 4]
        some, all_ = (syncmers.likeness(*syncmers.fingerprints(pa.array([a, b]), kept)) for kept in (64, None))
        off.append(some - all_)
    assert np.abs(off).max() < 4 / 16 and np.sqrt(np.mean(np.square(off))) < 1 / 16


# -- quality classifier


def shape_of(token):
    letters = re.fullmatch(rb"[a-zA-Z\x80-\xff]+", token)
    if token.isdigit():
        return "digits"
    if not letters:
        return token
    upper = sum(65 <= b <= 90 for b in token)
    if not upper:
        return "lower"
    if upper == 1 and 65 <= token[0] <= 90:
        return "capital"
    return "upper" if upper > 1 and 2 * upper > len(token) else token


def indicators(text):
    tokens = re.findall(rb"[a-zA-Z\x80-\xff]+|[0-9]+|[^a-zA-Z0-9\x80-\xff\t\n\x0b\x0c\r ]+", text.encode())
    shapes, before = [], None
    for t in tokens:
        letters = re.fullmatch(rb"[a-zA-Z\x80-\xff]+", t)
        shapes.append("again" if letters and t == before else shape_of(t))
        before = t if letters else before
    grams = {("word", t) for t in tokens} | {("pair", *tokens[i : i + 2]) for i in range(len(tokens) - 1)}
    return grams | {(n, *shapes[i : i + n]) for n in (3, 5) for i in range(len(shapes) - n + 1)}


def test_indicators_are_the_definition_s(prose):
    """As many different features as the definition gives, up to collisions of hashing."""
    texts = [prose(80, 1), "The THE the McX ABc a a a, 12 12 -- é É!? a, a", "", "x", "A1b2 c3!! !! ..", prose(5, 2).upper(), "a\n\tb  a b a b"]
    for text, (_, _, data, offs) in zip(texts, (b for t in texts for b in arrays.blocks(pa.array([t])))):
        at, first = quality.features(data, offs)
        want = len(indicators(text))
        assert 0 <= want - len(at) <= want * want / (1 << quality.BITS) + 2 and len(set(at.tolist())) == len(at)


def test_dual_descent_reaches_the_optimum(prose):
    """The primal objective on ratio-scaled indicators is that of the dual, and scores are the formula's."""
    r = random.Random(2)
    texts = [prose(12, i) if i % 3 else prose(12, i).upper().replace(" ", "! ") for i in range(60)]
    texts = [t if r.random() < 0.9 else texts[0] for t in texts]
    parts = [quality.features(d, o)[0] for t in texts for _, _, d, o in arrays.blocks(pa.array([t]))]
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    label = np.array([int(i % 3 > 0) for i in range(60)])
    cost = 0.5
    model = quality.fit(np.concatenate(parts), first, label, np.zeros(60, bool), cost=cost, rounds=2000)
    good, bad = np.ones(1 << quality.BITS), np.ones(1 << quality.BITS)
    for p, y in zip(parts, label):
        (good if y else bad)[p] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    y = np.where(label == 1, 1.0, -1.0)
    own = np.divide(model.weights, ratio, out=np.zeros_like(ratio), where=ratio != 0)
    x = [np.zeros(0)] * 60
    margins = []
    for i, p in enumerate(parts):
        x[i] = ratio[p] / math.sqrt(len(p))
        margins.append(float(own[p] @ x[i]) + model.bias)
    weight = {s: cost * 60 / (2 * (y == s).sum()) for s in (1.0, -1.0)}
    primal = 0.5 * (own @ own + model.bias**2) + sum(weight[s] * max(0, 1 - s * m) for s, m in zip(y, margins))
    # at the optimum w'w + b'b = the sum of alpha, so twice the regulariser and the losses meet in the dual value
    dense = np.zeros((60, (1 << quality.BITS)), np.float32)
    for i, p in enumerate(parts):
        dense[i, p] = x[i]
    gram = (dense @ dense.T + 1) * np.outer(y, y)
    alpha, most = np.zeros(60), np.array([weight[s] for s in y])
    for _ in range(4000):
        for i in range(60):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1) / gram[i, i], 0), most[i])
    dual = alpha.sum() - 0.5 * alpha @ gram @ alpha
    assert primal == pytest.approx(dual, rel=2e-2)
    scores = model.scores(np.concatenate(parts), first)
    for i, p in enumerate(parts):
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * (model.weights[p].sum() / math.sqrt(len(p)) + model.bias) + model.offset))))


# -- language


def word_grams(word, size):
    out = [("in", word[i : i + size]) for i in range(len(word) - size + 1)]
    if size > 1 and len(word) >= size - 1:
        out += [("first", word[: size - 1]), ("last", word[len(word) - size + 1 :])]
    return out


def test_language_is_the_definition_s(spark, documents, prose):
    import zlib

    rows = []
    for i in range(90):
        text = prose(25, 3000 + i)
        rows.append((i, [text, " ".join("sch" + w[::-1] + "ü" for w in text.split()), text.upper() + " qu'où"][i % 3], ["en", "de", "fr"][i % 3], "s"))
    rows += [(1000, "UNSEENWORD Österreich", None, "s"), (1001, "", None, "s"), (1002, "中文", "en", "s"), (1003, "the 12 the", None, "s"), (1004, None, "en", "s")]
    got = {x.doc_id: x for x in language.languages_of(documents(rows)).collect()}
    words = lambda t: [w.decode() for w in re.findall(rb"[a-z\x80-\xff]+", (t or "").lower().encode())]
    train = [(words(t), la) for i, t, la, _ in rows if la and t is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted({la for _, la in train})
    counts = [defaultdict(Counter) for _ in range(language.LONGEST + 1)]
    for ws, la in train:
        for w in ws:
            counts[0][w][la] += 1
            for size in range(1, language.LONGEST + 1):
                for g in word_grams(w, size):
                    counts[size][g][la] += 1
    counts = [{k: c for k, c in table.items() if sum(c.values()) >= language.LEAST} for table in counts]
    totals = [{la: sum(c[la] for c in table.values()) for la in names} for table in counts]
    log = lambda size, value, la: math.log((counts[size][value][la] + 0.5) / (totals[size][la] + 0.5 * (len(counts[size]) + 1)))
    docs_of = Counter(la for _, la in train)
    for i, t, _, _ in rows:
        ws = words(t)
        sums = {la: math.log(docs_of[la] / len(train)) for la in names}
        for w in ws:
            known = [(0, w)] if w in counts[0] else next((k for size in range(language.LONGEST, 0, -1) if (k := [(size, g) for g in word_grams(w, size) if g in counts[size]])), [])
            for la in names:
                sums[la] += sum(log(size, v, la) for size, v in known) / max(len(known), 1)
        share = {la: math.exp((v - max(sums.values())) / math.sqrt(len(ws) + 1)) for la, v in sums.items()}
        best = max(names, key=share.get)
        if any(c.isalpha() for c in t or ""):
            assert got[i].lang_pred == best and got[i].score == pytest.approx(share[best] / sum(share.values()), abs=1e-4)
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_languages_are_bounded_by_parameters(spark, documents, prose):
    rows = [(i, prose(10, i), f"l{i % 40}", "s") for i in range(200)]
    model = language.train(documents(rows), languages=5, sample_of_all=10)
    assert len(model.languages) == 5 == len(model.base[0]) and model.lang[0].max() < 5
    many = language.train(documents(rows))
    assert len(many.languages) == 40
    text = next(iter(arrays.blocks(pa.array([rows[0][1], rows[7][1]]))))
    whole = many.predict(text[2], text[3])
    language.CELLS, kept = 80, language.CELLS
    try:
        assert np.allclose(many.predict(text[2], text[3])[1], whole[1])
    finally:
        language.CELLS = kept


def test_latent_space_is_of_all_passages(spark, documents, prose, monkeypatch):
    """The vectors hold what the best ones of the matrix of all passages hold, however few ``sampled_passages`` would draw."""
    monkeypatch.setattr(decontaminate, "SAMPLE", 10)
    rows = [(i, prose(40 + i % 90, 3000 + i) + f" topic{i % 150}" * 9, "en", "s") for i in range(900)]
    benchmark = spark.createDataFrame([(k, prose(30, 100 + k)) for k in range(5)], "item_id long, text string")
    _, scaled = decontaminate._scans(documents(rows), benchmark, "doc_id", "text", "item_id", "text", None)

    words = decontaminate._split(pa.array([x[1] for x in rows]))
    passages = [w[a : a + 32] for w in words for a in range(0, len(w), 32)]
    asked = [w[a:b] for w in decontaminate._split(benchmark.toArrow().column(1).combine_chunks()) for a, b in decontaminate.cuts(len(w))]
    size = 1 << decontaminate.BITS
    seen = sum(np.bincount(np.unique(decontaminate.bucket(p)), minlength=size) for p in passages)
    weights = np.log((len(passages) + 1) / (seen + 1)) + 1e-3
    used = np.unique(np.concatenate([decontaminate.bucket(p) for p in passages + asked]))

    def matrix(lists):
        out = np.array([np.bincount(decontaminate.bucket(p), minlength=size)[used] for p in lists]) * weights[used]
        return out / np.linalg.norm(out, axis=1, keepdims=True) / len(lists) ** 0.5

    whole = np.vstack((matrix(passages), matrix(asked)))
    vectors = scaled.value[:-1] / weights[:, None]
    assert np.allclose(vectors.T @ vectors, np.eye(decontaminate.RANK), atol=1e-3)
    best = np.linalg.svd(whole, compute_uv=False)[: decontaminate.RANK]
    assert np.linalg.norm(whole @ vectors[used]) ** 2 > 0.96 * (best**2).sum()
