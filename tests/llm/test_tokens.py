import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from deltaloom.llm import arrays, bpe  # noqa: E402
from deltaloom.llm.storage import new_path  # noqa: E402
from deltaloom.llm.token_counts import PrefixCounts, token_counts  # noqa: E402
from deltaloom.llm.token_files import lookup, token_digests, write_tokens  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXT = st.text(alphabet=st.sampled_from(list("ab '\n\t1é!sS  trevmld’中😀 x")), max_size=40)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pretokens_are_the_pattern_s(text):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _ = bpe.pretokens(data, np.array([0, len(raw)]))
    ends = [*starts[1:].tolist(), len(raw)][: len(starts)]
    assert [raw[a:b].decode() for a, b in zip(starts.tolist(), ends)] == regex.findall(public.PATTERN, text)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_every_prefix_is_exact(text):
    table = PrefixCounts(text, bpe.vocabulary(PATH))
    assert table.counts.tolist() == [len(library(text[:i])) for i in range(len(text) + 1)]
    for budget in (0, 1, 3):
        assert table.longest_within(budget) == max(i for i in range(len(text) + 1) if len(library(text[:i])) <= budget)


def test_counts_of_a_table(spark, documents, odd_rows):
    got = token_counts(documents(odd_rows), PATH, limit=50).collect()
    assert len(got) == len(odd_rows)
    by_row = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got)
    assert by_row == sorted((i or -1, len((t or "").encode()), len(library(t)), len(library(t)) > 50) for i, t, _, _ in odd_rows)
    for r in got:
        text = next((t for i, t, _, _ in odd_rows if i == r.doc_id), "") or ""
        if r.over_limit:
            cut = text.encode()[: r.limit_bytes].decode()
            assert len(library(cut)) <= 50 < min(len(library(text[: len(cut) + k])) for k in range(1, 6) if len(cut) + k <= len(text))
    assert token_counts(documents([]), PATH).count() == 0


END = "<|endoftext|>"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([END, " ", "  ", "a", "!", "\n", "'s", "<|", "é", "endoftext|>"]), max_size=6).map("".join))
def test_special_strings_are_as_the_library_has_them(text):
    table = PrefixCounts(text, bpe.vocabulary(PATH))
    assert table.counts.tolist() == [len(library(text[:i])) for i in range(len(text) + 1)]


def test_special_strings_in_a_table(spark, documents):
    texts = ["a " + END + " b", END, END + END, "x" + END[:-1], END[5:]]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    assert {r.doc_id: r.n_tokens for r in token_counts(documents(rows), PATH).collect()} == {i: len(library(t)) for i, t in enumerate(texts)}
    path = new_path(spark, "tokens")
    write_tokens(documents(rows), path, PATH, file_rows=3)
    assert lookup(spark, path, [0]).first().ids == [*library(texts[0]), 0]


def test_files_round_trip(spark, documents, odd_rows):
    path = new_path(spark, "tokens")
    write_tokens(documents(odd_rows), path, PATH, file_rows=4)
    got = token_digests(spark, path).orderBy("start").collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t, _, _) in zip(got, rows, strict=True):
        ids = [*library(t), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert lookup(spark, path, [4]).first().ids == [*library(odd_rows[3][1]), 0]
    empty = new_path(spark, "tokens")
    write_tokens(documents([]), empty, PATH)
    assert token_digests(spark, empty).count() == 0


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc xabc abd", np.uint8)
    h = arrays.span_hashes(data, np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert h[0] == h[1] != h[2]
