"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

``token_counts`` gives each document's byte and token count, whether it exceeds a token limit and
the longest prefix within the limit, from one pass over the text and without encoding it again.
``PrefixCounts`` holds the count at every prefix of one text and answers any truncation or budget
question about it.

Defined results: null text is empty text (0 bytes, 0 tokens); repeated rows are each counted; an
empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deltaloom.llm import arrays, bpe

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long"


class PrefixCounts:
    """Token counts of all prefixes of one text (in code points), as if each were encoded alone."""

    def __init__(self, text: str | None, vocabulary: bpe.Vocabulary):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        starts, _ = bpe.pretokens(raw, np.array([0, len(raw)]), vocabulary.specials)
        ends = np.append(starts[1:], len(raw)).astype(np.int64)
        by_byte, base, before = [0], 0, b""
        for a, b in zip(starts.tolist(), ends.tolist()):
            piece = raw[a:b].tobytes()
            table = partial_counts(before, piece, vocabulary)
            by_byte += [base + x for x in table[1:]]
            base, before = base + vocabulary.prefix_counts(piece)[-1], piece
        #: As many bytes as the first i code points have.
        self.ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int64) if len(raw) else np.zeros(1, np.int64)
        #: Tokens of the first i code points.
        self.counts = np.array(by_byte, np.int64)[self.ends]

    def tokens(self, n_chars: int) -> int:
        """Tokens of the prefix of so many code points."""
        return int(self.counts[min(n_chars, len(self.counts) - 1)])

    def longest_within(self, n_tokens: int) -> int:
        """Code points of the longest prefix of at most so many tokens."""
        return int(np.flatnonzero(self.counts <= n_tokens)[-1])


def partial_counts(before: bytes, piece: bytes, vocabulary: bpe.Vocabulary) -> list[int]:
    """Tokens that each prefix of a piece adds to all before the piece, when the text ends there.

    Three kinds of piece are cut differently when the text ends inside them: a special string is
    ordinary text as long as it isn't complete, an apostrophe ending ('re) falls apart, and a white
    space after white space joins it.
    """
    table = vocabulary.prefix_counts(piece)
    if piece in vocabulary.specials:
        alone = 0 if before in vocabulary.specials else vocabulary.prefix_counts(before)[-1]
        before = b"" if before in vocabulary.specials else before
        for n in range(1, len(piece)):
            raw = np.frombuffer(before + piece[:n], np.uint8)
            starts, _ = bpe.pretokens(raw, np.array([0, len(raw)]))
            table[n] = sum(vocabulary.prefix_counts(raw[a:b].tobytes())[-1] for a, b in zip(starts, [*starts[1:], len(raw)])) - alone
        return table
    if piece[:1] == b"'" and piece[1:] in bpe.ENDINGS:
        table = [*range(len(piece)), table[-1]]
    first = piece.decode()[:1]
    if first and before and all(bpe.classes()[ord(c)] == bpe.SPACE for c in before.decode() + first):
        n = len(first.encode())
        table = [*table[:n], vocabulary.prefix_counts(before + first.encode())[-1] - vocabulary.prefix_counts(before)[-1], *table[n + 1 :]]
    return table


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    vocabulary = bpe.vocabulary(path)
    known = bpe.remembered(path, "counts")

    def count_new(pieces: list[bytes]) -> tuple[None, np.ndarray]:
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        counts = np.zeros(len(pieces), np.int64)
        counts[order] = [table[-1] for table in vocabulary.prefix_tables([pieces[i] for i in order])]
        return None, counts

    for batch in batches:
        ids = batch.column(0)
        for a, b, data, offs in arrays.blocks(batch.column(1)):
            starts, doc = bpe.pretokens(data, offs, vocabulary.specials)
            ends = np.append(starts[1:], len(data)).astype(np.int64)[: len(starts)]
            _, counts = known.resolve(data, starts, count_new)
            total = np.concatenate(([0], np.cumsum(counts)))
            _, first = arrays.counts_by_doc(doc, b - a)
            n_tokens = total[first[1:]] - total[first[:-1]]
            limit_bytes = offs[1:] - offs[:-1]
            for d in np.flatnonzero(n_tokens > limit).tolist():
                # the piece in which the count passes the limit
                at = int(np.searchsorted(total, total[first[d]] + limit, "right")) - 1
                piece = data[starts[at] : ends[at]].tobytes()
                before = data[starts[at - 1] : ends[at - 1]].tobytes() if at > first[d] else b""
                left = limit - int(total[at] - total[first[d]])
                table = partial_counts(before, piece, vocabulary)
                cuts = [j for j in range(len(piece)) if table[j] <= left and (piece[j] & 0xC0) != 0x80]
                limit_bytes[d] = starts[at] + cuts[-1] - offs[d]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a).cast(pa.int64()), pa.array(offs[1:] - offs[:-1]), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(limit_bytes)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"],
            )


def token_counts(documents: DataFrame, vocabulary_path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, and limit_bytes of its longest prefix within the limit.

    Narrow: one pass, no shuffle; each worker remembers the counts of recent pre-tokens.
    """
    return documents.select(id_column, text_column).mapInArrow(lambda batches: _count(batches, vocabulary_path, limit), SCHEMA)
