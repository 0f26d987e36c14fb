"""Byte-level BPE over whole batches: pre-token spans, prefix tables, and memoised encodings."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from deltaloom.llm import arrays

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the GPT-2 pre-tokeniser splits off after an apostrophe.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
#: Slots of a worker's table of pre-tokens met before (a later one takes the slot of an earlier one), and ids it holds.
SLOTS = 1 << 19
POOL = 1 << 21
#: Pairs of tokens of which a worker remembers whether they fit.
PAIRS = 800_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            table[i] = LETTER
        elif c == "N":
            table[i] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(1)
def ascii_classes() -> np.ndarray:
    """The class of each byte that is a whole code point; 0 for the others."""
    table = np.zeros(256, np.uint8)
    table[:128] = classes()[:128]
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the code point that each byte of valid UTF-8 belongs to."""
    kind = ascii_classes()[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int32)
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        follow = [padded[lead + i].astype(np.int32) & 0x3F for i in (1, 2, 3)]
        point = np.where(
            b < 0xE0,
            (b & 0x1F) << 6 | follow[0],
            np.where(b < 0xF0, (b & 0x0F) << 12 | follow[0] << 6 | follow[1], (b & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]),
        )
        own = classes()[point]
        kind[lead] = own
        for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            has = b >= least
            kind[lead[has] + i] = own[has]
    return kind


def pretokens(data: np.ndarray, offs: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of a block (no pre-token crosses a document), and their documents.

    Special strings are pieces of their own; what is before and after one is cut as texts of their own.

    The same pieces as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    special = special_spans(data, first, specials) if specials else []
    for a, b in special:
        first[a] = first[b] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space of a run before something else leaves the run; a blank joins what follows
    space = kind == SPACE
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    blank = data[ends] == 32
    start[ends[blank] + 1] = False
    while (inner := (data[ends] & 0xC0) == 0x80).any():
        ends = ends - inner
    start[ends] = True
    # endings after an apostrophe that starts a piece
    for q in np.flatnonzero((data == 39) & start).tolist():
        tail = data[q + 1 : q + 3].tobytes()
        for ending in ENDINGS:
            stop = q + 1 + len(ending)
            if tail.startswith(ending) and not first[q + 1 : stop].any():
                start[q + 1 : stop] = False
                if stop < n:
                    start[stop] = start[stop] or kind[stop] == LETTER
                break
    for a, b in special:
        start[a + 1 : b] = False
        start[a : a + 1] = start[b : b + 1] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(offs, starts, "right") - 1


def special_spans(data: np.ndarray, first: np.ndarray, specials: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Where special strings are, leftmost and then longest first; ``first`` marks where documents begin."""
    raw, at, found = data.tobytes(), 0, []
    pattern = re.compile(b"|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))
    while hit := pattern.search(raw, at):
        a, at = hit.span()
        if first[a + 1 : at].any():  # it runs over the end of a document
            at = a + 1
        else:
            found.append((a, at))
    return found


class Vocabulary:
    """Byte strings of a byte-level BPE vocabulary with their ids (the id is the merge rank)."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model["added_tokens"]}
        #: Strings that the library takes as one token wherever they are in a text.
        self.specials = special_strings(model)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.ids = {bytes(back[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.ranks = {(bytes(back[c] for c in a), bytes(back[c] for c in b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain BPE: merge the pair of least rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, far = self.ranks, len(self.ranks)
        while len(parts) > 1:
            best, at = min((ranks.get((parts[i], parts[i + 1]), far), i) for i in range(len(parts) - 1))
            if best == far:
                break
            pair = (parts[at], parts[at + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def whole(self, token: bytes) -> bool:
        """Whether merging can yield the token at all."""
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = len(self.merge(token)) == 1
        return got

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether merging the two tokens' bytes gives these two tokens again."""
        got = self._fits.get((left, right))
        if got is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            got = self._fits[left, right] = self.merge(left + right) == [left, right]
        return got

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Exact token count of every prefix of one pre-token, lengths 0 to its own."""
        return self.prefix_tables([piece])[0]

    def prefix_tables(self, pieces: list[bytes]) -> list[list[int]]:
        """``prefix_counts`` of sorted pre-tokens; what a piece shares with the one before is kept.

        The last token of the encoding of a prefix is the only token that ends there, starts where
        another prefix ends, and fits that prefix's last token; so one pass over the end positions,
        each looking up shorter prefixes, finds the encodings of all prefixes.
        """
        ids, fits, longest = self.ids, self._fits, self.longest
        counts, lasts, before, out = [0], [b""], b"", []
        for piece in pieces:
            if piece in self.specials:
                out.append([0] * len(piece) + [1])
                continue
            shared, most = 0, min(len(piece), len(before))
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del counts[shared + 1 :], lasts[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = piece[start:end]
                    if token in ids:
                        pair = (lasts[start], token)
                        fit = fits.get(pair)
                        if fit is None:
                            fit = fits[pair] = self.fits(*pair) if start else self.whole(token)
                        if fit:
                            counts.append(counts[start] + 1)
                            lasts.append(token)
                            break
            out.append(counts.copy())
            before = piece
        return out


def special_strings(model: dict) -> tuple[bytes, ...]:
    for x in model["added_tokens"]:
        if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
            raise ValueError(f"{x['content']}: only plain special tokens are supported")
    return tuple(x["content"].encode() for x in model["added_tokens"])


@lru_cache(2)
def specials_of(path: str) -> dict[bytes, int]:
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    ids = {x["content"].encode(): x["id"] for x in model["added_tokens"]}
    return {s: ids[s] for s in special_strings(model)}


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Remembered:
    """Token ids (or only their number) of pre-tokens by hash: a fixed number of slots and a bounded pool."""

    def __init__(self):
        self.key, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.zeros(POOL, np.int32), 0

    def resolve(self, data: np.ndarray, starts: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each pre-token of a block; ``encode`` gives (ids or None, numbers) of new ones."""
        ends = np.append(starts[1:], len(data)).astype(np.int64)[: len(starts)]
        value = arrays.span_hashes(data, starts, ends)
        if self.used > POOL // 2:  # forget all, with room for a block's new pieces
            self.key[:], self.used = 0, 0
        slot = (value & np.uint64(SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != value)
        at, size = self.at[slot], self.size[slot]
        if len(miss):
            new, where, back = np.unique(value[miss], return_index=True, return_inverse=True)
            raw = data.tobytes()
            first = miss[where]
            ids, numbers = encode([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            places = np.zeros(len(new), np.int64)
            if ids is not None:
                places = self.used + np.concatenate(([0], np.cumsum(numbers)[:-1]))
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.int32)))
                self.pool[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
            own = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.key[own], self.at[own], self.size[own] = new, places, numbers
            at[miss], size[miss] = places[back], numbers[back]
        return at, size


@lru_cache(4)
def remembered(path: str, what: str) -> Remembered:
    """A worker's table, kept from task to task."""
    return Remembered()


def library_ids(path: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens by the library's own BPE model, end to end, and their numbers."""
    letters = {b: c for b, c in byte_letters().items()}
    tokenize = library(path).model.tokenize
    special = specials_of(path)
    each = [[special[piece]] if piece in special else [t.id for t in tokenize(piece.decode("latin-1").translate(letters))] for piece in pieces]
    numbers = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter((i for ids in each for i in ids), np.int32, int(numbers.sum())), numbers
