"""Vectorised text primitives shared by the operators of this subpackage.

All functions work on whole texts.  Texts of one Arrow batch are handled in
slices of about ``SLICE`` code points, so memory does not follow the batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Code points handled at once; a single longer text is one slice of its own.
SLICE = 400_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: Cells that are hashed one after another; longer segments are hashed in chunks, and so are their chunks' hashes.
_CHUNK = 16
_BYTE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_POINT_MASK = np.array([(1 << (21 * k)) - 1 for k in range(4)], np.uint64)
_POINT = np.uint64((1 << 21) - 1)


def _packed(symbols: np.ndarray) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray | None]:
    """A function of places that gives the next 8 bytes, 3 code points or 1 word as one number; masks by the symbols that count."""
    if symbols.dtype == np.uint8:
        raw = np.concatenate([symbols, np.zeros(8, np.uint8)])
        return np.ndarray(len(symbols), "<u8", raw, strides=(1,)).__getitem__, _BYTE_MASK
    if symbols.dtype.itemsize < 8:
        raw = np.concatenate([symbols, np.zeros(2, symbols.dtype)]).astype("<u4", copy=False)
        two = np.ndarray(len(symbols) + 1, "<u8", raw, strides=(4,))  # the first code point is the low half

        def three(at: np.ndarray) -> np.ndarray:
            x = two[at]
            return x & _POINT | x >> np.uint64(32) << np.uint64(21) | raw[at + 2].astype(np.uint64) << np.uint64(42)

        return three, _POINT_MASK
    return symbols.__getitem__, None


def segment_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``symbols[s:e]``, equal for equal segments wherever they lie.

    Every step mixes what came before with the next symbols, so that no arithmetic of a
    sum of powers lets built-up texts share a hash."""
    cells, masks = _packed(symbols)
    step = 1 if masks is None else len(masks) - 1
    lengths = ends - starts
    counts = -(-lengths // step)
    h = mix64((lengths.astype(np.uint64) + np.uint64(1)) * _MULT)
    if len(counts) and counts.max() > _CHUNK:
        long = np.flatnonzero(counts > _CHUNK)
        parts = -(-counts[long] // _CHUNK)
        last = np.cumsum(parts)
        begin = np.repeat(starts[long], parts) + _CHUNK * step * (np.arange(last[-1]) - np.repeat(last - parts, parts))
        inner = segment_hashes(symbols, begin, np.minimum(begin + _CHUNK * step, np.repeat(ends[long], parts)))
        h[long] = mix64(h[long] ^ segment_hashes(inner, last - parts, last))
        counts = counts.copy()
        counts[long] = 0
    at = np.flatnonzero(counts)
    k = 0
    while len(at):
        x = cells(starts[at] + k * step)
        if masks is not None:
            x = x & masks[np.minimum(lengths[at] - k * step, step)]
        h[at] = mix64((h[at] ^ x) + _MULT)
        k += 1
        at = at[counts[at] > k]
    return h


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most`` code points."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """One string of all texts (null: empty), its code points and the texts' bounds."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=bounds[1:])
    text = "".join(t for t in texts if t)
    return text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def joined_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the texts' bounds among them."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=bounds[1:])
    return np.frombuffer(b"".join(raw), np.uint8), bounds


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, cut at the bounds too."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    """Per code point: letter, number, white space or other."""
    by = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for a, b in ((0, 0x40000), (0xE0000, 0xE1000)):  # no other plane has letters or numbers
        table[a:b] = np.fromiter((by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(a, b)), np.uint8, b - a)
    table[WHITE_SPACE] = SPACE
    return table


def byte_level_words(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the words into which byte-level BPE cuts texts before merging.

    The rule: contractions ('s 't 're 've 'm 'll 'd); runs of letters, of numbers
    or of other signs, each with one space before it; runs of white space, which
    leave their last character to what follows.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[cps]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    cut = first[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    gap = cps == 0x20
    # The last of a white run of two or more starts a word if something follows in its text.
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~first[1 : n + 1]
    start = cut | last
    # A space right before a run belongs to that run.
    glued = np.zeros(n, bool)
    glued[1:] = last[:-1] & gap[:-1] & cut[1:]
    start &= ~glued
    marks = np.flatnonzero((cps == 0x27) & start)
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == LETTER) & ~first[marks + 1]]
    if len(marks):
        one, two = cps[marks + 1], np.zeros(len(marks), np.uint32)
        inside = marks + 2 < n
        inside[inside] = ~first[marks[inside] + 2]
        two[inside] = cps[marks[inside] + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[marks[short | long] + 1] = False
        for ends in (marks[short] + 2, marks[long] + 3):
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


class WordTable:
    """What an encoder gives for each distinct word, kept for the words to come.

    ``encode(words)`` returns all ids of the words, one after another, and their
    counts.  The table holds at most ``limit`` words; beyond it starts anew, so
    its memory is bounded and nothing is lost.
    """

    def __init__(self, encode, limit: int = 500_000) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        from pandas._libs.hashtable import UInt64Factorizer

        self.codes = UInt64Factorizer(1 << 16)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.n = self.used = 0

    def look_up(self, text: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of the words ``text[s:e]``; unseen words are encoded first."""
        if self.n > self.limit:
            self.clear()
        codes = self.codes.factorize(segment_hashes(cps, starts, ends)).astype(np.int64)
        n = int(codes.max(initial=-1)) + 1
        if n > self.n:
            where = np.flatnonzero(codes >= self.n)
            first = np.zeros(n - self.n, np.int64)
            first[codes[where[::-1]] - self.n] = where[::-1]
            a, b = starts[first].tolist(), ends[first].tolist()
            ids, counts = self.encode([text[x:y] for x, y in zip(a, b, strict=True)])
            if n > len(self.at):
                self.at, self.size = np.resize(self.at, 2 * n), np.resize(self.size, 2 * n)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.size[self.n : n] = counts
            self.at[self.n : n] = self.used + np.cumsum(counts) - counts
            self.n, self.used = n, self.used + len(ids)
        return codes

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of words, and each word's count."""
        sizes = self.size[codes].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.at[codes] - before, sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes


def byte_bpe_ids(texts: list[str | None], table: WordTable, special: str = "<|endoftext|>", special_id: int = 50256) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, one after another, and each text's bounds among them.

    The special string is cut out before words are, as the tokenizers library does.
    """
    whole, cps, bounds = joined(texts)
    inner, marks = bounds, np.zeros(0, np.int64)
    if special in whole:
        marks, edges = [], set()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = whole.find(special, a, b)
            while at >= 0:
                marks.append(at)
                edges.update((at, at + len(special)))
                at = whole.find(special, at + len(special), b)
        marks = np.array(marks, np.int64)
        inner = np.unique(np.concatenate([bounds, np.array(sorted(edges), np.int64)]))
    starts = byte_level_words(cps, inner)
    if len(marks):
        hidden = np.zeros(len(cps) + 1, np.int64)
        hidden[marks] += 1
        np.subtract.at(hidden, marks + len(special), 1)
        inside = np.cumsum(hidden)[starts] > 0
        starts = starts[~inside | np.isin(starts, marks)]
    ends = np.append(starts[1:], len(cps))
    is_mark = np.isin(starts, marks)
    plain = np.flatnonzero(~is_mark)
    sizes = np.ones(len(starts), np.int64)
    ids, sizes[plain] = table.expand(table.look_up(whole, cps, starts[plain], ends[plain]))
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    if len(marks):
        out = np.full(total[-1], special_id, np.uint32)
        out[np.repeat(~is_mark, sizes)] = ids
        ids = out
    return ids, total[np.searchsorted(starts, bounds)]
