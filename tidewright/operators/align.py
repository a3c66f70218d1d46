"""Gap- and word-aware global alignment of a timed and a labelled sequence.

Totals are filled along anti-diagonals in float32, for all items of one shape at once, so a step is a few vector
operations; of equal totals the first operation in MATCH .. SPLIT order wins.  Only two diagonals of totals are held.
The way back needs each cell's operation: a large grid keeps the two diagonals before every block of about the
square root of all diagonals, and fills the blocks again from the last to the first, holding one block's
operations.  So memory is linear in the longer sequence but for that root, with the same operations and ties.
Bad inputs give an error text, never an exception.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

f32 = np.float32
#: Scores and limits of the alignment.
GAP, SIL_DELETE, LEAST, SMALL = f32(-1.0), f32(2.1) + f32(0.01), f32(-2.1), f32(0.01)
LONGEST = 499
FLOOR = np.finfo(f32).min
#: Cells whose operations are held at once.
CELLS = 1 << 22
#: Labels without text counterpart.
NOISE = {"sil", "+nsn+", "+spn+"}
SILENT = NOISE | {"<sil>", "</s>"}

NONE, MATCH, DELETE, MERGE, INSERT, SPLIT = range(6)
OPS = ["", "match", "delete", "merge_left", "insert", "split_left"]

SEGMENT = "struct<phoneme:string,word_start:boolean,start:bigint,stop:bigint,weight:float,score:float,active:boolean,op:string,source:string>"
RESULT = f"rows array<{SEGMENT}>, ops array<string>, min_score float, has_gaps boolean, error string"


class Similarity:
    """Scores by (audio label, text label), lower case; a gap penalty for all others."""

    def __init__(self, scores: dict[tuple[str, str], float], gap: float = -1.0) -> None:
        self.gap = f32(gap)
        self.audio = {a: i for i, a in enumerate(dict.fromkeys(a.lower() for a, _ in scores))}
        self.text = {t: i for i, t in enumerate(dict.fromkeys(t.lower() for _, t in scores))}
        # One more row and column for unknown labels.
        self.table = np.full((len(self.audio) + 1, len(self.text) + 1), self.gap, f32)
        for (a, t), s in scores.items():
            self.table[self.audio[a.lower()], self.text[t.lower()]] = s

    def codes(self, labels: pa.Array, known: dict[str, int]) -> np.ndarray:
        """Rows or columns of the table by lower-case labels."""
        coded = labels.dictionary_encode()
        place = np.array([known.get(x, len(known)) for x in coded.dictionary.to_pylist()] or [0])
        return place[coded.indices.to_numpy()] if len(labels) else np.zeros(0, np.int64)


class Lanes:
    """Items of one shape: n heard segments by m labels each, arrays by (item, place)."""

    def __init__(self, sim: Similarity, heard: np.ndarray, noise: np.ndarray, silence: np.ndarray, start: np.ndarray, stop: np.ndarray, said: np.ndarray, begins: np.ndarray) -> None:
        self.sim, self.heard, self.noise, self.said, self.begins = sim, heard, noise, said, begins
        (self.items, self.n), self.m = heard.shape, said.shape[1]
        self.drop = np.where(silence, SIL_DELETE, sim.gap).astype(f32)
        self.gap = start > np.concatenate([stop[:, :1], stop[:, :-1]], 1)
        self.follows = np.concatenate([self.gap[:, 1:], np.zeros((self.items, 1), bool)], 1)
        self.closes = np.concatenate([begins[:, 1:], np.ones((self.items, 1), bool)], 1)

    def costs(self, a, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own scores of match, merge and split at cells (index arrays or slices of heard segments and of labels)."""
        gap, follows, begins, closes = self.gap[a], self.follows[a], self.begins[t], self.closes[t]
        score = np.where(self.noise[a], LEAST, self.sim.table[self.heard[a], self.said[t]])
        across = self.sim.gap * f32(1.5) + score * f32(0.5)
        apart = (gap & ~begins) | (follows & begins & ~closes)
        match = np.where(apart & ~(begins & closes), across, score)
        return match, np.where(gap, across, score - SMALL), np.where(follows & ~closes, across, score - SMALL)

    def forward(self, first: int, last: int, state: tuple, ops: list[np.ndarray] | None) -> tuple:
        """Fills the diagonals first .. last from the totals of the two before, and the operations of the one before."""
        n, m, gap, (two, one, done) = self.n, self.m, self.sim.gap, state
        for d in range(first, last + 1):
            total, op = np.full((self.items, n + 1), FLOOR, f32), np.zeros((self.items, n + 1), np.int8)
            low, high = max(1, d - m), min(n, d - 1)
            if low <= high:
                here, left = slice(low, high + 1), slice(low - 1, high)
                labels = slice(d - low - 1, d - high - 2 if d - high >= 2 else None, -1)
                match, merge, split = self.costs((slice(None), left), (slice(None), labels))
                sums = np.stack([
                    two[:, left] + match,
                    one[:, left] + self.drop[:, left],
                    np.where(done[:, left] == MATCH, one[:, left] + merge, FLOOR),
                    one[:, here] + gap,
                    np.where(done[:, here] == MATCH, one[:, here] + split, FLOOR),
                ])
                best = sums.argmax(0)
                op[:, here] = best + 1
                total[:, here] = np.take_along_axis(sums, best[None], 0)[0]
            if d <= m:
                total[:, 0], op[:, 0] = one[:, 0] + gap, INSERT
            if d <= n:
                total[:, d], op[:, d] = one[:, d - 1] + self.drop[:, d - 1], DELETE
            if ops is not None:
                ops.append(op)
            two, one, done = one, total, op
        return two, one, done

    def path(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The steps of the best paths in order: item, operation, heard segment, label (-1: before the first), own score."""
        n, m, size = self.n, self.m, self.n + self.m
        two = np.full((self.items, n + 1), FLOOR, f32)
        one = two.copy()
        one[:, 0] = 0
        state = (two, one, np.zeros((self.items, n + 1), np.int8))
        block = size if self.items * (n + 1) * size <= CELLS else math.isqrt(size) + 1
        firsts, states, ops = list(range(1, size + 1, block)), [], []
        for f in firsts:
            states.append(state)
            state = self.forward(f, min(f + block - 1, size), state, ops if len(firsts) == 1 else None)
        at, place = np.full(self.items, size), np.full(self.items, n)
        steps: list[tuple] = []
        for f, state in zip(reversed(firsts), reversed(states), strict=True):
            if len(firsts) > 1:
                ops = []
                self.forward(f, min(f + block - 1, size), state, ops)
            for d in range(f + len(ops) - 1, f - 1, -1):
                items = np.flatnonzero(at == d)
                if len(items):
                    a = place[items]
                    op = ops[d - f][items, a]
                    steps.append((items, op, a - 1, d - a - 1, np.full(len(items), d)))
                    at[items] -= np.where(op == MATCH, 2, 1)
                    place[items] -= (op == MATCH) | (op == DELETE) | (op == MERGE)
        item, op, a, t, d = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((d, item))
        item, op, a, t = item[order], op[order], a[order], t[order]
        match, merge, split = self.costs((item, np.maximum(a, 0)), (item, np.maximum(t, 0)))
        drop = self.drop[item, np.maximum(a, 0)]
        own = np.choose(op - 1, [match, drop, merge, np.full(len(op), self.sim.gap, f32), split]).astype(f32)
        return item, op, a, t, own


def _flat(column: pa.ListArray) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """The cells of a list column, and where each list begins and how long it is; a null list is an empty one."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.cumsum(sizes) - sizes, sizes


def _text(cells: pa.StructArray, field: str) -> pa.Array:
    return pc.fill_null(cells.field(field), "")


def of_one_shape(n: np.ndarray, m: np.ndarray, items: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """The items in blocks of one shape (n, m), each of so many cells or one item."""
    order = items[np.lexsort((m[items], n[items]))]
    edges = np.flatnonzero(np.diff(n[order], prepend=-1) | np.diff(m[order], prepend=-1)).tolist()
    for x, y in zip(edges, edges[1:] + [len(order)] * bool(edges), strict=True):
        size, width = int(n[order[x]]), int(m[order[x]])
        step = max(1, cells // ((size + 1) * (size + width)))
        for k in range(x, y, step):
            yield order[k : min(k + step, y)]


def align_batch(sim: Similarity, audio: pa.ListArray, text: pa.ListArray, longest: int | None = LONGEST) -> list[pa.Array]:
    """The columns rows, ops, min_score, has_gaps and error of a batch of items."""
    heard, a0, n = _flat(audio)
    said, t0, m = _flat(text)
    sounds, labels = _text(heard, "phoneme"), _text(said, "phoneme")
    low_sounds, low_labels = pc.utf8_lower(sounds), pc.utf8_lower(labels)
    codes, words = sim.codes(low_sounds, sim.audio), sim.codes(low_labels, sim.text)
    noise = pc.is_in(low_sounds, pa.array(sorted(NOISE))).to_numpy(zero_copy_only=False)
    silent = pc.is_in(low_sounds, pa.array(sorted(SILENT))).to_numpy(zero_copy_only=False)
    silence = pc.equal(low_sounds, "sil").to_numpy(zero_copy_only=False)
    begin, end = (heard.field(f).to_numpy(zero_copy_only=False) for f in ("start", "stop"))
    starts = pc.fill_null(said.field("word_start"), False).to_numpy(zero_copy_only=False)
    weights = said.field("weight").to_numpy(zero_copy_only=False)
    most = np.maximum(n, m)
    empty, long = (n == 0) | (m == 0), most > (longest if longest is not None else most.max(initial=0))
    sound = np.flatnonzero(~empty & ~long)
    # Items of one shape are lanes, in blocks whose cells are held at once.
    parts = []
    for mine in of_one_shape(n, m, sound, CELLS):
        a, t = a0[mine][:, None] + np.arange(n[mine[0]]), t0[mine][:, None] + np.arange(m[mine[0]])
        item, op, i, j, own = Lanes(sim, codes[a], noise[a], silence[a], begin[a], end[a], words[t], starts[t]).path()
        item = mine[item]
        parts.append((item, op, a0[item] + i, t0[item] + j, own))
    item, op, i, j, own = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, k) for k in (np.int64, np.int8, np.int64, np.int64, f32))
    by_item = np.argsort(item, kind="stable")
    item, op, i, j, own = item[by_item], op[by_item], i[by_item], j[by_item], own[by_item]
    return _columns(len(n), item, op, i, j, own, sounds, labels, begin, end, starts, weights, silent, empty, long, longest)


def _columns(count, item, op, i, j, own, sounds, labels, begin, end, starts, weights, silent, empty, long, longest) -> list[pa.Array]:
    """The result columns of the steps of all items, by item and step."""
    total = len(item)
    same = np.zeros(total + 1, bool)
    same[1:-1] = item[1:] == item[:-1]
    next_op = np.where(same[1:], np.append(op[1:], 0), 0)
    skipped = np.zeros(total, bool)
    gone = op == DELETE
    skipped[gone] = silent[i[gone]]
    score = np.where(op == MERGE, (np.roll(own, 1) + own) / f32(2), own).astype(f32)
    # A match that the next step merges becomes that step's row.
    shown = np.flatnonzero(~skipped & ~((op == MATCH) & (next_op == MERGE)))
    o, i_, j_ = op[shown], np.maximum(i[shown], 0), np.maximum(j[shown], 0)
    begins, ends = (x[i_] if len(x) else np.zeros(0, np.int64) for x in (begin, end))
    half = begins + (ends - begins) // 2
    first = np.where(o == SPLIT, half, np.where(o == MERGE, begin[np.maximum(i_ - 1, 0)] if len(begin) else 0, begins))
    last = np.where((o == MATCH) & (next_op[shown] == SPLIT), half, ends)
    # An inserted label lies where the last row that was heard ends, or at 0.
    inserted, lane = o == INSERT, item[shown]
    place = np.maximum.accumulate(np.where(inserted, -1, np.arange(len(o))))
    heard_before = (place >= 0) & (lane[place] == lane)
    at = np.where(heard_before, last[place], 0)
    first, last = np.where(inserted, at, first), np.where(inserted, at, last)
    word = np.isin(o, (MATCH, MERGE, INSERT, SPLIT))
    label = np.where(word, np.array(labels.to_pylist(), object)[j_] if len(labels) else "", "_") if len(o) else np.zeros(0, object)
    names = sounds.to_pylist()

    def span(k: int) -> str:
        return f"{names[k]}[{begin[k]}-{end[k]}]"

    def source(kind: int, k: int, name: str) -> str:
        if kind == MATCH:
            return f"{name:<2}~ {span(k)}"
        if kind == DELETE:
            return f"{'':<2}d {span(k)}"
        if kind == MERGE:
            return f"{name:<2}~> {span(k - 1)}+{span(k)}"
        return f"{name:<2}i" if kind == INSERT else f"{name:<2}\\ {span(k)}"

    sources = [source(*x) for x in zip(o.tolist(), i_.tolist(), label.tolist(), strict=True)]
    kinds = np.array(OPS, object)
    cells = [
        pa.array(label, pa.string()),
        pa.array(word & (starts[j_] if len(starts) else False)),
        pa.array(first.astype(np.int64)),
        pa.array(last.astype(np.int64)),
        pa.array(np.where(word, weights[j_] if len(weights) else 1.0, 1.0).astype(f32)),
        pa.array(score[shown]),
        pa.array(np.isin(o, (MATCH, MERGE, SPLIT))),
        pa.array(kinds[o], pa.string()),
        pa.array(sources, pa.string()),
    ]
    rows = pa.StructArray.from_arrays(cells, fields=list(_SEGMENT))

    def lists(owner: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)), values)

    counted = np.flatnonzero(~skipped)
    least = np.full(count, np.inf, f32)
    np.minimum.at(least, item[counted], score[counted])
    gaps = np.zeros(count, bool)
    gaps[item[counted][np.isin(op[counted], (DELETE, INSERT))]] = True
    bad = empty | long
    error = np.full(count, None, object)
    error[long], error[empty] = f"more than {longest} segments", "empty sequence"
    return [
        lists(lane, rows),
        lists(item, pa.array(kinds[op], pa.string())),
        pa.array(least, mask=bad | np.isinf(least)),
        pa.array(gaps, mask=bad),
        pa.array(error, pa.string()),
    ]


_SEGMENT = pa.struct([
    ("phoneme", pa.string()), ("word_start", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("weight", pa.float32()),
    ("score", pa.float32()), ("active", pa.bool_()), ("op", pa.string()), ("source", pa.string()),
])
_AUDIO = pa.list_(pa.struct([("phoneme", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_TEXT = pa.list_(pa.struct([("phoneme", pa.string()), ("word_start", pa.bool_()), ("weight", pa.float32())]))
_NAMES = ["rows", "ops", "min_score", "has_gaps", "error"]


def align(sim: Similarity, audio: list[dict] | None, text: list[dict] | None, longest: int | None = LONGEST) -> dict:
    """The aligned rows of one item."""
    found = align_batch(sim, pa.array([audio], _AUDIO), pa.array([text], _TEXT), longest)
    return {k: c[0].as_py() for k, c in zip(_NAMES, found, strict=True)}


def align_tracks(pairs: DataFrame, scores: list[tuple[str, str, float]], gap: float = -1.0, longest: int | None = LONGEST) -> DataFrame:
    """(id, rows, ops, min_score, has_gaps, error) for rows (id, audio, text) of segment arrays.

    ``scores`` is a similarity matrix (audio, text, score): a fixed table of labels, not data.  Items with a sequence of
    more than ``longest`` segments are an error; None aligns any length.
    """
    sim = Similarity({(a, t): s for a, t, s in scores}, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = align_batch(sim, batch.column(1), batch.column(2), longest)
            yield pa.record_batch([batch.column(0), *found], names=["id", *_NAMES])

    from ..session import ship

    ship(pairs.sparkSession)
    return pairs.select(F.col("id").cast("long").alias("id"), "audio", "text").mapInArrow(run, f"id long, {RESULT}")
