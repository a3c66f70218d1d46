"""The k best alignments of a pair of sequences, not only the best.

Alignments are the ways through the grid whose operations and scores are those of the alignment operator; a merge or a
split comes right after a match.  Each cell keeps the k best ways to it that end with a match, and the k best others;
they are filled along diagonals for all items of one shape at once and followed back together.  Scores are summed in
millionths, so that equal totals are equal; ways of equal total are ordered by the operations read from the end (match,
delete, merge, insert, split): those of one cell differ in the last operation, or in the one before it, which is a match
or not, or in their order at the cell before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import _AUDIO, _TEXT, DELETE, INSERT, LONGEST, MATCH, MERGE, NOISE, OPS, SPLIT, Lanes, Similarity, _flat, _text, of_one_shape

_FAR = -(1 << 60)
#: Ways into cells that are held at once.
WAYS = 1 << 20
#: The lists of ways into a cell by operations other than a match, in the order of ties: operation, and whether a match comes before.
_INTO = np.array([(DELETE, 1), (DELETE, 0), (MERGE, 1), (INSERT, 1), (INSERT, 0), (SPLIT, 1)])
RESULT = "id long, rank int, total double, ops array<string>"


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(x, np.float64) * 1e6).astype(np.int64)


def _best(totals: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest totals of the last axis, of equal ones the first ones; fewer if no cell has so many."""
    most = max(1, min(k, int((totals > _FAR // 2).sum(-1).max(initial=0))))
    return np.argsort(-totals, axis=-1, kind="stable")[..., :most]


def best_ways(lanes: Lanes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item and total in millionths of the k best ways of each item, best first, and where the operations of each begin
    in the list of all operations, which follows."""
    items, n, m = lanes.items, lanes.n, lanes.m
    drop, gap, size = _units(lanes.drop)[:, :, None], int(_units(lanes.sim.gap)), n + m
    # The ways to the cells of a diagonal by item, heard segments, kind (1: after a match) and rank.
    one = np.full((items, n + 1, 2, 1), _FAR)
    one[:, 0, 0, 0] = 0
    two, chosen, widths = np.full_like(one, _FAR), [], [1, 1]
    for d in range(1, size + 1):
        matched = np.full((items, n + 1, 2, two.shape[-1]), _FAR)
        others = np.full((items, n + 1, len(_INTO), one.shape[-1]), _FAR)
        low, high = max(1, d - m), min(n, d - 1)
        if low <= high:
            here, left = slice(low, high + 1), slice(low - 1, high)
            labels = slice(d - low - 1, d - high - 2 if d - high >= 2 else None, -1)
            match, merge, split = (_units(x)[:, :, None] for x in lanes.costs((slice(None), left), (slice(None), labels)))
            matched[:, here, 0], matched[:, here, 1] = two[:, left, 1] + match, two[:, left, 0] + match
            others[:, here, 2], others[:, here, 5] = one[:, left, 1] + merge, one[:, here, 1] + split
        low, high = max(1, d - m), min(n, d)
        if low <= high:
            here, left = slice(low, high + 1), slice(low - 1, high)
            others[:, here, 0], others[:, here, 1] = one[:, left, 1] + drop[:, left], one[:, left, 0] + drop[:, left]
        here = slice(max(0, d - m), min(n, d - 1) + 1)
        others[:, here, 3], others[:, here, 4] = one[:, here, 1] + gap, one[:, here, 0] + gap
        lists = [x.reshape(items, n + 1, -1) for x in (others, matched)]
        places = [_best(x, k) for x in lists]
        new = np.full((items, n + 1, 2, max(p.shape[-1] for p in places)), _FAR)
        for kind, (x, p) in enumerate(zip(lists, places, strict=True)):
            new[:, :, kind, : p.shape[-1]] = np.take_along_axis(x, p, -1)
        chosen.append([p.astype(np.min_scalar_type(x.shape[-1])) for x, p in zip(lists, places, strict=True)])
        two, one = one, new
        widths.append(new.shape[-1])
    ends = one[:, n, ::-1].reshape(items, -1)
    place = _best(ends, k)
    total = np.take_along_axis(ends, place, -1)
    item, way = np.nonzero(total > _FAR // 2)
    total, place = total[item, way], place[item, way]
    kind, rank = 1 - place // one.shape[-1], place % one.shape[-1]
    a, at, steps = np.full(len(item), n), np.full(len(item), size), []
    for d in range(size, 0, -1):
        now = np.flatnonzero(at == d)
        for f, mine in [(f, now[kind[now] == f]) for f in (0, 1)]:
            if not len(mine):
                continue
            # widths[d] is that of the diagonal before d, widths[d - 1] of the one before that.
            width = widths[d - f]
            c = chosen[d - 1][f][item[mine], a[mine], rank[mine]].astype(np.int64)
            into, rank[mine] = c // width, c % width
            op = np.full(len(mine), MATCH) if f else _INTO[into, 0]
            kind[mine] = 1 - into if f else _INTO[into, 1]
            a[mine] -= (op == MATCH) | (op == DELETE) | (op == MERGE)
            at[mine] -= 1 + f
            steps.append((mine, np.full(len(mine), d), op))
    owner, d, op = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((d, owner))
    return item, total, np.searchsorted(owner[order], np.arange(len(item) + 1)), op[order]


def n_best_batch(sim: Similarity, audio: pa.ListArray, text: pa.ListArray, k: int, longest: int | None = LONGEST) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Item numbers and the columns rank, total and ops of the k best alignments of a batch, in blocks of whole items."""
    heard, a0, n = _flat(audio)
    said, t0, m = _flat(text)
    sounds, labels = pc.utf8_lower(_text(heard, "phoneme")), pc.utf8_lower(_text(said, "phoneme"))
    codes, words = sim.codes(sounds, sim.audio), sim.codes(labels, sim.text)
    noise = pc.is_in(sounds, pa.array(sorted(NOISE))).to_numpy(zero_copy_only=False)
    silence = pc.equal(sounds, "sil").to_numpy(zero_copy_only=False)
    begin, end = (heard.field(f).to_numpy(zero_copy_only=False) for f in ("start", "stop"))
    starts = pc.fill_null(said.field("word_start"), False).to_numpy(zero_copy_only=False)
    names = pa.array(OPS)
    most = np.maximum(n, m)
    sound = np.flatnonzero((n > 0) & (m > 0) & (most <= (longest if longest is not None else most.max(initial=0))))
    for mine in of_one_shape(n, m, sound, WAYS // k) if k > 0 else ():
        a, t = a0[mine][:, None] + np.arange(n[mine[0]]), t0[mine][:, None] + np.arange(m[mine[0]])
        item, total, bounds, op = best_ways(Lanes(sim, codes[a], noise[a], silence[a], begin[a], end[a], words[t], starts[t]), k)
        rank = np.arange(len(item)) - np.searchsorted(item, item) + 1
        yield mine[item], [pa.array(rank.astype(np.int32)), pa.array(total / 1e6), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), names.take(pa.array(op)))]


def n_best(sim: Similarity, audio: list[dict] | None, text: list[dict] | None, k: int) -> list[tuple[float, list[str]]]:
    """(total, operations) of the k best alignments, fewer if there are fewer; none of an empty sequence."""
    found = n_best_batch(sim, pa.array([audio], _AUDIO), pa.array([text], _TEXT), k, None)
    return [way for _, (_, total, ops) in found for way in zip(total.to_pylist(), ops.to_pylist(), strict=True)]


def n_best_tracks(pairs: DataFrame, scores: list[tuple[str, str, float]], k: int, gap: float = -1.0, longest: int | None = LONGEST) -> DataFrame:
    """(id, rank, total, ops) for rows (id, audio, text) of segment arrays, ranks from 1; items with an empty sequence, or
    one of more than ``longest`` segments, have no rows."""
    sim = Similarity({(a, t): s for a, t, s in scores}, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, columns in n_best_batch(sim, batch.column(1), batch.column(2), k, longest):
                yield pa.record_batch([batch.column(0).take(pa.array(item)), *columns], names=["id", "rank", "total", "ops"])

    from ..session import ship

    ship(pairs.sparkSession)
    return pairs.select(F.col("id").cast("long").alias("id"), "audio", "text").mapInArrow(run, RESULT)
