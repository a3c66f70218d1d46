"""Drags against a plain version that handles one click at a time."""

import random

from pyspark.sql import functions as F

from tidewright.operators import drags

rng = random.Random(21)


def plain_block(track, slot, left, mode):
    """(first, last, first active, last active) of a click on a track of (start, stop, word_start, active), places from 0."""
    if mode == "word":
        first = max([i for i, s in enumerate(track) if s[2] and i <= slot], default=0)
        last = min([i - 1 for i, s in enumerate(track) if s[2] and i > slot], default=len(track) - 1)
        active = [i for i in range(first, last + 1) if track[i][3]] + [slot]
        return first, last, min(active), max(active)
    first = last = slot
    if mode in ("neighbour", "linked"):
        other = slot - 1 if left else slot + 1
        if 0 <= other < len(track):
            a, b = min(slot, other), max(slot, other)
            if mode == "neighbour" or track[a][1] >= track[b][0]:
                first, last = a, b
    return first, last, first, last


def plain_drag(track, slot, position, mode, delta, longest, damping):
    if not 0 <= slot < len(track) or 0.3 <= position <= 0.7:
        return None
    left = position < 0.3
    first, last, first_active, last_active = plain_block(track, slot, left, mode)
    reference = track[slot][0] if left else track[slot][1]
    begin, end = track[first][0], track[last][1]
    low = 0 if left and slot <= first_active else begin
    high = longest if not left and slot >= last_active else end
    out, floor = [], low
    for i in range(first, len(track)):
        if track[i][1] > end:
            break

        def moved(at):
            if at < reference:
                weight = damping * (at - begin) / (reference - begin) if reference != begin else None
            elif at > reference:
                weight = damping * (end - at) / (end - reference) if end != reference else None
            else:
                weight = 1.0
            if weight is None:
                return None
            to = int(at + delta * weight)
            snapped = int(abs(to) / 5 + 0.5) * 5 * (1 if to >= 0 else -1)
            return low if snapped < low else high if snapped > high else snapped

        a, b = moved(track[i][0]), moved(track[i][1])
        a = max(a, floor) if out else a
        b = max(a, b)
        floor = b
        out.append((i + 1, a, b))
    return (first + 1, last + 1, reference, begin, end, low, high), out


def test_equal_to_one_click_at_a_time(spark):
    segments, tracks = [], {}
    for t in range(40):
        at, track = 0, []
        for _ in range(rng.randint(1, 9)):
            start = at + rng.choice([0, 0, 15])
            at = start + rng.randint(10, 80)
            track.append((start, at, rng.random() < 0.3, rng.random() < 0.7))
        tracks[t] = track
        segments += [(t, i + 1, *s, "x") for i, s in enumerate(track)]
    clicks = [(c, rng.randint(0, 41), rng.randint(0, 10), rng.choice([0.0, 0.1, 0.29, 0.5, 0.75, 1.0]), rng.choice([*drags.MODES, "odd"]), rng.randint(-90, 90)) for c in range(600)]
    rows = spark.createDataFrame(segments, "id long, slot long, start long, stop long, word_start boolean, active boolean, side string")
    asked = spark.createDataFrame(clicks, "click long, id long, slot long, position double, mode string, delta long")
    starts = drags.drag_starts(asked, rows, F.lit(700))
    points = drags.drag_points(starts, rows, damping=0.8)
    want = {c: plain_drag(tracks[t], slot - 1, position, mode, delta, 700, 0.8) for c, t, slot, position, mode, delta in clicks if t in tracks and mode != "odd"}
    want = {c: w for c, w in want.items() if w}
    got = {r.click: (r.first, r.last, r.reference, r.block_start, r.block_stop, r.low, r.high) for r in starts.collect()}
    assert got == {c: w[0] for c, w in want.items()} and len(got) > 100
    moved = {}
    for r in drags.drag_results(points, F.col("delta")).collect():
        moved.setdefault(r.click, []).append((r.slot, r.start, r.stop))
    assert {c: sorted(m) for c, m in moved.items()} == {c: w[1] for c, w in want.items()}


def test_empty(spark):
    rows = spark.createDataFrame([], "id long, slot long, start long, stop long, word_start boolean, active boolean")
    asked = spark.createDataFrame([(1, 1, 1, 0.1, "none", 5), (2, None, 1, None, None, 5)], "click long, id long, slot long, position double, mode string, delta long")
    assert drags.drag_starts(asked, rows, F.lit(10)).count() == 0
