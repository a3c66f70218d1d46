"""Timing edits of one track, as folds over its array of segments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, LEAST_MS = 5, 50


def snap(time: float, low: int, high: int, step: int = STEP) -> int:
    t = math.floor(time / step + 0.5) * step if time >= 0 else -math.floor(-time / step + 0.5) * step
    return low if t < low else high if t > high else int(t)


def neighbours(segments: list[dict], k: int) -> tuple[int | None, int | None]:
    """Where the change of segment k reaches on both sides, within its word."""
    before = None if segments[k]["word_start"] else next((i for i in range(k - 1, -1, -1) if segments[i]["active"] or segments[i]["word_start"]), None)
    after = None
    for i in range(k + 1, len(segments)):
        if segments[i]["word_start"]:
            break
        after = i
        if segments[i]["active"]:
            break
    return before, after


def deactivate(segments: list[dict], k: int) -> None:
    """Segment k and inactive ones beside it collapse onto one position, which their active neighbours reach."""
    me = segments[k]
    me["active"] = False
    before, after = neighbours(segments, k)
    left, right = before is not None and segments[before]["active"], after is not None and segments[after]["active"]
    middle = me["start"] + max(me["stop"] - me["start"], 0) // 2
    at = middle if left == right else me["stop"] if left else me["start"]
    for s in segments[before:k] if before is not None else ():
        s["stop"] = at
        if not s["active"]:
            s["start"] = at
    me["start"] = me["stop"] = at
    for s in segments[k + 1 : after + 1] if after is not None else ():
        s["start"] = at
        if not s["active"]:
            s["stop"] = at


def activate(segments: list[dict], k: int, longest: int) -> None:
    """Segment k takes at least LEAST_MS around its middle; active neighbours give room."""
    me = segments[k]
    me["active"] = True
    before, after = neighbours(segments, k)
    size = max(me["stop"] - me["start"], 0)
    middle, size = me["start"] + size * 0.5, max(LEAST_MS, size)
    begin = snap(middle - size * 0.5, 0, me["stop"])
    end = snap(middle + size * 0.5, begin, longest)
    for s in segments[before:k] if before is not None else ():
        if s["active"]:
            s["stop"] = snap(s["start"] + (s["stop"] - s["start"]) * 0.75, s["start"], s["stop"])
        else:
            s["start"] = s["stop"] = begin
        begin = s["stop"]
    for s in reversed(segments[k + 1 : after + 1] if after is not None else ()):
        if s["active"]:
            s["start"] = snap(s["start"] + (s["stop"] - s["start"]) / 3.0, s["start"], s["stop"])
        else:
            s["start"] = s["stop"] = end
        end = s["start"]
    me["start"], me["stop"] = begin, end


def close_all(segments: list[dict]) -> int:
    """Closes the gaps of all inactive _ segments, in order; returns their number."""
    open_ = [i for i, s in enumerate(segments) if not s["active"] and s["phoneme"] == "_"]
    for i in open_:
        segments[i]["active"] = True
    for i in open_:
        deactivate(segments, i)
    return len(open_)


def close_gaps(tracks: DataFrame) -> DataFrame:
    """(id, closed, segments) for rows (id, segments), segments an array of structs in slot order."""
    kind = tracks.select("segments").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r or [] for r in batch.column(1).to_pylist()]
            counts = [close_all(r) for r in rows]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, batch.column(1).type)], names=["id", "closed", "segments"])

    from ..session import ship

    ship(tracks.sparkSession)
    return tracks.select(F.col("id").cast("long").alias("id"), "segments").mapInArrow(run, f"id long, closed long, segments {kind}")


def activated(tracks: DataFrame) -> DataFrame:
    """(id, before, after, segments) for rows (id, segments, slot, longest): the segment in that slot (from 1) is active, and
    its neighbours up to the slots before and after give it room; a track without such a slot stays as it is."""
    kind = tracks.select("segments").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r or [] for r in batch.column(1).to_pylist()]
            sides = []
            for r, slot, longest in zip(rows, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if slot is None or not 1 <= slot <= len(r):
                    sides.append((None, None))
                    continue
                sides.append(tuple(None if x is None else x + 1 for x in neighbours(r, slot - 1)))
                activate(r, slot - 1, longest)
            cells = [pa.array([x[j] for x in sides], pa.int64()) for j in (0, 1)]
            yield pa.record_batch([batch.column(0), *cells, pa.array(rows, batch.column(1).type)], names=["id", "before", "after", "segments"])

    from ..session import ship

    ship(tracks.sparkSession)
    kept = tracks.select(F.col("id").cast("long").alias("id"), "segments", F.col("slot").cast("long").alias("slot"), F.col("longest").cast("long").alias("longest"))
    return kept.mapInArrow(run, f"id long, before long, after long, segments {kind}")


def no_overlap(segments: Column) -> Column:
    """Each start at or after the end before it (an ordered array of structs with start and stop)."""
    return F.aggregate(
        segments,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.filter(segments, lambda s: F.lit(False)).alias("out")),
        lambda acc, s: F.struct(
            F.greatest(s["stop"], s["start"], acc["at"]).alias("at"),
            F.concat(acc["out"], F.array(s.withField("start", F.greatest(s["start"], acc["at"])).withField("stop", F.greatest(s["stop"], s["start"], acc["at"])))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
