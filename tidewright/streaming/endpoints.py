"""Starts and ends of speech by votes: a window of frames decides, so single frames do not.

Frames are rows (clip, n, voiced), numbered from 0 in each clip.  Speech starts at the first frame of a window with
more voiced frames than ``ratio`` of it; it ends after the first frame of a window with fewer than the rest of it.
A clip that ends in speech ends it there.  ``close`` rows (voiced null) end a clip's stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from .ordered import InOrder

EVENTS = "clip long, event string, frame long"


def limits(window: int, ratio: float) -> tuple[int, int]:
    """More votes than the first start speech, fewer than the second end it."""
    if window < 1 or not 0.5 < ratio <= 1:
        raise ValueError("a window of one frame or more and a ratio over a half are needed")
    return int(ratio * window + 0.5), max(1, int((1 - ratio) * window + 0.5))


class Votes:
    """The last frames of a clip, and whether they are speech."""

    def __init__(self, window: int, ratio: float, ring: str = "", speech: bool = False) -> None:
        self.window, (self.most, self.least) = window, limits(window, ratio)
        self.ring, self.speech = ring, speech

    def frame(self, n: int, voiced: bool) -> tuple[str, int] | None:
        self.ring = (self.ring + "01"[bool(voiced)])[-self.window :]
        votes = self.ring.count("1")
        if not self.speech and votes > self.most:
            self.speech = True
            return "start", max(0, n - self.window + 1)
        if self.speech and votes < self.least:
            self.speech = False
            return "end", n - self.window + 2
        return None


def speech_events(frames: DataFrame, window: int = 10, ratio: float = 0.9) -> DataFrame:
    """Streaming (clip, event, frame); frames may come late, out of order and more than once, and a clip's state goes
    with its closing row (which is numbered as the frame after its last)."""
    ship(frames.sparkSession)
    limits(window, ratio)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        votes, order, closed, found = Votes(window, ratio), InOrder(0), False, []
        if state.exists:
            ring, speech, after, waiting, repeats = state.get
            votes, order = Votes(window, ratio, ring, speech), InOrder(after, waiting, repeats)
        for part in parts:
            marks = (None if v is None or v != v else bool(v) for v in part["voiced"].tolist())
            for n, voiced in order.take(zip(part["n"].tolist(), marks, strict=True)):
                closed = voiced is None
                event = ("end", n) if closed and votes.speech else None if closed else votes.frame(n, voiced)
                if event:
                    found.append((int(key[0]), *event))
        if closed:
            state.remove()
        else:
            state.update((votes.ring, votes.speech, order.next, order.held(), order.repeats))
        if found:
            yield pd.DataFrame(found, columns=["clip", "event", "frame"])

    rows = frames.select("clip", "n", "voiced").where("clip is not null and n is not null")
    kept = "ring string, speech boolean, next long, waiting string, repeats long"
    return rows.groupBy("clip").applyInPandasWithState(fold, EVENTS, kept, "append", GroupStateTimeout.NoTimeout)


def endpoints(frames: DataFrame, window: int = 10, ratio: float = 0.9) -> DataFrame:
    """The same events of whole clips (clip, n, voiced), as window functions."""
    most, least = limits(window, ratio)
    order = Window.partitionBy("clip").orderBy("n")
    votes = F.sum(F.col("voiced").cast("int")).over(order.rowsBetween(1 - window, 0))
    rows = frames.withColumn("votes", votes)
    mark = F.when(F.col("votes") > most, True).when(F.col("votes") < least, False)
    rows = rows.withColumn("speech", F.coalesce(F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    rows = rows.withColumn("before", F.lag("speech", 1, False).over(order)).withColumn("last", F.lead("n").over(order).isNull())
    first = F.greatest(F.lit(0), F.col("n") - window + 1)
    turn = F.when(F.col("speech") & ~F.col("before"), F.struct(F.lit("start").alias("event"), first.alias("frame"))).when(
        ~F.col("speech") & F.col("before"), F.struct(F.lit("end").alias("event"), (F.col("n") - window + 2).alias("frame"))
    )
    close = F.when(F.col("last") & F.col("speech"), F.struct(F.lit("end").alias("event"), (F.col("n") + 1).alias("frame")))
    each = rows.select("clip", F.explode(F.array_compact(F.array(turn, close))).alias("x"))
    return each.select("clip", "x.event", F.col("x.frame").cast("bigint").alias("frame"))
