"""Drags of segment borders: clicks joined to the blocks that they take hold of, and where a drag leaves the borders.

A click near a segment's left or right border takes hold of that border; one in between takes hold of nothing.  How far
the drag reaches is its mode: ``none`` the segment alone, ``neighbour`` the one beside that border too, ``linked`` that one
only if no gap lies between, ``word`` all of the segment's word.  Clicks are rows, so any number of them on any number of
tracks is one join; what a click needs to know of its track comes from windows over tracks, not from a search per click.

Clicks on tracks or slots that do not exist, without a position, or with an unknown mode, take hold of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edits import STEP, drag_side, dragged

MODES = ("none", "neighbour", "linked", "word")


def reaches(segments: DataFrame) -> DataFrame:
    """segments (id, slot, start, stop, word_start, active) with what each mode reaches from them.

    A word begins at the last word start up to the segment, or with the track, and ends before the next one.  The first
    and last active slots are those of its active segments, or the segment's own slot where that lies beyond."""
    track = Window.partitionBy("id").orderBy("slot")
    rows = segments.select("id", "slot", "start", "stop", "active", F.sum(F.col("word_start").cast("int")).over(track).alias("_word"))
    rows = rows.withColumns({f"{at}_{c}": f(c).over(track) for at, f in (("before", F.lag), ("after", F.lead)) for c in ("slot", "start", "stop")})
    word = Window.partitionBy("id", "_word")
    whole = word.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when(F.col("active"), F.col("slot"))
    return rows.withColumns({
        "word_first": F.min("slot").over(word),
        "word_last": F.max("slot").over(word),
        "word_begin": F.first("start").over(whole),
        "word_end": F.last("stop").over(whole),
        "first_active": F.least("slot", F.min(own).over(word)),
        "last_active": F.greatest("slot", F.max(own).over(word)),
    }).drop("_word", "active")


def drag_starts(clicks: DataFrame, segments: DataFrame, longest: Column) -> DataFrame:
    """(click, id, side, reference, first, last, block_start, block_stop, low, high) of the clicks that take hold of a border.

    clicks (click, id, slot, position as a share of the segment, mode, ...); reference is the border's time, low and
    high the range in which borders may move: the block, or the audio up to its end (``longest``) where the
    block's outermost active border is dragged outwards.  Further columns of clicks are kept."""
    known = reaches(segments)
    more = [c for c in clicks.columns if c not in ("click", "id", "slot", "position", "mode")]
    held = clicks.withColumn("side", drag_side(F.col("position"))).where(F.col("side").isin("left", "right") & F.col("mode").isin(*MODES))
    rows = held.join(known, ["id", "slot"])
    left, mode = F.col("side") == "left", F.col("mode")
    # The neighbour at the border, unless the track ends there; a linked one must touch.
    beside = F.when(left, F.col("before_slot")).otherwise(F.col("after_slot")).isNotNull() & mode.isin("neighbour", "linked")
    torn = F.when(left, F.col("before_stop") < F.col("start")).otherwise(F.col("stop") < F.col("after_start"))
    taken = beside & ((mode == "neighbour") | ~torn)
    word = mode == "word"

    def pick(own: str, beside: str, by_word: str, at_left: bool) -> Column:
        here = left if at_left else ~left
        return F.when(word, F.col(by_word)).when(taken & here, F.col(beside)).otherwise(F.col(own))

    first, last = pick("slot", "before_slot", "word_first", True), pick("slot", "after_slot", "word_last", False)
    begin, end = pick("start", "before_start", "word_begin", True), pick("stop", "after_stop", "word_end", False)
    outer_left = left & (F.col("slot") <= F.when(word, F.col("first_active")).otherwise(first))
    outer_right = ~left & (F.col("slot") >= F.when(word, F.col("last_active")).otherwise(last))
    return rows.select(
        "click",
        "id",
        "side",
        F.when(left, F.col("start")).otherwise(F.col("stop")).alias("reference"),
        first.alias("first"),
        last.alias("last"),
        begin.alias("block_start"),
        end.alias("block_stop"),
        F.when(outer_left, F.lit(0)).otherwise(begin).cast("bigint").alias("low"),
        F.when(outer_right, longest).otherwise(end).cast("bigint").alias("high"),
        *more,
    )


def drag_points(starts: DataFrame, segments: DataFrame, scaling: float = 1.0, damping: float = 1.0) -> DataFrame:
    """The borders that each drag moves: (click, id, slot, start, stop, weight_start, weight_stop, low, high, ...).

    They are the segments from the block's first on, up to the first that ends after the block.  A border at the
    reference moves by all of the drag; others by less, the nearer they are to the block's end on their side."""
    more = [c for c in starts.columns if c not in ("click", "id", "side", "reference", "first", "last", "block_start", "block_stop", "low", "high")]
    cells = segments.select("id", "slot", "start", "stop")
    rows = starts.join(cells, "id").where("slot >= first and stop <= block_stop")
    place = F.row_number().over(Window.partitionBy("click").orderBy("slot"))
    rows = rows.withColumn("_place", place).where("slot - first + 1 = _place")

    def weight(at: str) -> Column:
        rising = F.try_divide(damping * (F.col(at) - F.col("block_start")), F.col("reference") - F.col("block_start"))
        falling = F.try_divide(damping * (F.col("block_stop") - F.col(at)), F.col("block_stop") - F.col("reference"))
        return scaling * F.when(F.col(at) < F.col("reference"), rising).when(F.col(at) > F.col("reference"), falling).otherwise(1.0)

    return rows.select("click", "id", "slot", "start", "stop", weight("start").alias("weight_start"), weight("stop").alias("weight_stop"), "low", "high", *more)


def drag_results(points: DataFrame, delta: Column, step: int = STEP) -> DataFrame:
    """(click, slot, start, stop) after each drag by its delta."""
    keyed = points.drop("id").withColumnRenamed("click", "id")
    found = dragged(keyed, delta, F.col("low"), F.col("high"), step)
    return found.withColumnRenamed("id", "click")
