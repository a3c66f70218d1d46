"""Edits of segments as expressions over whole tables: positions, drags, markers, row colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snap_ms

#: How near a border a click has to be, as shares of the segment, and the granularity in milliseconds.
LEFT_ZONE, RIGHT_ZONE, STEP = 0.3, 0.7, 5


def set_position(start: Column, stop: Column, new_start: Column, new_stop: Column, longest: Column, step: int = STEP) -> tuple[Column, Column]:
    """The snapped start, held below the old stop, and the snapped stop, held above the new start."""
    begin = snap_ms(new_start, step, F.lit(0), stop)
    return begin, snap_ms(new_stop, step, begin, longest)


def edited_slot(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """segments (id, slot, active, weight, ...) with the weight and the toggled state of changes (id, slot, weight, toggle)."""
    new = changes.select("id", "slot", F.col("weight").alias("_weight"), F.col("toggle").alias("_toggle"))
    rows = segments.join(new, ["id", "slot"], "left")
    active = F.col("active") != F.coalesce("_toggle", F.lit(False))
    return rows.withColumn("weight", F.coalesce("_weight", "weight")).withColumn("active", active).select(*segments.columns)


def link_breaks(segments: DataFrame) -> DataFrame:
    """segments with broken: an active one that begins after the stop of the active one before it."""
    track = Window.partitionBy("id").orderBy("slot")
    last = F.last(F.when(F.col("active"), F.col("stop")), ignorenulls=True).over(track.rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("broken", F.coalesce(F.col("active") & (last < F.col("start")), F.lit(False)))


def drag_side(position: Column) -> Column:
    """Which border a click at a share of a segment takes hold of: left, right or none."""
    return F.when(position < LEFT_ZONE, "left").when(position > RIGHT_ZONE, "right").otherwise("none")


def drag_points(segments: DataFrame, reference: Column, damping: float = 1.0) -> DataFrame:
    """segments of one block each (id, slot, start, stop) with the weights of their borders: 1 at the reference time,
    falling to 0 at the block's ends; and the block's range."""
    block = Window.partitionBy("id")
    rows = segments.withColumn("block_start", F.min("start").over(block)).withColumn("block_stop", F.max("stop").over(block)).withColumn("reference", reference)

    def weight(at: Column) -> Column:
        rising = F.try_divide(damping * (at - F.col("block_start")), F.col("reference") - F.col("block_start"))
        falling = F.try_divide(damping * (F.col("block_stop") - at), F.col("block_stop") - F.col("reference"))
        return F.when(at < F.col("reference"), rising).when(at > F.col("reference"), falling).otherwise(1.0)

    return rows.withColumn("weight_start", weight(F.col("start"))).withColumn("weight_stop", weight(F.col("stop")))


def dragged(points: DataFrame, delta: Column, low: Column, high: Column, step: int = STEP) -> DataFrame:
    """(id, slot, start, stop) after a drag by delta milliseconds: borders move by their weights, are snapped and held in
    the range, and no segment begins before the one before it ends (a running maximum)."""

    def moved(at: Column, weight: Column) -> Column:
        to = at + delta * weight
        return snap_ms(F.when(to < 0, F.ceil(to)).otherwise(F.floor(to)), step, low, high)

    rows = points.select("id", "slot", moved(F.col("start"), F.col("weight_start")).alias("a"), moved(F.col("stop"), F.col("weight_stop")).alias("b"))
    before = Window.partitionBy("id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.greatest("a", "b")
    start = F.greatest("a", F.coalesce(F.max(reach).over(before), F.col("a")))
    return rows.select("id", "slot", start.alias("start"), F.max(reach).over(upto).alias("stop"))


def zipped(segments: DataFrame, points: DataFrame) -> DataFrame:
    """segments (id, slot, ...) with the control points (id, slot, ...) of the same place, as far as both go."""
    return segments.join(points, ["id", "slot"])


def playback_start(start: Column, stop: Column, wanted: Column, samples: Column) -> tuple[Column, Column]:
    """Markers after the start is set: without a marked region the end follows."""
    at = F.least(wanted, samples)
    return at, F.when(start >= stop, at).otherwise(stop)


def playback_end(start: Column, wanted: Column, samples: Column) -> Column:
    """The end marker; one at or before the start marks no region."""
    at = F.least(wanted, samples)
    return F.when(start < at, at).otherwise(start)


def playback_range_end(start: Column, stop: Column, samples: Column) -> Column:
    """Where playing ends: at the marked end, or with the samples."""
    return F.when(start < stop, stop).otherwise(samples)


def row_colour(has_warnings: Column, highlighted: Column) -> Column:
    """Red, green and blue of a row, fixed values."""
    rgb = lambda *x: F.array(*(F.lit(v) for v in x))
    plain = F.when(highlighted, rgb(1.0, 1.0, 0.0)).otherwise(rgb(1.0, 1.0, 1.0))
    return F.when(has_warnings, F.when(highlighted, rgb(1.0, 0.35, 1.0)).otherwise(rgb(1.0, 0.35, 0.35))).otherwise(plain)
