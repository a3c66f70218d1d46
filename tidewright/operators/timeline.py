"""Views of PCM clips and of a zoomed timeline."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, FULL = 44_100, 32_767
#: Zoom limits.
ZOOM_LOW, ZOOM_HIGH = 1.0, 30.0


def peak(pcm: Column) -> Column:
    """The largest amplitude, at most 32767."""
    return F.least(F.array_max(F.transform(pcm, lambda v: F.abs(v.cast("int")))), F.lit(FULL))


def normalised(pcm: Column, share: float = 0.95) -> Column:
    """Samples scaled so that the peak is a share of the full range; silence stays."""
    # An array of one cell, so that the peak is found once and not for every sample.
    clip = F.array(F.struct(pcm.alias("pcm"), peak(pcm).alias("top")))

    def scaled(cell: Column) -> Column:
        top = cell["top"]
        return F.transform(cell["pcm"], lambda v: F.when(top == 0, v.cast("int")).otherwise(F.round(v * (FULL * share) / top).cast("int")))

    return F.transform(clip, scaled)[0]


def duration_ms(pcm: Column, rate: int = RATE) -> Column:
    return F.floor(F.size(pcm) * 1000 / rate).cast("bigint")


def decimated(pcm: Column, begin: int, window: int, width: int) -> Column:
    """Every step-th sample of a window, for a drawing of some width; starts are multiples of the step."""
    step = max(1, math.ceil(window / (width * 0.5)))
    n = F.size(pcm)
    first = F.least(F.lit(begin - begin % step), F.greatest(n - window, F.lit(0)))
    last = F.least(first + window, n) - 1
    return F.when(last >= first, F.transform(F.sequence(first, last, F.lit(step)), lambda i: F.get(pcm, i)))


def zoom(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(ZOOM_LOW)), F.lit(ZOOM_HIGH))


def zoomed(offset: Column, factor: Column, amount: Column, fixed: Column, samples: Column) -> tuple[Column, Column]:
    """The factor and the offset in samples after zooming by an amount (a quarter of the factor each), so that the sample at
    the fixed place stays where it is; the view stays inside the clip."""
    new = zoom(factor + factor * 0.25 * amount)
    shifted = F.greatest(F.lit(0.0), offset - fixed * ((factor - new) / (factor * new)))
    return new, F.least(F.floor(shifted), samples - F.floor(samples / new)).cast("bigint")


def view_window(length_ms: Column, zoom_: Column, offset: Column) -> tuple[Column, Column]:
    """First and last millisecond of a view; the offset is a share of the length, kept inside it."""
    size = length_ms / zoom(zoom_)
    begin = F.least(F.greatest(offset * length_ms, F.lit(0.0)), length_ms - size)
    return F.floor(begin).cast("bigint"), F.floor(begin + size).cast("bigint")


def last_channel(samples: Column, channels: int) -> Column:
    """The last channel of interleaved samples."""
    return F.transform(F.sequence(F.lit(channels - 1), F.size(samples) - 1, F.lit(channels)), lambda i: F.get(samples, i))


def audio_gate(channels: Column, rate: Column, bits: Column, target: int = RATE) -> Column:
    """What to do with a clip of a format: use, resample or error."""
    return F.when((channels <= 2) & (rate == target) & (bits == 16), "use").when((channels <= 2) & (rate >= target), "resample").otherwise("error")


def drag_weight(position: Column, first: Column, reference: Column, last: Column) -> Column:
    """The share of a drag that a segment follows: 1 at the reference, falling to the block's ends."""
    before = F.try_divide(position - first, reference - first)
    after = F.try_divide(last - position, last - reference)
    return F.when(position == reference, 1.0).when(position < reference, F.coalesce(before, F.lit(1.0))).otherwise(F.coalesce(after, F.lit(1.0)))
