"""Ordered analytics over segments (id, slot, phoneme, word_start, start, stop, score, active, version).

One window spec, partitioned by the track and ordered by slot, serves all of them, so a track
is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the quality rules.
SHORTEST, LONGEST, LOW_SCORE, MOST_LOW = 15, 500, 0.15, 20
QUALITY = ["Ok", "NeedsCheckWarn", "NeedsCheckError"]


def _track():
    return Window.partitionBy("id").orderBy("slot")


def _word():
    return Window.partitionBy("id", "word_no").orderBy("slot")


def _before():
    return _word().rowsBetween(Window.unboundedPreceding, -1)


def _all():
    return Window.partitionBy("id", "word_no")


def with_words(segments: DataFrame) -> DataFrame:
    """word_no: words counted from their starts; segments before the first start are word 0."""
    upto = _track().rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("word_no", F.sum(F.col("word_start").cast("int")).over(upto).cast("bigint"))


def with_word_slots(segments: DataFrame) -> DataFrame:
    """word_slot, word_size: position and number of segments of a word, without _."""
    real = (F.col("phoneme") != "_").cast("bigint")
    upto = _word().rowsBetween(Window.unboundedPreceding, 0)
    return with_words(segments).withColumns({"word_slot": F.sum(real).over(upto), "word_size": F.sum(real).over(_all())})


def with_findings(segments: DataFrame) -> DataFrame:
    """gap_in_word, unusual, low, inactive_real and inner: the findings behind a track's quality."""
    rows = with_word_slots(segments)
    headed = F.max(F.col("word_start").cast("int")).over(_all()) == 1
    first = F.first("start").over(_word().rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(F.when(F.col("active"), F.col("stop")), ignorenulls=True).over(_before())
    position = F.when(F.col("word_start"), F.col("start")).otherwise(F.coalesce(last, F.when(headed, first), F.lit(0)))
    duration = F.greatest(F.col("stop") - F.col("start"), F.lit(0))
    inactive = ~F.col("active") & (F.col("phoneme") != "_")
    return rows.withColumns(
        {
            "gap_in_word": F.col("active") & (F.col("start") > position),
            "unusual": F.col("active") & ~duration.between(SHORTEST, LONGEST),
            "low": F.col("active") & (F.col("score") < LOW_SCORE),
            "inactive_real": inactive,
            "inner": inactive & (F.col("word_slot") > 1) & (F.col("word_slot") < F.col("word_size")),
        }
    )


def track_quality(segments: DataFrame) -> DataFrame:
    """(id, n_segments, n_active, n_gaps, n_unusual, n_inactive, low_percent, quality)."""
    n = lambda c: F.count_if(F.col(c)).cast("bigint")
    sums = with_findings(segments).groupBy("id").agg(
        F.max("version").alias("version"), F.count("*").alias("n_segments"), n("active").alias("n_active"), n("gap_in_word").alias("n_gaps"), n("unusual").alias("n_unusual"), n("inactive_real").alias("n_inactive"), n("inner").alias("n_inner"), n("low").alias("n_low")
    )
    low = F.coalesce(F.round(F.try_divide(F.col("n_low") * 100, F.col("n_active"))), F.lit(0)).cast("bigint")
    severity = F.when((F.col("n_gaps") > 0) | (F.col("n_inner") > 0), 2).when((F.col("n_unusual") > 0) | (F.col("n_inactive") > 0) | (low > MOST_LOW), 1).otherwise(0)
    fresh = F.element_at(F.array(*map(F.lit, QUALITY)), severity + 1)
    quality = F.when(F.col("version") <= 1, fresh).when(severity == 0, "EditedOk").otherwise("EditedWithErrors")
    return sums.select("id", "n_segments", "n_active", "n_gaps", "n_unusual", "n_inactive", low.alias("low_percent"), quality.alias("quality"))


#: The texts of warnings, for unusual durations, gaps, inactive segments and low scores.
SHORT = ("suspicious duration: %dms", "phoneme gap within a word?", "inactive phoneme within a word", "low confidence-score: %.2f")
LONG = (
    "unusually short/long segment duration %d ms for a phoneme within a word",
    "detected possible phoneme gap within a word",
    "inactive segments within a word (found %d)",
    "> 20%% of active segments have low confidence-score (found %d%%, see phoneme data table)",
)


def with_warnings(segments: DataFrame) -> DataFrame:
    """short and long: the texts of each segment's findings; low scores are one where the track has many of them."""
    track = Window.partitionBy("id")
    found = with_findings(segments).withColumns({
        "_inactive": F.count_if(F.col("inactive_real")).over(_all()),
        "_low": F.round(F.try_divide(F.count_if(F.col("low")).over(track) * 100, F.count_if(F.col("active")).over(track))).cast("bigint"),
    })
    duration = F.greatest(F.col("stop") - F.col("start"), F.lit(0))
    many = F.col("low") & (F.col("_low") > MOST_LOW)

    def texts(form: tuple, inactive: Column, low: Column) -> Column:
        each = (
            F.when(F.col("unusual"), F.format_string(form[0], duration)),
            F.when(F.col("gap_in_word"), F.lit(form[1])),
            F.when(F.col("inactive_real"), inactive),
            F.when(many, low),
        )
        return F.array_compact(F.array(*each))

    return found.withColumns({
        "short": texts(SHORT, F.lit(SHORT[2]), F.format_string(SHORT[3], F.col("score").cast("double"))),
        "long": texts(LONG, F.format_string(LONG[2], "_inactive"), F.format_string(LONG[3], "_low")),
    }).drop("_inactive", "_low")


def word_bounds(segments: DataFrame) -> DataFrame:
    """(id, word_no, first_slot, last_slot, first_active, last_active, word_start_ms, word_stop_ms)."""
    live = F.when(F.col("active"), F.col("slot"))
    return with_words(segments).groupBy("id", "word_no").agg(
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.min(live).alias("first_active"), F.max(live).alias("last_active"), F.min("start").alias("word_start_ms"), F.max("stop").alias("word_stop_ms")
    )


def with_gap_flags(segments: DataFrame) -> DataFrame:
    """gap_before, gap_follows, ends_word: a segment's neighbours in its track."""
    gap = F.coalesce(F.col("start") > F.lag("stop").over(_track()), F.lit(False))
    rows = segments.withColumn("gap_before", gap)
    return rows.withColumns({"gap_follows": F.lead("gap_before", 1, False).over(_track()), "ends_word": F.lead("word_start", 1, True).over(_track())})


def with_active_neighbours(segments: DataFrame) -> DataFrame:
    """Slots of the nearest active segments before and after, within the word."""
    live = F.when(F.col("active"), F.col("slot"))
    return with_words(segments).withColumns({"active_before": F.last(live, ignorenulls=True).over(_before()), "active_after": F.first(live, ignorenulls=True).over(_word().rowsBetween(1, Window.unboundedFollowing))})


def clean_recognised(frames: DataFrame) -> DataFrame:
    """Recognizer frames (id, slot, label, first_frame, last_frame) to milliseconds (id, slot, phoneme, start, stop).

    Silence labels become SIL, silences of no length go, starts must rise, and speech next to speech
    takes half of the 10 ms between them, in tracks of more than two segments.
    """
    label = F.when(F.col("label").isin("<s>", "<sil>", "</s>", "(NULL)", "SIL"), "SIL").otherwise(F.col("label"))
    rows = frames.select("id", "slot", label.alias("phoneme"), (F.col("first_frame") * 10).alias("start"), (F.col("last_frame") * 10).alias("stop"))
    rows = rows.where("not (phoneme = 'SIL' and start = stop)")
    kept = rows.withColumn("high", F.coalesce(F.max("start").over(_track().rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).where("start > high").drop("high")
    many = F.count("*").over(Window.partitionBy("id")) > 2
    before, after = F.lag("phoneme").over(_track()), F.lead("phoneme").over(_track())
    start = F.when(many & before.isNotNull() & (before != "SIL") & (F.col("phoneme") != "SIL"), F.col("start") - 5).otherwise(F.col("start"))
    stop = F.when(many & after.isNotNull() & (after != "SIL"), F.col("stop") + 5).otherwise(F.col("stop"))
    return kept.withColumns({"start": start, "stop": stop})


def generated_timings(phonemes: DataFrame) -> DataFrame:
    """Rows (id, word_no, i, raw) of translated phonemes, with start and stop from the durations of a track of their number."""
    from ..functions import text as T

    order = Window.partitionBy("id").orderBy("word_no", "i")
    n = F.count("*").over(Window.partitionBy("id"))
    rows = phonemes.withColumns({"unit": T.slot_duration(n), "padding": T.lead_padding(n)})
    rows = rows.withColumn("duration", T.phoneme_duration(F.col("raw"), F.col("unit")))
    stop = F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("word_no") * F.col("unit") + F.col("padding")
    return rows.select("id", "word_no", "i", T.strip_stress(F.col("raw")).alias("phoneme"), (F.col("i") == 0).alias("word_start"), (stop - F.col("duration")).alias("start"), stop.alias("stop"), T.phoneme_weight(F.col("raw")).alias("weight"))


def visible(segments: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """Active segments that overlap the view, borders excluded."""
    return segments.where(F.col("active") & (F.col("start") < high) & (F.col("stop") > low))


def marked(segments: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """Segments that overlap the markers, borders included."""
    return segments.where((F.lit(high) >= F.col("start")) & (F.col("stop") >= F.lit(low)))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, slot, change) of segments that differ in phoneme, start, stop, weight or active."""
    fields = ["phoneme", "start", "stop", "weight", "active"]
    a = old.select("id", "slot", F.struct(*fields).alias("a"))
    b = new.select("id", "slot", F.struct(*fields).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, ["id", "slot"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("id", "slot", change.alias("change"))
