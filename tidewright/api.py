"""The library's public functions: preparing, generating and extracting tracks from lines and audio.

Translators and recognizers are plain functions over DataFrames, so that any engine can be plugged in:
a translator takes lines (id, text) and returns (id, translated), words by spaces and phonemes by _;
a recognizer takes clips (id, ...) and returns frames (id, slot, label, first_frame, last_frame).
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import align, catalog, gaps, resample, timeline, tracks, updates
from .session import saved
from .sources import formats, readers, sinks

log = logging.getLogger("tidewright")

Translator = Callable[[DataFrame], DataFrame]
Recognizer = Callable[[DataFrame], DataFrame]
Decoder = Callable[[bytes], tuple[int, int, list[int]]]

#: Decoders (rate, channels, samples) by file name ending; WAV is read without one.
_DECODERS: dict[str, Decoder] = {}


def register_decoder(ending: str, decoder: Decoder) -> None:
    """Plugs in a decoder for audio files with this ending, such as ogg."""
    _DECODERS[ending.lower().lstrip(".")] = decoder


#: Fixed value: the error for a format that cannot be used.
WRONG_FORMAT = "expected format >= %d Hz, 16 bit, 1 or 2 channel. found %d Hz, %d bit, %d channel(s)"


def load_audio(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """Clips (path, rate, channels, bits, pcm) of a file or folder by the decoder of its ending; other endings are an error.

    With a rate, clips pass the format gate: one or two channels of 16 bits at that rate are used as they are, others with
    at most two channels are resampled to it, but never from a lower rate; the rest is an error when rows are read."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in _DECODERS:
        decode = _DECODERS[ending]

        def run(parts):
            for part in parts:
                found = [decode(x) for x in part["content"]]
                yield part[["path"]].assign(rate=[f[0] for f in found], channels=[f[1] for f in found], bits=16, pcm=[f[2][f[1] - 1 :: f[1]] for f in found])

        raw = spark.read.format("binaryFile").load(path).select("path", "content")
        clips = raw.mapInPandas(run, "path string, rate int, channels int, bits int, pcm array<smallint>")
    elif ending == "wav" or "." not in path.rsplit("/", 1)[-1]:
        clips = readers.wav_clips(spark, path)
    else:
        raise ValueError(f"no decoder for .{ending} files; see register_decoder")
    if rate is None:
        return clips
    gate = timeline.audio_gate(F.col("channels"), F.col("rate"), F.col("bits"), rate)
    wrong = F.raise_error(F.format_string(WRONG_FORMAT, F.lit(rate), "rate", "bits", "channels"))
    return resample.resampled(clips.withColumn("pcm", F.when(gate == "error", wrong).otherwise(F.col("pcm"))), rate)


def one_of(**options: object) -> str:
    """The one option that is given; none, or more than one, is an error."""
    given = [name for name, value in options.items() if value]
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(options)} is needed, not {len(given)}")
    return given[0]


def find_missing_audio(lines: DataFrame, audio_files: DataFrame) -> DataFrame:
    """Lines (id, text, actor) without an audio file; audio_files (name)."""
    files = catalog.catalogue(audio_files).where("kind = 'audio'").select("id")
    return catalog.missing_lines(lines, files)


def generate(lines: DataFrame, translate: Translator) -> tuple[DataFrame, DataFrame]:
    """Tracks from text alone: segments (id, word_no, i, phoneme, ...) with generated timings, and results (id, actor, error).

    Lines without an actor are skipped; a line whose translation is empty is an error."""
    spoken = updates.with_actor(lines)
    made = translate(spoken.select("id", "text"))
    each = made.select("id", F.posexplode(T.phoneme_tokens(F.col("translated"))).alias("k", "t"))
    order = Window.partitionBy("id").orderBy("k")
    begins = F.col("t.word_start")
    place = F.col("k") - F.last(F.when(begins, F.col("k")), ignorenulls=True).over(order)
    raw = each.select("id", (F.sum(begins.cast("int")).over(order) - 1).alias("word_no"), place.alias("i"), F.col("t.phoneme").alias("raw"))
    done = lines.select("id", "actor").join(raw.select("id").distinct().withColumn("_made", F.lit(True)), "id", "left")
    error = F.when(F.col("actor").isNotNull() & F.col("_made").isNull(), "empty translation")
    return tracks.generated_timings(raw), done.select("id", "actor", error.alias("error"))


def _pairs(lines: DataFrame, heard: DataFrame, translate: Translator) -> DataFrame:
    """(id, translated, hypothesis, audio, text) of lines (id, text) and cleaned recognizer rows; hints are not spoken."""
    cells = heard.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "phoneme"))).alias("a"))
    audio = F.transform("a", lambda x: F.struct(x["phoneme"].alias("phoneme"), x["start"].alias("start"), x["stop"].alias("stop")))
    made = translate(lines.select("id", T.strip_hints(F.col("text")).alias("text"))).select("id", "translated", T.phoneme_tokens(F.col("translated")).alias("w"))
    text = F.transform("w", lambda x: F.struct(T.strip_stress(x["phoneme"]).alias("phoneme"), x["word_start"].alias("word_start"), T.phoneme_weight(x["phoneme"]).alias("weight")))
    hypothesis = F.array_join(F.transform("a", lambda x: x["phoneme"]), " ")
    return made.join(cells, "id", "left").select("id", "translated", hypothesis.alias("hypothesis"), audio.alias("audio"), text.alias("text"))


def extract(lines: DataFrame, clips: DataFrame, translate: Translator, recognize: Recognizer, scores: list[tuple[str, str, float]], gap: float = -1.0) -> DataFrame:
    """Aligned tracks (id, rows, ops, min_score, has_gaps, error) of lines (id, text) and their clips (id, ...)."""
    return align.align_tracks(_pairs(lines, tracks.clean_recognised(recognize(clips)), translate), scores, gap)


#: The errors of a task, and the rate that recognizers hear.
NO_TRANSLATION, NOT_HEARD = "text to phoneme translator returned empty string.", "audio phoneme extractor returned empty result."
NO_AUDIO, NO_TEXT = "audio not found: %s", "no text for line %d"
HEARING_RATE = 16000


def process(
    tasks: DataFrame,
    lines: DataFrame,
    clips: DataFrame,
    translate: Translator,
    recognize: Recognizer,
    scores: list[tuple[str, str, float]],
    folder: str,
    language: str | None = None,
    gap: float = -1.0,
) -> DataFrame:
    """Works off tasks (task_id, line_id, audiofile, renaming_required, full_rename): results (task_id, line_id, operation,
    result, quality, closed, error).

    A task that must be renamed gets its file's new name as result; the renaming itself is the caller's.  Any other is
    extracted: its line's text without hints is translated, its clip (audiofile, rate, channels, bits, pcm) passes the
    format gate, is scaled to its peak and resampled for the recognizer, both are aligned, gaps in words are closed, the
    quality is assessed, and the track is written to ``folder`` as the file that is the result.  A task that fails at
    any step has that step's error and no file; the others go on.
    """
    spark = tasks.sparkSession
    formats.register(spark)
    known = clips.select("audiofile", "rate", "channels", "bits", F.size("pcm").alias("samples"))
    asked = tasks.select("task_id", "line_id", "audiofile", "renaming_required", "full_rename")
    asked = asked.join(lines.select(F.col("id").alias("line_id"), "text", "actor"), "line_id", "left").join(known, "audiofile", "left")
    gate = timeline.audio_gate(F.col("channels"), F.col("rate"), F.col("bits"), HEARING_RATE)
    unfit = F.when(gate == "error", F.format_string(WRONG_FORMAT, F.lit(HEARING_RATE), "rate", "bits", "channels"))
    early = F.when(F.col("text").isNull(), F.format_string(NO_TEXT, "line_id")).when(F.col("rate").isNull(), F.format_string(NO_AUDIO, "audiofile"))
    named = F.element_at(F.split("audiofile", "/"), -1)
    new_name = T.rename_target(F.col("line_id"), F.col("samples") / F.col("rate"), F.col("actor"), F.col("text"), named, F.col("full_rename"))
    asked = asked.withColumns({"early": F.when(F.col("renaming_required"), early).otherwise(F.coalesce(early, unfit)), "new_name": new_name})
    asked = saved(asked.drop("samples", "channels", "bits", "rate"), "tasks")

    due = asked.where("not renaming_required and early is null")
    loud = clips.withColumn("pcm", timeline.normalised(F.col("pcm")).cast("array<smallint>")).select("audiofile", "rate", "pcm")
    heard = tracks.clean_recognised(recognize(resample.resampled(due.select(F.col("task_id").alias("id"), "audiofile").join(loud, "audiofile"), HEARING_RATE)))
    pairs = saved(_pairs(due.select(F.col("task_id").alias("id"), "text"), heard, translate), "pairs")
    found = align.align_tracks(pairs, scores, gap)
    cell = F.transform("rows", lambda x, i: F.struct((i + 1).alias("slot"), *(x[c].alias(c) for c in ("phoneme", "word_start", "start", "stop")),
        x["weight"].cast("double").alias("weight"), x["score"].cast("double").alias("score"), x["active"].alias("active"), x["source"].alias("info")))
    closed = saved(gaps.close_gaps(found.where("error is null").select("id", cell.alias("segments"))), "closed")
    each = closed.select("id", F.explode("segments").alias("x")).select("id", "x.*", F.lit(1).alias("version"))
    quality = tracks.track_quality(each).select("id", "quality")
    late = F.when(F.coalesce("translated", F.lit("")) == "", NO_TRANSLATION).when(F.coalesce("hypothesis", F.lit("")) == "", NOT_HEARD)
    judged = pairs.select("id", "translated", "hypothesis", late.alias("late")).join(found.select("id", F.col("error").alias("apart")), "id", "left")
    judged = judged.join(closed, "id", "left").join(quality, "id", "left").withColumnRenamed("id", "task_id")
    done = asked.join(judged, "task_id", "left")
    error = F.when(F.col("renaming_required"), F.col("early")).otherwise(F.coalesce("early", "late", "apart"))
    done = saved(done.withColumn("error", error), "done")

    meta = {"id": F.col("line_id"), "version": F.lit(1), "language": F.lit(language), "translation": F.col("translated"), "audio_hypothesis": F.col("hypothesis")}
    good = done.where("not renaming_required and error is null")
    sinks.track_files(good.withColumns(meta)).write.format("tracks").mode("append").save(folder)
    file = F.concat(F.lit(folder.rstrip("/") + "/"), F.lpad(F.col("line_id").cast("string"), 10, "0"), F.lit(".phonemes"))
    return done.select(
        "task_id",
        "line_id",
        F.when(F.col("renaming_required"), "rename").otherwise("extract").alias("operation"),
        F.when(F.col("error").isNull(), F.when(F.col("renaming_required"), F.col("new_name")).otherwise(file)).alias("result"),
        "quality",
        "closed",
        "error",
    )


def result_events(results: DataFrame, states: DataFrame) -> DataFrame:
    """The events of processed tasks for the queue's log (task_id, seq, event, detail), after the states' last ones."""
    rows = results.join(states.select("task_id", "applied"), "task_id")
    event = F.when(F.col("error").isNotNull(), "fail").when(F.col("operation") == "rename", "renamed").otherwise("finished")
    steps = F.array(
        F.struct((F.col("applied") + 1).alias("seq"), F.lit("start").alias("event"), F.lit(None).cast("string").alias("detail")),
        F.struct((F.col("applied") + 2).alias("seq"), event.alias("event"), F.coalesce("error", "result").alias("detail")),
    )
    return rows.select("task_id", F.explode(steps).alias("x")).select("task_id", "x.*")


def language_settings(spark: SparkSession, folder: str) -> DataFrame:
    """The languages that a data folder has settings for."""
    return readers.languages(spark, folder)


def search_strings_file(spark: SparkSession, *folders: str) -> str | None:
    return readers.strings_file(spark, *folders)


def search_actor_mappings_file(folder: str, name: str = "actor_mapping.cfg") -> str:
    """The actor mapping file of a folder on the driver; an empty one is made where there is none."""
    path = Path(folder) / name
    if not path.exists():
        log.info("no %s found, creating an empty one", path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.touch()
    return str(path)


def refresh_phoneme_dictionary(spark: SparkSession, path: str, labels: DataFrame) -> bool:
    """Writes the dictionary `label label` of labels (label) and SIL, unless the one there has the same set."""
    wanted = labels.select("label").union(spark.createDataFrame([("SIL",)], "label string")).distinct()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        old = spark.read.text(path).select(F.split("value", r"\s+")[0].alias("label")).where("label <> ''").distinct()
        if catalog.same_set(old, wanted):
            return False
    log.info("writing phoneme dictionary %s", path)
    sinks.write_lines(wanted.orderBy("label").select(F.concat_ws(" ", "label", "label").alias("line")), path)
    return True


def console_logging(level: int = logging.INFO) -> None:
    """Messages of the library on the console: level, then text."""
    handler = logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(levelname)-5s %(message)s"))
    log.handlers = [handler]
    log.setLevel(level)
