"""File catalogue, task queue and line reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordinals import numbered


def catalogue(names: DataFrame) -> DataFrame:
    """(name, kind, id, duration) of audio and phoneme files; other files are left out."""
    # In steps, so that the generated code stays small: the stem, the id, the kind.
    stems = names.select("name", T.stem(F.col("name")).alias("stem"))
    ids = stems.select("name", T.id_of_stem(F.col("stem")).alias("id"))
    kinds = ids.select("name", "id", T.file_kind(F.col("name"), F.col("id")).alias("kind")).where("kind is not null")
    return kinds.select(
        "name",
        "kind",
        F.when(F.col("kind") != "unlinked", F.col("id")).alias("id"),
        F.when(F.col("kind") == "audio", T.file_duration(F.col("name"))).alias("duration"),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return keep_first(rows, keys, [F.col(order).desc()])


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def task_queue(files: DataFrame, force_rename: bool = False) -> DataFrame:
    """(line_id, audiofile, phonemefile, state, renaming_required): one task per audio id, and one per unlinked file.

    One pass over the files: all files of an id meet in one aggregate, and an unlinked file is a group of its own.
    Of several files of an id the first by name counts.  A task with phonemes is finished if its audio file's name has
    a duration, unless all are to be renamed; a task without a duration in its name is to be renamed."""
    own = F.when(F.col("kind") == "unlinked", F.monotonically_increasing_id())
    groups = files.select("kind", "name", "duration", "id", own.alias("own")).groupBy("id", "own")

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.struct("name", F.col("duration").isNotNull().alias("timed"))))

    tasks = groups.agg(first("audio").alias("audio"), first("phonemes").alias("phonemes"), first("unlinked").alias("loose")).where("audio is not null or loose is not null")
    unlinked, timed = F.col("loose").isNotNull(), F.col("audio.timed") & F.lit(not force_rename)
    return tasks.select(
        F.when(unlinked, 0).otherwise(F.col("id")).cast("bigint").alias("line_id"),
        F.coalesce("audio.name", "loose.name").alias("audiofile"),
        F.col("phonemes.name").alias("phonemefile"),
        F.when(unlinked, "UnassignedId").when(F.col("phonemes").isNotNull() & timed, "Finished").otherwise("Waiting").alias("state"),
        (unlinked | ~timed).alias("renaming_required"),
    )


def queue_stats(tasks: DataFrame) -> DataFrame:
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    sums = tasks.agg(n("Waiting", "UnassignedId").alias("waiting"), n("Processing").alias("processing"), n("Finished").alias("done"), n("Error").alias("errors"), F.count("*").alias("total"))
    return sums.withColumn("caption", F.format_string("%d waiting, %d processing, %d done, %d errors of %d", "waiting", "processing", "done", "errors", "total"))


def next_waiting(tasks: DataFrame) -> DataFrame:
    return tasks.where("state = 'Waiting'").orderBy("line_id", "audiofile").limit(1)


def captions(tasks: DataFrame) -> DataFrame:
    """(slot, caption) in queue order."""
    placed = numbered(tasks.select("line_id", "state", "audiofile"), ["line_id", "audiofile"], "slot")
    return placed.select("slot", F.format_string("%d: %010d %s %s", "slot", "line_id", "state", "audiofile").alias("caption"))


def missing_lines(lines: DataFrame, audio: DataFrame) -> DataFrame:
    """Lines without an audio file."""
    return lines.join(audio.select("id"), "id", "left_anti").select("id", "text", "actor")


def missing_ratio(lines: DataFrame, audio: DataFrame) -> DataFrame:
    total = lines.agg(F.count("*").alias("total"))
    missing = missing_lines(lines, audio).agg(F.count("*").alias("missing"))
    # Two single rows.
    return total.join(F.broadcast(missing), F.lit(True)).select("total", "missing", F.round(F.try_divide(F.col("missing") * 100, F.col("total")), 4).alias("percent"))


def search(lines: DataFrame, query: str, most: int | None = None) -> DataFrame:
    """Lines that contain the query in any case, by id; with ``most``, one row more than it, as a search box shows them."""
    found = lines.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("id", "text")
    return found if most is None else found.orderBy("id").limit(most + 1)


def is_capped(lines: DataFrame, query: str, most: int) -> DataFrame:
    n = F.count_if(F.contains(F.lower("text"), F.lit(query.lower())))
    return lines.agg(n.alias("hits"), (n > most + 1).alias("capped"))


def rename_plan(tasks: DataFrame, lines: DataFrame) -> DataFrame:
    """(audiofile, new_name): names by line id, duration, actor and text; the renaming itself is not part of a query."""
    rows = tasks.where("line_id > 0").join(lines.select(F.col("id").alias("line_id"), "text", "actor"), "line_id")
    return rows.select("audiofile", T.rename_target(F.col("line_id"), T.file_duration(F.col("audiofile")), F.col("actor"), F.col("text"), F.col("audiofile")).alias("new_name"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two single-column tables hold the same values, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
