"""Updates of the task queue and of lines: key lookups, state checks, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import numbered

#: States in which a task can be selected, and what a line selection shows without a line or provider.
SELECTABLE = ["UnassignedId", "Finished"]
NO_TEXT, NO_PROVIDER = "text not found", "missing strings provider!"


def selectable(tasks: DataFrame, selected: int | None = None) -> DataFrame:
    """Tasks (id, state, ...) that may be selected: finished or without an id, and not the selected one."""
    return tasks.where(F.col("state").isin(SELECTABLE) & ~F.col("id").eqNullSafe(F.lit(selected)))


def with_actor(lines: DataFrame) -> DataFrame:
    """Lines that name an actor; the others are skipped when phonemes are generated from text."""
    return lines.where("actor is not null")


def generation_counters(results: DataFrame) -> DataFrame:
    """(generated, failed, skipped) of rows (actor, error)."""
    spoken = F.col("actor").isNotNull()
    return results.agg(
        F.count_if(spoken & F.col("error").isNull()).alias("generated"),
        F.count_if(spoken & F.col("error").isNotNull()).alias("failed"),
        F.count_if(~spoken).alias("skipped"),
    )


def existing(ids: DataFrame, tasks: DataFrame) -> DataFrame:
    """The ids (line_id) that the queue holds already."""
    return ids.join(tasks.select("line_id"), "line_id", "left_semi")


def task_ids(tasks: DataFrame, *order: str) -> DataFrame:
    """Tasks numbered from 1 in the given order."""
    return numbered(tasks, list(order), "id")


def updated(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """tasks with the values of changes (id, and some of its columns) where those are not null."""
    own = [c for c in changes.columns if c != "id"]
    new = changes.select("id", F.struct(*own).alias("_new"))
    return tasks.join(new, "id", "left").select(*(F.coalesce(f"_new.{c}", c).alias(c) if c in own else c for c in tasks.columns))


#: The errors of a removal.
NOT_FOUND, IN_WORK = "task (%d) not found.", "cannot remove task in processing state"


def removed(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, error) of the removal of ids; a null error means that the task goes."""
    found = ids.select("id").join(tasks.select("id", "state"), "id", "left")
    missing = F.format_string(NOT_FOUND, "id")
    return found.select("id", F.when(F.col("state").isNull(), missing).when(F.col("state") == "Processing", IN_WORK).alias("error"))


def without(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """tasks without those that may be removed.  A task in work stays in the queue when its removal fails: an error
    leaves the table as it was."""
    return tasks.join(ids.select("id").join(tasks.where("state = 'Processing'").select("id"), "id", "left_anti"), "id", "left_anti")


def prepended(queue: DataFrame, more: DataFrame) -> DataFrame:
    """Actions (pos, action) with more of them before the others, in the order of both."""
    rows = queue.select(F.lit(1).alias("late"), "pos", "action").union(more.select(F.lit(0), "pos", "action"))
    placed = numbered(rows.withColumnRenamed("pos", "old"), ["late", "old"], "pos", first=0)
    return placed.select("pos", "action")


def selected_actor(actors: DataFrame, available: DataFrame) -> DataFrame:
    """(actor, id): the first available (pos, id, caption) whose id is the actor or whose caption is it capitalised; else the first."""
    from ..functions.text import capitalize

    keys = available.select("pos", "id", F.explode(F.array_distinct(F.array(F.struct(F.col("id").alias("key"), F.lit("id").alias("by")), F.struct(F.col("caption").alias("key"), F.lit("caption").alias("by"))))).alias("k"))
    by_id = keys.where("k.by = 'id'").groupBy(F.col("k.key").alias("actor")).agg(F.min(F.struct("pos", "id")).alias("a"))
    by_caption = keys.where("k.by = 'caption'").groupBy(F.col("k.key").alias("caption")).agg(F.min(F.struct("pos", "id")).alias("b"))
    default = available.agg(F.min_by("id", "pos").alias("default"))
    rows = actors.withColumn("caption", capitalize(F.col("actor"))).join(by_id, "actor", "left").join(by_caption, "caption", "left")
    best = F.least("a", "b")  # the smaller position; nulls are left out
    return rows.join(F.broadcast(default), F.lit(True), "left").select("actor", F.coalesce(best["id"], F.col("default")).alias("id"))


def selected_text(selection: DataFrame, lines: DataFrame | None) -> DataFrame:
    """(line_id, text) of selected lines, with the fixed texts where there is no line or no catalogue."""
    if lines is None:
        return selection.select("line_id", F.lit(NO_PROVIDER).alias("text"))
    known = lines.select(F.col("id").alias("line_id"), F.coalesce("text", F.lit(NO_TEXT)).alias("text"))
    return selection.select("line_id").join(known, "line_id", "left").select("line_id", F.coalesce("text", F.lit(NO_TEXT)).alias("text"))


def with_text(tasks: DataFrame, lines: DataFrame) -> DataFrame:
    """tasks with text and actor of their lines; a missing text is an error, a missing actor is null."""
    known = lines.select(F.col("id").alias("line_id"), "text", "actor")
    error = F.when(F.col("text").isNull(), F.format_string("no text for line %d", "line_id"))
    return tasks.join(known, "line_id", "left").withColumn("error", error)


def set_actor(tracks: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """Tracks (id, saved_actor, actor, ...) with the chosen actor where the saved one is open, and the mappings
    (actor, mapped) that follow from it."""
    opened = F.col("saved_actor").isNull() | (F.col("saved_actor") == "default")
    new = tracks.withColumn("actor", F.when(opened, chosen).otherwise(F.col("actor")))
    mappings = new.where("actor is not null").select("actor", chosen.alias("mapped")).distinct()
    return new, mappings


def saved_track(tracks: DataFrame, quality: DataFrame) -> DataFrame:
    """Tracks (id, version, ...) one version on, with their quality (id, ...) as it is now."""
    return tracks.withColumn("version", F.col("version") + 1).join(quality, "id", "left")


def caption_text(slot: Column, line_id: Column, state: Column, file: Column) -> Column:
    return F.format_string("%d: %010d %s %s", slot, line_id, state, file)


def listing(files: DataFrame) -> DataFrame:
    """(slot, name, is_dir) of a folder's entries: `..`, then folders, then files, by name."""
    up = files.sparkSession.createDataFrame([("..", True)], "name string, is_dir boolean")
    rows = files.select("name", "is_dir").union(up)
    placed = numbered(rows, [F.col("name") != "..", ~F.col("is_dir"), "name"], "slot")
    return placed.select("slot", "name", "is_dir")
