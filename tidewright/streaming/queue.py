"""The task queue as a log of events: a state machine per task, as a stream and as a batch.

Events are rows (task_id, seq, event, detail), numbered from 1 in each task's log; they may come late, out of order and
more than once.  A task's state is kept by key; a micro-batch gives one row for each task that it changed, however many
events it had.  An event that its task's state does not allow is counted and leaves the state as it was: a result
counts only while the task is in work.

Nulls: an event without task, number or name is not part of a log and is left out; a null detail is a null file or error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.updates import IN_WORK
from ..session import ship
from .ordered import InOrder, all_rows, latest, run_batches

LOG = "task_id long, seq long, event string, detail string"
STATES = (
    "task_id long, state string, audiofile string, phonemefile string, renaming_required boolean, full_rename boolean, error string, "
    "rejected long, rejection string, applied long"
)
#: Why an event is rejected.
ONLY_IN_WORK, UNKNOWN = "setting result valid only in processed state", "update of unknown task: {}"
DUPLICATE, NOT_WAITING = "found duplicate audiofile for id [{}]. audiofile not added to queue", "only waiting tasks can be started"
NO_EVENT = "unknown event: {}"
RESULTS = ("fail", "renamed", "finished")


@dataclass
class Task:
    """One task; without a state it is not in the queue."""

    task_id: int
    state: str | None = None
    audiofile: str | None = None
    phonemefile: str | None = None
    renaming_required: bool = False
    full_rename: bool = False
    error: str | None = None
    rejected: int = 0
    rejection: str | None = None
    applied: int = 0

    def apply(self, event: str, detail: str | None) -> None:
        self.applied += 1
        why = self._refusal(event)
        if why is not None:
            self.rejected, self.rejection = self.rejected + 1, why
        elif event in ("add", "add_unlinked"):
            loose = event == "add_unlinked"
            self.state, self.audiofile, self.renaming_required = "UnassignedId" if loose else "Waiting", detail, loose
            self.phonemefile, self.full_rename, self.error = None, False, None
        elif event == "start":
            self.state = "Processing"
        elif event == "fail":
            self.state, self.error = "Error", detail
        elif event == "renamed":
            self.audiofile, self.renaming_required = detail, False
            self.state = "Waiting" if self.phonemefile is None else "Finished"
        elif event == "finished":
            self.state, self.phonemefile = "Finished", detail
        elif event == "force_rename":
            if self.state not in ("Processing", "UnassignedId", "Error"):
                self.state, self.renaming_required, self.full_rename = "Waiting", True, True
        else:
            self.state = None

    def _refusal(self, event: str) -> str | None:
        if event in ("add", "add_unlinked"):
            return None if self.state is None else DUPLICATE.format(self.task_id)
        if event not in (*RESULTS, "start", "force_rename", "remove"):
            return NO_EVENT.format(event)
        if self.state is None:
            return UNKNOWN.format(self.task_id)
        if event in RESULTS and self.state != "Processing":
            return ONLY_IN_WORK
        if event == "start" and self.state != "Waiting":
            return NOT_WAITING
        return IN_WORK if event == "remove" and self.state == "Processing" else None


_FIELDS = [f.name for f in fields(Task)]


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _events(log: DataFrame) -> DataFrame:
    return log.select("task_id", "seq", "event", "detail").where("task_id is not null and seq is not null and event is not null")


def task_states(log: DataFrame) -> DataFrame:
    """Streaming (task_id, state, ...): the state of each task that a micro-batch changed, after all of its events."""
    ship(log.sparkSession)
    kept = f"{STATES.split(', ', 1)[1]}, next long, waiting string, repeats long"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task, order = Task(int(key[0])), InOrder(1)
        if state.exists:
            *values, after, waiting, repeats = state.get
            task, order = Task(task.task_id, *values), InOrder(after, waiting, repeats)
        before = task.applied
        for part in parts:
            rows = zip(part["seq"].tolist(), part["event"].tolist(), map(_text, part["detail"]), strict=True)
            for _, event, detail in order.take(rows):
                task.apply(event, detail)
        values = [getattr(task, f) for f in _FIELDS]
        state.update((*values[1:], order.next, order.held(), order.repeats))
        if task.applied > before:
            yield pd.DataFrame([values], columns=_FIELDS)

    return _events(log).groupBy("task_id").applyInPandasWithState(fold, STATES, kept, "update", GroupStateTimeout.NoTimeout)


def folded(log: DataFrame) -> DataFrame:
    """The state of each task after its whole log, as a batch: logs are read in order, one event at a time, so a task's
    log may be of any length.  Events after a gap in a log are not applied, as in the stream."""
    ship(log.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, order = None, None
        for part in parts:
            done = []
            for key, seq, event, detail in zip(part["task_id"].tolist(), part["seq"].tolist(), part["event"].tolist(), map(_text, part["detail"]), strict=True):
                if task is None or key != task.task_id:
                    if task is not None and task.applied:
                        done.append([getattr(task, f) for f in _FIELDS])
                    task, order = Task(key), InOrder(1)
                if seq > order.next:
                    continue  # beyond a gap
                for _, now, what in order.take([(seq, event, detail)]):
                    task.apply(now, what)
            yield pd.DataFrame(done, columns=_FIELDS)
        if task is not None and task.applied:
            yield pd.DataFrame([[getattr(task, f) for f in _FIELDS]], columns=_FIELDS)

    return _events(log).repartition("task_id").sortWithinPartitions("task_id", "seq").mapInPandas(run, STATES)


def run_queue(log: DataFrame, folder: str, checkpoint: str) -> None:
    """Works off a streamed log; the changes of each micro-batch go to a folder of their own."""
    run_batches(task_states(log), "update", folder, checkpoint)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The states after all batches that run_queue() wrote."""
    return latest(all_rows(spark, folder, STATES), "task_id")


def work(states: DataFrame, lines: DataFrame, rename: DataFrame, extracted: DataFrame) -> DataFrame:
    """The events (task_id, seq, event, detail) of working off waiting tasks (task_id, line_id, state, ..., applied): each is
    started, then renamed if it must be, else extracted.

    lines (id, text); rename (audiofile, new_name); extracted (line_id, phonemefile, error).  A task without text,
    or without a result, fails with an error."""
    due = states.where("state = 'Waiting'").join(lines.select(F.col("id").alias("line_id"), "text"), "line_id", "left")
    named = due.join(rename.select("audiofile", "new_name"), "audiofile", "left")
    each = named.join(extracted.select("line_id", F.col("phonemefile").alias("made"), F.col("error").alias("why")), "line_id", "left")
    good = F.when(F.col("renaming_required"), F.col("new_name")).otherwise(F.when(F.col("why").isNull(), F.col("made")))
    no_text = F.format_string("no text for line %d", "line_id")
    error = F.when(F.col("text").isNull(), no_text).when(good.isNull(), F.coalesce("why", F.lit("no result")))
    event = F.when(error.isNotNull(), "fail").when(F.col("renaming_required"), "renamed").otherwise("finished")
    steps = F.array(
        F.struct((F.col("applied") + 1).alias("seq"), F.lit("start").alias("event"), F.lit(None).cast("string").alias("detail")),
        F.struct((F.col("applied") + 2).alias("seq"), event.alias("event"), F.coalesce(error, good).alias("detail")),
    )
    return each.select("task_id", F.explode(steps).alias("x")).select("task_id", "x.*")
