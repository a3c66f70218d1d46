"""States of tasks, work on a folder, sessions by gaps; streaming.queue has the queue as a log of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (state, event) -> state; other events leave a state as it is.
TRANSITIONS = {
    ("Waiting", "start"): "Processing",
    ("Processing", "finish"): "Finished",
    ("Processing", "fail"): "Error",
    ("UnassignedId", "rename"): "Waiting",
    ("UnassignedId", "rename_done"): "Finished",
    ("Waiting", "rename_done"): "Finished",
}
KEPT_BY_RESET = {"Processing", "UnassignedId", "Error"}


def next_state(state: str, event: str) -> str:
    if event == "reset":
        return state if state in KEPT_BY_RESET else "Waiting"
    return TRANSITIONS.get((state, event), state)


def reset_all(tasks: DataFrame) -> DataFrame:
    """All tasks wait again and are to be renamed in full, but for those in work, unassigned or failed."""
    kept = F.col("state").isin(*KEPT_BY_RESET)
    again = {"state": F.when(kept, F.col("state")).otherwise("Waiting")}
    for flag in ("renaming_required", "full_rename"):
        again[flag] = F.when(kept, F.col(flag) if flag in tasks.columns else F.lit(False)).otherwise(True)
    return tasks.withColumns(again)


def process_waiting(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Works off files of tasks that lie in a folder, batch by batch, and ends when none are left."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        work(rows.where("state = 'Waiting'")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def speech_sessions(frames: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(clip, begin, end, n) of runs of voiced frames (clip, ts, voiced); the detector itself is an input."""
    voiced = frames.where("voiced").withWatermark("ts", late)
    runs = voiced.groupBy("clip", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return runs.select("clip", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
