"""What the keyed streams share: rows in order of their numbers, and sinks that a repeated batch overwrites."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InOrder:
    """Rows of one key by number, however they arrive.

    A row is handed on when all rows before it were; earlier ones wait.  Rows that were handed on already, or wait, are
    counted as repeats and dropped, so a source may deliver a row more than once.
    """

    def __init__(self, first: int, waiting: str = "{}", repeats: int = 0) -> None:
        self.next, self.repeats = first, repeats
        self.waiting: dict[str, list] = json.loads(waiting)

    def take(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows (number, ...) that are due after rows have come."""
        for number, *rest in rows:
            if number < self.next or str(number) in self.waiting:
                self.repeats += 1
                continue
            self.waiting[str(number)] = rest
            while (due := self.waiting.pop(str(self.next), None)) is not None:
                yield self.next, *due
                self.next += 1

    def held(self) -> str:
        return json.dumps(self.waiting)


def run_batches(stream: DataFrame, mode: str, folder: str, checkpoint: str) -> None:
    """Runs a stream until its source is used up; each batch overwrites its own folder, so a batch that is run again
    after a failure changes nothing."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def all_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What all batches wrote, with the batch's number."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", folder).parquet(f"{folder}/batch=*")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last batch's row of each key."""
    kept = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("r")).select(key, "r.*")
