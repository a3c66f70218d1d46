"""Registered queries over streams and their batch twins, and the SQL that both must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved, shared_folder
from ..streaming import endpoints, ordered, queue
from . import adapters as A
from .queries import query

# --- the queue as a log ------------------------------------------------------------------------


def _log(s: SparkSession, d: str) -> DataFrame:
    """Events of a user as the log of a task; one event in ten is delivered twice."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    name = (
        F.when(F.col("seq") == 1, F.when(F.col("user_id") % 5 == 0, "add_unlinked").otherwise("add"))
        .when(kind == "click", "start")
        .when(kind == "view", "finished")
        .when(kind == "purchase", "renamed")
        .when(kind == "signup", F.when(F.col("event_id") % 4 == 0, "remove").otherwise("force_rename"))
        .when(F.col("event_id") % 2 == 0, "add")
        .otherwise("fail")
    )
    rows = A.table(s, d, "events").withColumn("seq", F.row_number().over(order).cast("long"))
    copies = F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    detail = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    return rows.select(F.col("user_id").alias("task_id"), "seq", name.alias("event"), detail.alias("detail"), copies.alias("copy")).drop("copy")


_LOG = """SELECT user_id AS task_id, seq, 'f' || event_id AS detail, CASE WHEN seq = 1 THEN CASE WHEN user_id % 5 = 0 THEN 'add_unlinked' ELSE 'add' END
    WHEN event_type = 'click' THEN 'start' WHEN event_type = 'view' THEN 'finished' WHEN event_type = 'purchase' THEN 'renamed'
    WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'force_rename' END WHEN event_id % 2 = 0 THEN 'add' ELSE 'fail' END AS event
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""

_QUEUE = f"""WITH RECURSIVE log AS ({_LOG}), judged AS (SELECT *, event IN ('add', 'add_unlinked') AS adds, event IN ('fail', 'renamed', 'finished') AS results FROM log
), t(task_id, applied, state, audiofile, phonemefile, renaming_required, full_rename, error, rejected, rejection) AS (
  SELECT DISTINCT task_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false, false, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM log
  UNION ALL
  SELECT task_id, seq,
    CASE WHEN why IS NOT NULL THEN state WHEN event = 'add' THEN 'Waiting' WHEN event = 'add_unlinked' THEN 'UnassignedId' WHEN event = 'start' THEN 'Processing' WHEN event = 'fail' THEN 'Error'
      WHEN event = 'renamed' THEN CASE WHEN phonemefile IS NULL THEN 'Waiting' ELSE 'Finished' END WHEN event = 'finished' THEN 'Finished'
      WHEN event = 'force_rename' THEN CASE WHEN stays THEN state ELSE 'Waiting' END END,
    CASE WHEN why IS NULL AND (adds OR event = 'renamed') THEN detail ELSE audiofile END,
    CASE WHEN why IS NULL AND adds THEN NULL WHEN why IS NULL AND event = 'finished' THEN detail ELSE phonemefile END,
    CASE WHEN why IS NOT NULL THEN renaming_required WHEN adds THEN event = 'add_unlinked' WHEN event = 'renamed' THEN false WHEN event = 'force_rename' AND NOT stays THEN true ELSE renaming_required END,
    CASE WHEN why IS NOT NULL THEN full_rename WHEN adds THEN false WHEN event = 'force_rename' AND NOT stays THEN true ELSE full_rename END,
    CASE WHEN why IS NULL AND adds THEN NULL WHEN why IS NULL AND event = 'fail' THEN detail ELSE error END,
    rejected + CASE WHEN why IS NULL THEN 0 ELSE 1 END, coalesce(why, rejection)
  FROM (SELECT t.*, l.seq, l.event, l.detail, l.adds, t.state IN ('Processing', 'UnassignedId', 'Error') AS stays,
      CASE WHEN l.adds THEN CASE WHEN t.state IS NOT NULL THEN 'found duplicate audiofile for id [' || t.task_id || ']. audiofile not added to queue' END
        WHEN t.state IS NULL THEN 'update of unknown task: ' || t.task_id
        WHEN l.results AND t.state <> 'Processing' THEN 'setting result valid only in processed state'
        WHEN l.event = 'start' AND t.state <> 'Waiting' THEN 'only waiting tasks can be started'
        WHEN l.event = 'remove' AND t.state = 'Processing' THEN 'cannot remove task in processing state' END AS why
    FROM t JOIN judged l ON l.task_id = t.task_id AND l.seq = t.applied + 1)
) SELECT * FROM t QUALIFY applied = max(applied) OVER (PARTITION BY task_id)"""


@query(_QUEUE)
def queue_log_states(s, d):
    return queue.folded(_log(s, d))


@query(_QUEUE)
def queue_log_stream(s, d):
    """The same log, dealt to files out of order and read as a stream in two batches or more."""
    folder = f"{shared_folder(s)}/queue-{uuid.uuid4().hex}"
    _log(s, d).repartition(4, F.hash("detail")).write.parquet(f"{folder}/log")
    log = s.readStream.schema(queue.LOG).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    queue.run_queue(log, f"{folder}/states", f"{folder}/checkpoint")
    return queue.current(s, f"{folder}/states")


# --- speech endpoints --------------------------------------------------------------------------

_WINDOW, _RATIO = 8, 0.75


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Events of a user as frames of a clip, in spells of the same vote."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = A.table(s, d, "events").withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    voiced = ((F.floor(F.col("n") / 12) + F.col("user_id")) % 2 == 0) != (F.col("event_type") == "error")
    return rows.select(F.col("user_id").alias("clip"), "n", voiced.alias("voiced"))


_ENDPOINTS = f"""SELECT clip, event, frame FROM (
  SELECT clip, unnest([CASE WHEN speech AND NOT before THEN 'start' WHEN before AND NOT speech THEN 'end' END, CASE WHEN speech AND last THEN 'end' END]) AS event,
    unnest([CASE WHEN speech THEN greatest(0, n - {_WINDOW - 1}) ELSE n - {_WINDOW - 2} END, n + 1]) AS frame
  FROM (SELECT *, lag(speech, 1, false) OVER w AS before, lead(n) OVER w IS NULL AS last
    FROM (SELECT *, coalesce(last_value(CASE WHEN votes > 6 THEN true WHEN votes < 2 THEN false END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY n ROWS UNBOUNDED PRECEDING), false) AS speech
      FROM (SELECT *, sum(CAST(voiced AS INTEGER)) OVER (PARTITION BY clip ORDER BY n ROWS {_WINDOW - 1} PRECEDING) AS votes
        FROM (SELECT user_id AS clip, n, ((n // 12 + user_id) % 2 = 0) <> (event_type = 'error') AS voiced
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))))
    WINDOW w AS (PARTITION BY clip ORDER BY n))) WHERE event IS NOT NULL"""


@query(_ENDPOINTS)
def speech_endpoints(s, d):
    return endpoints.endpoints(_frames(s, d), _WINDOW, _RATIO)


@query(_ENDPOINTS)
def speech_endpoints_stream(s, d):
    """The same frames, dealt to files out of order, with a closing row a clip, read as a stream."""
    folder = f"{shared_folder(s)}/frames-{uuid.uuid4().hex}"
    frames = saved(_frames(s, d), "frames")
    close = frames.groupBy("clip").agg((F.max("n") + 1).alias("n")).select("clip", "n", F.lit(None).cast("boolean").alias("voiced"))
    frames.union(close).repartition(4, F.hash("clip", "n")).write.parquet(f"{folder}/frames")
    stream = s.readStream.schema("clip long, n long, voiced boolean").option("maxFilesPerTrigger", 2).parquet(f"{folder}/frames")
    ordered.run_batches(endpoints.speech_events(stream, _WINDOW, _RATIO), "append", f"{folder}/events", f"{folder}/checkpoint")
    return ordered.all_rows(s, f"{folder}/events", endpoints.EVENTS).drop("batch")
