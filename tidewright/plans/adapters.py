"""Canonical tables from the star-schema and corpus tables, each as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    actor = F.when(F.col("doc_id") % 7 != 0, F.upper("source"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text", actor.alias("actor"))


LINES = "SELECT doc_id AS id, lang, text, CASE WHEN doc_id % 7 <> 0 THEN upper(source) END AS actor FROM documents"


def audio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("duration"))


AUDIO = "SELECT doc_id AS id, quality + toxic AS duration FROM labels"


def names(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    padded = F.lpad(key.cast("string"), 10, "0")
    k = key % 5
    name = (
        F.when(k == 0, F.concat(padded, F.lit("["), F.floor("o_totalprice").cast("string"), F.lit(".5]-x.wav")))
        .when(k == 1, F.concat(padded, F.lit("-x.wav")))
        .when(k == 2, F.concat(F.lit("x_"), key.cast("string"), F.lit(".ogg")))
        .when(k == 3, F.concat(F.lit("note_"), F.lower("o_orderstatus"), F.lit(".wav")))
        .otherwise(F.concat(F.lpad((key - 4).cast("string"), 10, "0"), F.lit(".phonemes")))
    )
    return table(spark, d, "orders").select(name.alias("name"))


NAMES = """SELECT CASE o_orderkey % 5
  WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '[' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5]-x.wav'
  WHEN 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-x.wav'
  WHEN 2 THEN 'x_' || CAST(o_orderkey AS VARCHAR) || '.ogg'
  WHEN 3 THEN 'note_' || lower(o_orderstatus) || '.wav'
  ELSE lpad(CAST(o_orderkey - 4 AS VARCHAR), 10, '0') || '.phonemes' END AS name FROM orders"""

FILES = f"""SELECT name, CASE WHEN id IS NOT NULL AND (ends_with(name, '.wav') OR ends_with(name, '.ogg')) THEN 'audio'
  WHEN ends_with(name, '.wav') OR ends_with(name, '.ogg') THEN 'unlinked' WHEN ends_with(name, '.phonemes') AND id IS NOT NULL THEN 'phonemes' END AS kind, id, secs
FROM (SELECT name, CASE WHEN coalesce(a, b) <= 4294967295 THEN coalesce(a, b) END AS id, secs
  FROM (SELECT name, TRY_CAST(nullif(regexp_extract(stem, '^([0-9]{{1,10}})', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(stem, '([0-9]{{1,10}})$', 1), '') AS BIGINT) AS b,
      TRY_CAST(nullif(regexp_extract(stem, '\\[([^\\]]*)', 1), '') AS DOUBLE) AS secs
    FROM (SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM ({NAMES}))))"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tracks, their items as timed segments."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ms = (F.col("l_quantity") * 10).cast("bigint")
    phoneme = F.when(F.col("l_suppkey") % 13 == 0, "_").otherwise(F.col("l_returnflag"))
    slot = F.row_number().over(order)
    stop = F.sum(ms).over(order.rowsBetween(Window.unboundedPreceding, 0))
    shift = F.when(F.col("l_partkey") % 11 == 0, 5).otherwise(0)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), slot.cast("bigint").alias("slot"), phoneme.alias("phoneme"), slot.isin(1, 4).alias("word_start"), (stop - ms + shift).alias("start"), stop.alias("stop"),
        F.lit(1.0).alias("weight"), (F.col("l_discount") * 10 - 0.2).alias("score"), ((F.col("l_returnflag") != "R") & (phoneme != "_")).alias("active"), (F.col("l_orderkey") % 3).alias("version"),
    )


SEGMENTS = """SELECT id, slot, phoneme, slot IN (1, 4) AS word_start, stop - ms + shift AS start, stop, score, flag <> 'R' AND phoneme <> '_' AS active, id % 3 AS version
FROM (SELECT l_orderkey AS id, row_number() OVER w AS slot, CASE WHEN l_suppkey % 13 = 0 THEN '_' ELSE l_returnflag END AS phoneme, l_returnflag AS flag,
  CAST(l_quantity * 10 AS BIGINT) AS ms, CAST(sum(CAST(l_quantity * 10 AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
  CASE WHEN l_partkey % 11 = 0 THEN 5 ELSE 0 END AS shift, l_discount * 10 - 0.2 AS score FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Recognizer frames from the same tracks: some silences, some without length, some out of order."""
    rows = segments(spark, d)
    label = F.when(F.col("phoneme") == "_", "<sil>").otherwise(F.col("phoneme"))
    last = F.when((F.col("phoneme") == "_") & (F.col("slot") % 2 == 0), F.col("start")).otherwise(F.col("stop") - 1)
    first = F.when(F.col("slot") % 5 == 0, F.col("start") - 600).otherwise(F.col("start"))
    return rows.select("id", "slot", label.alias("label"), first.alias("first_frame"), F.greatest(first, last).alias("last_frame"))


FRAMES = f"""SELECT id, slot, label, first_frame, greatest(first_frame, last) AS last_frame FROM (
  SELECT id, slot, CASE WHEN phoneme = '_' THEN '<sil>' ELSE phoneme END AS label, CASE WHEN slot % 5 = 0 THEN start - 600 ELSE start END AS first_frame,
    CASE WHEN phoneme = '_' AND slot % 2 = 0 THEN start ELSE stop - 1 END AS last FROM ({SEGMENTS}))"""


def pcm(spark: SparkSession, d: str) -> DataFrame:
    clip = lambda x: F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(clip(x) * 32767).cast("smallint")).alias("pcm"))


PCM = "SELECT vec_id AS id, [CAST(round(least(greatest(CAST(x AS DOUBLE), -1.0), 1.0) * 32767) AS INTEGER) for x in embedding] AS pcm FROM embeddings"

#: A small similarity matrix over event types, as fixed values.
SIM = [(a, t, 2.0 if a == t else s) for a, t, s in [
    (a, t, [1.75, 0.5, 0.25, -1.0, 0.1][(i + 2 * j) % 5]) for i, a in enumerate(["click", "view", "purchase", "signup", "error"]) for j, t in enumerate(["click", "view", "purchase", "signup", "error"])
]]


def sim(spark: SparkSession) -> DataFrame:
    rows = [(t, a, k, s) for k, (a, t, s) in enumerate(SIM)]
    return spark.createDataFrame(rows, "text_ph string, audio_ph string, col_pos int, score double")


SIM_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{a}', {k}, CAST({s} AS DOUBLE))" for k, (a, t, s) in enumerate(SIM)) + ") v(text_ph, audio_ph, col_pos, score)"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """A similarity matrix (text_ph, audio_ph, kind, col_pos, score) from events: how often the labels of an event meet."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") % 7
    kind, place = F.col("event_type"), F.col("event_id") % 8
    pairs = table(spark, d, "events").select(F.concat(F.lit("t"), k.cast("string")).alias("text_ph"), F.concat_ws("_", kind, place.cast("string")).alias("audio_ph"), kind.alias("kind"))
    counts = pairs.groupBy("text_ph", "audio_ph", "kind").agg(F.count("*").alias("n"))
    total = counts.groupBy("text_ph").agg(F.sum("n").alias("total"))
    columns = counts.groupBy("audio_ph").agg(F.count("*").alias("texts"))
    # Few labels, however many events: the position of a column is the number of labels before it.
    before = columns.select(F.col("audio_ph").alias("other"))
    ranked = columns.join(before, F.col("other") < F.col("audio_ph"), "left").groupBy("audio_ph").agg(F.count("other").alias("col_pos"))
    score = F.round(F.col("n") * 200 / F.col("total") - 5, 4)
    return counts.join(total, "text_ph").join(ranked, "audio_ph").select("text_ph", "audio_ph", "kind", "col_pos", score.alias("score"))


MATRIX = """SELECT text_ph, audio_ph, kind, dense_rank() OVER (ORDER BY audio_ph) - 1 AS col_pos, round(n * 200.0 / sum(n) OVER (PARTITION BY text_ph) - 5, 4) AS score
FROM (SELECT 't' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 AS text_ph, event_type || '_' || event_id % 8 AS audio_ph, event_type AS kind, count(*) AS n FROM events GROUP BY ALL)"""
