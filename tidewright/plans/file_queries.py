"""Registered queries over files that are written from the tables first, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import formats, sinks
from . import adapters as A
from .queries import query


def _supplied(s, d):
    """A supplier's items as one track."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    ms = (F.col("l_quantity") * 10).cast("bigint")
    slot, stop = F.row_number().over(order), F.sum(ms).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return A.table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("id"), slot.alias("slot"), F.col("l_returnflag").alias("phoneme"), (slot % 4 == 1).alias("word_start"),
        (stop - ms).alias("start"), stop.alias("stop"), F.lit(1.0).alias("weight"), F.round("l_discount", 2).cast("double").alias("score"), (F.col("l_returnflag") != "R").alias("active"),
    )


@query("""SELECT id, slot, phoneme, slot % 4 = 1 AS word_start, stop - ms AS start, stop, CAST(round(l_discount, 2) AS DOUBLE) AS score, phoneme <> 'R' AS active
FROM (SELECT *, CAST(sum(ms) OVER (PARTITION BY id ORDER BY slot) AS BIGINT) AS stop FROM (SELECT l_suppkey AS id, CAST(l_quantity * 10 AS BIGINT) AS ms, l_returnflag AS phoneme, l_discount,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS slot FROM lineitem))""")
def track_files(s, d):
    """Tracks written as files, one a supplier, and all of them read again."""
    formats.register(s)
    cell = F.struct("slot", "phoneme", "word_start", "start", "stop", "weight", "score", "active", F.lit(None).cast("string").alias("info"))
    rows = _supplied(s, d).groupBy("id").agg(F.array_sort(F.collect_list(cell)).alias("segments"))
    meta = {c: F.lit(None).cast("string") for c in ("language", "actor", "text", "translation", "audio_hypothesis")}
    folder = f"{shared_folder(s)}/tracks-{uuid.uuid4().hex}"
    sinks.track_files(rows.withColumns(meta | {"version": F.lit(1)})).write.format("tracks").mode("append").save(folder)
    read = s.read.format("tracks").option("kind", "phonemes").load(folder)
    each = read.select("id", F.explode("segments").alias("x")).select("id", "x.*")
    return each.select("id", F.col("slot").cast("bigint").alias("slot"), "phoneme", "word_start", "start", "stop", "score", "active")


@query("SELECT c_custkey AS id, c_mktsegment AS lang, c_name AS text, CASE WHEN c_custkey % 7 <> 0 THEN 'n' || c_nationkey END AS actor FROM customer")
def catalogue_files(s, d):
    """Line catalogues written by market segment, and all of them read again."""
    formats.register(s)
    folder = f"{shared_folder(s)}/lines-{uuid.uuid4().hex}"
    actor = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise("")
    rows = A.table(s, d, "customer").select(F.col("c_mktsegment").alias("lang"), F.pmod(F.hash("c_custkey"), F.lit(16)).alias("part"), F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", actor).alias("line"))
    # A catalogue for each language and sixteenth of its lines.
    files = rows.groupBy("lang", "part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    head = F.concat(F.lit(";meta[language="), F.col("lang"), F.lit("]\n;id|text|actor\n"))
    named = files.select(F.concat_ws("-", F.lower("lang"), F.col("part").cast("string"), F.lit("lines.csv")).alias("name"), F.concat(head, "body", F.lit("\n")).alias("content"))
    named.write.format("tracks").mode("append").save(folder)
    return s.read.format("lines").load(folder).select("id", "lang", "text", "actor")
