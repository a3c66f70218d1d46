"""Writers of tracks, reports and mappings; each returns a DataFrame of lines or writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meta_line(key: str, value: Column) -> Column:
    return F.concat(F.lit(f";meta[{key}="), F.coalesce(value.cast("string"), F.lit("")), F.lit("]"))


def header_line(text: Column) -> Column:
    return F.concat(F.lit(";"), text)


def comment_line(text: Column) -> Column:
    return F.concat(F.lit(";"), text)


def segment_line(s: Column) -> Column:
    """One segment, with fixed widths; ; marks inactive ones, and scores below zero ask for a check."""
    status = F.when(s["score"] < 0, "<- VERIFY!").otherwise("ok")
    row = F.format_string("%-8s|%5d|%5d|%6.2f|%6.2f| %-11s| %s", F.concat(F.when(s["active"], "").otherwise(";"), s["phoneme"]), s["start"], s["stop"], s["weight"].cast("double"), s["score"].cast("double"), status, F.coalesce(s["info"], F.lit("")))
    return row


def track_files(tracks: DataFrame) -> DataFrame:
    """(name, content): the text of each track's file."""
    heard = F.col("audio_hypothesis").isNotNull()
    rule = F.repeat(F.lit("-"), F.when(heard, 72).otherwise(48))
    meta = [meta_line(k, F.col(c)) for k, c in (("language", "language"), ("version", "version"), ("actor", "actor"), ("text", "text"), ("translation", "translation"))]
    head = F.concat(F.array(*meta), F.when(heard, F.array(meta_line("audio-hypothesis", F.col("audio_hypothesis")))).otherwise(F.array().cast("array<string>")), F.array(F.lit(";phoneme|start|  end|weight| score| status     | info")))
    body = F.flatten(F.transform(F.array_sort("segments"), lambda s: F.when(s["word_start"], F.array(rule, segment_line(s))).otherwise(F.array(segment_line(s)))))
    return tracks.select(F.concat(F.lpad(F.col("id").cast("string"), 10, "0"), F.lit(".phonemes")).alias("name"), F.concat(F.array_join(F.concat(head, body), "\n"), F.lit("\n")).alias("content"))


def write_named(files: DataFrame, folder: str) -> None:
    """One file per row (name, content), written by the executors to a folder that all of them reach."""

    def write(rows) -> None:
        from pathlib import Path

        for r in rows:
            target = Path(folder) / r.name
            part = target.with_suffix(target.suffix + ".part")
            part.write_text(r.content, encoding="utf-8")
            part.replace(target)

    files.foreachPartition(write)


def missing_report(missing: DataFrame) -> DataFrame:
    """(line) of the missing-audio report, in order; empty if nothing is missing."""
    rows = missing.select(F.lit(1).alias("k"), "id", F.concat(F.lpad(F.col("id").cast("string"), 10, "0"), F.lit("|"), F.coalesce("actor", F.lit("")), F.lit("|"), "text").alias("line"))
    head = rows.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).alias("k"), F.posexplode(F.array(F.lit(";"), F.concat(F.lit("; missing lines: "), F.col("n")), F.lit(";"))).alias("id", "line"))
    return head.select("k", F.col("id").cast("bigint").alias("id"), "line").union(rows).orderBy("k", "id").select("line")


def mapping_lines(mappings: DataFrame, comments: list[str]) -> DataFrame:
    """(line) of an actor mapping file: comments, then key:value lines, sorted."""
    spark = mappings.sparkSession
    head = spark.createDataFrame([(i, c) for i, c in enumerate(comments)], "k int, line string")
    rows = mappings.select(F.lit(len(comments)).alias("k"), F.concat("actor", F.lit(":"), "mapped").alias("line"))
    return head.union(rows).orderBy("k", "line").select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """A report as one text file in a folder; reports are small by nature."""
    lines.coalesce(1).write.mode("overwrite").text(path)
