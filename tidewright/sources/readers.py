"""Readers of the text and audio formats.

Text files are read whole, one row per file, so that line order and header rules hold
within a file; files are the unit of parallelism.  Parsing keeps bad rows with an error
text; ``fail_on_error`` turns the first one (smallest line) into an exception.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Track metadata keys, and limits of similarity scores.
META_KEYS = ["language", "version", "actor", "text", "translation", "audio-hypothesis"]
CONFIG_KEYS = ["phonemes", "cleanup", "phoneme-model", "dictionary", "noise-dictionary"]
#: The signs that a translator's texts are cleaned of, whatever its dictionary says.
CLEANUP = "-…*/+\\"
SCORE_LOW, SCORE_HIGH, EMPTY_SCORE = -2.1, 2.1, -1.0


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of the regular files of a directory, or of a glob; contents are not read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    return rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the lines of whole files, from 1."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = rows.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("k", "line"))
    return lines.select("path", (F.col("k") + 1).alias("line_no"), "line")


def fail_on_error(rows: DataFrame) -> DataFrame:
    """rows without their column error; raises with the smallest line's text if any is set."""
    bad = rows.where("error is not null").agg(F.min(F.struct("line_no", "error")).alias("e")).first()
    if bad and bad.e:
        raise ValueError(f"line {bad.e.line_no}: {bad.e.error}")
    return rows.drop("error")


def _content(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).where(F.trim("line") != "").where(~F.startswith(F.col("line"), F.lit(";")))


def key_values(spark: SparkSession, path: str, separator: str = "=", lower: bool = False) -> DataFrame:
    """(line_no, key, value, error) of lines key<separator>value; ; starts a comment."""
    parts = F.split("line", separator if separator not in ".|" else f"\\{separator}")
    cell = lambda k: F.trim(F.lower(F.get(parts, k)) if lower else F.get(parts, k))
    rows = _content(spark, path)
    return rows.select("line_no", cell(0).alias("key"), cell(1).alias("value"), F.when(F.size(parts) != 2, F.format_string("expected 2 columns, found %d", F.size(parts))).alias("error"))


def actor_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(pos, actor, mapped): duplicate keys keep their first position and last value."""
    rows = fail_on_error(key_values(spark, path, ":", lower=True))
    return rows.groupBy("key").agg(F.min("line_no").alias("pos"), F.max_by("value", "line_no").alias("mapped")).select("pos", F.col("key").alias("actor"), "mapped")


def comments(spark: SparkSession, path: str) -> list[str]:
    """The comment lines of a small file such as an actor mapping, in order, to be written back with it."""
    rows = numbered_lines(spark, path).where(F.startswith(F.trim("line"), F.lit(";"))).orderBy("line_no")
    return [r.line.strip() for r in rows.collect()]


def similarity_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(text_ph, audio_ph, col_pos, score): the matrix as long table; empty cells have the default score."""
    rows = _content(spark, path).withColumn("cells", F.transform(F.split("line", r"\|"), F.trim))
    header = rows.agg(F.min(F.struct("line_no", "cells")).alias("h")).select("h.cells").withColumnRenamed("cells", "header")
    body = rows.join(F.broadcast(header), F.lit(True))  # one row
    body = body.where(~F.startswith(F.col("line"), F.lit("[T\\A]")))
    wrong = F.when(F.get("header", 0) != "[T\\A]", "missing header").when(F.size("cells") != F.size("header"), "row width differs from header")
    each = body.select("line_no", F.lower(F.get("cells", 0)).alias("text_ph"), wrong.alias("error"), "header", F.posexplode(F.slice("cells", F.lit(2), F.size("cells"))).alias("k", "cell"))
    score = F.when(F.col("cell") == "", EMPTY_SCORE).otherwise(F.col("cell").try_cast("float"))
    checked = F.coalesce("error", F.when(score.isNull(), "not a number").when(~score.between(F.lit(SCORE_LOW).cast("float"), F.lit(SCORE_HIGH).cast("float")), "score out of range"))
    rows = each.select("line_no", "text_ph", F.get("header", F.col("k") + 1).alias("audio_ph"), F.col("k").alias("col_pos"), score.alias("score"), checked.alias("error"))
    double = rows.groupBy("text_ph").agg(F.countDistinct("line_no").alias("n"), F.max("line_no").alias("l")).where("n > 1").select("text_ph", "l")
    rows = rows.join(double, "text_ph", "left").withColumn("error", F.coalesce("error", F.when(F.col("line_no") == F.col("l"), "duplicate text phoneme"))).drop("l")
    return fail_on_error(rows).drop("line_no")


def cleanup_signs(settings: DataFrame) -> str:
    """The signs that texts are cleaned of, of a recognizer's settings: each once, in order."""
    found = settings.where("key = 'cleanup'").first()
    return "".join(sorted(set(found.value) - {" "})) if found else ""


def recognizer_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settings, phonemes, letters) of key = value lines with known keys; one-letter keys have alternatives, which must be phonemes."""
    rows = key_values(spark, path)
    strange = F.format_string("unknown key %s", "key")
    empty = F.format_string("expected at least one alternative for character %s", "key")
    wrong = F.when((F.length("key") != 1) & ~F.col("key").isin(CONFIG_KEYS), strange).when((F.length("key") == 1) & (F.coalesce("value", F.lit("")) == ""), empty)
    rows = fail_on_error(rows.withColumn("error", F.coalesce("error", wrong)))
    last = rows.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))
    words = F.array_sort(F.array_distinct(F.filter(F.split("value", r"[\s,|]+"), lambda x: x != "")))
    phonemes = last.where("key = 'phonemes'").select(F.explode(words).alias("label"))
    single = last.where(F.length("key") == 1).select(F.col("key").alias("letter"), words.alias("l"))
    unknown = single.select(F.explode("l").alias("label")).join(phonemes, "label", "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown phoneme: {unknown.first().label}")
    letters = single.select("letter", F.when(F.size("l") > 1, F.concat(F.lit("("), F.array_join("l", "|"), F.lit(")"))).otherwise(F.array_join("l", "|")).alias("alternatives"))
    return last.where(F.length("key") > 1), phonemes, letters


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """(word, rule) of lines "word rule"; the last of a word wins."""
    rows = _content(spark, path).select("line_no", F.lower(F.regexp_extract("line", r"^\s*(\S+)\s+(.*)$", 1)).alias("word"), F.trim(F.regexp_extract("line", r"^\s*(\S+)\s+(.*)$", 2)).alias("rule"))
    return rows.groupBy("word").agg(F.max_by("rule", "line_no").alias("rule"))


def phoneme_set(spark: SparkSession, path: str) -> DataFrame:
    return _content(spark, path).select(F.regexp_extract("line", r"^\s*(\S+)", 1).alias("label")).distinct()


def replacements(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(search, replacement), the last of a word, and the clean-up signs of a translator's dictionary: lines "word phonemes"
    and "cleanup = signs"; another line with = is an error, a missing file is an empty one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], "search string, replacement string"), "".join(sorted(set(CLEANUP)))
    lines = numbered_lines(spark, path).where(~F.startswith(F.col("line"), F.lit(";")))
    assigned = F.contains("line", F.lit("="))
    clean = F.lower(F.trim(F.substring_index("line", "=", 1))) == "cleanup"
    error = F.when(assigned & ~clean, F.format_string("failed to parse dictionary line [%s]", "line"))
    rows = fail_on_error(lines.withColumn("error", error))
    signs = {c for r in rows.where(assigned).collect() for c in r.line.split("=", 1)[1].strip()}
    cells = rows.where(~assigned & F.contains("line", F.lit(" "))).select("line_no", F.split("line", " ", 2).alias("p"))
    words = cells.select("line_no", F.trim(F.get("p", 0)).alias("search"), F.trim(F.get("p", 1)).alias("replacement"))
    return words.groupBy("search").agg(F.max_by("replacement", "line_no").alias("replacement")), "".join(sorted(signs | set(CLEANUP)))


def _catalogue_rows(content: str, language: str | None) -> tuple[list[tuple], str]:
    """Rows (line_no, id, text, actor, error) and the language of one line catalogue."""
    lines = content.replace("\r\n", "\n").split("\n")
    head = lines[0].lstrip("﻿") if lines else ""
    if head.startswith(";meta[language="):
        found = head[len(";meta[language=") :].split("]")[0]
        if language and found != language:
            return [(1, None, None, None, f"language is {found}, not {language}")], found
        names = [c.strip() for c in (lines[1] if len(lines) > 1 else "").lstrip(";").split("|")]
        if missing := [c for c in ("id", "text") if c not in names]:
            return [(2, None, None, None, f"missing column {missing[0]}")], found
        rows, at = [], {c: names.index(c) for c in ("id", "text", "actor") if c in names}
        start, split, voiced = 2, lambda x: x.split("|"), False
    else:
        names = [c.strip().lower() for c in head.split(";")]
        found = language or ""
        wanted = {"id": "id", "text": found.lower(), "actor": "voiceover"}
        at = {k: names.index(v) for k, v in wanted.items() if v in names}
        if "id" not in at or "text" not in at:
            return [(1, None, None, None, "missing column id or language")], found
        rows, start, split, voiced = [], 1, _quoted, True
    for k, line in enumerate(lines[start:], start + 1):
        if not line.strip() or (not voiced and line.startswith(";")):
            continue
        cells = split(line)
        if len(cells) <= max(at["id"], at["text"]):
            rows.append((k, None, None, None, "too few columns"))
        elif not cells[at["id"]].strip().isdigit():
            rows.append((k, None, None, None, "id is not a number"))
        else:
            actor = cells[at["actor"]].strip() if "actor" in at and at["actor"] < len(cells) else None
            rows.append((k, int(cells[at["id"]].strip()), cells[at["text"]], actor or None, None))
    return rows, found


def _quoted(line: str) -> list[str]:
    """Cells between semicolons; a cell that begins with a quote, but for the first, may hold some."""
    cells, now, inside = [], [], False
    for i, c in enumerate(line):
        if c == ";" and not inside:
            cells.append("".join(now))
            now, inside = [], line[i + 1 : i + 2] == '"'
            continue
        if c == '"' and inside and now and line[i + 1 : i + 2] in (";", ""):
            inside = False
        now.append(c)
    return [*cells, "".join(now)]


def line_catalogue(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """(id, lang, text, actor, line_no) of a line catalogue, either variant; the last of an id wins."""
    from ..session import ship

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for value in part["value"]:
                rows, found = _catalogue_rows(value, language)
                voiced = not value.lstrip("﻿").startswith(";meta[language=")
                yield pd.DataFrame([(r[1], found, r[2], r[3], r[0], r[4], voiced) for r in rows], columns=["id", "lang", "text", "actor", "line_no", "error", "voiced"]).astype({"id": "Int64"})

    ship(spark)
    rows = spark.read.text(path, wholetext=True).mapInPandas(run, "id long, lang string, text string, actor string, line_no int, error string, voiced boolean")
    rows = fail_on_error(rows).withColumns({"text": T.decode_text(F.col("text")), "actor": F.when(F.col("voiced"), T.voiceover_actor(F.col("actor"))).otherwise(F.col("actor"))})
    return rows.groupBy("id").agg(F.max_by(F.struct("lang", "text", "actor", "line_no"), "line_no").alias("r")).select("id", "r.lang", "r.text", "r.actor", "r.line_no")


def _track(content: str) -> tuple[dict, list[dict]]:
    meta, rows, header, starts = {"version": "0"}, [], False, False
    for k, line in enumerate(content.replace("\r\n", "\n").split("\n"), 1):
        if not line.strip():
            continue
        if line.startswith(";meta["):
            key, _, value = line[6:].rstrip().removesuffix("]").partition("=")
            if key not in META_KEYS:
                raise ValueError(f"line {k}: unknown meta key {key}")
            meta[key] = value
        elif line.startswith(";") and not header and "phoneme" in line:
            header = True
        elif line.startswith(";") and not header:
            key, _, value = line[1:].partition(":")
            if key.strip() in META_KEYS and value:
                meta[key.strip()] = value.strip(' "')
        elif line.lstrip(";").startswith("---"):
            starts = True
        else:
            if not header:
                raise ValueError(f"line {k}: body before header")
            cells = [c.strip() for c in line.removeprefix(";").split("|")]
            if not 4 <= len(cells) <= 7:
                raise ValueError(f"line {k}: {len(cells)} columns")
            rows.append({"slot": len(rows) + 1, "phoneme": cells[0], "word_start": starts, "start": int(cells[1]), "stop": int(cells[2]), "weight": float(cells[3]), "score": float(cells[4]) if len(cells) > 4 and cells[4] else 0.0, "active": not line.startswith(";"), "info": cells[6] if len(cells) > 6 else None})
            starts = False
    return meta, rows


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row per track file: id, version, language, actor, text, translation, audio_hypothesis, segments."""
    from ..session import ship

    segment = "struct<slot:int,phoneme:string,word_start:boolean,start:bigint,stop:bigint,weight:double,score:double,active:boolean,info:string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, value in zip(part["path"], part["value"], strict=True):
                meta, rows = _track(value)
                digits = "".join(c for c in name.rsplit("/", 1)[-1][:10] if c.isdigit())
                out.append((int(digits or 0), int(meta["version"]), *(meta.get(k) for k in ("language", "actor", "text", "translation", "audio-hypothesis")), rows))
            yield pd.DataFrame(out, columns=["id", "version", "language", "actor", "text", "translation", "audio_hypothesis", "segments"])

    ship(spark)
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.mapInPandas(run, f"id long, version int, language string, actor string, text string, translation string, audio_hypothesis string, segments array<{segment}>")


def wav_clips(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, bits, pcm): 16-bit samples of the last channel."""
    from ..session import ship

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, content in zip(part["path"], part["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    raw = np.frombuffer(w.readframes(w.getnframes()), "<i2") if w.getsampwidth() == 2 else np.zeros(0, np.int16)
                    out.append((name, w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), raw.reshape(-1, w.getnchannels())[:, -1].tolist()))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "bits", "pcm"])

    ship(spark)
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInPandas(run, "path string, rate int, channels int, bits int, pcm array<smallint>")


def help_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, title, body) of sections that begin with ##; empty bodies are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "(?m)^##")).alias("k", "s")).where("k > 0")
    first = F.trim(F.substring_index("s", "\n", 1))
    body = F.trim(F.expr("substring(s, length(substring_index(s, '\n', 1)) + 2)"))
    return rows.select(F.substring_index(first, "#", 1).alias("topic"), F.substring_index(first, "#", -1).alias("title"), body.alias("body")).where("body <> ''")


def languages(spark: SparkSession, path: str) -> DataFrame:
    """(language) of the two-letter configurations of a data directory."""
    return file_names(spark, path).select(F.regexp_extract("name", r"^([^.]{2})\..*cfg$", 1).alias("language")).where("language <> ''").distinct()


def strings_file(spark: SparkSession, *directories: str) -> str | None:
    """The first line catalogue (by name) in the directories, in their order."""
    for d in directories:
        found = file_names(spark, d).where(F.col("name").rlike(r"\.(csv|strings-csv)$")).orderBy("name").limit(1).first()
        if found:
            return found.path
    return None
