"""Lookups with defaults and cascades, as equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters_to_say

#: Least score and number of the alternatives of a text label, and the default score.
LEAST_SCORE, MOST_ALTERNATIVES, DEFAULT_SCORE, NOISE_SCORE = 0.1, 25, -1.0, -2.1
NOISE = ["sil", "+nsn+", "+spn+"]


def resolve_actors(actors: DataFrame, general: DataFrame, overrides: DataFrame) -> DataFrame:
    """(actor, resolved): an override; else the id of the first general entry whose caption or id it is; else itself.

    general (pos, id, caption); overrides (actor, mapped), one row an actor; matching in lower case.
    """
    keys = general.select("pos", "id", F.explode(F.array_distinct(F.array(F.lower("caption"), F.lower("id")))).alias("key"))
    first = keys.groupBy("key").agg(F.min_by("id", "pos").alias("first_id"))
    over = overrides.select(F.lower("actor").alias("key"), "mapped")
    rows = actors.withColumn("key", F.lower("actor")).join(over, "key", "left").join(first, "key", "left")
    return rows.select("actor", F.coalesce("mapped", "first_id", "actor").alias("resolved"))


def similarity(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """pairs (audio_ph, text_ph, ...) with their score; unknown pairs have the default one, noise the lowest."""
    a, t = F.lower(pairs["audio_ph"]), F.lower(pairs["text_ph"])
    known = scores.select(F.lower("audio_ph").alias("_a"), F.lower("text_ph").alias("_t"), F.col("score").alias("_score"))
    joined = pairs.join(known, (a == known["_a"]) & (t == known["_t"]), "left")
    score = F.when(F.lower("audio_ph").isin(*NOISE), NOISE_SCORE).otherwise(F.coalesce("_score", F.lit(DEFAULT_SCORE)))
    return joined.select(*pairs.columns, score.alias("score"))


def alternatives(scores: DataFrame) -> DataFrame:
    """(text_ph, alternatives): the best audio labels of each text label; scores (text_ph, audio_ph, col_pos, score)."""
    ranked = scores.where(F.col("score") >= LEAST_SCORE).withColumn("n", F.row_number().over(Window.partitionBy("text_ph").orderBy(F.desc("score"), "col_pos")))
    best = ranked.where(F.col("n") <= MOST_ALTERNATIVES).groupBy("text_ph").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "audio_ph"))), lambda x: x["audio_ph"]).alias("l"))
    joined = scores.select("text_ph").distinct().join(best, "text_ph", "left")
    text = F.when(F.col("l").isNull(), "").when(F.size("l") == 1, F.col("l")[0]).otherwise(F.concat(F.lit("("), F.array_join("l", "|"), F.lit(")")))
    return joined.select("text_ph", text.alias("alternatives"))


def phonetize(words: DataFrame, mapping: DataFrame) -> DataFrame:
    """(word, phones): every label of a word mapped; null if any is unknown. words (word, labels array)."""
    each = words.select("word", F.posexplode_outer("labels").alias("k", "label")).join(mapping, "label", "left")
    phones = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "phone"))), lambda x: x["phone"]), " ")
    return each.groupBy("word").agg(F.when(F.count_if(F.col("phone").isNull()) == 0, phones).alias("phones"))


def pronounce(words: DataFrame, custom: DataFrame, dictionary: DataFrame, mapped: DataFrame, letters: DataFrame) -> DataFrame:
    """(word, rule): from the custom dictionary, else the recognizer's, else the mapped translation, else letter by letter."""
    spelled = words.select("word", F.posexplode(letters_to_say(F.trim("word"))).alias("k", "letter")).join(letters, "letter", "left").groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "alternatives"))), lambda x: x["alternatives"]), " ").alias("spelled"))
    rows = words.join(custom.select("word", F.col("rule").alias("r1")), "word", "left").join(dictionary.select("word", F.col("rule").alias("r2")), "word", "left").join(mapped.select("word", F.col("rule").alias("r3")), "word", "left").join(spelled, "word", "left")
    return rows.select("word", F.coalesce("r1", "r2", "r3", "spelled").alias("rule"))


def replace_words(texts: DataFrame, replacements: DataFrame) -> DataFrame:
    """(id, text) with whole words replaced, a word's key being it without _; a small dictionary becomes a map."""
    each = texts.select("id", F.posexplode(F.split("text", " ")).alias("k", "w")).withColumn("key", F.replace(F.col("w"), F.lit("_"), F.lit("")))
    done = each.join(replacements.select(F.col("search").alias("key"), "replacement"), "key", "left")
    words = F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("replacement", "w").alias("w")))), lambda x: x["w"])
    return done.groupBy("id").agg(F.array_join(words, " ").alias("text"))


def unknown_labels(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, label) of rules with labels that are no phonemes; must be empty."""
    each = rules.select("word", F.explode(F.split(F.regexp_replace("rule", r"[|()\[\]]", " "), " +")).alias("label")).where("label <> ''")
    return each.join(labels, "label", "left_anti").select("word", "label").distinct()
