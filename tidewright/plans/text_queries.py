"""Registered queries over names, words, fields, views and activations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gaps, lookup, timeline
from . import adapters as A
from .queries import query

# --- names and words ---------------------------------------------------------------------------


@query(f"""SELECT name, regexp_replace(name, '^[0-9]+', '') AS rest, translate(left(regexp_replace(name, '\\.[^.]*$', ''), 10), '._', '  ') AS preset FROM ({A.NAMES})""")
def name_edits(s, d):
    name = F.col("name")
    return A.names(s, d).select("name", T.drop_leading_digits(name).alias("rest"), T.search_preset(T.stem(name)).alias("preset"))


@query("""SELECT p_partkey, '#JSGF V1.0;' || chr(10) || 'grammar line;' || chr(10) || 'public <line> = ' || replace('[SIL] ' || array_to_string(string_split(p_name, ' '), ' [ SIL+ ] ') || ' [SIL]', '  ', ' ') || ';' AS grammar FROM part""")
def grammar_lines(s, d):
    return A.table(s, d, "part").select("p_partkey", T.grammar(F.split("p_name", " ")).alias("grammar"))


_SPREAD = "'(en)_' || replace(replace(regexp_replace(p_name, '([a-z])', '\\1_', 'g'), 'o_', 'o__ː'), 'a', '_a') || '_(fr)'"


@query(f"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_SPREAD}, '\\([^)]*\\)', '', 'g'), '_+([ːʲʰ])', '\\1', 'g'), '_{{2,}}', '_', 'g'), '(^| )_', '\\1', 'g'), '_( |$)', '\\1', 'g') AS phonemes FROM part""")
def translated_phonemes(s, d):
    spread = F.replace(F.replace(F.regexp_replace("p_name", "([a-z])", "$1_"), F.lit("o_"), F.lit("o__ː")), F.lit("a"), F.lit("_a"))
    return A.table(s, d, "part").select("p_partkey", T.ipa_separated(F.concat(F.lit("(en)_"), spread, F.lit("_(fr)"))).alias("phonemes"))


@query("""SELECT c_custkey, CASE code WHEN 'br' THEN 'pt' WHEN 'cz' THEN 'cs' WHEN 'esmx' THEN 'es-la' WHEN 'kr' THEN 'ko' ELSE code END AS voice
FROM (SELECT c_custkey, ['br', 'cz', 'esmx', 'kr', 'de', 'en'][c_nationkey % 6 + 1] AS code FROM customer)""")
def voices(s, d):
    code = F.get(F.array(*map(F.lit, ("br", "cz", "esmx", "kr", "de", "en"))), (F.col("c_nationkey") % 6).cast("int"))
    return A.table(s, d, "customer").select("c_custkey", T.voice(code).alias("voice"))


_FIRST = "SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part"


@query(f"""SELECT p_partkey AS id, string_agg(coalesce(upper(f.w), x), ' ' ORDER BY k) AS text FROM (
  SELECT p_partkey, unnest(string_split(spread, ' ')) AS x, generate_subscripts(string_split(spread, ' '), 1) AS k FROM (SELECT p_partkey, replace(p_name, 'e', 'e_') AS spread FROM part))
  LEFT JOIN ({_FIRST}) f ON f.w = replace(x, '_', '') GROUP BY p_partkey""")
def replaced_words(s, d):
    part = A.table(s, d, "part")
    search = part.select(F.substring_index("p_name", " ", 1).alias("search")).distinct()
    texts = part.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit("e"), F.lit("e_")).alias("text"))
    return lookup.replace_words(texts, search.select("search", F.upper("search").alias("replacement")))


@query(f"""SELECT DISTINCT word, label FROM (SELECT p_partkey AS word, unnest(string_split(p_name, ' ')) AS label FROM part) WHERE label <> '' AND label NOT IN (SELECT w FROM ({_FIRST}) WHERE length(w) % 2 = 0)""")
def unknown_labels(s, d):
    part = A.table(s, d, "part")
    labels = part.select(F.substring_index("p_name", " ", 1).alias("label")).distinct().where(F.length("label") % 2 == 0)
    rules = part.select(F.col("p_partkey").alias("word"), F.concat(F.lit("("), F.replace("p_name", F.lit(" "), F.lit("|")), F.lit(")")).alias("rule"))
    return lookup.unknown_labels(rules, labels)


@query("""SELECT doc_id, text <> '' AS nonempty, regexp_full_match(text, '[\\x00-\\x7F]*') AS plain, length(text) >= 40 OR text = '' AS long_enough, length(text) <= 400 AS short_enough,
  regexp_full_match(source, '([a-z]|[0-3])*') AS known_chars, regexp_full_match(clock, '([01][0-9]|2[0-3]):[0-5][0-9]') AS clock, regexp_full_match(clock || ':' || doc_id % 100, '[0-9]{2}:[0-5][0-9]:[0-5][0-9]') AS seconds
FROM (SELECT *, lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(doc_id % 70 AS VARCHAR), 2, '0') AS clock FROM documents)""")
def field_checks(s, d):
    key, text = F.col("doc_id"), F.col("text")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(key % 30), two(key % 70))
    return A.table(s, d, "documents").select(
        "doc_id",
        T.valid(text, nonempty=True).alias("nonempty"),
        T.valid(text, ascii_only=True).alias("plain"),
        T.valid(text, least=40).alias("long_enough"),
        T.valid(text, most=400).alias("short_enough"),
        T.valid(F.col("source"), chars="[a-z]|[0-3]").alias("known_chars"),
        T.is_clock(clock).alias("clock"),
        T.is_clock(F.concat_ws(":", clock, (key % 100).cast("string")), seconds=True).alias("seconds"),
    )


# --- clips and views ---------------------------------------------------------------------------

_ZOOM = f"least(greatest(event_id % 50 / 2.0, {timeline.ZOOM_LOW}), {timeline.ZOOM_HIGH})"


@query(f"""SELECT event_id, CAST(floor(begin) AS BIGINT) AS first_ms, CAST(floor(begin + size) AS BIGINT) AS last_ms FROM (
  SELECT event_id, size, least(greatest((event_id % 13 - 1) / 10.0::DOUBLE * length, 0.0), length - size) AS begin FROM (SELECT event_id, user_id * 37 + 500 AS length, (user_id * 37 + 500) / ({_ZOOM})::DOUBLE AS size FROM events))""")
def view_windows(s, d):
    key = F.col("event_id")
    first, last = timeline.view_window(F.col("user_id") * 37 + 500, (key % 50 / 2).cast("double"), ((key % 13 - 1) / F.lit(10.0)))
    return A.table(s, d, "events").select("event_id", first.alias("first_ms"), last.alias("last_ms"))


@query("""SELECT p_partkey, CASE WHEN channels <= 2 AND rate = 44100 AND bits = 16 THEN 'use' WHEN channels <= 2 AND rate >= 44100 THEN 'resample' ELSE 'error' END AS gate
FROM (SELECT p_partkey, p_partkey % 4 AS channels, [8000, 16000, 44100, 48000][p_partkey // 4 % 4 + 1] AS rate, [8, 16, 24][p_partkey // 16 % 3 + 1] AS bits FROM part)""")
def audio_gates(s, d):
    key = F.col("p_partkey")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    gate = timeline.audio_gate(key % 4, pick((8000, 16000, 44100, 48000), F.floor(key / 4) % 4), pick((8, 16, 24), F.floor(key / 16) % 3), 44100)
    return A.table(s, d, "part").select("p_partkey", gate.alias("gate"))


@query(f"""SELECT event_id, factor, CAST(least(floor(greatest(0.0, place - fixed * ((old - factor) / (old * factor)))), n - floor(n / factor)) AS BIGINT) AS begin
FROM (SELECT *, least(greatest(old + old * 0.25::DOUBLE * amount, {timeline.ZOOM_LOW}), {timeline.ZOOM_HIGH})::DOUBLE AS factor
  FROM (SELECT event_id, (1 + event_id % 29)::DOUBLE AS old, (event_id % 7 - 3)::DOUBLE AS amount, user_id * 10 AS place, event_id % 900 AS fixed, user_id * 100 + 1000 AS n FROM events))""")
def zoomed_views(s, d):
    key, user = F.col("event_id"), F.col("user_id")
    factor, begin = timeline.zoomed(user * 10, (1 + key % 29).cast("double"), (key % 7 - 3).cast("double"), key % 900, user * 100 + 1000)
    return A.table(s, d, "events").select("event_id", factor.alias("factor"), begin.alias("begin"))


# --- activation --------------------------------------------------------------------------------

_SNAP = "CASE WHEN {t} < {low} THEN {low} WHEN {t} > {high} THEN {high} ELSE {t} END"


def _snap(time: str, low: str, high: str) -> str:
    return _SNAP.format(t=f"(floor(({time}) / 5.0 + 0.5) * 5)", low=low, high=high)


_ACTIVATED = f"""WITH tracks AS (SELECT id, list({{'slot': slot, 'phoneme': phoneme, 'ws': word_start, 'start': start, 'stop': stop, 'active': active}} ORDER BY slot) AS segs FROM ({A.SEGMENTS}) GROUP BY id),
picked AS (SELECT *, list_min([i for i in range(1, len(segs) + 1) if NOT segs[i].active]) AS k FROM tracks),
ends AS (SELECT *, coalesce(list_min([i for i in range(k + 1, len(segs) + 1) if segs[i].ws]), len(segs) + 1) AS word_end, segs[k].start AS s0, segs[k].stop AS e0, greatest(segs[k].stop - segs[k].start, 0) AS size FROM picked),
sides AS (SELECT *, CASE WHEN NOT segs[k].ws THEN list_max([i for i in range(1, k) if segs[i].active OR segs[i].ws]) END AS before,
    coalesce(list_min([i for i in range(k + 1, word_end) if segs[i].active]), CASE WHEN word_end > k + 1 THEN word_end - 1 END) AS after, s0 + size * 0.5 AS middle, greatest(50, size) AS span FROM ends),
first AS (SELECT *, {_snap('middle - span * 0.5', '0', 'e0')} AS b0 FROM sides), second AS (SELECT *, {_snap('middle + span * 0.5', 'b0', '4000')} AS a0 FROM first),
room AS (SELECT *, CASE WHEN before IS NOT NULL AND segs[before].active THEN {_snap('segs[before].start + (segs[before].stop - segs[before].start) * 0.75', 'segs[before].start', 'segs[before].stop')} ELSE b0 END AS b,
    CASE WHEN after IS NOT NULL AND segs[after].active THEN {_snap('segs[after].start + (segs[after].stop - segs[after].start) / 3.0::DOUBLE', 'segs[after].start', 'segs[after].stop')} ELSE a0 END AS a FROM second)
SELECT id, before, after, x.slot AS slot, CAST(CASE WHEN i = k THEN b WHEN i >= before AND i < k AND NOT x.active THEN b WHEN i > k AND i <= after THEN a ELSE x.start END AS BIGINT) AS start,
  CAST(CASE WHEN i = k THEN a WHEN i >= before AND i < k THEN b WHEN i > k AND i <= after AND NOT x.active THEN a ELSE x.stop END AS BIGINT) AS stop, coalesce(x.active OR i = k, x.active) AS active
FROM (SELECT *, unnest(segs) AS x, unnest(range(1, len(segs) + 1)) AS i FROM room)"""


@query(_ACTIVATED)
def activated_segments(s, d):
    """Each track with its first inactive segment made active."""
    cell = F.struct("slot", "phoneme", "word_start", "start", "stop", "active")
    arrays = A.segments(s, d).groupBy("id").agg(F.array_sort(F.collect_list(cell)).alias("segments"), F.min(F.when(~F.col("active"), F.col("slot"))).alias("slot"))
    found = gaps.activated(arrays.withColumn("longest", F.lit(4000)))
    return found.select("id", "before", "after", F.explode("segments").alias("x")).select("id", "before", "after", "x.slot", "x.start", "x.stop", "x.active")
