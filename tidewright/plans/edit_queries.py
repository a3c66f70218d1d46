"""Registered queries over updates, edits and tokens, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, catalog, edits, nbest, updates
from . import adapters as A
from .align_sql import n_best_sql, rows_sql
from .queries import _TASKS, _tasks, query

_NUMBERED = f"SELECT row_number() OVER (ORDER BY line_id, audiofile) AS id, * FROM ({_TASKS})"


def _numbered(s, d):
    return updates.task_ids(_tasks(s, d), "line_id", "audiofile")


@query(f"SELECT id, line_id, audiofile, state FROM ({_NUMBERED})")
def task_ids(s, d):
    return _numbered(s, d).select("id", "line_id", "audiofile", "state")


@query(f"SELECT id, state FROM ({_NUMBERED}) WHERE state IN ('UnassignedId', 'Finished') AND id <> 3")
def selectable_tasks(s, d):
    return updates.selectable(_numbered(s, d), 3).select("id", "state")


@query(f"SELECT id, text, actor FROM ({A.LINES}) WHERE actor IS NOT NULL")
def spoken_lines(s, d):
    return updates.with_actor(A.lines(s, d)).select("id", "text", "actor")


_ERROR = "CASE WHEN id % 9 = 0 THEN 'no translation' END"


@query(f"""SELECT count(*) FILTER (WHERE actor IS NOT NULL AND e IS NULL) AS generated, count(*) FILTER (WHERE actor IS NOT NULL AND e IS NOT NULL) AS failed,
  count(*) FILTER (WHERE actor IS NULL) AS skipped FROM (SELECT actor, {_ERROR} AS e FROM ({A.LINES}))""")
def generation_counters(s, d):
    return updates.generation_counters(A.lines(s, d).select("actor", F.expr(_ERROR).alias("error")))


@query(f"SELECT DISTINCT o_orderkey AS line_id FROM orders WHERE o_orderkey IN (SELECT line_id FROM ({_TASKS}))")
def existing_ids(s, d):
    return updates.existing(A.table(s, d, "orders").select(F.col("o_orderkey").alias("line_id")).distinct(), _tasks(s, d))


@query(f"""SELECT id, CASE WHEN id % 10 = 0 THEN 'Finished' ELSE state END AS state, CASE WHEN id % 20 = 0 THEN 'new.phonemes' ELSE phonemefile END AS phonemefile FROM ({_NUMBERED})""")
def task_update(s, d):
    tasks = _numbered(s, d)
    changes = tasks.where("id % 10 = 0").select("id", F.lit("Finished").alias("state"), F.when(F.col("id") % 20 == 0, "new.phonemes").alias("phonemefile"))
    return updates.updated(tasks, changes).select("id", "state", "phonemefile")


_STATES = f"SELECT id, CASE WHEN id % 4 = 0 THEN 'Processing' ELSE state END AS state FROM ({_NUMBERED})"


@query(f"""SELECT r.id, CASE WHEN t.state IS NULL THEN 'task (' || r.id || ') not found.' WHEN t.state = 'Processing' THEN 'cannot remove task in processing state' END AS error
  FROM (SELECT id * 2 AS id FROM ({_NUMBERED})) r LEFT JOIN ({_STATES}) t ON r.id = t.id""")
def task_removal(s, d):
    tasks = _numbered(s, d).withColumn("state", F.when(F.col("id") % 4 == 0, "Processing").otherwise(F.col("state")))
    return updates.removed(tasks, tasks.select((F.col("id") * 2).alias("id")))


@query(f"SELECT id, state FROM ({_STATES}) WHERE NOT (id % 2 = 0 AND state <> 'Processing')")
def task_queue_after_removal(s, d):
    tasks = _numbered(s, d).select("id", F.when(F.col("id") % 4 == 0, "Processing").otherwise(F.col("state")).alias("state"))
    return updates.without(tasks, tasks.where("id % 2 = 0").select("id"))


@query("""SELECT row_number() OVER (ORDER BY late, pos) - 1 AS pos, action FROM (
  SELECT 1 AS late, r_regionkey AS pos, r_name AS action FROM region UNION ALL SELECT 0, n_nationkey, n_name FROM nation WHERE n_regionkey = 1)""")
def action_prepend(s, d):
    queue = A.table(s, d, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("action"))
    more = A.table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("action"))
    return updates.prepended(queue, more)


_CAP = "upper(left({0}, 1)) || lower(substr({0}, 2))"


@query(f"""WITH av AS (SELECT n_nationkey AS pos, lower(n_name) AS id, {_CAP.format('n_name')} AS caption FROM nation WHERE n_name NOT LIKE '% %'),
  a AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN lower(n_name) WHEN s_suppkey % 3 = 1 THEN n_name ELSE s_name END AS actor FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT actor, coalesce((SELECT arg_min(id, pos) FROM av WHERE av.id = actor OR av.caption = upper(left(actor, 1)) || substr(actor, 2)), (SELECT arg_min(id, pos) FROM av)) AS id FROM a""")
def actor_selection(s, d):
    nation = A.table(s, d, "nation")
    available = nation.where("n_name not like '% %'").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("id"), F.concat(F.upper(F.left("n_name", F.lit(1))), F.lower(F.substring("n_name", 2, 100))).alias("caption"))
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, F.lower("n_name")).when(k == 1, F.col("n_name")).otherwise(F.col("s_name"))
    actors = A.table(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name.alias("actor")).distinct()
    return updates.selected_actor(actors, available)


@query(f"SELECT l.doc_id AS line_id, coalesce(t.text, 'text not found') AS text FROM (SELECT doc_id + 50 AS doc_id FROM labels) l LEFT JOIN ({A.LINES}) t ON t.id = l.doc_id")
def selected_text(s, d):
    chosen = A.table(s, d, "labels").select((F.col("doc_id") + 50).alias("line_id"))
    return updates.selected_text(chosen, A.lines(s, d))


@query(f"""SELECT t.line_id, l.text, l.actor, CASE WHEN l.text IS NULL THEN 'no text for line ' || t.line_id END AS error FROM (SELECT DISTINCT line_id FROM ({_TASKS})) t LEFT JOIN ({A.LINES}) l ON l.id = t.line_id""")
def task_texts(s, d):
    return updates.with_text(_tasks(s, d).select("line_id").distinct(), A.lines(s, d)).select("line_id", "text", "actor", "error")


@query("""SELECT row_number() OVER (ORDER BY name <> '..', NOT is_dir, name) AS slot, name, is_dir FROM (
  SELECT n_name AS name, n_nationkey % 3 = 0 AS is_dir FROM nation UNION ALL SELECT '..', true)""")
def folder_listing(s, d):
    return updates.listing(A.table(s, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 == 0).alias("is_dir")))


@query(f"SELECT slot, slot || ': ' || lpad(CAST(line_id AS VARCHAR), 10, '0') || ' ' || state || ' ' || audiofile AS caption FROM (SELECT row_number() OVER (ORDER BY line_id, audiofile) AS slot, * FROM ({_TASKS}))")
def queue_captions(s, d):
    return catalog.captions(_tasks(s, d)).select(F.col("slot").cast("bigint").alias("slot"), "caption")


# --- timing edits ------------------------------------------------------------------------------

_SNAP = "round(({0}) / 5.0) * 5"


@query(f"""SELECT id, slot, CAST(a AS BIGINT) AS start, CAST(CASE WHEN t < a THEN a WHEN t > 5000 THEN 5000 ELSE t END AS BIGINT) AS stop FROM (
  SELECT *, CASE WHEN x < 0 THEN 0 WHEN x > stop THEN stop ELSE x END AS a FROM (
    SELECT id, slot, stop, {_SNAP.format('start + 37')} AS x, {_SNAP.format('stop - 22')} AS t FROM ({A.SEGMENTS})))""")
def set_position(s, d):
    start, stop = edits.set_position(F.col("start"), F.col("stop"), F.col("start") + 37, F.col("stop") - 22, F.lit(5000))
    return A.segments(s, d).select("id", "slot", start.alias("start"), stop.alias("stop"))


@query(f"SELECT id, slot, active <> (slot = 2) AS active, CASE WHEN slot <= 2 THEN 0.5 + slot ELSE 1.0 END AS weight FROM ({A.SEGMENTS})")
def slot_edit(s, d):
    rows = A.segments(s, d)
    changes = rows.where("slot <= 2").select("id", "slot", (F.col("slot") + 0.5).cast("double").alias("weight"), (F.col("slot") == 2).alias("toggle"))
    return edits.edited_slot(rows, changes).select("id", "slot", "active", F.col("weight").cast("double").alias("weight"))


@query(f"""SELECT id, slot, coalesce(active AND before < start, false) AS broken FROM (
  SELECT *, last_value(CASE WHEN active THEN stop END IGNORE NULLS) OVER (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({A.SEGMENTS}))""")
def link_breaks(s, d):
    return edits.link_breaks(A.segments(s, d)).select("id", "slot", "broken")


_POINTS = f"""SELECT *, CASE WHEN start < ref THEN (start - lo) / nullif(ref - lo, 0) WHEN start > ref THEN (hi - start) / nullif(hi - ref, 0) ELSE 1.0 END AS ws,
    CASE WHEN stop < ref THEN (stop - lo) / nullif(ref - lo, 0) WHEN stop > ref THEN (hi - stop) / nullif(hi - ref, 0) ELSE 1.0 END AS we
  FROM (SELECT id, slot, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS stop, min(start) OVER (PARTITION BY id) AS lo, max(stop) OVER (PARTITION BY id) AS hi, CAST(id % 400 AS DOUBLE) AS ref FROM ({A.SEGMENTS}))"""


def _points(s, d):
    return edits.drag_points(A.segments(s, d).select("id", "slot", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")), (F.col("id") % 400).cast("double"))


@query(f"SELECT id, slot, round(ws, 6) AS weight_start, round(we, 6) AS weight_stop FROM ({_POINTS})")
def drag_weights(s, d):
    return _points(s, d).select("id", "slot", F.round("weight_start", 6).alias("weight_start"), F.round("weight_stop", 6).alias("weight_stop"))


_MOVED = f"SELECT id, slot, least(greatest({_SNAP.format('trunc(start + 40 * ws)')}, 0), 3000) AS a, least(greatest({_SNAP.format('trunc(stop + 40 * we)')}, 0), 3000) AS b FROM ({_POINTS})"


@query(f"""SELECT id, slot, CAST(greatest(a, coalesce(max(greatest(a, b)) OVER (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS BIGINT) AS start,
  CAST(max(greatest(a, b)) OVER (PARTITION BY id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM ({_MOVED})""")
def drag_update(s, d):
    return edits.dragged(_points(s, d), F.lit(40), F.lit(0), F.lit(3000))


@query(f"SELECT id, slot, CASE WHEN p < 0.3 THEN 'left' WHEN p > 0.7 THEN 'right' ELSE 'none' END AS side FROM (SELECT id, slot, (id * 7 + slot) % 11 / 10.0 AS p FROM ({A.SEGMENTS}))")
def drag_zone(s, d):
    return A.segments(s, d).select("id", "slot", edits.drag_side((F.col("id") * 7 + F.col("slot")) % 11 / 10).alias("side"))


@query(f"""SELECT a.id, a.slot, a.phoneme, b.phoneme AS other FROM ({A.SEGMENTS}) a JOIN (SELECT id - 1 AS id, slot, phoneme FROM ({A.SEGMENTS})) b ON a.id = b.id AND a.slot = b.slot""")
def positional_zip(s, d):
    rows = A.segments(s, d).select("id", "slot", "phoneme")
    return edits.zipped(rows, rows.select((F.col("id") - 1).alias("id"), "slot", F.col("phoneme").alias("other")))


@query(f"""SELECT id, slot, least(a, 2000) AS first, CASE WHEN start >= stop THEN least(a, 2000) ELSE stop END AS after_first,
  CASE WHEN start < least(a, 2000) THEN least(a, 2000) ELSE start END AS after_last, CASE WHEN start < stop THEN stop ELSE 2000 END AS plays_to FROM (SELECT id, slot, start, stop, id * 3 % 2500 AS a FROM ({A.SEGMENTS}))""")
def playback_markers(s, d):
    wanted, samples, start, stop = F.col("id") * 3 % 2500, F.lit(2000), F.col("start"), F.col("stop")
    first, after = edits.playback_start(start, stop, wanted, samples)
    return A.segments(s, d).select("id", "slot", first.cast("bigint").alias("first"), after.alias("after_first"), edits.playback_end(start, wanted, samples).alias("after_last"), edits.playback_range_end(start, stop, samples).alias("plays_to"))


@query(f"""SELECT id, slot, CASE WHEN phoneme = '_' AND active THEN 1.0 WHEN phoneme = '_' THEN 1.0 ELSE 1.0 END AS red, CASE WHEN phoneme = '_' THEN 0.35 ELSE 1.0 END AS green,
  CASE WHEN phoneme = '_' THEN CASE WHEN slot = 1 THEN 1.0 ELSE 0.35 END ELSE CASE WHEN slot = 1 THEN 0.0 ELSE 1.0 END END AS blue FROM ({A.SEGMENTS})""")
def row_colours(s, d):
    rgb = edits.row_colour(F.col("phoneme") == "_", F.col("slot") == 1)
    return A.segments(s, d).select("id", "slot", *(rgb[k].alias(n) for k, n in enumerate(("red", "green", "blue"))))


# --- tokens ------------------------------------------------------------------------------------

_RAW = "replace(replace(replace(p_name, 'a', 'ˈa'), 'o', 'oː'), 'e', '_')"


def _raw(s, d):
    raw = F.replace(F.replace(F.replace(F.col("p_name"), F.lit("a"), F.lit("ˈa")), F.lit("o"), F.lit("oː")), F.lit("e"), F.lit("_"))
    return A.table(s, d, "part").select("p_partkey", "p_name", raw.alias("raw"))


@query(f"SELECT p_partkey, trim(replace(regexp_replace(w, '([^ˈ\"ˌ])', '\\1_', 'g'), '_ː', 'ː'), '_') AS token FROM (SELECT p_partkey, split_part({_RAW}, ' ', 1) AS w FROM part)")
def replacement_tokens(s, d):
    return _raw(s, d).select("p_partkey", T.replacement_token(F.substring_index("raw", " ", 1)).alias("token"))


@query(f"""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) AS pos, phoneme, row_number() OVER (PARTITION BY p_partkey, i ORDER BY j) = 1 AS word_start FROM (
  SELECT p_partkey, i, unnest(string_split(w, '_')) AS phoneme, generate_subscripts(string_split(w, '_'), 1) AS j FROM (
    SELECT p_partkey, unnest(string_split({_RAW}, ' ')) AS w, generate_subscripts(string_split({_RAW}, ' '), 1) AS i FROM part)) WHERE phoneme <> ''""")
def phoneme_tokens(s, d):
    rows = _raw(s, d).select("p_partkey", F.posexplode(T.phoneme_tokens(F.col("raw"))).alias("k", "t"))
    return rows.select("p_partkey", (F.col("k") + 1).cast("bigint").alias("pos"), "t.phoneme", "t.word_start")


@query(f"SELECT p_partkey, len(string_split(replace({_RAW}, '_', ' '), ' ')) AS n FROM part")
def phoneme_counts(s, d):
    return _raw(s, d).select("p_partkey", T.phoneme_count(F.col("raw")).alias("n"))


_LETTERS = "list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1])"


@query(f"SELECT c_custkey, array_to_string({_LETTERS}, ' ') AS letters FROM (SELECT c_custkey, string_split(replace(replace(c_name, '#', ''''), 'u', 'uu'), '') AS raw, string_split(replace(replace(replace(c_name, '#', ''''), 'u', 'uu'), '''', ''), '') AS l FROM customer)")
def spelled_letters(s, d):
    word = F.replace(F.replace("c_name", F.lit("#"), F.lit("'")), F.lit("u"), F.lit("uu"))
    return A.table(s, d, "customer").select("c_custkey", F.array_join(T.letters_to_say(word), " ").alias("letters"))


@query("""SELECT event_id, round(greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))), 6) AS log_sum, round(a + b, 6) AS log_product, round(a / ln(1.0001), 3) AS in_base
  FROM (SELECT event_id, ln(1 + value) AS a, ln(1 + user_id) AS b FROM events)""")
def log_domain(s, d):
    a, b = F.log(1 + F.col("value")), F.log(1 + F.col("user_id").cast("double"))
    return A.table(s, d, "events").select("event_id", F.round(T.log_add(a, b), 6).alias("log_sum"), F.round(T.log_multiply(a, b), 6).alias("log_product"), F.round(T.log_to_base(a, 1.0001), 3).alias("in_base"))


@query(f"SELECT count(*) FILTER (WHERE score <> -1.0) AS explicit_scores, count(*) AS cells FROM ({A.MATRIX})")
def explicit_scores(s, d):
    return A.matrix(s, d).agg(F.count_if(F.col("score") != -1.0).alias("explicit_scores"), F.count("*").alias("cells"))


_LABELED = f"SELECT id, slot, ['click', 'view', 'purchase', 'signup', 'error'][slot % 5 + 1] AS phoneme, word_start, start, stop FROM ({A.SEGMENTS})"


_TRACKS = (
    f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY slot) AS a, phoneme, start, stop FROM ({_LABELED})",
    f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY slot) AS t, phoneme, word_start, 1.0 AS weight FROM ({_LABELED}) WHERE slot % 3 <> 0",
    A.SIM_SQL,
)


def _pairs(s, d):
    """Each track with its segments heard in order, every third one not written."""
    label = F.element_at(F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error"))), (F.col("slot") % 5 + 1).cast("int"))
    rows = A.segments(s, d).select("id", "slot", label.alias("label"), "word_start", "start", "stop")
    heard = F.array_sort(F.collect_list(F.struct("slot", "label", "start", "stop")))
    said = F.array_sort(F.collect_list(F.when(F.col("slot") % 3 != 0, F.struct("slot", "label", "word_start"))))
    audio = F.transform(heard, lambda x: F.struct(x["label"].alias("phoneme"), x["start"].alias("start"), x["stop"].alias("stop")))
    text = F.transform(said, lambda x: F.struct(x["label"].alias("phoneme"), x["word_start"].alias("word_start"), F.lit(1.0).alias("weight")))
    return rows.groupBy("id").agg(audio.alias("audio"), text.alias("text"))


@query(rows_sql(*_TRACKS))
def aligned_rows(s, d):
    found = align.align_tracks(_pairs(s, d), A.SIM)
    return found.select("id", F.posexplode("rows").alias("pos", "r")).select("id", "pos", "r.phoneme", "r.word_start", "r.start", "r.stop", "r.score", "r.active", "r.op", "r.source")


@query(n_best_sql(*_TRACKS, 3))
def n_best_alignments(s, d):
    found = nbest.n_best_tracks(_pairs(s, d), A.SIM, 3)
    return found.select("id", "rank", "total", F.array_join("ops", " ").alias("ops"))
