"""The registered queries over the canonical tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, catalog, gaps, graph, lookup, resample, timeline, tracks
from . import adapters as A
from .align_sql import summary_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- lines and files ---------------------------------------------------------------------------


@query(f"SELECT l.id, l.text, l.actor FROM ({A.LINES}) l WHERE NOT EXISTS (SELECT 1 FROM labels a WHERE a.doc_id = l.id)")
def missing_lines(s, d):
    return catalog.missing_lines(A.lines(s, d), A.audio(s, d))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing,
  round(100.0 * count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) / count(*), 4) AS percent FROM documents""")
def missing_ratio(s, d):
    return catalog.missing_ratio(A.lines(s, d), A.audio(s, d))


@query(f"SELECT name, kind, CASE WHEN kind <> 'unlinked' THEN id END AS id, CASE WHEN kind = 'audio' THEN secs END AS seconds FROM ({A.FILES}) WHERE kind IS NOT NULL")
def file_catalog(s, d):
    return catalog.catalogue(A.names(s, d)).select("name", "kind", "id", F.col("duration").cast("double").alias("seconds"))


_TASKS = f"""SELECT a.id AS line_id, a.name AS audiofile, p.name AS phonemefile, CASE WHEN p.name IS NOT NULL AND a.secs THEN 'Finished' ELSE 'Waiting' END AS state,
    NOT a.secs AS renaming_required
  FROM (SELECT id, min(name) AS name, arg_min(secs IS NOT NULL, name) AS secs FROM ({A.FILES}) WHERE kind = 'audio' GROUP BY id) a
  LEFT JOIN (SELECT id, min(name) AS name FROM ({A.FILES}) WHERE kind = 'phonemes' GROUP BY id) p ON a.id = p.id
  UNION ALL SELECT 0, name, NULL, 'UnassignedId', true FROM ({A.FILES}) WHERE kind = 'unlinked'"""


def _tasks(s, d):
    return catalog.task_queue(catalog.catalogue(A.names(s, d)))


@query(_TASKS)
def task_queue(s, d):
    return _tasks(s, d)


@query(f"""SELECT *, waiting || ' waiting, ' || processing || ' processing, ' || done || ' done, ' || errors || ' errors of ' || total AS caption FROM (
  SELECT count(*) FILTER (WHERE state IN ('Waiting', 'UnassignedId')) AS waiting, count(*) FILTER (WHERE state = 'Processing') AS processing,
    count(*) FILTER (WHERE state = 'Finished') AS done, count(*) FILTER (WHERE state = 'Error') AS errors, count(*) AS total FROM ({_TASKS}))""")
def queue_stats(s, d):
    return catalog.queue_stats(_tasks(s, d))


@query(f"SELECT * FROM ({_TASKS}) WHERE state = 'Waiting' ORDER BY line_id, audiofile LIMIT 1")
def next_waiting(s, d):
    return catalog.next_waiting(_tasks(s, d))


@query(f"""SELECT line_id, audiofile, CASE WHEN kept THEN state ELSE 'Waiting' END AS state, CASE WHEN kept THEN renaming_required ELSE true END AS renaming_required,
  NOT kept AS full_rename FROM (SELECT *, state IN ('Processing', 'UnassignedId', 'Error') AS kept FROM ({_TASKS}))""")
def queue_reset(s, d):
    from ..streaming.tasks import reset_all

    return reset_all(_tasks(s, d)).select("line_id", "audiofile", "state", "renaming_required", "full_rename")


_ESCAPE = "left(regexp_replace({}, '[/?%*:|<>\".$…, ]', '_', 'g'), 50)"


@query(f"""SELECT t.audiofile, lpad(CAST(t.line_id AS VARCHAR), 10, '0') || coalesce('[' || printf('%.4f', f.secs) || ']', '') || coalesce({_ESCAPE.format("'-' || l.actor || '-'")}, '') || {_ESCAPE.format('l.text')} || '.' || regexp_extract(t.audiofile, '[^.]*$') AS new_name
  FROM ({_TASKS}) t JOIN ({A.LINES}) l ON l.id = t.line_id JOIN ({A.FILES}) f ON f.name = t.audiofile WHERE t.line_id > 0""")
def rename_projection(s, d):
    return catalog.rename_plan(_tasks(s, d), A.lines(s, d))


@query(f"SELECT name, count(*) AS n FROM ({A.NAMES}) GROUP BY name HAVING count(*) > 1")
def duplicate_keys(s, d):
    return catalog.duplicates(A.names(s, d), ["name"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def keep_first(s, d):
    return catalog.keep_first(A.table(s, d, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def keep_last(s, d):
    return catalog.keep_last(A.table(s, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id AS id, text FROM documents WHERE contains(lower(text), 'the')")
def line_search(s, d):
    return catalog.search(A.lines(s, d), "The")


@query("SELECT doc_id AS id, text FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 101")
def line_search_capped(s, d):
    return catalog.search(A.lines(s, d), "The", 100)


@query("SELECT count(*) AS hits, count(*) > 101 AS capped FROM documents WHERE contains(lower(text), 'the')")
def line_search_state(s, d):
    return catalog.is_capped(A.lines(s, d), "the", 100)


# --- text functions ----------------------------------------------------------------------------


@query("SELECT doc_id, translate(lower(text), '.,%*#$&!|', '         ') AS clean FROM documents")
def clean_text(s, d):
    return A.table(s, d, "documents").select("doc_id", T.clean_text(F.col("text"), ".,%*#$&!|").alias("clean"))


@query("SELECT doc_id, regexp_replace(text, '\\*[^*]+\\*', '', 'g') AS plain FROM documents")
def hints_stripped(s, d):
    return A.table(s, d, "documents").select("doc_id", T.strip_hints(F.col("text")).alias("plain"))


@query("SELECT doc_id, len([w for w in string_split(text, ' ') if w <> '']) AS n_tokens FROM documents")
def token_lists(s, d):
    return A.table(s, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query()
def consecutive_dedup(s, d):
    return A.table(s, d, "conversations").select("conv_id", "turn", T.consecutive_dedup(F.col("text")).alias("squeezed"))


@query("SELECT c_custkey, list_aggregate([upper(left(w, 1)) || substr(w, 2) for w in string_split(trim(lower(c_mktsegment) || ' of ' || c_name), ' ')], 'string_agg', ' ') AS caption FROM customer")
def capitalize_actor(s, d):
    return A.table(s, d, "customer").select("c_custkey", T.capitalize(F.concat(F.lower("c_mktsegment"), F.lit(" of "), F.col("c_name"))).alias("caption"))


@query("SELECT p_partkey, nullif(upper(trim(regexp_replace(replace(p_name, ' ', '_'), '(_[^_]*){1,2}$', ''))), '') AS actor FROM part")
def voiceover_actor(s, d):
    return A.table(s, d, "part").select("p_partkey", T.voiceover_actor(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("actor"))


@query(f"SELECT doc_id, {_ESCAPE.format('text')} AS part, CASE WHEN octet_length(encode(text)) > 70 THEN left(text, 70) || '...' ELSE text END AS short FROM documents")
def name_parts(s, d):
    return A.table(s, d, "documents").select("doc_id", T.escape_textline(F.col("text")).alias("part"), T.ellipsis(F.col("text")).alias("short"))


# --- lookups -----------------------------------------------------------------------------------


def _general(s, d):
    return A.table(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("id"), F.concat(F.lit("caption "), (F.col("n_nationkey") % 10).cast("string")).alias("caption"))


@query("""WITH g AS (SELECT n_nationkey AS pos, lower(n_name) AS id, 'caption ' || (n_nationkey % 10) AS caption FROM nation),
  o AS (SELECT 'nation_' || (3 * r_regionkey) AS actor, lower(r_name) AS mapped FROM region),
  a AS (SELECT DISTINCT CASE c_nationkey % 3 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'Caption ' || (c_nationkey % 12) ELSE 'Else ' || c_nationkey END AS actor FROM customer)
  SELECT actor, coalesce((SELECT mapped FROM o WHERE o.actor = lower(a.actor)), (SELECT arg_min(g.id, g.pos) FROM g WHERE g.caption = lower(a.actor) OR g.id = lower(a.actor)), actor) AS resolved FROM a""")
def actor_resolve(s, d):
    key = F.col("c_nationkey")
    actor = F.when(key % 3 == 0, F.concat(F.lit("NATION_"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("Caption "), (key % 12).cast("string"))).otherwise(F.concat(F.lit("Else "), key.cast("string")))
    overrides = A.table(s, d, "region").select(F.concat(F.lit("nation_"), (F.col("r_regionkey") * 3).cast("string")).alias("actor"), F.lower("r_name").alias("mapped"))
    return lookup.resolve_actors(A.table(s, d, "customer").select(actor.alias("actor")).distinct(), _general(s, d), overrides)


@query(f"""SELECT e.event_id, CASE WHEN e.audio_ph = 'sil' THEN CAST(-2.1 AS DOUBLE) ELSE coalesce(v.score, -1.0) END AS score FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'SIL' ELSE upper(event_type) END AS shown,
   CASE WHEN event_id % 17 = 0 THEN 'sil' ELSE event_type END AS audio_ph, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'view' END AS text_ph FROM events) e LEFT JOIN ({A.SIM_SQL}) v ON v.audio_ph = e.audio_ph AND v.text_ph = e.text_ph""")
def sim_lookup(s, d):
    key = F.col("event_id")
    pairs = A.table(s, d, "events").select("event_id", F.when(key % 17 == 0, "SIL").otherwise(F.upper("event_type")).alias("audio_ph"), F.when(key % 5 == 0, "other").otherwise("View").alias("text_ph"))
    return lookup.similarity(pairs, A.sim(s)).select("event_id", "score")


@query(f"""SELECT text_ph, CASE WHEN count(n) = 0 THEN '' WHEN count(n) = 1 THEN max(audio_ph) FILTER (WHERE n IS NOT NULL) ELSE '(' || string_agg(audio_ph, '|' ORDER BY n) FILTER (WHERE n IS NOT NULL) || ')' END AS alternatives
  FROM (SELECT text_ph, audio_ph, CASE WHEN score >= 0.1 THEN row_number() OVER (PARTITION BY text_ph ORDER BY score DESC, col_pos) END AS n FROM ({A.MATRIX})) GROUP BY text_ph""")
def alternatives_topk(s, d):
    return lookup.alternatives(A.matrix(s, d))


_PHONES = [("en", "EH N"), ("fr", "EH F"), ("de", "D EH"), ("src0", "S0"), ("src1", "S1"), ("src2", "S2"), ("src3", "")]


@query("WITH m(label, phone) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PHONES) + """) SELECT doc_id AS word, CASE WHEN a.phone IS NOT NULL AND b.phone IS NOT NULL THEN a.phone || ' ' || b.phone END AS phones
  FROM documents LEFT JOIN m a ON a.label = lang LEFT JOIN m b ON b.label = source""")
def phonetize_all_or_nothing(s, d):
    mapping = s.createDataFrame(_PHONES, "label string, phone string")
    return lookup.phonetize(A.table(s, d, "documents").select(F.col("doc_id").alias("word"), F.array("lang", "source").alias("labels")), mapping)


_KINDS = ["click", "view", "purchase", "signup", "error"]


@query("SELECT text_ph, " + ", ".join(f"max(score) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS) + f" FROM ({A.MATRIX}) GROUP BY text_ph")
def sim_pivot(s, d):
    return A.matrix(s, d).groupBy("text_ph").pivot("kind", _KINDS).agg(F.max("score"))


# --- tracks ------------------------------------------------------------------------------------

_WORDS = f"SELECT *, CAST(sum(CAST(word_start AS INTEGER)) OVER (PARTITION BY id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS word_no FROM ({A.SEGMENTS})"
_SLOTS = f"""SELECT *, CAST(count(*) FILTER (WHERE phoneme <> '_') OVER (PARTITION BY id, word_no ORDER BY slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS word_slot,
  CAST(count(*) FILTER (WHERE phoneme <> '_') OVER (PARTITION BY id, word_no) AS BIGINT) AS word_size FROM ({_WORDS})"""
_FOUND = f"""SELECT *, active AND start > pos AS gap_in_word, active AND NOT (greatest(stop - start, 0) BETWEEN 15 AND 500) AS unusual, active AND score < 0.15 AS low,
    NOT active AND phoneme <> '_' AS inactive_real, NOT active AND phoneme <> '_' AND word_slot > 1 AND word_slot < word_size AS inner_
  FROM (SELECT *, CASE WHEN word_start THEN start ELSE coalesce(last_value(CASE WHEN active THEN stop END IGNORE NULLS) OVER (PARTITION BY id, word_no ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      CASE WHEN bool_or(word_start) OVER (PARTITION BY id, word_no) THEN first_value(start) OVER (PARTITION BY id, word_no ORDER BY slot) END, 0) END AS pos FROM ({_SLOTS}))"""


@query(f"SELECT id, slot, word_no, word_slot, word_size FROM ({_SLOTS})")
def word_slots(s, d):
    return tracks.with_word_slots(A.segments(s, d)).select("id", "slot", "word_no", "word_slot", "word_size")


@query(f"""SELECT id, word_no, min(slot) AS first_slot, max(slot) AS last_slot, min(slot) FILTER (WHERE active) AS first_active, max(slot) FILTER (WHERE active) AS last_active,
  min(start) AS word_start_ms, max(stop) AS word_stop_ms FROM ({_WORDS}) GROUP BY id, word_no""")
def word_bounds(s, d):
    return tracks.word_bounds(A.segments(s, d))


@query(f"SELECT id, slot, gap_in_word, unusual, low, inactive_real, inner_ AS inside FROM ({_FOUND})")
def segment_findings(s, d):
    return tracks.with_findings(A.segments(s, d)).select("id", "slot", "gap_in_word", "unusual", "low", "inactive_real", F.col("inner").alias("inside"))


@query(f"""SELECT id, slot, concat_ws('; ', CASE WHEN unusual THEN 'suspicious duration: ' || ms || 'ms' END, CASE WHEN gap_in_word THEN 'phoneme gap within a word?' END,
    CASE WHEN inactive_real THEN 'inactive phoneme within a word' END, CASE WHEN many THEN 'low confidence-score: ' || printf('%.2f', score) END) AS short,
  concat_ws('; ', CASE WHEN unusual THEN 'unusually short/long segment duration ' || ms || ' ms for a phoneme within a word' END, CASE WHEN gap_in_word THEN 'detected possible phoneme gap within a word' END,
    CASE WHEN inactive_real THEN 'inactive segments within a word (found ' || n_inactive || ')' END, CASE WHEN many THEN '> 20% of active segments have low confidence-score (found ' || percent || '%, see phoneme data table)' END) AS long
FROM (SELECT *, low AND percent > 20 AS many FROM (SELECT *, greatest(stop - start, 0) AS ms, count(*) FILTER (WHERE inactive_real) OVER (PARTITION BY id, word_no) AS n_inactive,
  CAST(round(count(*) FILTER (WHERE low) OVER (PARTITION BY id) * 100.0 / nullif(count(*) FILTER (WHERE active) OVER (PARTITION BY id), 0)) AS BIGINT) AS percent FROM ({_FOUND})))""")
def segment_warnings(s, d):
    found = tracks.with_warnings(A.segments(s, d))
    return found.select("id", "slot", F.array_join("short", "; ").alias("short"), F.array_join("long", "; ").alias("long"))


@query(f"""SELECT id, n_segments, n_active, n_gaps, n_unusual, n_inactive, low_percent, CASE WHEN version <= 1 THEN CASE severity WHEN 2 THEN 'NeedsCheckError' WHEN 1 THEN 'NeedsCheckWarn' ELSE 'Ok' END WHEN severity = 0 THEN 'EditedOk' ELSE 'EditedWithErrors' END AS quality
  FROM (SELECT *, CASE WHEN n_gaps > 0 OR n_inner > 0 THEN 2 WHEN n_unusual > 0 OR n_inactive > 0 OR low_percent > 20 THEN 1 ELSE 0 END AS severity
  FROM (SELECT id, max(version) AS version, count(*) AS n_segments, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE gap_in_word) AS n_gaps, count(*) FILTER (WHERE unusual) AS n_unusual,
    count(*) FILTER (WHERE inactive_real) AS n_inactive, count(*) FILTER (WHERE inner_) AS n_inner,
    CAST(CASE WHEN count(*) FILTER (WHERE active) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE low) * 100.0 / count(*) FILTER (WHERE active)) END AS BIGINT) AS low_percent FROM ({_FOUND}) GROUP BY id))""")
def track_quality(s, d):
    return tracks.track_quality(A.segments(s, d))


@query(f"""SELECT id, slot, gap_before, coalesce(lead(gap_before) OVER (PARTITION BY id ORDER BY slot), false) AS gap_follows, coalesce(lead(word_start) OVER (PARTITION BY id ORDER BY slot), true) AS ends_word
  FROM (SELECT *, coalesce(start > lag(stop) OVER (PARTITION BY id ORDER BY slot), false) AS gap_before FROM ({A.SEGMENTS}))""")
def gap_flags(s, d):
    return tracks.with_gap_flags(A.segments(s, d)).select("id", "slot", "gap_before", "gap_follows", "ends_word")


@query(f"""SELECT id, slot, last_value(CASE WHEN active THEN slot END IGNORE NULLS) OVER (PARTITION BY id, word_no ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active_before,
  first_value(CASE WHEN active THEN slot END IGNORE NULLS) OVER (PARTITION BY id, word_no ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS active_after FROM ({_WORDS})""")
def active_neighbours(s, d):
    return tracks.with_active_neighbours(A.segments(s, d)).select("id", "slot", "active_before", "active_after")


@query(f"""WITH k AS (SELECT * FROM (SELECT *, coalesce(max(start) OVER (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS high
    FROM (SELECT id, slot, CASE WHEN label IN ('<s>', '<sil>', '</s>', '(NULL)', 'SIL') THEN 'SIL' ELSE label END AS phoneme, first_frame * 10 AS start, last_frame * 10 AS stop FROM ({A.FRAMES})) WHERE NOT (phoneme = 'SIL' AND start = stop)) WHERE start > high),
  n AS (SELECT *, count(*) OVER (PARTITION BY id) > 2 AS many, lag(phoneme) OVER (PARTITION BY id ORDER BY slot) AS b, lead(phoneme) OVER (PARTITION BY id ORDER BY slot) AS a FROM k)
  SELECT id, slot, phoneme, CASE WHEN many AND b <> 'SIL' AND phoneme <> 'SIL' THEN start - 5 ELSE start END AS start, CASE WHEN many AND a <> 'SIL' THEN stop + 5 ELSE stop END AS stop FROM n""")
def recognizer_cleanup(s, d):
    return tracks.clean_recognised(A.frames(s, d))


def _raw(s, d):
    order = Window.partitionBy("l_orderkey", "word_no").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = A.table(s, d, "lineitem").withColumn("word_no", F.col("l_linenumber").cast("bigint"))
    raw = F.concat(F.when(F.col("l_partkey") % 4 == 0, "ˈ").otherwise(""), F.col("l_returnflag"), F.when(F.col("l_suppkey") % 3 == 0, "ː").otherwise(""))
    return rows.select(F.col("l_orderkey").alias("id"), "word_no", (F.row_number().over(order) - 1).cast("bigint").alias("i"), raw.alias("raw"))


_RAW = """SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS word_no, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i,
  CASE WHEN l_partkey % 4 = 0 THEN 'ˈ' ELSE '' END || l_returnflag || CASE WHEN l_suppkey % 3 = 0 THEN 'ː' ELSE '' END AS raw FROM lineitem"""


@query(f"""SELECT id, word_no, i, translate(raw, '"ˌˈ', '') AS phoneme, i = 0 AS word_start, stop - duration AS start, stop, CASE WHEN contains(raw, 'ˈ') THEN CAST(1.1 AS DOUBLE) ELSE 1.0 END AS weight
  FROM (SELECT *, CAST(sum(duration) OVER (PARTITION BY id ORDER BY word_no, i ROWS UNBOUNDED PRECEDING) + word_no * unit + greatest(75, 1000 - n * unit) AS BIGINT) AS stop
  FROM (SELECT *, CASE WHEN contains(raw, 'ː') THEN unit * 2 ELSE unit END AS duration FROM (SELECT *, CASE WHEN n <= 20 THEN 100 WHEN n <= 50 THEN 80 WHEN n <= 75 THEN 75 ELSE 73 END AS unit
  FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({_RAW})))))""")
def generated_timings(s, d):
    return tracks.generated_timings(_raw(s, d))


@query(f"SELECT id, slot, phoneme, start, stop FROM ({A.SEGMENTS}) WHERE active AND start < 1200 AND stop > 400")
def visible_segments(s, d):
    return tracks.visible(A.segments(s, d), 400, 1200).select("id", "slot", "phoneme", "start", "stop")


@query(f"SELECT id, slot, phoneme, start, stop FROM ({A.SEGMENTS}) WHERE 1200 >= start AND stop >= 400")
def marked_segments(s, d):
    return tracks.marked(A.segments(s, d), 400, 1200).select("id", "slot", "phoneme", "start", "stop")


@query(f"SELECT id, slot, CAST(CASE WHEN t < 100 THEN 100 WHEN t > 2000 THEN 2000 ELSE t END AS BIGINT) AS snapped FROM (SELECT id, slot, round((start + stop) / 2.0 / 5) * 5 AS t FROM ({A.SEGMENTS}))")
def snap_5ms(s, d):
    return A.segments(s, d).select("id", "slot", T.snap_ms((F.col("start") + F.col("stop")) / 2, 5, F.lit(100), F.lit(2000)).alias("snapped"))


@query(f"""SELECT id, slot, CASE WHEN slot % 6 = 0 THEN 'removed' ELSE 'changed' END AS change FROM ({A.SEGMENTS}) WHERE slot % 6 = 0 OR id % 10 = 0 OR (phoneme = '_' AND NOT active)""")
def change_detection(s, d):
    old = A.segments(s, d)
    new = old.where("slot % 6 <> 0").withColumns({"stop": F.when(F.col("id") % 10 == 0, F.col("stop") + 5).otherwise(F.col("stop")), "active": F.col("active") | (F.col("phoneme") == "_")})
    return tracks.changed(old, new)


#: Tracks as lists; each step takes the next open segment off todo and collapses it between its neighbours.
_CLOSED = f"""WITH RECURSIVE tracks AS (
  SELECT id, list({{'slot': slot, 'phoneme': phoneme, 'ws': word_start, 'start': start, 'stop': stop, 'active': active}} ORDER BY slot) AS raw FROM ({A.SEGMENTS}) GROUP BY id
), folds(id, closed, todo, segs) AS (
  SELECT id, len(list_filter(raw, lambda x: NOT x.active AND x.phoneme = '_')), [i for i in range(1, len(raw) + 1) if NOT raw[i].active AND raw[i].phoneme = '_'],
    list_transform(raw, lambda x: {{'slot': x.slot, 'phoneme': x.phoneme, 'ws': x.ws, 'start': x.start, 'stop': x.stop, 'active': x.active OR x.phoneme = '_'}}) FROM tracks
  UNION ALL
  SELECT id, closed, todo[2:], list_transform(segs, lambda x, i: {{'slot': x.slot, 'phoneme': x.phoneme, 'ws': x.ws, 'active': x.active AND i <> k,
      'start': CASE WHEN i = k OR (i > k AND i <= after) OR (i >= before AND i < k AND NOT x.active) THEN place ELSE x.start END,
      'stop': CASE WHEN i = k OR (i >= before AND i < k) OR (i > k AND i <= after AND NOT x.active) THEN place ELSE x.stop END}})
  FROM (SELECT *, CASE WHEN coalesce(segs[before].active, false) = coalesce(segs[after].active, false) THEN segs[k].start + greatest(segs[k].stop - segs[k].start, 0) // 2
      WHEN coalesce(segs[before].active, false) THEN segs[k].stop ELSE segs[k].start END AS place
    FROM (SELECT *, CASE WHEN NOT segs[k].ws THEN list_max([i for i in range(1, k) if segs[i].active OR segs[i].ws]) END AS before,
        coalesce(list_min([i for i in range(k + 1, word_end) if segs[i].active]), CASE WHEN word_end > k + 1 THEN word_end - 1 END) AS after
      FROM (SELECT *, coalesce(list_min([i for i in range(k + 1, len(segs) + 1) if segs[i].ws]), len(segs) + 1) AS word_end FROM (SELECT *, todo[1] AS k FROM folds WHERE len(todo) > 0))))
) SELECT id, closed, x.slot AS slot, x.phoneme AS phoneme, x.start AS start, x.stop AS stop, x.active AS active
FROM (SELECT id, closed, unnest(segs) AS x FROM folds WHERE len(todo) = 0)"""


@query(_CLOSED)
def close_gaps(s, d):
    rows = A.segments(s, d)
    cell = F.struct("slot", "phoneme", "word_start", "start", "stop", "active")
    arrays = rows.groupBy("id").agg(F.array_sort(F.collect_list(cell)).alias("segments"))
    return gaps.close_gaps(arrays).select("id", "closed", F.explode("segments").alias("x")).select("id", "closed", "x.slot", "x.phoneme", "x.start", "x.stop", "x.active")


_HOURS = "SELECT user_id * 1000000 + (epoch_us(ts) // 1000 // 3600000) % 1000000 AS id, event_id, event_type, value, epoch_us(ts) // 1000 % 3600000 AS ms FROM events"
_HEARD = f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY ms, event_id) AS a, event_type AS phoneme, ms AS start, CAST(ms + round(value * 10) AS BIGINT) AS stop FROM ({_HOURS}) WHERE event_id % 4 <> 0"
_SAID = f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY event_id) AS t, event_type AS phoneme, event_type = 'purchase' AS word_start, 1.0 AS weight FROM ({_HOURS})"


@query(summary_sql(f"SELECT DISTINCT id FROM ({_HOURS})", _HEARD, _SAID, A.SIM_SQL))
def align_tracks(s, d):
    """Events of each user in hours: the even ones heard, all of them written."""
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    rows = A.table(s, d, "events").select((F.col("user_id") * 1_000_000 + F.floor(ms / 3_600_000) % 1_000_000).alias("id"), "event_id", "event_type", "value", F.floor(ms % 3_600_000).cast("bigint").alias("at"))
    heard = F.array_sort(F.collect_list(F.when(F.col("event_id") % 4 != 0, F.struct("at", "event_id", "event_type", "value"))))
    said = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    both = rows.groupBy("id").agg(heard.alias("h"), said.alias("w"))
    audio = F.transform("h", lambda x: F.struct(x["event_type"].alias("phoneme"), x["at"].alias("start"), (x["at"] + F.round(x["value"] * 10)).cast("bigint").alias("stop")))
    text = F.transform("w", lambda x: F.struct(x["event_type"].alias("phoneme"), (x["event_type"] == "purchase").alias("word_start"), F.lit(1.0).alias("weight")))
    found = align.align_tracks(both.select("id", audio.alias("audio"), text.alias("text")), A.SIM)
    return found.select("id", F.size("ops").alias("n_ops"), F.size("rows").alias("n_rows"), "min_score", "has_gaps", "error")


# --- clips and graphs --------------------------------------------------------------------------


@query(f"SELECT id, list_max([abs(v) for v in pcm]) AS peak, CAST(floor(len(pcm) * 1000 / 44100.0) AS BIGINT) AS ms FROM ({A.PCM})")
def clip_peaks(s, d):
    return A.pcm(s, d).select("id", timeline.peak(F.col("pcm")).alias("peak"), timeline.duration_ms(F.col("pcm")).alias("ms"))


@query(f"SELECT id, unnest(range(1, len(pcm) + 1)) AS i, unnest([CAST(round(v * (32767 * CAST(0.95 AS DOUBLE)) / top) AS INTEGER) for v in pcm]) AS v FROM (SELECT id, pcm, list_max([abs(v) for v in pcm]) AS top FROM ({A.PCM}))")
def normalise_pcm(s, d):
    return A.pcm(s, d).select("id", F.posexplode(timeline.normalised(F.col("pcm"))).alias("i", "v")).select("id", (F.col("i") + 1).cast("bigint").alias("i"), "v")


@query(f"SELECT id, unnest([8, 12, 16, 20, 24, 28, 32, 36]) AS i, unnest([pcm[k + 1] for k in [8, 12, 16, 20, 24, 28, 32, 36]]) AS v FROM ({A.PCM})")
def waveform_decimate(s, d):
    """A window of 32 samples from the tenth on, drawn 16 wide: every fourth sample from the eighth on."""
    return A.pcm(s, d).select("id", F.posexplode(timeline.decimated(F.col("pcm"), 10, 32, 16)).alias("k", "v")).select("id", (F.col("k") * 4 + 8).cast("int").alias("i"), F.col("v").cast("int").alias("v"))


#: Samples of 44,100 Hz at 16,000 Hz: 160 phases; weights under a Hann window, 47 samples to each side.
_RESAMPLED = f"""WITH clips AS ({A.PCM}), places AS (SELECT id, pcm, unnest(range(len(pcm) * 160 // 441)) AS n FROM clips),
near AS (SELECT *, [i - 46 for i in range(94)] AS js, n * 441 // 160 AS place, (n * 441 % 160) / 160.0::DOUBLE AS part, 0.95::DOUBLE * 16000 / 44100 AS band FROM places),
weighted AS (SELECT *, [(CASE WHEN part = j THEN 1.0 ELSE sin(pi() * band * (part - j)) / (pi() * band * (part - j)) END) * (0.5 + 0.5 * cos(pi() * least(1.0, greatest(-1.0, (part - j) / 47.0::DOUBLE)))) for j in js] AS h FROM near)
SELECT id, n, CAST(least(32767, greatest(-32768, floor(list_inner_product(h, [coalesce(CASE WHEN place + j >= 0 THEN pcm[place + j + 1] END, 0)::DOUBLE for j in js]) / list_sum(h) + 0.5))) AS INTEGER) AS v FROM weighted"""


@query(_RESAMPLED)
def resampled_clips(s, d):
    """Clips in chunks of 50 samples, resampled chunk by chunk."""
    chunks = resample.chunked(A.pcm(s, d).withColumn("rate", F.lit(44100)), 50)
    found = resample.resampled_chunks(chunks, 16000, size=50, most_rate=44100)
    each = found.select("id", "first", F.posexplode("pcm").alias("i", "v"))
    return each.select("id", (F.col("first") + F.col("i")).alias("n"), F.col("v").cast("int").alias("v"))


def _edges(s, d):
    key = F.col("p_partkey")
    return A.table(s, d, "part").where("p_partkey > 0").select(F.floor(key / F.when(key % 2 == 0, 2).otherwise(3)).cast("bigint").alias("src"), key.alias("dst"))


@query("""WITH RECURSIVE e AS (SELECT CAST(floor(p_partkey / (CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END)) AS BIGINT) AS src, p_partkey AS dst FROM part WHERE p_partkey > 0),
  w(node, depth) AS (SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node) SELECT node, max(depth) AS depth FROM w GROUP BY node""")
def graph_depth(s, d):
    return graph.depths(A.table(s, d, "part").select(F.col("p_partkey").alias("node")), _edges(s, d))


@query("SELECT src, count(DISTINCT dst) AS n FROM (SELECT CAST(floor(p_partkey / (CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END)) AS BIGINT) AS src, p_partkey AS dst FROM part WHERE p_partkey > 0) GROUP BY src")
def graph_adjacency(s, d):
    return graph.adjacency(_edges(s, d)).select("src", F.size("targets").cast("bigint").alias("n"))


#: Squeezed texts: a character goes if it equals the one before it, but line breaks stay.
SQL["consecutive_dedup"] = "SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1] OR x = chr(10)), '') AS squeezed FROM (SELECT conv_id, turn, string_split(text, '') AS l FROM conversations)"

from . import drag_queries, edit_queries, file_queries, model_queries, stream_queries, text_queries  # noqa: E402, F401  register further queries here
