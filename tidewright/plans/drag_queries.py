"""Registered queries over drags, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drags
from . import adapters as A
from .queries import query

_MODES = {"click": "none", "view": "neighbour", "purchase": "linked", "signup": "word", "error": "word"}


def _clicks(s, d):
    """Events as clicks on tracks, some on slots or tracks that do not exist."""
    key, kind = F.col("event_id"), F.col("event_type")
    mode = F.create_map(*(F.lit(x) for pair in _MODES.items() for x in pair))[kind]
    position = key % 11 / F.lit(10.0)
    return A.table(s, d, "events").select(
        key.alias("click"), (key + 1).alias("id"), (key % 5 + 1).alias("slot"), position.alias("position"), mode.alias("mode"), (F.round("value") - 20).cast("bigint").alias("delta")
    )


_STARTS = f"""WITH seg AS ({A.SEGMENTS}), words AS (SELECT *, sum(CAST(word_start AS INTEGER)) OVER (PARTITION BY id ORDER BY slot) AS word FROM seg),
known AS (SELECT *, lag(slot) OVER t AS b_slot, lag(start) OVER t AS b_start, lag(stop) OVER t AS b_stop, lead(slot) OVER t AS a_slot, lead(start) OVER t AS a_start, lead(stop) OVER t AS a_stop,
    min(slot) OVER w AS w_first, max(slot) OVER w AS w_last, least(slot, min(slot) FILTER (WHERE active) OVER w) AS f_active, greatest(slot, max(slot) FILTER (WHERE active) OVER w) AS l_active,
    first_value(start) OVER (PARTITION BY id, word ORDER BY slot) AS w_start, last_value(stop) OVER (PARTITION BY id, word ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w_stop
  FROM words WINDOW t AS (PARTITION BY id ORDER BY slot), w AS (PARTITION BY id, word)),
clicks AS (SELECT event_id AS click, event_id + 1 AS id, event_id % 5 + 1 AS slot, event_id % 11 / 10.0 AS position, CAST(round(value) - 20 AS BIGINT) AS delta,
    CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'neighbour' WHEN 'purchase' THEN 'linked' ELSE 'word' END AS mode FROM events),
held AS (SELECT *, position < 0.3 AS is_left FROM clicks WHERE position < 0.3 OR position > 0.7),
found AS (SELECT *, CASE WHEN mode = 'word' THEN false WHEN is_left THEN b_slot IS NOT NULL AND (mode = 'neighbour' OR mode = 'linked' AND b_stop >= start)
    ELSE a_slot IS NOT NULL AND (mode = 'neighbour' OR mode = 'linked' AND stop >= a_start) END AS taken FROM held JOIN known USING (id, slot)),
blocks AS (SELECT *, CASE WHEN mode = 'word' THEN w_first WHEN taken AND is_left THEN b_slot ELSE slot END AS first, CASE WHEN mode = 'word' THEN w_last WHEN taken AND NOT is_left THEN a_slot ELSE slot END AS last,
    CASE WHEN mode = 'word' THEN w_start WHEN taken AND is_left THEN b_start ELSE start END AS block_start, CASE WHEN mode = 'word' THEN w_stop WHEN taken AND NOT is_left THEN a_stop ELSE stop END AS block_stop FROM found),
starts AS (SELECT click, id, CASE WHEN is_left THEN 'left' ELSE 'right' END AS side, CASE WHEN is_left THEN start ELSE stop END AS reference, first, last, block_start, block_stop,
    CASE WHEN is_left AND slot <= CASE WHEN mode = 'word' THEN f_active ELSE first END THEN 0 ELSE block_start END AS low,
    CASE WHEN NOT is_left AND slot >= CASE WHEN mode = 'word' THEN l_active ELSE last END THEN 3000 ELSE block_stop END AS high, delta FROM blocks)"""


@query(f"{_STARTS} SELECT * FROM starts")
def drag_starts(s, d):
    return drags.drag_starts(_clicks(s, d), A.segments(s, d), F.lit(3000))


_SNAP = "least(greatest(round(trunc({0} + delta * {1}) / 5.0) * 5, low), high)"


@query(f"""{_STARTS}, cells AS (SELECT s.*, g.slot, g.start, g.stop, row_number() OVER (PARTITION BY click ORDER BY g.slot) AS place FROM starts s JOIN seg g ON g.id = s.id AND g.slot >= s.first AND g.stop <= s.block_stop),
points AS (SELECT *, CASE WHEN start < reference THEN 0.9 * (start - block_start) / nullif(reference - block_start, 0) WHEN start > reference THEN 0.9 * (block_stop - start) / nullif(block_stop - reference, 0) ELSE 1.0 END AS ws,
    CASE WHEN stop < reference THEN 0.9 * (stop - block_start) / nullif(reference - block_start, 0) WHEN stop > reference THEN 0.9 * (block_stop - stop) / nullif(block_stop - reference, 0) ELSE 1.0 END AS we
  FROM cells WHERE slot - first + 1 = place),
moved AS (SELECT click, slot, {_SNAP.format('start', 'CAST(ws AS DOUBLE)')} AS a, {_SNAP.format('stop', 'CAST(we AS DOUBLE)')} AS b FROM points)
SELECT click, slot, CAST(greatest(a, coalesce(max(greatest(a, b)) OVER (PARTITION BY click ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS BIGINT) AS start,
  CAST(max(greatest(a, b)) OVER (PARTITION BY click ORDER BY slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM moved""")
def drag_results(s, d):
    points = drags.drag_points(drags.drag_starts(_clicks(s, d), A.segments(s, d), F.lit(3000)), A.segments(s, d), damping=0.9)
    return drags.drag_results(points, F.col("delta"))
