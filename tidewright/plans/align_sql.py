"""DuckDB SQL of the alignment: its recurrence over anti-diagonals, the way back, and the rows that follow.

Inputs are queries audio (id, a, phoneme, start, stop) and text (id, t, phoneme, word_start, weight) with places from 1, and
a matrix (audio_ph, text_ph, score).  Sums are single precision, as in the operator.
"""

from __future__ import annotations

_COSTS = """
shapes AS (SELECT id, n, m FROM (SELECT id, max(a) AS n FROM audio GROUP BY id) JOIN (SELECT id, max(t) AS m FROM words GROUP BY id) USING (id) WHERE n <= 499 AND m <= 499),
heard AS (SELECT *, coalesce(lead(gap) OVER (PARTITION BY id ORDER BY a), false) AS follows, lower(phoneme) IN ('sil', '+nsn+', '+spn+') AS noise,
    CASE WHEN lower(phoneme) = 'sil' THEN 2.1::FLOAT + 0.01::FLOAT ELSE -1.0::FLOAT END AS own
  FROM (SELECT *, start > coalesce(lag(stop) OVER (PARTITION BY id ORDER BY a), stop) AS gap FROM audio)),
said AS (SELECT *, coalesce(lead(word_start) OVER (PARTITION BY id ORDER BY t), true) AS closes FROM words),
cells AS (
  SELECT id, a, t, gap, CASE WHEN apart AND NOT (word_start AND closes) THEN across ELSE score END AS match, CASE WHEN gap THEN across ELSE score - 0.01::FLOAT END AS merge,
    CASE WHEN follows AND NOT closes THEN across ELSE score - 0.01::FLOAT END AS split
  FROM (SELECT *, -1.0::FLOAT * 1.5::FLOAT + score * 0.5::FLOAT AS across, (gap AND NOT word_start) OR (follows AND word_start AND NOT closes) AS apart
    FROM (SELECT h.id, h.a, s.t, h.gap, h.follows, s.word_start, s.closes, CASE WHEN h.noise THEN -2.1::FLOAT ELSE coalesce(x.score::FLOAT, -1.0::FLOAT) END AS score
      FROM shapes JOIN heard h USING (id) JOIN said s USING (id) LEFT JOIN matrix x ON x.audio_ph = lower(h.phoneme) AND x.text_ph = lower(s.phoneme)))),
"""

_STEPS = """
-- A cell's total, operation (1 match, 2 delete, 3 merge, 4 insert, 5 split) and its own score; age 1 is the diagonal before.
best(id, n, m, a, t, total, op, own, age) AS (
  SELECT id, n, m, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0::FLOAT, 0, 0::FLOAT, 0 FROM shapes
  UNION ALL
  (SELECT id, n, m, a, t, total, op, own, 0 FROM (
    SELECT w.id, w.n, w.m, w.a + 1 AS a, w.t + 1 AS t, w.total + c.match AS total, 1 AS op, c.match AS own FROM best w JOIN cells c ON c.id = w.id AND c.a = w.a + 1 AND c.t = w.t + 1 WHERE w.age = 1
    UNION ALL SELECT w.id, w.n, w.m, w.a + 1, w.t, w.total + h.own, 2, h.own FROM best w JOIN heard h ON h.id = w.id AND h.a = w.a + 1 WHERE w.age = 0
    UNION ALL SELECT w.id, w.n, w.m, w.a + 1, w.t, w.total + c.merge, 3, c.merge FROM best w JOIN cells c ON c.id = w.id AND c.a = w.a + 1 AND c.t = w.t WHERE w.age = 0 AND w.op = 1
    UNION ALL SELECT w.id, w.n, w.m, w.a, w.t + 1, w.total + -1.0::FLOAT, 4, -1.0::FLOAT FROM best w WHERE w.age = 0 AND w.t < w.m
    UNION ALL SELECT w.id, w.n, w.m, w.a, w.t + 1, w.total + c.split, 5, c.split FROM best w JOIN cells c ON c.id = w.id AND c.a = w.a AND c.t = w.t + 1 WHERE w.age = 0 AND w.op = 1)
  QUALIFY row_number() OVER (PARTITION BY id, a, t ORDER BY total DESC, op) = 1
  UNION ALL SELECT id, n, m, a, t, total, op, own, 1 FROM best WHERE age = 0)),
found AS (SELECT id, n, m, a, t, op, own FROM best WHERE age = 0),
way(id, a, t, k, op, own) AS (
  SELECT id, a, t, 0, op, own FROM found WHERE a = n AND t = m
  UNION ALL
  SELECT w.id, f.a, f.t, w.k - 1, f.op, f.own FROM way w JOIN found f ON f.id = w.id AND f.a = w.a - CASE WHEN w.op IN (1, 2, 3) THEN 1 ELSE 0 END AND f.t = w.t - CASE WHEN w.op IN (1, 4, 5) THEN 1 ELSE 0 END
  WHERE w.op <> 0),
steps AS (SELECT *, lead(op) OVER w AS next_op, lag(own) OVER w AS before FROM (SELECT * FROM way WHERE op <> 0) WINDOW w AS (PARTITION BY id ORDER BY k)),
kept AS (
  SELECT p.*, s.phoneme AS label, s.word_start AS starts, s.weight, h.phoneme AS sound, h.start AS first, h.stop AS last, h.start + (h.stop - h.start) // 2 AS half, b.phoneme AS sound_before, b.start AS first_before, b.stop AS last_before,
    CASE WHEN p.op = 3 THEN (p.before + p.own) / 2::FLOAT ELSE p.own END AS score
  FROM steps p LEFT JOIN said s ON s.id = p.id AND s.t = p.t LEFT JOIN heard h ON h.id = p.id AND h.a = p.a LEFT JOIN heard b ON b.id = p.id AND b.a = p.a - 1
  WHERE NOT (p.op = 2 AND lower(h.phoneme) IN ('sil', '+nsn+', '+spn+', '<sil>', '</s>'))),
made AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pos, k, op,
    CASE WHEN op = 2 THEN '_' ELSE label END AS phoneme, CASE WHEN op = 2 THEN false ELSE starts END AS word_start,
    CASE op WHEN 3 THEN first_before WHEN 5 THEN half WHEN 4 THEN NULL ELSE first END AS start0, CASE WHEN op = 4 THEN NULL WHEN op = 1 AND next_op = 5 THEN half ELSE last END AS stop0,
    CASE WHEN op = 2 THEN 1.0 ELSE weight END AS weight, score, op IN (1, 3, 5) AS active,
    CASE WHEN length(label) < 2 THEN rpad(label, 2, ' ') ELSE label END AS pad, sound || '[' || first || '-' || last || ']' AS span, sound_before || '[' || first_before || '-' || last_before || ']' AS span_before
  FROM kept WHERE NOT (op = 1 AND coalesce(next_op, 0) = 3)),
rows_ AS (
  SELECT id, pos, phoneme, word_start, coalesce(start0, place) AS start, coalesce(stop0, place) AS stop, weight, score, active, ['match', 'delete', 'merge_left', 'insert', 'split_left'][op] AS op,
    CASE op WHEN 1 THEN pad || '~ ' || span WHEN 2 THEN '  d ' || span WHEN 3 THEN pad || '~> ' || span_before || '+' || span WHEN 4 THEN pad || 'i' ELSE pad || '\\ ' || span END AS source
  FROM (SELECT *, coalesce(last_value(stop0 IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS place FROM made))"""


def _with(audio: str, text: str, matrix: str) -> str:
    return f"WITH RECURSIVE audio AS ({audio}), words AS ({text}), matrix AS ({matrix}),{_COSTS}{_STEPS}"


def rows_sql(audio: str, text: str, matrix: str) -> str:
    """The aligned rows (id, pos, phoneme, ...) of all items."""
    return f"{_with(audio, text, matrix)} SELECT id, pos, phoneme, word_start, start, stop, score, active, op, source FROM rows_"


def summary_sql(ids: str, audio: str, text: str, matrix: str) -> str:
    """(id, n_ops, n_rows, min_score, has_gaps, error) of all items of ids (id)."""
    return f"""{_with(audio, text, matrix)}, ids AS ({ids})
SELECT i.id, coalesce(s.n, 0) AS n_ops, coalesce(r.n, 0) AS n_rows, k.least AS min_score, CASE WHEN b.id IS NOT NULL THEN coalesce(k.gaps, false) END AS has_gaps,
  CASE WHEN b.id IS NULL THEN CASE WHEN i.id NOT IN (SELECT id FROM audio) OR i.id NOT IN (SELECT id FROM words) THEN 'empty sequence' ELSE 'more than 499 segments' END END AS error
FROM ids i LEFT JOIN shapes b USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM steps GROUP BY id) s USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM made GROUP BY id) r USING (id)
  LEFT JOIN (SELECT id, min(score) AS least, bool_or(op IN (2, 4)) AS gaps FROM kept GROUP BY id) k USING (id)"""


def n_best_sql(audio: str, text: str, matrix: str, k: int) -> str:
    """(id, rank, total, ops) of the k best alignments: the k best ways to each cell, after a match (f = 1) or another step."""
    return f"""WITH RECURSIVE audio AS ({audio}), words AS ({text}), matrix AS ({matrix}),{_COSTS}
units AS (SELECT id, a, t, CAST(round(match::DOUBLE * 1e6) AS BIGINT) AS match, CAST(round(merge::DOUBLE * 1e6) AS BIGINT) AS merge, CAST(round(split::DOUBLE * 1e6) AS BIGINT) AS split FROM cells),
way(id, n, m, a, t, f, total, back, age) AS (
  SELECT id, n, m, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', 0 FROM shapes
  UNION ALL
  (SELECT id, n, m, a, t, f, total, back, 0 FROM (
    SELECT w.id, w.n, w.m, w.a + 1 AS a, w.t + 1 AS t, 1 AS f, w.total + c.match AS total, '1' || w.back AS back FROM way w JOIN units c ON c.id = w.id AND c.a = w.a + 1 AND c.t = w.t + 1 WHERE w.age = 1
    UNION ALL SELECT w.id, w.n, w.m, w.a + 1, w.t, 0, w.total + CAST(round(h.own::DOUBLE * 1e6) AS BIGINT), '2' || w.back FROM way w JOIN heard h ON h.id = w.id AND h.a = w.a + 1 WHERE w.age = 0
    UNION ALL SELECT w.id, w.n, w.m, w.a + 1, w.t, 0, w.total + c.merge, '3' || w.back FROM way w JOIN units c ON c.id = w.id AND c.a = w.a + 1 AND c.t = w.t WHERE w.age = 0 AND w.f = 1
    UNION ALL SELECT w.id, w.n, w.m, w.a, w.t + 1, 0, w.total - 1000000, '4' || w.back FROM way w WHERE w.age = 0 AND w.t < w.m
    UNION ALL SELECT w.id, w.n, w.m, w.a, w.t + 1, 0, w.total + c.split, '5' || w.back FROM way w JOIN units c ON c.id = w.id AND c.a = w.a AND c.t = w.t + 1 WHERE w.age = 0 AND w.f = 1)
  QUALIFY row_number() OVER (PARTITION BY id, a, t, f ORDER BY total DESC, back) <= {k}
  UNION ALL SELECT id, n, m, a, t, f, total, back, 1 FROM way WHERE age = 0)
)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY total DESC, back) AS INTEGER) AS rank, total / 1e6 AS total,
  array_to_string([['match', 'delete', 'merge_left', 'insert', 'split_left'][CAST(x AS INTEGER)] for x in string_split(reverse(back), '')], ' ') AS ops
FROM way WHERE age = 0 AND a = n AND t = m QUALIFY rank <= {k}"""
