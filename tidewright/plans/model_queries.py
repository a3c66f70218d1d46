"""Registered queries over n-gram models, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ngrams
from . import adapters as A
from .queries import query


def _words(table: str) -> str:
    return f"SELECT row_number() OVER () AS r, [w for w in string_split_regex(text, '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM {table}"


_MODEL = f"""texts AS (SELECT r, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i, w FROM ({_words('documents')})),
counts AS (SELECT a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS n FROM texts GROUP BY ALL),
one AS (SELECT a AS c, sum(n) AS n FROM counts GROUP BY a), two AS (SELECT a AS b, b AS c, sum(n) AS n FROM counts WHERE b IS NOT NULL GROUP BY ALL), three AS (SELECT a, b, c, n FROM counts WHERE c IS NOT NULL),
words AS (SELECT c, (n - 0.75::DOUBLE) / sum(n) OVER () AS p, 0.75::DOUBLE * count(*) OVER () / sum(n) OVER () AS rest FROM one),
pairs AS (SELECT b, c, (n - 0.75::DOUBLE) / sum(n) OVER h AS p, 0.75::DOUBLE * count(*) OVER h / sum(n) OVER h AS rest FROM two WINDOW h AS (PARTITION BY b)),
triples AS (SELECT a, b, c, (n - 0.75::DOUBLE) / sum(n) OVER h AS p, 0.75::DOUBLE * count(*) OVER h / sum(n) OVER h AS rest FROM three WINDOW h AS (PARTITION BY a, b)),
word_bow AS (SELECT p.b, any_value(p.rest) / (1 - sum(w.p)) AS bow FROM pairs p JOIN words w USING (c) GROUP BY p.b),
pair_bow AS (SELECT t.a, t.b, any_value(t.rest) / (1 - sum(p.p)) AS bow FROM triples t JOIN pairs p USING (b, c) GROUP BY t.a, t.b)"""


@query(f"""WITH {_MODEL} SELECT b, c, round(ln(p), 6) AS logp, round(ln(bow), 6) + 0 AS weight FROM pairs p LEFT JOIN (SELECT a AS b, b AS c, bow FROM pair_bow) USING (b, c)""")
def bigram_model(s, d):
    by = ngrams.model(A.table(s, d, "documents"))
    return by.pairs.select("b", "c", F.round("p", 6).alias("logp"), (F.round("bow", 6) + 0).alias("weight"))


@query(f"""WITH {_MODEL}, spoken AS (SELECT CASE WHEN i > 2 THEN w[i - 2] END AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, w[i] AS c, count(*) AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM ({_words('conversations')})) GROUP BY ALL),
found AS (SELECT s.*, t.p AS p3, q.p AS p2, w.p AS p1, v.bow AS w2, u.bow AS w1, (SELECT any_value(rest) FROM words) AS unseen FROM spoken s LEFT JOIN triples t ON t.a = s.a AND t.b = s.b AND t.c = s.c
  LEFT JOIN pairs q ON q.b = s.b AND q.c = s.c LEFT JOIN words w ON w.c = s.c LEFT JOIN pair_bow v ON v.a = s.a AND v.b = s.b LEFT JOIN word_bow u ON u.b = s.b)
SELECT a, b, c, n, round(logp, 6) AS logp, round(9.5 * logp + ln(0.7::DOUBLE), 5) AS score, CASE WHEN p3 IS NOT NULL THEN 3 WHEN p2 IS NOT NULL THEN 2 WHEN p1 IS NOT NULL THEN 1 ELSE 0 END AS used
FROM (SELECT *, CASE WHEN p3 IS NOT NULL THEN ln(p3) ELSE coalesce(ln(w2), 0) + CASE WHEN p2 IS NOT NULL THEN ln(p2) ELSE coalesce(ln(w1), 0) + ln(coalesce(p1, unseen)) END END AS logp FROM found)""")
def trigram_scores(s, d):
    """The words of conversations after the two before them, by the model of documents."""
    found = ngrams.scores_of_texts(ngrams.spoken_grams(A.table(s, d, "conversations")), A.table(s, d, "documents"), 9.5, 0.7)
    return found.select("a", "b", "c", "n", F.round("logp", 6).alias("logp"), F.round("score", 5).alias("score"), "used")
