"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, html_extract, knn, language, linededup, minhash, packing, pii, runs, tokencount, toxicity, turns


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op6_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.whole_vectors(_table(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


OP6_SQL = """
WITH sound AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.link_components(_table(spark, sf_dir, "documents"), size=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}))"


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = language.identify(docs, language.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return turns.with_all_ids(turns.report(turns.damaged(conversations)), conversations)


#: Steps of one edit: state before, letters of the macro edit, state after, cost; states 0 start, 1 s, 2 u, 3 a.
OP12_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm
  FROM conversations
), harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE harm <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial,
    regexp_extract(text, '(?s)([^ 	-])[ 	-]*$', 1) AS sign
  FROM harmed
), faulty AS (
  SELECT *, CASE WHEN sign = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
      WHEN sign NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN n > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal
  FROM placed
), turn_of(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), inserts(state, letters, made, after) AS (VALUES (0, '', '', 0), (1, '', '', 1), (2, '', '', 2), (3, '', '', 3),
  (0, 'I', 'u', 2), (1, 'I', 'u', 2), (2, 'I', 'a', 3), (3, 'I', 'u', 2), (0, 'II', 'ua', 3), (1, 'II', 'ua', 3), (2, 'II', 'au', 2), (3, 'II', 'ua', 3)
), best(conv_id, n, state, cost, audit, lines) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM faulty
  UNION ALL
  SELECT conv_id, n, state, cost, audit, lines FROM (
    SELECT b.conv_id, f.n, e.after AS state, b.cost + 3 * length(i.letters) + e.cost AS cost, b.audit || i.letters || e.letter AS audit,
      list_concat(list_concat(b.lines, [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END for x in string_split(i.made, '') if x <> '']), e.line) AS lines
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.n + 1 JOIN inserts i ON i.state = b.state,
    LATERAL (
      SELECT 'D' AS letter, 4 AS cost, i.after AS after, CAST([] AS VARCHAR[]) AS line
      UNION ALL SELECT 'K', CASE WHEN f.fault = 3 THEN 3 ELSE 0 END, t.after, [f.role || ':' || f.text] FROM turn_of t
        WHERE t.state = i.after AND t.initial = f.initial AND f.fault NOT IN (1, 2)
      UNION ALL SELECT 'R', CASE WHEN f.fault = 3 THEN 6 ELSE 3 END, t.after, [CASE t.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] FROM turn_of t
        WHERE t.state = i.after AND t.initial <> 's' AND f.fault NOT IN (1, 2)) e
    QUALIFY row_number() OVER (PARTITION BY b.conv_id, e.after ORDER BY b.cost + 3 * length(i.letters) + e.cost, b.audit || i.letters || e.letter) = 1)
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, CAST(sum(illegal) AS BIGINT) AS illegal
  FROM faulty GROUP BY conv_id
), ended AS (
  SELECT c.*, b.cost + 3 * length(i.letters) AS cost, b.audit || i.letters AS audit,
    list_concat(b.lines, [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END for x in string_split(i.made, '') if x <> '']) AS lines
  FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.n = c.n JOIN inserts i ON i.state = b.state AND i.after IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY b.cost + 3 * length(i.letters), b.audit || i.letters) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return runs.run_report(docs, text_col=runs.with_repeated_tail(F.col("doc_id"), F.col("text")))


OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, [w for w in string_split_regex(coalesce(text, ''), '[ 	-]+') if w <> ''] AS w,
    {_crc_sql("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents
), planned AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs
), made AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
      THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END for i in range(n)] ELSE w END AS w
  FROM planned
), words AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM made
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), likely AS (
  SELECT r, p FROM pairs GROUP BY r, p HAVING count(*) >= greatest(p, 12 - p)
), stretches AS (
  SELECT r, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pairs SEMI JOIN likely USING (r, p))
  GROUP BY r, p, island HAVING count(*) >= greatest(p, 12 - p)
), runs AS (
  SELECT r, start, length, min(p) AS period FROM stretches GROUP BY r, start, length
), listed AS (
  SELECT r, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, {{'a': -length, 'b': start, 'c': period}}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text
  FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT w.r, w.i FROM words w JOIN runs u ON w.r = u.r AND w.i >= u.start + u.period AND w.i < u.start + u.length
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM made m LEFT JOIN listed l ON l.r = m.r LEFT JOIN kept k ON k.r = m.r
"""


_QUERIES = [
    op1_pii,
    op2_fingerprints,
    op3_line_dedup,
    op4_toxicity,
    op5_html_extraction,
    op6_top_k_search,
    op7_packing,
    op8_bpe,
    op9_token_counts,
    op10_minhash_near_dedup,
    op11_language_id,
    op12_conversation_repair,
    op13_periodic_runs,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_top_k_search": OP6_SQL, "op12_conversation_repair": OP12_SQL, "op13_periodic_runs": OP13_SQL}
