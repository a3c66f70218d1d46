"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, and so on.  On
each level runs of one symbol become one; deterministic coin tossing (the lowest bit in
which a symbol differs from the one before it, and its value there, repeated on the
labels) leaves labels below eight; and a phrase begins where a label is larger than both
neighbours.  Borders depend on a few symbols around them only, so equal substrings get
equal phrases inside, wherever they lie.  A phrase's name is a hash of its content.

The fingerprint holds the KEPT smallest (hashed) names of the levels in ``LEVELS``; the
likeness of two fingerprints is the estimated share of common names (exact while both
hold all their names).  Texts too short for a phrase name on these levels have one
phrase, the whole text.  Null texts count as empty; the empty text's fingerprint is
empty, and is like another empty one only.

Documents are ordered by falling id (rows without an id last), then by text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textops import joined_bytes, mix64, segment_hashes, slices

KEPT = 64
LEVELS = (2, 3)
_DEPTH = max(LEVELS)
#: Index of the lowest set bit of 16-bit numbers.
_LOW = np.zeros(65536, np.uint8)
for _k in range(15, -1, -1):
    _LOW[(np.arange(65536) >> _k) & 1 == 1] = _k


def _toss(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One round: labels from 16-bit symbols and those before them (0 at a text's edge)."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[edges] = 0
    low = _LOW[x ^ before]
    return (low << 1) | ((x >> low) & 1).astype(np.uint8)


def _phrases(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level, and the texts' bounds among them."""
    edge = np.zeros(len(x) + 1, bool)
    edge[bounds] = True
    fresh = edge[:-1].copy()
    fresh[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(fresh)
    symbols = x[at].astype(np.uint16) if x.dtype == np.uint8 else (x[at] >> np.uint64(24)).astype(np.uint16)
    begins = np.flatnonzero(edge[at])
    label = _toss(symbols, begins)
    for _ in range(3):
        label = _toss(label.astype(np.uint16), begins)
    top = np.ones(len(label), bool)
    top[1:] = label[1:] > label[:-1]
    top[:-1] &= label[:-1] > label[1:]
    # A text's last symbol begins no phrase, its first one always does.
    top[begins[1:] - 1] = False
    top[-1] = False
    top[begins] = True
    start = at[top]
    names = segment_hashes(x, start, np.append(start[1:], len(x)))
    return names, np.searchsorted(start, bounds)


def sketches(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted kept names (32 bits) of each text."""
    x, bounds = joined_bytes(texts)
    names, edges = [], []
    for level in range(1, _DEPTH + 1):
        if len(x):
            x, bounds = _phrases(x, bounds)
        if level in LEVELS:
            names.append((mix64(x + np.uint64(level)) >> np.uint64(32)).astype(np.uint32) if len(x) else np.zeros(0, np.uint32))
            edges.append(bounds.tolist())
    out = []
    for i in range(len(texts)):
        mine = np.concatenate([n[e[i] : e[i + 1]] for n, e in zip(names, edges, strict=True)])
        mine.sort()
        if len(mine):
            mine = mine[np.append(True, mine[1:] != mine[:-1])]
        out.append(mine[:KEPT].copy())
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common names, from the smallest names of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    distinct = both[np.append(True, ~same)][:KEPT]
    return int(np.count_nonzero(both[1:][same] <= distinct[-1])) / len(distinct)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[np.ndarray]]]:
    for batch in batches:
        ids, texts, extra = (batch.column(k).to_pylist() for k in range(3))
        for a, b in slices(texts):
            part = [t or "" for t in texts[a:b]]
            yield list(zip(ids[a:b], extra[a:b], strict=True)), part, sketches(part)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in order; the last, marked row is the one after the bucket (else it is the first)."""
    keys, texts, marks, head = [], [], [], None
    for more_keys, more_texts, more_marks in _rows(batches):
        head = head or (more_texts[0], more_marks[0])
        keys, texts, marks = keys + more_keys, texts + more_texts, marks + more_marks
        if len(keys) > 1:
            yield _compared(keys[:-1], texts, marks)
            keys, texts, marks = keys[-1:], texts[-1:], marks[-1:]
    if keys and not keys[0][1]:
        yield _compared(keys, [texts[0], head[0]], [marks[0], head[1]])


def _compared(keys: list, texts: list[str], marks: list[np.ndarray]) -> pa.RecordBatch:
    n = len(keys)
    new = [edited(t, u) for t, u in zip(texts[:n], texts[1:], strict=True)]
    new_marks = sketches(new)
    columns = [
        pa.array([k[0] for k in keys], pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
        pa.array([written(m) for m in marks[:n]], pa.string()),
        pa.array([written(m) for m in new_marks], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(marks, new_marks, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(marks[:n], marks[1:], strict=True)], pa.float64()),
    ]
    return pa.record_batch(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text's fingerprint as hexadecimal string) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([written(m) for m in sketches(texts[a:b])], pa.string())], names=["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, rows_each: int = 4000, most_buckets: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next document.

    Rows are dealt into buckets of neighbouring ids, whose borders come from the ids' quantiles; each bucket also
    gets the first row of the next one, so one shuffle of the texts is enough.
    """
    from pyspark.ml.feature import Bucketizer

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = docs.count()
    wanted = min(most_buckets, max(1, math.ceil(n / rows_each)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)] or [0.5], max(10_000, 10 * wanted))).first()[0]
    cuts = sorted({float(c) for c in cuts}) if cuts and wanted > 1 else []
    splits = [-math.inf, *(cuts or [0.0]), math.inf]
    cutter = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket")
    dealt = cutter.transform(docs.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))).select("doc_id", "text", F.col("_bucket").cast("int").alias("bucket"))
    # One row per bucket, whatever the number of documents.
    heads = {r.bucket: r.head for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    after = [(heads[b], a) for a, b in zip(order, order[1:] + order[:1], strict=True) if len(order) > 1]
    rows = dealt.withColumn("extra", F.lit(False))
    if after:
        # A bucket of rows without an id alone has none as its head.
        targets = docs.sparkSession.createDataFrame(after, "head long, bucket int")
        first = docs.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("doc_id", "bucket").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("t"))
        rows = rows.union(first.select("doc_id", "t.text", "bucket", F.lit(True)))
    rows = rows.repartitionById(len(splits) - 1, F.col("bucket")).sortWithinPartitions(F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return map_arrow(rows.select("doc_id", "text", "extra"), _chain, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
