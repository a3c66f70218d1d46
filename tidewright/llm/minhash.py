"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``tables`` short tuples of minimum hashes are computed; a table
key joins a tuple of the first with a tuple of the second, so tables**2 tables of
2*rows hashes each take only 2*tables*rows minimum hashes.  Documents that share a
key are candidates; links are confirmed on full shingle sets.

The stages, none of which gathers a group in one task:

1. documents with equal sets form classes (aggregation), and only the smallest id of
   each goes on;
2. tuples that no other document has are left out, before the keys are formed;
3. in each table every document is held against the smallest id and the smallest set of
   its bucket, and confirmed links give components;
4. the documents of buckets that then still hold two or more components go through an
   exact prefix filter, which finds all pairs from different components that can be links.

So no link between documents that share a bucket is lost, and pairs already known to be
connected are not formed.

Null and empty texts have empty sets and are linked with nothing.  Rows without an
id are linked with nothing and kept.  Of rows with the same id, a link of any holds
for all in ``link_components``; ``near_duplicates_removed`` tells rows of equal id apart
by their texts.  Other columns are kept by it, whatever their names, and not read else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, map_arrow, saved
from .textops import joined_bytes, mix64, runs, segment_hashes, slices

#: Ids that are broadcast at most; with more, texts are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: [\x20\x09-\x0D]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of the texts, one after another, and their bounds."""
    raw, bounds = joined_bytes(texts)
    raw = _LOWER[raw]
    starts, ends = runs(~_SPACE[raw], bounds)
    words = segment_hashes(raw, starts, ends)
    first = np.searchsorted(starts, bounds)
    n_words = np.diff(first)
    h = np.zeros(len(words), np.uint64)
    for k in range(size):
        h[: len(words) - k] = mix64(h[: len(words) - k] * _A + words[k:] + _B)
    # With fewer words than a shingle has, all words are the one shingle.
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    keep = np.zeros(len(words) + 1, np.int64)
    np.add.at(keep, first[:-1], 1)
    np.subtract.at(keep, first[:-1] + counts, 1)
    keep = np.cumsum(keep)[:-1] > 0
    for d in np.flatnonzero((n_words > 0) & (n_words < size)).tolist():
        one = np.array([n_words[d]], np.uint64)
        for w in words[first[d] : first[d + 1]]:
            one = mix64(one * _B + w)
        h[first[d]] = one[0]
    h = h[keep]
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    edges = at.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[at[:-1][counts > 0]] = True
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(fresh, out=total[1:])
    return h[fresh], total[at]


@lru_cache(8)
def _multipliers(n: int) -> np.ndarray:
    return (mix64(np.arange(1, n + 1, dtype=np.uint64) * _A) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def band_tuples(sets: np.ndarray, bounds: np.ndarray, rows: int, tables: int) -> np.ndarray:
    """2*tables tuple hashes of each set; the first half is one collection, the second the other.  Empty sets: zeros."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, 2 * tables), np.int64)
    if len(full):
        x, at = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32), bounds[full]
        mult = _multipliers(2 * tables * rows)
        for k in range(2 * tables):
            h = np.full(len(full), k + 1, np.uint64) * _A
            for r in range(rows):
                h = mix64(h * _B + np.minimum.reduceat(x * mult[k * rows + r], at).astype(np.uint64))
            out[full, k] = h.view(np.int64)
    return out


def signatures(docs: DataFrame, size: int, rows: int, tables: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, tuples): h1, h2 are equal for equal sets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets, bounds = shingle_sets(texts[a:b], size)
                sums = np.zeros((2, len(sets) + 1), np.uint64)
                np.cumsum(mix64(sets ^ _B), out=sums[0, 1:])
                np.cumsum(mix64(sets + _A), out=sums[1, 1:])
                sums = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
                tuples = pa.FixedSizeListArray.from_arrays(pa.array(band_tuples(sets, bounds, rows, tables).ravel()), 2 * tables).cast(pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(sums[1]), tuples], names=["doc_id", "n_shingles", "h1", "h2", "tuples"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, h1 long, h2 long, tuples array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, text) joined to wanted, which has a column doc_id; few ids are broadcast, many are shuffled."""
    ids = wanted.select("doc_id").distinct()
    if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                h, bounds = shingle_sets(texts[a:b], size)
                raw, at = memoryview(h.tobytes()), (8 * bounds).tolist()
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([bytes(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["a", "b", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                lo, hi = sorted((len(x), len(y)))
                if 100 * lo >= percent * hi > 0:
                    both = np.concatenate([x, y])
                    both.sort()
                    inside = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok[i] = 100 * inside >= percent * (lo + hi - inside)
            yield batch.select([0, 1]).filter(pa.array(ok))

    # The second document's set travels once per pair, the first one's once.
    second = map_arrow(texts_of(docs, pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("other"))).select("doc_id", "text", "other"), sets, "b long, a long, s binary")
    first = map_arrow(texts_of(docs, pairs.select(F.col("a").alias("doc_id")).distinct()).select("doc_id", "text", F.col("doc_id").alias("same")), sets, "a long, same long, s binary")
    met = second.select("a", "b", F.col("s").alias("sb")).hint("merge").join(first.select("a", F.col("s").alias("sa")), "a")
    return map_arrow(met.select("a", "b", "sa", "sb"), compare, "a long, b long").distinct()


def prefix_pairs(opened: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs (a, b) of opened documents (doc_id, c) of different c that can reach percent, by prefix filtering.

    Shingles are ordered from rare to frequent.  Sets that reach the limit share one of
    the first n - ceil(percent * n / 100) + 1 shingles of either, and what they can share
    at most follows from its positions; both conditions are exact.  Of a shingle's
    documents, those of its most frequent c are held against the others only.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                h, bounds = shingle_sets(texts[a:b], size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(bounds)), lists], names=["doc_id", "c", "n", "h"])

    whole = saved(map_arrow(texts_of(docs, opened).select("doc_id", "text", "c"), sets, "doc_id long, c long, n long, h array<long>"), "sets")
    each = whole.select("doc_id", "c", "n", F.explode("h").alias("x"))
    shared = each.groupBy("x").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("f > 1")
    ordered = each.join(shared, "x").groupBy("doc_id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x", (F.col("lo") < F.col("hi")).alias("mixed")))).alias("s"))
    # Shingles of this document alone come first and meet nobody.
    alone = F.col("n") - F.size("s")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefix = ordered.where(length > 0).withColumn("alone", alone).select("doc_id", "c", "n", "alone", F.posexplode(F.slice("s", 1, F.greatest(length, F.lit(1)).cast("int"))).alias("k", "e"))
    prefix = saved(prefix.where("e.mixed").select(F.col("e.x").alias("x"), "doc_id", "c", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("rest")), "prefixes")
    main = prefix.groupBy("x", "c").agg(F.count("*").alias("f")).groupBy("x").agg(F.max(F.struct("f", "c")).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("x", F.col("m.c").alias("main"))
    left = prefix.join(main, "x").where("c <> main")
    right = prefix.select("x", F.col("doc_id").alias("other"), F.col("c").alias("oc"), F.col("n").alias("on"), F.col("rest").alias("orest"))
    fits = F.expr(f"c <> oc and (oc = main or doc_id < other) and 100 * least(n, on) >= {percent} * greatest(n, on) and {100 + percent} * least(rest, orest) >= {percent} * (n + on)")
    met = left.hint("merge").join(right, "x").where(fits)
    return met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def link_components(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 3, tables: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = saved(signatures(docs, size, rows, tables), "signatures")
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    lone = base.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    members = base.where("doc_id is not null").join(classes, ["n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("tuples")).alias("tuples"))
    members = saved(members, "members")

    reps = members.where("tuples is not null").select("doc_id", "tuples")
    each = reps.select("doc_id", F.posexplode("tuples").alias("k", "h"))
    shared = each.groupBy("k", "h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k", "h")
    kept = each.join(shared, ["k", "h"]).groupBy("doc_id").agg(F.collect_set(F.when(F.col("k") < tables, F.struct("k", "h"))).alias("us"), F.collect_set(F.when(F.col("k") >= tables, F.struct("k", "h"))).alias("vs"))
    keys = saved(kept.select("doc_id", "vs", F.explode("us").alias("u")).select("doc_id", "u", F.explode("vs").alias("v")).select(F.xxhash64("u", "v").alias("key"), "doc_id"), "keys")

    # Two centres of each bucket: the smallest id, and the smallest set, which is nearest to what all have in common.
    sized = keys.join(members.where("tuples is not null").select("doc_id", "n_shingles"), "doc_id")
    centres = sized.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("n_shingles", "doc_id")).alias("least")).where("lo < hi")
    stars = keys.join(centres.select("key", F.explode(F.array_distinct(F.array("lo", "least.doc_id"))).alias("c")), "key").where("doc_id <> c")
    pairs = saved(stars.select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")).distinct(), "pairs")
    links = saved(confirmed(pairs, docs, size, percent), "links")
    parts = saved(components(links), "parts")

    # What is left: documents of buckets that hold two or more components.
    named = keys.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    open_keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    opened = saved(named.join(open_keys, "key").select("doc_id", "c").distinct(), "open")
    more = saved(prefix_pairs(opened, docs, size, percent).join(pairs, ["a", "b"], "left_anti"), "more")
    parts = components(links.union(confirmed(more, docs, size, percent)))

    whole = members.select("doc_id", "n_shingles", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).union(lone)


def near_duplicates_removed(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns: one of each component, the smallest id; rows without an id are all kept.

    Where ids repeat, rows of equal id and text are one document, of which one row is kept, and rows of equal id and
    different texts are different documents: they are told apart by a hash of both."""
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    own = free_name(docs, "dropped")
    if ids.where("n > 1").limit(1).count() == 0:
        found = link_components(docs, size, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
        return docs.join(found, docs["doc_id"] == found[own], "left_anti")
    node = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    known = docs.where("doc_id is not null")
    nodes = saved(known.select(node.alias("node"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    found = link_components(known.select(node.alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias("node"), "component_id").distinct().join(nodes, "node")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("m")).select(F.col("m.node").alias(own))
    kept = known.join(first, node == first[own], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = kept.select(*columns, node.alias(own)).dropDuplicates([own]).select(*columns)
    return kept.union(docs.where("doc_id is null"))
