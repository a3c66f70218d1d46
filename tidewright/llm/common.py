"""Written tables, tokenizer files and connected components for this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import discard, saved, shared_folder, ship

__all__ = ["components", "discard", "free_name", "map_arrow", "saved", "shared_folder", "ship", "tokenizer_path"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


#: Bytes of one Arrow batch, where the session has Spark's own default (64 MB): a task holds a batch several times over.
BATCH_BYTES, DEFAULT_BYTES = "8m", "67108864b"


def _released(run, batches: Iterator) -> Iterator:
    """What run gives; then freed memory goes back to the system, as Python workers are used again by other stages."""
    yield from run(batches)
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with the package at hand on the executors."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    ship(spark)
    if spark.conf.get(key) == DEFAULT_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    return df.mapInArrow(partial(_released, run), schema)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), longs: rows (node, component), component the smallest node.

    Alternating large-star and small-star rounds: each points nodes at smaller
    neighbours, with partial aggregation before every shuffle, so that a hub with
    very many neighbours costs no more than its edges.  Loops are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, edges = edges, saved(small.distinct(), "edges")
        discard(before)
        # Each round keeps the components; when no edge changes, every node points at its smallest.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
