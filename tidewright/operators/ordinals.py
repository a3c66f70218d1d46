"""Ordinals over a whole table without gathering it: range partitions, their sizes, prefix sums, local numbers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_PLACE = 33


def numbered(rows: DataFrame, order: list[str | Column], column: str = "n", first: int = 1, partitions: int | None = None) -> DataFrame:
    """rows with the number of each row in the given order, a long from ``first`` on.

    Rows are dealt to partitions by ranges of the order, sorted there and written with their places; a partition's
    numbers begin after the sizes of all partitions before it, one number a partition.  Rows that tie in the whole order
    are numbered one after another in the order they were read; a last key of their own lets many ties be dealt to
    several partitions.  The table is written once, so numbers stay the same for all that read them.
    ``partitions`` fixes the number of partitions, which else follows the size of the data.
    """
    place, tie = f"_place_{column}", f"_tie_{column}"
    # Order columns by name, so that ranges and sort see the same values once.
    keys = {f"_key_{column}_{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(order)}
    known = rows.withColumn(tie, F.monotonically_increasing_id()).withColumns(keys)
    sort = [F.col(k).asc_nulls_first() for k in (*keys, tie)]
    dealt = known.repartitionByRange(partitions, *sort) if partitions else known.repartitionByRange(*sort)
    placed = dealt.sortWithinPartitions(*sort).withColumn(place, F.monotonically_increasing_id()).drop(*keys, tie)
    table = saved(placed, "ordinals")
    part = F.shiftright(place, _PLACE)
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    bases = [(p, b + first) for (p, _), b in zip(sizes, before, strict=False)]
    base = table.sparkSession.createDataFrame(bases, "_part long, _base long")
    # One row a partition.
    joined = table.join(F.broadcast(base), part == F.col("_part"))
    number = F.col("_base") + F.col(place).bitwiseAND(F.lit((1 << _PLACE) - 1))
    return joined.withColumn(column, number).drop("_part", "_base", place)
