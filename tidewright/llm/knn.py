"""Exact top-k inner-product search with multi-resolution segment statistics.

Components become whole numbers floor(64 * x).  A vector is cut into segments; per
segment its mean and its deviation (root of the summed squares around the mean)
are kept, for few long segments first and for more and shorter ones then.  With
segments of length L, the squared distance of q and x is at least the sum over
segments of L * (mean_q - mean_x)**2 + (dev_q - dev_x)**2; as the norms are known,
this bounds the inner product from above.  From coarse to fine, only candidates whose
bound reaches the k-th best score found so far go on to the next resolution, where the
survivors with the best bounds may raise it; what survives the finest is scored exactly.

Queries and candidates are dealt into blocks of bounded size, and each pair of
blocks is one task's group; per query and block at most k rows go on.

Vectors that are null, or hold null or non-finite components, and rows without an
id take no part; shorter vectors count as filled up with zeros.  A candidate with
the query's id is the query's own row.  Ties go to the smaller id; candidates with
repeated ids are candidates each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Queries of a block that are worked on at once.
LANES = 128
#: Share of surviving pairs above which a resolution is evaluated as one matrix product.
DENSE = 0.1


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.where(v.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("v"))


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, by rising id."""
    cells = table.column("v").combine_chunks()
    ids = table.column("vec_id").to_numpy()
    sizes = np.diff(cells.offsets.to_numpy())
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), width), np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(L) * means and deviations of the segments of each row."""
    parts = np.array_split(np.arange(x.shape[1]), segments)
    means = np.stack([x[:, p].mean(1) for p in parts], 1)
    devs = np.stack([np.sqrt(((x[:, p] - m[:, None]) ** 2).sum(1)) for p, m in zip(parts, means.T, strict=True)], 1)
    return means * np.sqrt([len(p) for p in parts]), devs


def _bounds(stat: list[np.ndarray], a: int, b: int) -> np.ndarray:
    """Upper bounds of the inner products of queries a to b with all candidates.

    The lower bound of the squared distance is |q|^2 + |x|^2 - 2 * (means and deviations of q) . (those of x)."""
    return stat[0][a:b] @ stat[1].T


def _raised(floor: np.ndarray, bound: np.ndarray | None, alive: np.ndarray, q: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The floor after exact scores of the n survivors of each query with the best bounds of this resolution."""
    if bound is None:
        return floor
    near = np.argpartition(np.where(alive, -bound, np.inf), n - 1, axis=1)[:, :n]
    score = np.einsum("qd,qkd->qk", q, c[near]).astype(np.float64)
    score[~np.take_along_axis(alive, near, 1)] = -np.inf
    return np.maximum(floor, score.min(1))


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best in one block of candidates, which rise by id."""
    width = c.shape[1]
    largest = max(abs(int(f(a))) for a in (q, c) for f in (np.min, np.max))
    exact = np.float64 if largest**2 * width < 2**53 else np.int64
    qx, cx = q.astype(exact), c.astype(exact)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    levels = [s for s in (1, 4, 16) if s < width]
    stats = [[np.hstack(segment_statistics(x, s)) for x in (qf, cf)] for s in levels]
    q2, c2 = (qf**2).sum(1), (cf**2).sum(1)
    out = []
    for a in range(0, len(q), LANES):
        b = min(a + LANES, len(q))
        own = c_ids[None, :] == q_ids[a:b, None]
        alive = ~own
        n = min(k, len(c))
        if levels and len(c) > 4 * k:
            # Exact scores of the k that look nearest at the coarsest resolution give a first floor.
            near = np.argpartition(-_bounds(stats[0], a, b), n - 1, axis=1)[:, :n]
            score = np.einsum("qd,qkd->qk", qx[a:b], cx[near]).astype(np.float64)
            score[np.take_along_axis(own, near, 1)] = -np.inf
            floor = score.min(1)
            for level, stat in enumerate(stats):
                if alive.mean() > DENSE:
                    bound = _bounds(stat, a, b)
                    alive &= bound + 1e-9 * (q2[a:b, None] + c2[None, :]) + 1e-3 >= floor[:, None]
                else:
                    qi, ci = np.nonzero(alive)
                    bound = np.einsum("nd,nd->n", stat[0][a + qi], stat[1][ci])
                    far = bound + 1e-9 * (q2[a + qi] + c2[ci]) + 1e-3 < floor[qi]
                    alive[qi[far], ci[far]] = False
                if level + 1 < len(stats):
                    floor = _raised(floor, bound if bound.ndim == 2 else None, alive, qx[a:b], cx, n)
        scores = qx[a:b] @ cx.T if alive.mean() > DENSE else None
        for i in range(b - a):
            at = np.flatnonzero(alive[i])
            got = scores[i, at] if scores is not None else cx[at] @ qx[a + i]
            if len(at) > k:
                limit = np.partition(got, len(got) - k)[len(got) - k]
                above, equal = np.flatnonzero(got > limit), np.flatnonzero(got == limit)
                pick = np.concatenate([above, equal[: k - len(above)]])
                at, got = at[pick], got[pick]
            out.append((np.full(len(at), q_ids[a + i]), c_ids[at], got.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, v) of whole vectors."""
    n_q, w_q = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    n_c, w_c = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(w_q or 1, w_c or 1, 1)
    q_blocks, c_blocks = max(1, math.ceil(n_q / QUERY_BLOCK)), max(1, math.ceil(n_c / CANDIDATE_BLOCK))

    def deal(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(blocks)).cast("int")
        return rows.select("vec_id", "v", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        return pa.table(best_of_block(*_matrix(left, width), *_matrix(right, width), k), schema=schema)

    ship(queries.sparkSession)
    met = deal(queries, "qb", q_blocks, "cb", c_blocks).groupBy("qb", "cb").cogroup(deal(candidates, "cb", c_blocks, "qb", q_blocks).groupBy("qb", "cb"))
    found = met.applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
