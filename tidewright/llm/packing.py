"""Packing by concatenating and cutting.

Documents are tokenised once into a written table, partition by partition, each
with the number of tokens before it in its partition.  A second pass turns the
partitions' totals into global offsets (prefix sums); every document is then cut
where fixed windows end, and each piece is a boundary record of its window.
Only the last sequence is not full.

Null texts count as empty: such a document is its end id alone.  Repeated rows
are packed once each.  Other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_signs
from .common import map_arrow, saved, tokenizer_path
from .textops import WordTable, byte_bpe_ids, slices


@lru_cache(2)
def _words(path: str) -> tuple[WordTable, int, str]:
    """Words are encoded by a library that takes the file's vocabulary as ranks."""
    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    signs, vocab = byte_signs(), spec["model"]["vocab"]
    special = spec["added_tokens"][0]
    ranks = {bytes(signs[c] for c in word): i for word, i in vocab.items() if i != special["id"]}
    core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [core.encode_ordinary(w) for w in words]
        return np.fromiter((i for ids in got for i in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    return WordTable(encode), special["id"], special["content"]


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, before, n, ids): the ids of each document with its end id, as 16-bit integers
    (32-bit, if the vocabulary is larger), and the tokens before it in its partition."""
    small = 1 + max(json.load(open(path, encoding="utf-8"))["model"]["vocab"].values()) < 65536
    kind = "<u2" if small else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, special_id, special = _words(path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, bounds = byte_bpe_ids(texts[a:b], table, special, special_id)
                ids = np.insert(ids, bounds[1:], end_id).astype(kind)
                bounds = bounds + np.arange(len(bounds))
                raw, width = memoryview(ids.tobytes()), ids.itemsize
                at = (width * bounds).tolist()
                cells = pa.array([bytes(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                n = b - a
                yield pa.record_batch([batch.column(0).slice(a, n), pa.array(np.full(n, part, np.int32)), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), cells], names=["doc_id", "part", "before", "n", "ids"])
                before += int(bounds[-1])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(kept, run, "doc_id long, part int, before long, n long, ids binary")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    table = saved(tokenised(docs, path, end_id, id_col, text_col), "tokens")
    # One number per partition, whatever the number of documents.
    totals = sorted(table.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, bases = 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    bases = spark.createDataFrame(bases, "part int, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, first, n, cells = (batch.column(k) for k in range(4))
            first, n = first.to_numpy(), n.to_numpy()
            lo, hi = first // window, (first + n - 1) // window
            pieces = hi - lo + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = np.repeat(lo - (np.cumsum(pieces) - pieces), pieces) + np.arange(len(row))
            begin = np.maximum(sequence * window, first[row])
            end = np.minimum((sequence + 1) * window, (first + n)[row])
            start, length = begin - first[row], end - begin
            for a in range(0, len(row), 2000):
                b = min(len(row), a + 2000)
                ids, last, now = [], -1, None
                for r, s, k in zip(row[a:b].tolist(), start[a:b].tolist(), length[a:b].tolist(), strict=True):
                    if r != last:
                        raw = cells[r].as_buffer()
                        now, last = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[r] else "<u4").astype("<u4"), r
                    ids.append(now[s : s + k].tobytes())
                out = [doc.take(pa.array(row[a:b])), pa.array(start[a:b]), pa.array(length[a:b]), pa.array(ids, pa.binary()), pa.array(n[row[a:b]]), pa.array(sequence[a:b]), pa.array((begin - sequence * window)[a:b])]
                yield pa.record_batch(out, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    return map_arrow(placed, cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
