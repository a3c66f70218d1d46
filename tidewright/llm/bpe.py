"""BPE encoding and decoding of whole texts by per-prefix dynamic programming.

Null texts count as empty; an empty text has no ids.  Repeated rows and repeated
ids each give a row.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import PrefixEncoder, encoder
from .common import map_arrow, tokenizer_path
from .textops import WordTable, byte_bpe_ids, slices


@lru_cache(2)
def _tools(path: str) -> tuple[PrefixEncoder, WordTable]:
    own = encoder(path)
    return own, WordTable(own.encode_words)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as little-endian unsigned 32-bit integers) of every row of docs."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, ids, bounds in _encoded(batches, path):
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "ids"])

    kept = docs.select(F.col(id_col), F.col(text_col))
    return map_arrow(kept, run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids); bytes that are not UTF-8 become replacement characters."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _tools(path)
        for batch in batches:
            texts = [own.decode_bytes(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kept = encoded.select(F.col(id_col), F.col("ids"))
    return map_arrow(kept, run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, text string")


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding, then decoding of the ids, as digests.

    Both steps are those of encode_documents and decode_documents, on the same
    slice of rows, so that ids do not travel between them.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _tools(path)
        for batch, _, ids, bounds in _encoded(batches, path):
            raw = memoryview(ids.astype("<u4").tobytes())
            text = own.decode_bytes(ids)
            sizes = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(own.shown_length[ids], out=sizes[1:])
            text, cuts, bounds = memoryview(text), sizes[bounds].tolist(), bounds.tolist()
            sha_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sha_text = [hashlib.sha256(bytes(text[a:b]).decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(sha_ids), pa.array(sha_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(kept, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple]:
    own, table = _tools(path)
    special_id, special = next(iter(own.added.items()))
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            ids, bounds = byte_bpe_ids(texts[a:b], table, special, special_id)
            yield batch.slice(a, b - a), texts[a:b], ids, bounds
