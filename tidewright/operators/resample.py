"""Band-limited resampling of clips in chunks, so that a long clip is many rows.

A clip at rate ``old`` becomes floor(samples * new / old) samples at rate ``new``.  Sample n lies at n * old / new of the
old ones and is the sum of those around it, weighted by a sinc under a Hann window whose band ends a little below half of
the lower rate; as new / old is a fraction, few sets of weights (phases) serve all samples.  Weights of a sample sum to 1;
beyond its ends a clip is silent.

Chunks are rows (id, k, total, pcm): the k-th ``size`` samples of a clip of ``total`` ones.  Each chunk needs some
samples of the chunks beside it; these are dealt by (id, k), so no task meets a whole clip.  Results do not depend on the
size.  Null and empty clips become empty ones.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Zero crossings of the kernel on each side, the share of the band that passes, and samples of a chunk.
CROSSINGS, ROLLOFF, SIZE = 16, 0.95, 1 << 16
#: Phases whose weights are kept as a table.
_PHASES = 4096


class Kernel:
    """The weights for one pair of rates."""

    def __init__(self, old: int, new: int) -> None:
        if old < 1 or new < 1:
            raise ValueError("rates are positive numbers")
        d = math.gcd(old, new)
        self.up, self.down = new // d, old // d
        self.band = min(1.0, new / old) * ROLLOFF
        self.reach = math.ceil(CROSSINGS / self.band)
        self.table = self.weights(np.arange(self.up)) if self.up <= _PHASES else None

    def weights(self, phases: np.ndarray) -> np.ndarray:
        """By phase: the weights of the samples from reach - 1 before the sample's place to reach after it."""
        x = (phases / self.up)[:, None] - np.arange(1 - self.reach, self.reach + 1)[None, :]
        h = np.sinc(self.band * x) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / self.reach, -1, 1)))
        return h / h.sum(1, keepdims=True)

    def length(self, total: int) -> int:
        return total * self.up // self.down

    def range(self, first: int, last: int, total: int) -> tuple[int, int]:
        """The new samples whose place lies among the old ones first .. last-1 of a clip."""
        return -(-first * self.up // self.down), min(self.length(total), -(-last * self.up // self.down))

    def chunk(self, pcm: np.ndarray, left: np.ndarray, right: np.ndarray, first: int, total: int) -> np.ndarray:
        """The new samples of a chunk that begins at old sample ``first``, given samples beside it."""
        begin, end = self.range(first, first + len(pcm), total)
        x = np.zeros(len(pcm) + 2 * self.reach)
        left, right = left[-self.reach :], right[: self.reach]
        x[self.reach - len(left) : self.reach] = left
        x[self.reach : self.reach + len(pcm)] = pcm
        x[self.reach + len(pcm) : self.reach + len(pcm) + len(right)] = right
        out = np.zeros(max(0, end - begin))
        around = np.arange(1 - self.reach, self.reach + 1)
        for b in range(begin, end, 4096):
            n = np.arange(b, min(b + 4096, end))
            place, phase = n * self.down // self.up, n * self.down % self.up
            near = x[(place - first + self.reach)[:, None] + around[None, :]]
            weights = self.table[phase] if self.table is not None else self.weights(phase)
            out[b - begin : b - begin + len(n)] = (near * weights).sum(1)
        return np.clip(np.floor(out + 0.5), -32768, 32767).astype(np.int16)


@lru_cache(16)
def kernel(old: int, new: int) -> Kernel:
    return Kernel(old, new)


CHUNKS = "k long, total long, pcm array<smallint>"


def chunked(clips: DataFrame, size: int = SIZE) -> DataFrame:
    """clips (pcm, ...) as chunks (k, total, pcm, ...); an empty or null clip is one empty chunk."""
    total = F.coalesce(F.size("pcm"), F.lit(0))
    total = F.when(total < 0, 0).otherwise(total).cast("long")
    known = clips.withColumn("total", total)
    last = F.greatest(F.lit(0), F.floor((F.col("total") - 1) / size)).cast("long")
    each = known.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    part = F.slice("pcm", (F.col("k") * size + 1).cast("int"), F.lit(size))
    return each.withColumn("pcm", F.coalesce(part, F.array().cast("array<smallint>")))


def wav_chunks(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """(path, rate, channels, bits, k, total, pcm): the last channel of WAV files in chunks; other than 16-bit samples are none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    channels, total = w.getnchannels(), w.getnframes() if w.getsampwidth() == 2 else 0
                    head = (name, w.getframerate(), channels, 8 * w.getsampwidth())
                    for k in range(max(1, -(-total // size))):
                        raw = np.frombuffer(w.readframes(size) if total else b"", "<i2").reshape(-1, channels)[:, -1]
                        yield pd.DataFrame([(*head, k, total, raw.tolist())], columns=["path", "rate", "channels", "bits", "k", "total", "pcm"])

    ship(spark)
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInPandas(run, f"path string, rate int, channels int, bits int, {CHUNKS}")


def resampled_chunks(chunks: DataFrame, rate: int, key: str = "id", size: int = SIZE, most_rate: int = 1 << 20) -> DataFrame:
    """Chunks (key, rate, k, total, pcm) at another rate: (key, rate, k, first, pcm), first the place of a chunk's first
    sample in its clip.  A chunk must be longer than the kernel reaches for rates up to ``most_rate``."""
    spark = chunks.sparkSession
    ship(spark)
    # A chunk's neighbours need its ends only.
    reach = math.ceil(CROSSINGS / ROLLOFF * max(1.0, most_rate / rate))
    reach = min(reach, size)
    rows = chunks.select(F.col(key).alias("key"), F.col("rate").alias("old"), "k", "total", "pcm")
    none = F.lit(None).cast("array<smallint>")
    tail = F.slice("pcm", F.greatest(F.lit(1), F.size("pcm") - reach + 1), F.lit(reach))
    sides = F.explode(F.array(
        F.struct(F.col("k").alias("at"), F.col("pcm").alias("own"), none.alias("left"), none.alias("right")),
        F.struct((F.col("k") + 1).alias("at"), none.alias("own"), tail.alias("left"), none.alias("right")),
        F.struct((F.col("k") - 1).alias("at"), none.alias("own"), none.alias("left"), F.slice("pcm", 1, reach).alias("right")),
    ))
    dealt = rows.select("key", "old", "total", sides.alias("x")).select("key", "old", "total", "x.*")
    one = {c: F.first(c, ignorenulls=True).alias(c) for c in ("own", "left", "right")}
    whole = dealt.groupBy("key", "old", "total", "at").agg(*one.values()).where("own is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            firsts, cells = [], []
            for old, total, at, own, left, right in zip(part["old"], part["total"], part["at"], part["own"], part["left"], part["right"], strict=True):
                use = kernel(int(old), rate)
                if use.reach > size and total > size:
                    raise ValueError(f"chunks of {size} samples are shorter than the kernel for {old} Hz")
                side = [np.zeros(0) if s is None else np.asarray(s, np.float64) for s in (left, right)]
                firsts.append(use.range(int(at) * size, int(at) * size, int(total))[0])
                cells.append(use.chunk(np.asarray(own, np.float64), *side, int(at) * size, int(total)))
            yield pd.DataFrame({"key": part["key"], "rate": rate, "k": part["at"], "first": firsts, "pcm": cells})

    kind = dict(rows.dtypes)["key"]
    out = whole.mapInPandas(run, f"key {kind}, rate int, k long, first long, pcm array<smallint>")
    return out.withColumnRenamed("key", key)


def resampled(clips: DataFrame, rate: int) -> DataFrame:
    """Whole clips (rate, pcm, ...) at another rate, by the same kernel: for clips that fit a row."""
    ship(clips.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cells = []
            for old, pcm in zip(part["rate"], part["pcm"], strict=True):
                x = np.zeros(0) if pcm is None else np.asarray(pcm, np.float64)
                cells.append(x.astype(np.int16) if old == rate else kernel(int(old), rate).chunk(x, x[:0], x[:0], 0, len(x)))
            yield part.assign(rate=rate, pcm=cells)

    return clips.mapInPandas(run, clips.schema)
