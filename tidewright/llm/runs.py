"""Periodic runs of words: heavy/light lag counting, then island scans.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, 2 * q)`` words
that no neighbouring word extends.  Lags are taken in ranges [P, 2P).  A run of period p in that range has
p words or more in a row that equal the word p places on, so its sequences of P/2 words repeat p places on
too: these grams are what is counted.  Per lag the number of equal grams is counted exactly, by Fourier
autocorrelation of each gram so frequent that its pairs could cost more than a transform (heavy), and by
position differences of all others (light).  Only lags with enough equal grams are scanned for islands.
What known runs add to the multiples of their periods is taken off first, so a long run costs no further
scans; its inside, which no run of a longer period can reach, is not counted at all.  When no gram occurs
twice, no longer period can exist and the text is done.

Null and empty texts have no words, hence no runs.  Every row is worked on by itself: rows of equal id or
text give equal results, null ids are kept, extra columns are not read, an empty table gives an empty one.
Runs are listed by start, then period; of the longest runs the one with the smallest start, then period,
comes first.  A text is one row of one task: memory follows the longest text, not the table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Fixed value: the least number of words of a run.
LEAST = 12
#: Lags below this are the first range, counted over grams of 4 words; a run of any of them repeats 6 or more words.
FIRST = 16
#: A gram is heavy if its pairs within the range's largest lag could be more than this many times the text's words.
HEAVY = 32

RUNS = "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def codes_of(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    known = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _doubled(grams: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the grams of 2k words from those of k words."""
    if len(grams) <= k:
        return grams[:0]
    return np.unique(grams[:-k] * (grams.max() + 1) + grams[k:], return_inverse=True)[1]


def _heavy_lags(at: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
    """How often positions in ``at`` lie low .. high-1 apart: Fourier autocorrelation, in blocks of some lags' length."""
    block = min(n, max(2 * high, 1 << 15))
    size = 1 << (block + high).bit_length()
    present = np.zeros(n + high, np.float64)
    present[at] = 1
    out = np.zeros(high - low, np.int64)
    for b in range(0, n, block):
        here = present[b : min(b + block, n)]
        if here.any():
            ahead = np.fft.rfft(present[b : b + block + high], size)
            both = np.fft.irfft(ahead * np.conj(np.fft.rfft(here, size)), size)
            out += np.rint(both[low:high]).astype(np.int64)
    return out


def lag_counts(grams: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each lag from low to high-1 the number of places whose gram is the same that many places on;
    negative numbers are no grams."""
    n, out = len(grams), np.zeros(high - low, np.int64)
    at = np.flatnonzero(grams >= 0)
    counts = np.bincount(grams[at], minlength=1)
    heavy = counts * np.minimum(counts, high) > HEAVY * n
    for g in np.flatnonzero(heavy):
        out += _heavy_lags(np.flatnonzero(grams == g), n, low, high)
    at = at[((counts > 1) & ~heavy)[grams[at]]]
    at = at[np.argsort(grams[at], kind="stable")]
    kind, d = grams[at], 1
    while d < len(at):
        apart = at[d:] - at[:-d]
        near = (kind[d:] == kind[:-d]) & (apart < high)
        if not near.any():  # the next ones of a gram are farther still
            break
        out += np.bincount(apart[near & (apart >= low)] - low, minlength=high - low)
        d += 1
    return out


def islands(codes: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of ``least`` or more words that equal the word ``lag`` places on."""
    same = np.zeros(len(codes) - lag + 2, np.int8)
    same[1:-1] = codes[lag:] == codes[:-lag]
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    keep = lengths >= least
    return starts[keep], lengths[keep]


def find_runs(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    n = len(codes)
    found: dict[tuple[int, int], int] = {}
    grams, k, low, high = codes, 1, 1, FIRST
    while 2 * low <= n and n >= LEAST:
        while k < (4 if low == 1 else low // 2):
            grams, k = _doubled(grams, k), 2 * k
        if not len(grams) or np.bincount(grams).max() < 2:
            break
        top = min(high, n // 2 + 1)
        # A run of a period p in this range shares less than p plus q words with one of period q: none of its grams
        # lies farther than 3 * low places from both ends of that one.
        edge, counted, known = 3 * low, grams, []
        for (start, length), period in found.items():
            size = length - k + 1
            if inside := size > 2 * (edge + low):
                counted = counted.copy() if counted is grams else counted
                counted[start + edge : start + size - edge] = -1
            known.append((size, period, inside))
        matches = lag_counts(counted, low, top)

        def subtract(size: int, period: int, inside: bool) -> None:
            """Takes off what a run of ``size`` grams adds to multiples of its period; with its inside left out, two edges."""
            first = max(-(-low // period), 1) * period
            lags = np.arange(first, min(top, edge if inside else size), period)
            matches[lags - low] -= 2 * (edge - lags) if inside else size - lags

        for run in known:
            subtract(*run)
        lags = np.arange(low, top)
        enough = np.maximum(lags, LEAST - lags) - k + 1
        for lag in lags[matches >= enough].tolist():
            least = max(lag, LEAST - lag)
            if matches[lag - low] < least - k + 1:  # runs that were found since
                continue
            for start, size in zip(*(x.tolist() for x in islands(codes, lag, least)), strict=True):
                if (start, size + lag) not in found:  # else lag is a multiple of its smallest period
                    found[start, size + lag] = lag
                    subtract(size + lag - k + 1, lag, False)
        low, high = high, 2 * high
    rows = sorted((start, length, period) for (start, length), period in found.items())
    rows.sort(key=lambda r: (r[0], r[2]))
    return np.array(rows, np.int64).reshape(-1, 3)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(change, runs[:, 0] + runs[:, 1], 1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """(doc_id, runs, collapsed): each text's runs of words, and its words without the repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, collapsed = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # at spaces and 0x09 to 0x0D
                runs = find_runs(codes_of(words))
                if len(runs):
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                cells.append(runs)
                collapsed.append(b" ".join(words).decode("utf-8", "replace"))
            flat = np.concatenate([*cells, np.zeros((0, 3), np.int64)])
            ends = np.zeros(len(cells) + 1, np.int32)
            np.cumsum([len(c) for c in cells], out=ends[1:])
            each = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends), each)
            yield pa.record_batch([batch.column(0), lists, pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), run, RUNS)


def with_repeated_tail(doc_id: Column, text: Column) -> Column:
    """Texts whose tail repeats with a period, for one in ten ids, as test cases; the others are as they are.

    With h = crc32(id), g = floor(h / 10), if h % 10 = 0: each word i >= a becomes word a + (i - a) % p of the n
    words, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(cell: Column) -> Column:
        words, a, g = cell["words"], cell["a"], cell["g"]
        rest = F.size(words) - a
        p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), rest - 1), lambda i: F.get(words, a + i % p))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

    # An array of one cell, so that each step is worked out once.
    step = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), (g % F.size(w)).cast("int").alias("a"), g.alias("g")))
    made = F.transform(step, repeated)[0]
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), made).otherwise(text)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, id_col, text_col)
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).otherwise(
        F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.signum(x["period"] - y["period"]).cast("int"))))
    first = F.get(best, F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("first", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "first.start",
        "first.length",
        "first.period",
        F.floor(F.col("first.length") * 1000 / F.col("first.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
