"""Trigram models with back-off: counts, probabilities and scores as joins, longest history first.

Probabilities are discounted by ``discount`` per distinct gram.  What is taken from the grams of a history is left to the
shorter history: log p(c | a b) is that of the trigram if it was seen, else the back-off weight of (a b) plus
log p(c | b); and so on down to single words, where the rest is the share of all words that were never seen.
Histories that were never seen have the weight 0.  Logarithms are natural.

Texts are cut at white space (0x20, 0x09 to 0x0D); null and empty texts have no words.  A text's grams are dealt out once,
by their middle word, and a model's tables are plans over that one shuffle: the grams of a word lie in one task, so the
most frequent word's share of all words is the largest task's.  Scores read only those rows of a model that are asked for.
Scores of many grams by large texts need no model: ``scores_of_texts`` sums what the grams ask for out of packed grams.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, saved, ship

DISCOUNT = 0.75
#: Words of texts that are dealt out together, and rows of a batch.
GRAMS, ROWS = 1 << 20, 10_000
SPACE = re.compile("[ \t-\r]+")
#: Grams whose keys are broadcast to the model's tables at most.
MOST_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _triples(words: Column) -> Column:
    """An array of (a, b, c) at every word of a list: the word and the two after it, null beyond the end."""
    # An array of the one list, so that it is worked out once; arrays_zip fills up with null.
    return F.transform(F.array(words), lambda w: F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.size(w)).alias("b"), F.slice(w, F.lit(3), F.size(w)).alias("c")))[0]


def counted(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, c, n): how often each word and the two after it occur; c, or b and c, are null at the end of a text."""
    cells = texts.select(F.explode(_triples(words_of(F.col(text_col)))).alias("x")).select("x.*")
    return cells.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def _dealt(texts: Iterator[str | None]) -> Iterator[tuple[list[str], list[str]]]:
    """Words b and for each the words around it, in blocks of GRAMS words or one text: "a c c ..." lines, the lines of one b
    in one string, an empty a or c where the text ends.  So a frequent word is sent once a block, not once a gram."""
    words: list[str] = []
    for text in itertools.chain(texts, [None]):
        if text is not None:
            words += ["", *filter(None, SPACE.split(text))]
            if len(words) < GRAMS:
                continue
        elif not words:
            continue
        coded = pa.array([*words, ""]).dictionary_encode()
        words, names, codes = [], coded.dictionary.to_pylist(), coded.indices.to_numpy()
        at = np.flatnonzero(codes[:-1])  # the empty word comes first, so it is 0
        b, a, c = codes[at], codes[at - 1], codes[at + 1]
        order = np.lexsort((c, a, b))
        b, a, last = b[order], a[order], [names[k] for k in c[order].tolist()]
        new_b = np.append(True, b[1:] != b[:-1]) if len(b) else np.zeros(0, bool)
        new = np.flatnonzero(new_b | np.append(True, a[1:] != a[:-1])) if len(b) else np.zeros(0, np.int64)
        lines = [f"{names[k]} {' '.join(last[x:y])}" for k, x, y in zip(a[new].tolist(), new.tolist(), [*new[1:].tolist(), len(b)])]
        first = np.flatnonzero(new_b[new]).tolist()
        yield [names[k] for k in b[new_b].tolist()], ["\n".join(lines[x:y]) for x, y in zip(first, [*first[1:], len(lines)])]


def centred(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(b, a, c, n): how often each word b occurs between the words a and c; a is null at the start of a text, c at its end.

    Grams are shuffled this one time, dealt by b: what a model asks of a gram is known where its middle word lies, but for
    the totals of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, around in _dealt(t for batch in batches for t in batch.column(0).to_pylist() if t is not None):
            for k in range(0, len(words), ROWS):
                yield pa.record_batch([pa.array(words[k : k + ROWS], pa.string()), pa.array(around[k : k + ROWS], pa.string())], names=["b", "around"])

    ship(texts.sparkSession)
    dealt = texts.select(F.col(text_col)).mapInArrow(run, "b string, around string").repartition("b")
    lines = dealt.select("b", F.explode(F.split("around", "\n", -1)).alias("line")).select("b", F.split("line", " ", -1).alias("w"))
    empty = lambda c: F.nullif(c, F.lit(""))
    cells = lines.select("b", F.col("w")[0].alias("a"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("c"))
    grams = cells.groupBy("b", "a", "c").agg(F.count("*").alias("n"))
    return grams.select("b", empty("a").alias("a"), empty("c").alias("c"), "n")


@dataclass
class Model:
    """words (c, p, bow), pairs (b, c, p, bow) and triples (a, b, c, p), tables of logarithms; bow is the weight of a
    history that backs off, null if nothing follows it; unseen is the log probability of an unknown word."""

    words: DataFrame
    pairs: DataFrame
    triples: DataFrame
    unseen: DataFrame


def model(texts: DataFrame, discount: float = DISCOUNT, text_col: str = "text") -> Model:
    """The model of texts.  Its tables are not written; all come out of the one shuffle of the grams, and a query runs
    what it reads of them."""
    if not 0 < discount < 1:
        raise ValueError("the discount lies between 0 and 1")
    counts = centred(texts, text_col)
    ones = counts.groupBy("b").agg(F.sum("n").alias("one"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("total"))
    size = ones.agg(F.sum("one").alias("_n"), F.count("*").alias("_kinds"))
    follows = F.col("c").isNotNull()
    # The probability of c after b, at each gram; windows within b need no shuffle.
    low = (F.sum("n").over(Window.partitionBy("b", "c")) - discount) / F.col("total")
    known = counts.join(ones, "b").withColumn("low", F.when(follows, low))
    # Each pair with its word's count, and the weight of its history: what it leaves over, by what the shorter history
    # gives to words not seen after it.
    left = discount * F.count("c") / F.sum(F.when(follows, F.col("n")))
    seen = known.where("a is not null").groupBy("b", "a").agg(F.sum("n").alias("n"), F.first("one").alias("one"), (left / (1 - F.sum("low"))).alias("bow"))
    pairs = seen.join(ones.select(F.col("b").alias("a"), "total"), "a").select(F.col("a").alias("b"), F.col("b").alias("c"), ((F.col("n") - discount) / F.col("total")).alias("p"), "bow")
    word = (F.col("one") - discount) / F.col("_n")
    sized = seen.join(F.broadcast(size), F.lit(True))  # one row
    by_word = sized.groupBy(F.col("a").alias("c")).agg((discount * F.count("*") / F.sum("n") / (1 - F.sum(word))).alias("bow"))
    words = ones.join(F.broadcast(size), F.lit(True)).select(F.col("b").alias("c"), word.alias("p"))
    own = Window.partitionBy("b", "a")
    triples = counts.where("c is not null").select("a", "b", "c", ((F.col("n") - discount) / F.sum("n").over(own)).alias("p")).where("a is not null")
    log = lambda c: F.log(c).alias(c)
    return Model(
        words.join(by_word, "c", "left").select("c", log("p"), log("bow")),
        pairs.select("b", "c", log("p"), log("bow")),
        triples.select("a", "b", "c", log("p")),
        size.select(F.log(discount * F.col("_kinds") / F.col("_n")).alias("unseen")),
    )


def scored(grams: DataFrame, by: Model, weight: float = 1.0, penalty: float = 1.0) -> DataFrame:
    """grams (a, b, c, ...) with logp and score of c after a and b, and used: how many words of the gram were found at once
    (0 for an unknown word).  A null a, or a and b, is a shorter history.  The score weighs logp and adds the log of the
    insertion penalty."""
    grams = saved(grams, "grams")
    few = grams.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST

    def of(table: DataFrame, **named: str) -> DataFrame:
        """The rows of a table that the grams ask for, with the grams' names of its columns."""
        table = table.select(*(F.col(c).alias(n) for c, n in named.items()))
        on = [n for n in named.values() if not n.startswith("_")]
        asked = grams.select(*on).distinct()
        return table.join(F.broadcast(asked) if few else asked, on, "left_semi")

    rows = grams.join(of(by.triples, a="a", b="b", c="c", p="_p3"), ["a", "b", "c"], "left")
    rows = rows.join(of(by.pairs, b="b", c="c", p="_p2"), ["b", "c"], "left")
    rows = rows.join(of(by.words, c="c", p="_p1"), "c", "left")
    rows = rows.join(of(by.pairs, b="a", c="b", bow="_w2"), ["a", "b"], "left")
    rows = rows.join(of(by.words, c="b", bow="_w1"), "b", "left")
    rows = rows.join(F.broadcast(by.unseen), F.lit(True), "left")  # one row
    low = F.coalesce("_p1", "unseen")
    middle = F.coalesce(F.col("_p2"), F.coalesce("_w1", F.lit(0.0)) + low)
    logp = F.coalesce(F.col("_p3"), F.coalesce("_w2", F.lit(0.0)) + middle)
    used = F.when(F.col("_p3").isNotNull(), 3).when(F.col("_p2").isNotNull(), 2).when(F.col("_p1").isNotNull(), 1).otherwise(0)
    return rows.select(*grams.columns, logp.alias("logp"), (logp * weight + F.log(F.lit(float(penalty)))).alias("score"), used.alias("used"))


def spoken_grams(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, c, n): each word c of texts with the two words before it, null before a text's first, and how often."""
    none = F.lit(None).cast("string")
    words = F.concat(F.array(none, none), words_of(F.col(text_col)))
    cells = texts.select(F.explode(_triples(words)).alias("x")).select("x.*").where("c is not null")
    return cells.groupBy("a", "b", "c").agg(F.count("*").alias("n"))

#: Words with a code of two bytes in the packed grams; 0 is any other word, sent by its hash.
CODED = (1 << 16) - 1
#: A word of which there is less than one among so many gets no code.
RAREST = 1 << 20
#: Distinct words of a block of which three codes fit into 63 bits.
FITTING = 1 << 21
#: Words of texts that are packed together, words in a bucket, buckets at most, words in a task, words from which buckets are cut by c.
PACKED, BUCKET, MOST_BUCKETS, TASK, CUT = 3 << 20, 1 << 16, 1 << 12, 1 << 21, 1 << 29
#: Bits of a word's hash.
HASHED = 64
#: What a bucket tells of the words before its own.
BEFORE = ["_h", "_one", "_kinds", "_total"]


def _hashes(words: list[bytes] | np.ndarray, key: int, bits: int) -> np.ndarray:
    """Odd hashes of words under a key; 0 is no word."""
    return (hash_array(np.array(words, object), hash_key=f"{key:016d}", categorize=False) >> np.uint64(64 - bits) | np.uint64(1)).view(np.int64)


def _coded(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct values of a column, the first of which is the empty word, and each row's code; null is the empty word."""
    column = pa.concat_arrays([pa.array([b""], pa.large_binary()), column.cast(pa.large_binary()).fill_null(b"")]).dictionary_encode()
    return column.dictionary.to_pylist(), column.indices.to_numpy()[1:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Distinct words and the codes of running texts, in blocks of PACKED words or one text; code 0 stands around each text."""
    parts, words, size = [], [], 0
    texts = (t for batch in batches for t in batch.column(0).cast(pa.large_binary()).to_pylist() if t)
    for text in itertools.chain(texts, [None]):
        if text is not None:
            words += [b"", *text.split()]  # bytes are cut at 0x20 and 0x09 to 0x0D
        if words and (text is None or len(words) >= GRAMS // 4):
            parts.append(pa.array(words, pa.large_binary()))
            size, words = size + len(words), []
        if parts and (text is None or size >= PACKED):
            yield _coded(pa.concat_arrays([*parts, pa.array([b""], pa.large_binary())]))
            parts, size = [], 0


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of values of each."""
    if not len(key):
        return (key, *values)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[first], *(np.add.reduceat(v[order], first) for v in values))


def _at(key: np.ndarray, asked: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of the asked keys among ordered ones, 0 where a key is missing."""
    k = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
    return [np.where(key[k] == asked, v[k], 0) if len(key) else np.zeros(len(asked), np.int64) for v in values]


def _packed(h: np.ndarray, codes: np.ndarray, top: np.ndarray, buckets: int, cuts: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, cut, grams) of a block of words with the hashes h: buckets by b, cuts by c; the grams of one b and of one a there stand together."""
    h[0] = 0
    bucket = (h >> 1) % buckets
    order = np.argsort(bucket[1:], kind="stable") + 1  # the empty word stays 0
    h, bucket = np.append(0, h[order]), np.append(-1, bucket[order])
    back = np.empty(len(h), np.int32)
    back[np.append(0, order)] = np.arange(len(h))
    codes = back[codes]
    rank = np.where(h == top[np.minimum(np.searchsorted(top, h), len(top) - 1)], np.searchsorted(top, h) + 1, 0).astype(np.uint16)
    at, m = np.flatnonzero(codes), len(h)
    for cut in range(cuts):
        x = at if cuts == 1 else at[(h[codes[at + 1]] >> 32) % cuts == cut]
        if not len(x):
            continue
        of, c = codes[x] * np.int64(m) + codes[x - 1], codes[x + 1]
        if m <= FITTING:
            of *= m  # in place, as blocks are what takes a task's memory
            of += c
            of.sort()
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            n = np.diff(np.append(first, len(of)))
            of = of[first]
            c = (of % m).astype(np.int32)
            of //= m
        else:  # three codes are too long for one number
            order = np.lexsort((c, of))
            of, c, n = of[order], c[order], np.ones(len(c), np.int64)
        g = np.flatnonzero(np.append(True, of[1:] != of[:-1]))  # each pair's first gram
        b, a = of[g] // m, of[g] % m
        p = np.flatnonzero(np.append(True, b[1:] != b[:-1]))  # each b's first pair
        s = np.flatnonzero(np.append(True, (x := bucket[b[p]])[1:] != x[:-1]))  # each bucket's first b
        more_g, more_p = np.append(g, len(c)), np.append(p, len(b))
        for x, y in zip(s.tolist(), [*s[1:].tolist(), len(p)]):
            px, py = more_p[x], more_p[y]
            gx, gy = more_g[px], more_g[py]
            ra, rc = rank[a[px:py]], rank[c[gx:gy]]
            ta, tc = h[a[px:py][ra == 0]], h[c[gx:gy][rc == 0]]
            sizes = np.array([y - x, py - px, gy - gx, len(ta), len(tc)], np.int64)
            rows = (sizes, h[b[p[x:y]]], ta, tc, np.diff(more_p[x : y + 1]).astype(np.uint32), np.diff(more_g[px : py + 1]).astype(np.uint32), n[gx:gy].astype(np.uint32), ra, rc)
            yield int(bucket[b[p[x]]]), cut, b"".join(v.tobytes() for v in rows)


def _unpacked(grams: list[bytes], top: np.ndarray) -> tuple[np.ndarray, ...]:
    """The hashes of b, a and c and the count of each gram."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    full = np.append(0, top)
    for data in grams:
        b, p, g, ta, tc = np.frombuffer(data, np.int64, 5).tolist()
        at, rows = 40, []
        for kind, k in ((np.int64, b), (np.int64, ta), (np.int64, tc), (np.uint32, b), (np.uint32, p), (np.uint32, g), (np.uint16, p), (np.uint16, g)):
            rows.append(np.frombuffer(data, kind, k, at))
            at += k * kind().itemsize
        hb, tail_a, tail_c, of_b, of_p, n, ra, rc = rows
        a, c = full[ra], full[rc]
        a[ra == 0], c[rc == 0] = tail_a, tail_c
        for column, x in zip(out, (np.repeat(np.repeat(hb, of_b), of_p), np.repeat(a, of_p), c, n.astype(np.int64))):
            column.append(x)
    return tuple(np.concatenate(x) for x in out)


class _Bucket:
    """The grams asked for whose middle words lie in one bucket, and what its texts' grams give to them, cut by cut."""

    def __init__(self, asked: pa.Table, key: int, bits: int):
        self.asked, self.pairs = asked, []
        self.b, self.a, self.c = ((h := _hashes(names, key, bits), np.where(codes > 0, h[codes], 0))[1] for names, codes in (_coded(asked[x].combine_chunks()) for x in ("b", "a", "c")))
        self.n3, self.n2 = np.zeros((2, len(self.b)), np.int64)

    def add(self, b: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray) -> None:
        (b, ub), (a, ua), (c, uc) = (pd.factorize(x) for x in (b, a, c))
        p, up = pd.factorize(b * len(ua) + a)
        gram, n = _summed(p * len(uc) + c, n)
        p, c = gram // len(uc), gram % len(uc)
        b, a = up[p] // len(ua), up[p] % len(ua)
        ends = uc[c] == 0
        k2, u2 = pd.factorize(b * len(uc) + c)
        n2 = np.bincount(k2, n).astype(np.int64)
        # The grams asked for, by the same numbers; -1 is unknown here.
        qb, qa, qc = (pd.Index(u).get_indexer(x) for u, x in ((ub, self.b), (ua, self.a), (uc, self.c)))
        seen = (qb >= 0) & (qc >= 0) & (self.c != 0)
        q2 = pd.Index(u2).get_indexer(np.where(seen, qb * len(uc) + qc, -1))
        self.n2 += np.where(q2 >= 0, n2[q2], 0)
        qp = pd.Index(up).get_indexer(np.where((qb >= 0) & (qa >= 0) & (self.a != 0), qb * len(ua) + qa, -1))
        self.n3 += _at(gram, np.where(seen & (qp >= 0), qp * len(uc) + qc, -1), n)[0]
        open_n = np.where(ends, 0, n)
        p, n, follow, kinds, low = _summed(p, n, open_n, (~ends).astype(np.int64), np.where(ends, 0, n2[k2]))
        self.pairs.append((ub[up[p] // len(ua)], ua[up[p] % len(ua)], n, follow, kinds, low))

    def done(self, discount: float) -> tuple[pa.Table, tuple[np.ndarray, ...]]:
        """The asked rows with p3, p2 and w2 of each, null where the texts have none; and for each word before one of this
        bucket the occurrences of the latter, the number of these, and how often they follow."""
        b, a, n, follow, kinds, low = (np.concatenate(x) for x in zip(*self.pairs)) if self.pairs else [np.zeros(0, np.int64)] * 6
        (b, ub), (a, ua) = pd.factorize(b), pd.factorize(a)
        p, n, follow, kinds, low = _summed(b * max(len(ua), 1) + a, n, follow, kinds, low)
        b, a = p // max(len(ua), 1), p % max(len(ua), 1)
        one, total = (np.bincount(b, x, len(ub)).astype(np.int64) for x in (n, follow))
        qb, qa = pd.Index(ub).get_indexer(self.b), pd.Index(ua).get_indexer(self.a)
        of, left, low = _at(p, np.where((qb >= 0) & (qa >= 0) & (self.a != 0), qb * len(ua) + qa, -1), follow, kinds, low)
        total = np.where(qb >= 0, total[qb], 0) if len(total) else np.zeros(len(qb), np.int64)
        with np.errstate(all="ignore"):
            p3, p2 = (self.n3 - discount) / of, (self.n2 - discount) / total
            w2 = discount * left / of / (1 - (low - discount * left) / total)
        asked = self.asked
        for name, x, there in (("_p3", p3, self.n3 > 0), ("_p2", p2, self.n2 > 0), ("_w2", w2, of > 0)):
            asked = asked.append_column(name, pa.array(x, pa.float64(), mask=~there))
        before = ua[a] != 0
        return asked, (ua[a][before], one[b][before], np.ones(before.sum(), np.int64), n[before])


def scores_of_texts(grams: DataFrame, texts: DataFrame, weight: float = 1.0, penalty: float = 1.0, discount: float = DISCOUNT, text_col: str = "text", bits: int = HASHED) -> DataFrame:
    """scored(grams, model(texts)) without the model's tables: of the texts' grams, only sums that grams ask for leave a task.

    Words travel as hashes of 64 bits, and as two bytes if they are among the most frequent; should two words have one hash,
    another key is taken.  Buckets of middle words are read in cuts by the word that follows, so that memory stays bounded."""
    if not 0 < discount < 1:
        raise ValueError("the discount lies between 0 and 1")
    spark = grams.sparkSession
    ship(spark)
    grams = saved(grams, "grams")
    names = grams.columns
    for key in itertools.count():
        words = _vocabulary(grams, texts.select(text_col), key, bits)
        if not words.groupBy("h").count().where("count > 1").limit(1).count():
            break
        discard(words)
    known = words.where("one > 0")
    size = known.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("n"), F.count("*").alias("kinds")).first()
    # At most so many words, whatever the texts, can be more than the RAREST part of all.
    top = known.where(F.col("one") > size.n // RAREST).orderBy(F.desc("one"), "h").limit(CODED).select("h").toArrow().column("h").to_numpy()
    top = np.sort(top) if len(top) else np.full(1, -1)
    buckets, cuts = min(MOST_BUCKETS, max(16, size.n // BUCKET)), 1 + size.n // CUT

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, codes in _blocks(batches):
            rows = _packed(_hashes(block, key, bits), codes, top, buckets, cuts)
            while some := list(itertools.islice(rows, 256)):
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*some), (pa.int64(), pa.int64(), pa.binary()))], names=["_bucket", "_cut", "_grams"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes = _coded(batch.column("b"))
            bucket = (_hashes(words, key, bits) >> 1) % buckets
            yield batch.append_column("_bucket", pa.array(bucket[codes])).append_column("_cut", pa.array(np.full(len(codes), -1)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = [], pa.schema([])

        def spent() -> Iterator[pa.RecordBatch]:
            rows = _summed(*(np.concatenate(x) for x in zip(*sums))) if sums else [[]]
            sums.clear()
            if len(rows[0]):
                yield from pa.table([*(pa.nulls(len(rows[0]), f.type) for f in schema), *map(pa.array, rows)], names=[*schema.names, *BEFORE]).to_batches(ROWS)

        for _, parts in itertools.groupby(_runs(batches), lambda x: x[0]):
            own = None
            for cut, part in itertools.groupby(parts, lambda x: x[1]):
                part = [x[2] for x in part]
                if own is None:  # the grams asked for come first
                    own = _Bucket(pa.Table.from_batches(part if cut < 0 else [part[0].slice(0, 0)]).select(names), key, bits)
                if cut >= 0:
                    own.add(*_unpacked([g for x in part for g in x.column("_grams").to_pylist()], top))
            asked, before = own.done(discount)
            schema = asked.schema
            for x in BEFORE:
                asked = asked.append_column(x, pa.nulls(len(asked), pa.int64()))
            yield from asked.to_batches(ROWS)
            sums.append(before)
            if sum(len(x[0]) for x in sums) >= GRAMS:
                sums[:] = [_summed(*(np.concatenate(x) for x in zip(*sums)))]
                if len(sums[0][0]) >= GRAMS // 2:
                    yield from spent()
        yield from spent()

    dealt = texts.select(text_col).mapInArrow(deal, "_bucket long, _cut long, _grams binary")
    fields = lambda schema: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    asking = grams.mapInArrow(ask, f"{fields(grams.schema)}, _bucket long, _cut long")
    both = asking.unionByName(dealt, allowMissingColumns=True).repartition(max(8, size.n // TASK), "_bucket").sortWithinPartitions("_bucket", "_cut")
    found = saved(both.mapInArrow(gather, f"{fields(grams.schema)}, _p3 double, _p2 double, _w2 double, {', '.join(f'{x} long' for x in BEFORE)}"), "scores")
    discard(grams)
    sums = found.where("_h is not null").groupBy(F.col("_h").alias("h")).agg(*(F.sum(x).alias(x) for x in BEFORE[1:]))
    left = discount * F.col("_kinds")
    bow = left / F.col("_total") / (1 - (F.col("_one") - left) / F.lit(float(size.n)))
    asked = words.where("asked").join(sums, "h", "left").select("w", F.when(F.col("one") > 0, (F.col("one") - discount) / float(size.n or 1)).alias("_p1"), bow.alias("_w1"))
    rows = found.where("_h is null")
    none = F.lit(None).cast("double")
    # Only grams whose last two words were never seen ask for those of single words.
    seen = rows.where("_p2 is not null").select(*names, "_p3", "_p2", "_w2", none.alias("_p1"), none.alias("_w1"))
    rest = rows.where("_p2 is null").join(asked.select(F.col("w").alias("c"), "_p1"), "c", "left").join(asked.select(F.col("w").alias("b"), "_w1"), "b", "left").select(*seen.columns)
    unseen = F.lit(discount * size.kinds / size.n if size.n else None).cast("double")
    log, zero = (lambda c: F.log(F.col(c))), F.lit(0.0)
    logp = F.coalesce(log("_p3"), F.coalesce(log("_w2"), zero) + F.coalesce(log("_p2"), F.coalesce(log("_w1"), zero) + F.coalesce(log("_p1"), F.log(unseen))))
    used = F.when(F.col("_p3").isNotNull(), 3).when(F.col("_p2").isNotNull(), 2).when(F.col("_p1").isNotNull(), 1).otherwise(0)
    return seen.unionByName(rest).select(*names, logp.alias("logp"), (logp * weight + F.log(F.lit(float(penalty)))).alias("score"), used.alias("used"))


def _vocabulary(grams: DataFrame, texts: DataFrame, key: int, bits: int) -> DataFrame:
    """(h, w, one, asked): the words of texts and of grams with their hashes, how often each occurs in the texts, and
    whether a gram has it."""

    def table(words: list[bytes], n: np.ndarray, asked: bool) -> Iterator[pa.RecordBatch]:
        h = _hashes(words, key, bits)
        w = pa.array(words, pa.binary()).view(pa.string())
        rows = pa.table([pa.array(h), w, pa.array(n), pa.array(np.full(len(h), asked))], names=["h", "w", "one", "asked"])
        yield from rows.slice(1).to_batches(ROWS)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes in _blocks(batches):
            yield from table(words, np.bincount(codes, minlength=len(words)), False)

    def of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {b""}
        for batch in batches:
            for column in batch.columns:
                words.update(_coded(column)[0])
            if len(words) >= GRAMS:
                yield from table([b"", *(words - {b""})], np.zeros(len(words), np.int64), True)
                words = {b""}
        yield from table([b"", *(words - {b""})], np.zeros(len(words), np.int64), True)

    kinds = "h long, w string, one long, asked boolean"
    both = texts.mapInArrow(of_texts, kinds).unionByName(grams.select("a", "b", "c").mapInArrow(of_grams, kinds))
    return saved(both.groupBy("h", "w").agg(F.sum("one").alias("one"), F.max("asked").alias("asked")), "words")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(bucket, cut, rows) for the runs of rows of one cut."""
    for batch in batches:
        bucket, cut = (batch.column(x).to_numpy() for x in ("_bucket", "_cut"))
        new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (cut[1:] != cut[:-1]))).tolist() if len(bucket) else []
        for x, y in zip(new, [*new[1:], len(bucket)]):
            yield int(bucket[x]), int(cut[x]), batch.slice(x, y - x)
