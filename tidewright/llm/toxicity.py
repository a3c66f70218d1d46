"""Toxicity scores by a bidirectional gated recurrent network over overlapping windows.

The network is trained in numpy by one task, on a bounded sample of labelled documents
(``most_positive`` and ``most_negative``, by a hash of their ids); the driver holds the
trained model's bytes only.  Rows whose crc32(id as text) mod 5 is 0 are never used.  Whole texts are cut into windows
of ``WIDTH`` words, each starting ``STRIDE`` words after the one before; every window
is scored, and a document has the score of its highest window.

Null and empty texts, and texts without words, are one empty window.  Without
labels of both kinds the score is the share of label 1 (0, if there are none).
Only the text is an input.  Repeated rows each get a row; rows without an id are scored.
Other columns are kept, whatever their names.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import gru
from .common import map_arrow, saved
from .textops import LETTER, NUMBER, WordTable, class_table, joined, runs, slices

WIDTH, STRIDE = 32, 16
MOST_WORDS, MOST_GRAMS = 20_000, 40_000
LONGEST = 40
#: Windows scored at once.
LANES = 1024


@dataclass
class Model:
    words: dict[str, int]
    grams: dict[str, int]
    params: gru.Params
    scale: float
    shift: float
    constant: float | None = None


def word_spans(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined lower-case text, its code points, starts and ends of its words (letters, digits), and the texts' bounds among them.

    A run of over LONGEST characters is cut into pieces that overlap by half; each counts as a word."""
    whole, cps, bounds = joined([t.lower() if t else None for t in texts])
    kind = class_table()[cps]
    starts, ends = runs((kind == LETTER) | (kind == NUMBER), bounds)
    if len(starts) and (ends - starts).max() > LONGEST:
        count = 1 + np.maximum(0, -(-(ends - starts - LONGEST) // (LONGEST // 2)))
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts, ends = np.repeat(starts, count) + place * (LONGEST // 2), np.repeat(ends, count)
        ends = np.minimum(ends, starts + LONGEST)
    return whole, cps, starts, ends, np.searchsorted(starts, bounds)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts with words first[i]:first[i+1]: each window's text, first word and number of words."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE))
    owner = np.repeat(np.arange(len(n)), count)
    begin = STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    return owner, first[owner] + begin, np.minimum(WIDTH, n[owner] - begin)


class Featuriser:
    """Input vectors of words; vectors of words that were seen are kept in a bounded table."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.vectors = np.zeros((1024, model.params["words"].shape[1]), np.float32)
        self.table = WordTable(self._encode, limit=400_000)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary ids of the words, their n-grams' ids one after another, and each word's number of n-grams."""
        m = self.model
        flat, sizes = array("i"), []
        for w in words:
            got = [i for g in gru.grams(w) if (i := m.grams.get(g))] or [0]
            flat.extend(got)
            sizes.append(len(got))
        return np.array([m.words.get(w, 0) for w in words], np.int64), np.frombuffer(flat, np.int32), np.array(sizes, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        begin = self.table.n
        if begin + len(words) > len(self.vectors):
            self.vectors = np.resize(self.vectors, (2 * (begin + len(words)), self.vectors.shape[1]))
        self.vectors[begin : begin + len(words)] = word_vectors(self.model.params, *self.ids(words))
        return np.zeros(len(words), np.uint32), np.ones(len(words), np.int64)

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, and the text of each."""
        whole, cps, starts, ends, first = word_spans(texts)
        codes = self.table.look_up(whole, cps, starts, ends) if len(starts) else np.zeros(0, np.int64)
        owner, begin, size = windows(first)
        codes = np.append(codes, 0)
        out = np.empty(len(owner), np.float32)
        for a in range(0, len(owner), LANES):
            at = begin[None, a : a + LANES] + np.arange(WIDTH)[:, None]
            mask = np.arange(WIDTH)[:, None] < size[None, a : a + LANES]
            used = int(mask.any(1).sum()) or 1
            x = self.vectors[codes[np.minimum(at[:used], len(codes) - 1)]]
            x *= mask[:used, :, None]
            out[a : a + LANES] = gru.forward(self.model.params, x, mask[:used])[0]
        return out, owner


def word_vectors(p: gru.Params, words: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros((0, p["words"].shape[1]), np.float32)
    at = np.cumsum(sizes) - sizes
    return p["words"][words] + np.add.reduceat(p["grams"][flat], at) / sizes[:, None].astype(np.float32)


def train(texts: list[str], labels: np.ndarray, steps: int = 200, batch: int = 128, rate: float = 0.01, seed: int = 11) -> Model:
    """Fits the network.  A document's windows share its label; in each epoch a document is seen by its highest
    window so far, or by another one, as toxic passages may be anywhere in it."""
    labels = np.asarray(labels, np.float32)
    dim_none = Model({}, {}, gru.fresh_params(1, 1), 1.0, 0.0)
    if not len(labels) or labels.min() == labels.max():
        dim_none.constant = float(labels.mean()) if len(labels) else 0.0
        return dim_none
    # Words and n-grams by number from here on, so that memory follows the distinct ones.
    index: dict[str, int] = {}
    docs = []
    for t in texts:
        whole, _, starts, ends, _ = word_spans([t])
        docs.append(np.array([index.setdefault(whole[a:b], len(index)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int32))
    distinct, gram_index, flat, sizes = list(index), {}, array("i"), []
    for w in distinct:
        got = [gram_index.setdefault(g, len(gram_index)) for g in gru.grams(w)]
        flat.extend(got)
        sizes.append(len(got))
    flat, sizes = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.array(sizes, np.int64)
    at = np.cumsum(sizes) - sizes
    seen, toxic = ([np.zeros(len(index)), np.zeros(len(gram_index))] for _ in range(2))
    for d, label in zip(docs, labels.tolist(), strict=True):
        u = np.unique(d)
        n = sizes[u]
        g = np.unique(flat[np.repeat(at[u] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        for k, ids in enumerate((u, g)):
            seen[k][ids] += 1
            toxic[k][ids] += label > 0
    least = 3 if len(texts) > 100 else 1

    def pick(names: list[str], count: np.ndarray, most: int) -> tuple[dict[str, int], np.ndarray]:
        """The most frequent names by number, from 1; and their places among all."""
        order = sorted(np.flatnonzero(count >= least).tolist(), key=lambda i: (-count[i], names[i]))[:most]
        return {names[i]: k for k, i in enumerate(order, 1)}, np.array(order, np.int64)

    known_words, word_places = pick(distinct, seen[0], MOST_WORDS)
    known_grams, gram_places = pick(list(gram_index), seen[1], MOST_GRAMS)
    model = Model(known_words, known_grams, {}, 1.0, 0.0)
    p = model.params = gru.fresh_params(1 + len(model.words), 1 + len(model.grams), seed)
    # The first two inputs start as how unevenly a word, an n-gram, is spread over both kinds.
    share = float(labels.mean())
    for k, (table, places) in enumerate((("words", word_places), ("grams", gram_places))):
        n, hit = seen[k][places], toxic[k][places]
        p[table] *= 0.3
        p[table][:, :2] = 0
        p[table][1:, k] = np.clip((hit - n * share) / np.sqrt(n * share * (1 - share) + 1), -2, 8) / 2
    del gram_index, flat, seen, toxic

    features = Featuriser(model)
    words, flat, sizes = features.ids(distinct) if distinct else (np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
    at = np.cumsum(sizes) - sizes
    codes = np.concatenate([*docs, np.zeros(1, np.int32)])
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    owner, begin, size = windows(first)
    of_doc = np.searchsorted(owner, np.arange(len(docs) + 1))
    cells = begin[:, None] + np.arange(WIDTH)
    cells = codes[np.minimum(cells, len(codes) - 1)]
    mask = np.arange(WIDTH) < size[:, None]

    rng, adam = np.random.default_rng(seed), gru.Adam(p, rate)
    # Both kinds weigh alike in training; the calibration below restores their shares.
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def logits() -> np.ndarray:
        x = word_vectors(p, words, flat, sizes)
        out = np.empty(len(owner), np.float32)
        for a in range(0, len(owner), LANES):
            m = mask[a : a + LANES].T
            out[a : a + LANES] = gru.forward(p, x[cells[a : a + LANES].T] * m[:, :, None], m)[0]
        return out

    epochs = max(8, -(-steps * batch // len(docs)))
    warm, top = max(2, epochs // 6), None
    for epoch in range(epochs):
        count = np.diff(of_doc)
        chosen = of_doc[:-1] + (rng.random(len(docs)) * count).astype(np.int64)
        if epoch >= warm:
            # After the first epochs: the highest window, mostly; it is looked for anew three times or so.
            if (epoch - warm) % max(1, -(-(epochs - warm) // 3)) == 0:
                top = np.lexsort((logits(), owner))[of_doc[1:] - 1]
            chosen = np.where((labels > 0) | (rng.random(len(docs)) < 0.7), top, chosen)
        adam.rate = rate * (1 - 0.8 * epoch / epochs)
        turn = rng.permutation(len(docs))
        for a in range(0, len(docs), batch):
            d = turn[a : a + batch]
            w = chosen[d]
            c, m = cells[w].T, mask[w].T
            u, back = np.unique(c, return_inverse=True)
            n = sizes[u]
            each = np.repeat(at[u] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            part = flat[each]
            vec = word_vectors(p, words[u], part, n)
            logit, cache = gru.forward(p, vec[back.reshape(c.shape)] * m[:, :, None], m, keep=True)
            dlogit = ((1 / (1 + np.exp(-logit)) - labels[d]) * weight[d] / len(d)).astype(np.float32)
            g, dx = gru.backward(p, cache, dlogit)
            dx = (dx * m[:, :, None]).reshape(-1, dx.shape[2])
            dvec = np.stack([np.bincount(back.ravel(), dx[:, k], len(u)) for k in range(dx.shape[1])], 1).astype(np.float32)
            g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
            np.add.at(g["words"], words[u], dvec)
            np.add.at(g["grams"], part, np.repeat(dvec / n[:, None].astype(np.float32), n, 0))
            g["words"][0] = g["grams"][0] = 0
            adam.step(p, g)
    best = np.maximum.reduceat(logits(), of_doc[:-1]).astype(np.float64)
    model.scale, model.shift = calibrated(best, labels)
    return model


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by regularised logistic regression (Newton steps)."""
    mean, dev = x.mean(), x.std() + 1e-6
    z = np.stack([(x - mean) / dev, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (q - y) + 0.1 * np.array([b[0], 0])
        b -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag([0.1, 1e-6]), grad)
    b[0] = max(b[0], 1e-3)
    return float(b[0] / dev), float(b[1] - b[0] * mean / dev)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_positive: int, most_negative: int) -> DataFrame:
    """(doc_id, toxic, text) of the training sample."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = rows.where("toxic = 1").orderBy(order, "doc_id").limit(most_positive).union(rows.where("toxic = 0").orderBy(order, "doc_id").limit(most_negative))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def trained(sample: DataFrame) -> bytes:
    """The model fitted to rows (doc_id, toxic, text) by one task, whatever their order, as bytes."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t or "") for batch in batches for i, y, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        model = train([r[2] for r in rows], np.array([r[1] for r in rows], np.float32))
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return bytes(map_arrow(saved(sample, "sample").repartition(1), fit, "model binary").first().model)


@lru_cache(1)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def score_documents(docs: DataFrame, labels: DataFrame, most_positive: int = 800, most_negative: int = 1600, id_col: str = "doc_id", text_col: str = "text", score_col: str = "_score", windows_col: str = "_windows") -> DataFrame:
    """The rows of docs, all columns, with score_col (double) and windows_col (long), which docs must not have."""
    packed = trained(labelled_sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most_positive, most_negative))
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(packed)
        features = Featuriser(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts):
                if model.constant is not None:
                    score, count = np.full(b - a, model.constant), np.zeros(b - a, np.int64)
                else:
                    logits, owner = features.window_logits(texts[a:b])
                    count = np.bincount(owner, minlength=b - a)
                    best = np.maximum.reduceat(logits, np.cumsum(count) - count).astype(np.float64)
                    score = 1 / (1 + np.exp(-np.clip(model.scale * best + model.shift, -40, 40)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(count.astype(np.int64))], names=[*names, score_col, windows_col])

    added = StructType([*schema.fields, StructField(score_col, DoubleType()), StructField(windows_col, LongType())])
    return map_arrow(docs, run, added)
