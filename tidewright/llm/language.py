"""Language identification by cross parsing against suffix automata.

Each language's labelled sample is one string; its suffix automaton accepts exactly that string's substrings.
A text is parsed greedily into phrases, each the longest match from where the last one ended.  A phrase costs
what it takes to say where in the sample it stands, log2(sample length / its occurrences): phrases normalised
by how common they are.  The language with the least cost wins (ties: the smaller name); scores are the
winner's share of 2 ** -(cost per average phrase cost).

Texts are compared as lower-case letters, all else being one space.  Whole texts are read, in pieces of
``PIECE`` bytes that are parsed side by side.  The sample is bounded (``ROWS`` stretches of ``STRETCH``
characters a language, of different texts, rows and places chosen by a hash of the text), so automata are
bounded too; they are built by one task a language and held by every worker, so languages are classes of a
model: some dozens, not data.

Null texts and texts without a letter are ``und`` with score 0, and so is every text when there is nothing to
learn from.  Rows of equal id or text are judged alike, each on its own; null ids are kept; an empty table gives
an empty one; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship
from .textops import LETTER, class_table, joined, slices

#: The bounded sample: stretches a language, and characters a stretch.
ROWS, STRETCH = 400, 400
#: Bytes of a text that are parsed as one; phrases do not cross pieces.
PIECE = 256
UNDEFINED = "und"
LETTERS = r"\p{L}"
MODEL = "lang string, state binary, byte binary, target binary, occurs binary"


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' letters in lower case as UTF-8, all else one space: bytes, each text's bounds, and whether it has a letter."""
    lower = [t.lower() if t else "" for t in texts]
    _, cps, bounds = joined(lower)
    letter = class_table()[cps] == LETTER
    cps = np.where(letter, cps, 0x20)
    first = np.zeros(len(cps) + 1, bool)
    first[bounds] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:-1]  # the first sign after a letter
    before = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    some = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(letter, out=some[1:])
    kept = cps[keep]
    width = 1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000)
    at = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    raw = np.frombuffer(kept.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return raw, at[before[bounds]], np.diff(some[bounds]) > 0


def suffix_automaton(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Its transitions (state, byte, next state) and each state's number of occurrences; state 0 is the start."""
    links, lengths, edges, own = [-1], [0], [{}], [0]
    last = 0
    for byte in data:
        now = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        edges.append({})
        own.append(1)
        p = last
        while p >= 0 and byte not in edges[p]:
            edges[p][byte] = now
            p = links[p]
        if p >= 0:
            q = edges[p][byte]
            if lengths[p] + 1 == lengths[q]:
                links[now] = q
            else:
                copy = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                edges.append(dict(edges[q]))
                own.append(0)
                while p >= 0 and edges[p].get(byte) == q:
                    edges[p][byte] = copy
                    p = links[p]
                links[q] = links[now] = copy
        last = now
    for state in np.argsort(lengths, kind="stable")[:0:-1].tolist():
        own[links[state]] += own[state]
    sizes = np.array([len(e) for e in edges], np.int64)
    flat = np.fromiter((x for e in edges for pair in e.items() for x in pair), np.int64, 2 * int(sizes.sum())).reshape(-1, 2)
    return np.repeat(np.arange(len(edges)), sizes).astype(np.int32), flat[:, 0].astype(np.uint8), flat[:, 1].astype(np.int32), np.array(own, np.int64)


class Automata:
    """The languages' automata as one table of transitions.

    States with one way on keep its byte and target; the others have a row of all bytes that occur."""

    def __init__(self, parts: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        parts = sorted(parts, key=lambda p: p[0])
        self.names = [p[0] for p in parts]
        self.used = np.zeros(256, np.int32)
        present = np.unique(np.concatenate([p[2] for p in parts])) if parts else np.zeros(0, np.uint8)
        self.used[present] = np.arange(1, len(present) + 1)
        self.roots = np.cumsum([0, *(len(p[4]) for p in parts)])[:-1]
        total = sum(len(p[4]) for p in parts)
        self.sign = np.zeros(total, np.int32)
        self.target = np.full(total, -1, np.int32)
        self.price = np.zeros(total, np.float32)
        self.row = np.zeros(total, np.int32)
        wide, rows = [], 1
        for (_, state, byte, target, occurs), root in zip(parts, self.roots, strict=True):
            ways = np.bincount(state, minlength=len(occurs))
            code, size = self.used[byte], len(occurs)
            one = ways[state] == 1
            self.sign[root + state[one]] = code[one]
            self.target[root + state[one]] = root + target[one]
            many = np.flatnonzero(ways > 1)
            self.row[root + many] = rows + np.arange(len(many))
            table = np.full((len(many), len(present) + 1), -1, np.int32)
            table[np.searchsorted(many, state[~one]), code[~one]] = root + target[~one]
            wide.append(table)
            rows += len(many)
            self.price[root : root + size] = np.log2(occurs[0] / np.maximum(occurs, 1))
        self.wide = np.concatenate([np.full((1, len(present) + 1), -1, np.int32), *wide]).ravel()
        self.row *= len(present) + 1
        #: What a byte costs that no sample has after nothing: as much as one that occurs once.
        self.unknown = np.array([np.log2(max(p[4][0], 2)) for p in parts], np.float32)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more byte, -1 where the sample has no such substring."""
        then = self.wide.take(self.row.take(states) + codes)
        one = np.flatnonzero(self.sign.take(states) == codes)
        then[one] = self.target.take(states[one])
        return then

    def costs(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cost of each piece of bytes in each language."""
        n, m = len(starts), len(self.names)
        codes, sizes = self.used[raw], ends - starts
        order = np.argsort(-sizes, kind="stable")
        falling = -sizes[order]
        begin = starts[order]
        roots = np.tile(self.roots, n).astype(np.int32)
        states, out = roots.copy(), np.zeros(n * m)
        none = np.tile(self.unknown, n)
        for k in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(falling, -k, "left")) * m
            now = states[:live]
            code = np.repeat(codes[begin[: live // m] + k], m)
            then = self.step(now, code)
            ended = np.flatnonzero(then < 0)
            if len(ended):
                old, root = now[ended], roots[ended]
                out[ended] += self.price[old]
                again = self.step(root, code[ended])
                missing = again < 0
                out[ended[missing]] += none[ended[missing]]
                then[ended] = np.where(missing, root, again)
            states[:live] = then
        out += self.price[states]  # nothing at a root
        result = np.zeros((n, m))
        result[order] = out.reshape(n, m)
        return result

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and score."""
        names, scores = [], np.zeros(len(texts))
        for a, b in slices(texts):
            raw, bounds, sound = normalised(texts[a:b])
            if not self.names:
                names += [UNDEFINED] * (b - a)
                continue
            sizes = np.diff(bounds)
            counts = -(-sizes // PIECE)
            owner = np.repeat(np.arange(b - a), counts)
            begin = bounds[:-1][owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
            total = np.zeros((b - a, len(self.names)))
            np.add.at(total, owner, self.costs(raw, begin, np.minimum(begin + PIECE, bounds[1:][owner])))
            best = total.argmin(1)
            behind = (total - total.min(1, keepdims=True)) / self.unknown.mean()
            scores[a:b] = np.where(sound, 1 / np.exp2(-behind).sum(1), 0.0)
            names += [self.names[k] if s else UNDEFINED for k, s in zip(best.tolist(), sound.tolist(), strict=True)]
        return names, scores


def sample(labelled: DataFrame, rows: int = ROWS, stretch: int = STRETCH) -> DataFrame:
    """(lang, stretch): at most ``rows`` stretches of each language of labelled (lang, text), of different texts."""
    spark = labelled.sparkSession
    known = labelled.where("lang is not null")
    counts = known.groupBy("lang").count().collect()  # one row a language
    # About twice the rows that are needed pass by their hash; of these the smallest hashes are taken.
    share = spark.createDataFrame([(r["lang"], min(1.0, 2.0 * rows / r["count"])) for r in counts], "lang string, share double")
    mark = F.xxhash64("text")
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - stretch + 1, F.lit(1))).cast("int") + 1
    drawn = known.where(F.col("text").rlike(LETTERS)).select("lang", "text", mark.alias("mark")).join(F.broadcast(share), "lang")
    drawn = drawn.where((F.col("mark") / 2.0**64 + 0.5) < F.col("share"))
    each = drawn.groupBy("lang", "mark").agg(F.min(F.substring("text", place, F.lit(stretch))).alias("stretch"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    return each.withColumn("n", first).where(F.col("n") <= rows).select("lang", "mark", "stretch")


def _automaton(frame: pd.DataFrame) -> pd.DataFrame:
    texts = frame.sort_values("mark")["stretch"].tolist()
    raw, bounds, _ = normalised(texts)
    data = b"\0".join(raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    state, byte, target, occurs = suffix_automaton(data)
    cells = [state.tobytes(), byte.tobytes(), target.tobytes(), occurs.astype(np.int32).tobytes()]
    return pd.DataFrame([(frame["lang"].iloc[0], *cells)], columns=["lang", "state", "byte", "target", "occurs"])


def learn(labelled: DataFrame, rows: int = ROWS, stretch: int = STRETCH) -> list[tuple]:
    """The automata of the languages of labelled (lang, text), each built by one task."""
    ship(labelled.sparkSession)
    kinds = (np.int32, np.uint8, np.int32, np.int32)
    found = sample(labelled, rows, stretch).groupBy("lang").applyInPandas(_automaton, MODEL).collect()
    return [(r[0], *(np.frombuffer(x, k) for x, k in zip(r[1:], kinds, strict=True))) for r in found]


_HELD: dict[str, Automata] = {}


def identify(docs: DataFrame, model: list[tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs by a model of learn()."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:  # once a worker
            _HELD.clear()
            _HELD[key] = Automata(shared.value)
        for batch in batches:
            names, scores = _HELD[key].judge(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(kept, run, "doc_id long, lang_pred string, score double")
