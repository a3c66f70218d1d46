"""Token counts by a compiled finite-state transducer.

The model file gives pieces and their scores; the machine is compiled from these.  Of a text's
prefixes each has one last token: the piece that ends there and whose pair with the last token
before it stays apart when both are encoded together.  The pieces that can still end further on
begin inside the longest suffix that begins some piece, so a state is that suffix together with
the last tokens, and the relative token counts, of the prefixes that end inside it: finitely many.
A transition reads one character and emits by how many the prefix's tokens become more (it may
be negative).  States and transitions are compiled when they are first met, and kept.

No piece joins a character to a following space mark, and some characters occur in no piece of
two or more; the text therefore falls into units (a run of space marks with what follows; a lone
character) at whose begin the machine is in its first state.  Counts of whole units are kept in a
table, so that a repeated unit is not read again.  Long texts are read in chunks: a chunk's map
takes any state before it to the state after it and the tokens between, and the maps of all
chunks are composed pairwise in a tree (a prefix scan's up-sweep).

Null texts count as empty; an empty text has no tokens.  Repeated rows and ids each give a row,
rows without an id too; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, tokenizer_path
from .textops import WordTable, joined, slices

MARK = 0x2581
#: States that are kept; with more, compilation starts anew from the present state.
MOST_STATES = 150_000


class State(NamedTuple):
    """The longest suffix of what was read that begins a piece; for the prefixes that end before, inside and at the
    end of it: the last token, and the tokens less those of what was read."""

    suffix: str
    tokens: tuple[str, ...]
    counts: tuple[int, ...]


FIRST = State("", ("",), (0,))


class Transducer:
    """The machine of one set of pieces with scores."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        #: What begins a piece; each string is held once, whatever the number of states that name it.
        self.begins = {x: x for p in scores for x in (*(p[:k] for k in range(len(p))), p)}
        self.apart: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[State] = []
        self.numbers: dict[State, int] = {}
        self.rows: list[dict[str, tuple[int, int]]] = []
        self.number(FIRST)

    def number(self, state: State) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.rows.append({})
        return self.numbers[state]

    def encoded(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether the token b may follow the token a (or begin, if a is empty)."""
        if (a, b) not in self.apart:
            if len(self.apart) > 4 * MOST_STATES:
                self.apart.clear()
            self.apart[a, b] = self.encoded(a + b) == ([a, b] if a else [b])
        return self.apart[a, b]

    def compiled(self, state: State, sign: str) -> tuple[State, int]:
        """The state after one more character, and the tokens that it emits."""
        suffix = state.suffix + sign
        for size in range(len(suffix), 0, -1):
            token, before = suffix[-size:], len(suffix) - size
            if (token in self.scores or size == 1) and self.stays_apart(state.tokens[before], token):
                break
        else:
            raise ValueError(f"no last token for {suffix!r}")
        emitted = state.counts[before] + 1
        tokens, counts = (*state.tokens, self.begins.get(token, token)), (*(c - emitted for c in state.counts), 0)
        cut = next(k for k in range(len(suffix) + 1) if suffix[k:] in self.begins)
        return State(self.begins[suffix[cut:]], tokens[cut:], counts[cut:]), emitted

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after text, and the tokens emitted."""
        at, total = self.number(state), 0
        for sign in text:
            step = self.rows[at].get(sign)
            if step is None:
                after, emitted = self.compiled(self.states[at], sign)
                if len(self.states) > MOST_STATES:
                    self.clear()
                    step = (self.number(after), emitted)
                else:
                    step = self.rows[at][sign] = (self.number(after), emitted)
            at, total = step[0], total + step[1]
        return self.states[at], total


class ChunkMap(NamedTuple):
    """What a chunk does: its head, up to the first unit border, is read from the state before it; what follows the
    border emits count tokens and ends in state.  Without a border the head is all, and state is None."""

    head: str
    count: int
    state: State | None


class UnitTransducer:
    """The machine of one model file, its units and their counts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.machine = Transducer({model.id_to_piece(i): model.get_score(i) for i in ordinary})
        pieces = list(self.machine.scores)
        inner = [p for p in pieces if "▁" in p.lstrip("▁")]
        if inner:
            raise ValueError(f"pieces with a space mark after a character: {inner[:5]}")
        #: Characters that can merge with a neighbour.
        self.joining = np.zeros(0x110000, bool)
        self.joining[[ord(c) for p in pieces if len(p) > 1 for c in p]] = True
        self.joining[MARK] = True
        if any(chr(c) not in self.machine.scores for c in np.flatnonzero(self.joining).tolist()):
            raise ValueError("a character of a longer piece is no piece")
        self.words = WordTable(self._compile)

    def _lone(self, sign: str) -> int:
        """A character that joins none is a piece, or its bytes are."""
        return 1 if sign in self.machine.scores else len(sign.encode("utf-8", "replace"))

    def _unit(self, unit: str) -> int:
        return self.machine.run(FIRST, unit)[1] if self.joining[ord(unit[0])] else self._lone(unit)

    def _compile(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self._unit(u) for u in units], np.uint32), np.ones(len(units), np.int64)

    def starts(self, cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where units begin."""
        alone = ~self.joining[cps]
        mark = cps == MARK
        cut = alone | mark
        cut[1:] &= alone[1:] | ~mark[:-1]
        cut[1:] |= alone[:-1]
        cut[bounds[:-1][bounds[:-1] < len(cps)]] = True
        return np.flatnonzero(cut)

    def emitted(self, text: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens that each unit emits."""
        codes = self.words.look_up(text, cps, starts, ends)
        return self.words.flat[self.words.at[codes]].astype(np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        whole, cps, bounds = joined(marked)
        if not len(cps):
            return np.zeros(len(texts), np.int64)
        starts = self.starts(cps, bounds)
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(self.emitted(whole, cps, starts, np.append(starts[1:], len(cps))), out=total[1:])
        at = np.searchsorted(starts, bounds)
        return total[at[1:]] - total[at[:-1]]

    def chunk_map(self, text: str, begin: int, end: int) -> ChunkMap:
        """The map of text[begin:end] (marks in place of spaces), whatever is before and after it."""
        skip = min(begin, 1)
        piece = text[begin - skip : end]
        cps = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.starts(cps, np.zeros(1, np.int64))
        starts = starts[starts >= skip]
        if not len(starts):
            return ChunkMap(piece[skip:], 0, None)
        inner = int(self.emitted(piece, cps, starts[:-1], starts[1:]).sum()) if len(starts) > 1 else 0
        last = piece[starts[-1] :]
        state, count = self.machine.run(FIRST, last) if self.joining[cps[starts[-1]]] else (FIRST, self._lone(last))
        return ChunkMap(piece[skip : starts[0]], inner + count, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if a.state is None:
            return ChunkMap(a.head + b.head, b.count, b.state)
        state, count = self.machine.run(a.state, b.head)
        return ChunkMap(a.head, a.count + count + b.count, state if b.state is None else b.state)

    def count_long(self, text: str, chunk: int) -> int:
        """Tokens of one text, read in chunks whose maps are composed in a tree."""
        if not text:
            return 0
        text = "▁" + text.replace(" ", "▁")
        maps = [self.chunk_map(text, k, min(k + chunk, len(text))) for k in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0].count


@lru_cache(2)
def transducer(path: str) -> UnitTransducer:
    return UnitTransducer(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, chunk: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; texts of over ``chunk`` code points are read in chunks."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            for a, b in slices(texts):
                part = [t if t and len(t) <= chunk else None for t in texts[a:b]]
                n[a:b] = machine.counts(part)
            for i, t in enumerate(texts):
                if t and len(t) > chunk:
                    n[i] = machine.count_long(t, chunk)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return map_arrow(kept, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
