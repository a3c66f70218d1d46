"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a word exactly one token can be its last one.  Candidates are
the tokens that end there, found by an automaton over the vocabulary (longest
first along suffix links); the one that fits starts the word or is compatible
with the last token of the prefix before it.  Back-pointers then give the ids.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, signs = spec["model"], byte_signs()
        #: Special tokens, which merging never gives: id -> content.
        self.added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.vocab_size = 1 + max([*model["vocab"].values(), *self.added])
        self.token_bytes: list[bytes] = [b""] * self.vocab_size
        for word, i in model["vocab"].items():
            if i not in self.added:
                self.token_bytes[i] = bytes(signs[c] for c in word)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = self.vocab_size
        self.length = np.array([len(t) for t in self.token_bytes], np.int32)
        # Rank 0 marks single bytes: they come before every merge.
        self.rank = np.zeros(n, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        pairs = {}
        for r, (a, b) in enumerate(merges, 1):
            left, right, whole = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            pairs[left << 20 | right] = r
            if not self.rank[whole]:
                self.rank[whole], self.left[whole], self.right[whole] = r, left, right
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self._build_automaton()
        shown = [self.added[i].encode() if i in self.added else t for i, t in enumerate(self.token_bytes)]
        #: What each id stands for in a decoded text.
        self.shown_length = np.array([len(t) for t in shown], np.int64)
        self.shown = np.frombuffer(b"".join(shown), np.uint8), np.cumsum(self.shown_length) - self.shown_length

    def _build_automaton(self) -> None:
        edges: list[dict[int, int]] = [{}]
        token_at = [-1]
        for i, word in enumerate(self.token_bytes):
            if not word:
                continue
            s = 0
            for b in word:
                nxt = edges[s].get(b)
                if nxt is None:
                    nxt = edges[s][b] = len(edges)
                    edges.append({})
                    token_at.append(-1)
                s = nxt
            token_at[s] = i
        fail, found, order = [0] * len(edges), [-1] * len(edges), [0]
        for s in order:  # breadth first: the list grows while it is read
            for b, t in edges[s].items():
                f = fail[s]
                while s and f and b not in edges[f]:
                    f = fail[f]
                fail[t] = edges[f].get(b, 0) if s else 0
                found[t] = t if token_at[t] >= 0 else found[fail[t]]
                order.append(t)
        keys = sorted((s << 8 | b, t) for s, e in enumerate(edges) for b, t in e.items())
        self.edge_keys = np.array([k for k, _ in keys], np.int64)
        self.edge_to = np.array([t for _, t in keys], np.int32)
        self.fail = np.array(fail, np.int32)
        # By state: the state of the longest token that ends there, and that token.
        self.longest = np.array(found, np.int32)
        self.token_at = np.array(token_at, np.int32)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int32)
        todo, s = np.arange(len(state)), state.astype(np.int64)
        while len(todo):
            key = s << 8 | byte[todo]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[at] == key
            out[todo[hit]] = self.edge_to[at[hit]]
            left = ~hit & (s > 0)
            todo, s = todo[left], self.fail[s[left]].astype(np.int64)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the tokens a and b, side by side, as they are.

        The last merges of both are undone, the later one first; a merge across the
        border must not have come before the merges that are already undone.
        """
        ok = np.ones(len(a), bool)
        todo, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        # A merge over the border is too late from these ranks on.
        bound = np.full(len(a), np.iinfo(np.int64).max)
        while len(todo):
            key = a << 20 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_ranks[at] < bound)
            ok[todo[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra > 0) | (rb > 0))
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            # Of equal ranks the left one is merged first, so the right one is undone first.
            # Across the border, the merge of equal rank comes after the left's and before the right's.
            bound = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and the number of ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(w) for w in raw], np.int64)
        counts = np.zeros(len(raw), np.int64)
        order = np.argsort(-lengths, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begin = 0
        while begin < len(order):
            longest = int(lengths[order[begin]])
            end = min(len(order), begin + max(1, 4_000_000 // max(longest, 1)))
            # Words of one block are at least half as long as its longest, or short.
            floor = longest // 2 if longest > 64 else 0
            end = begin + max(1, int(np.searchsorted(-lengths[order[begin:end]], -floor, "right")))
            chosen = order[begin:end]
            parts.append((chosen, *self._encode_block([raw[i] for i in chosen.tolist()], lengths[chosen])))
            begin = end
        for chosen, _, got in parts:
            counts[chosen] = got
        at = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        for chosen, flat, got in parts:
            before = np.cumsum(got) - got
            ids[np.repeat(at[chosen] - before, got) + np.arange(len(flat))] = flat
        return ids, counts

    def _encode_block(self, raw: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words ordered by falling length."""
        n, width = len(raw), int(lengths[0]) if len(raw) else 0
        if not width:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        grid = np.zeros((width, n), np.uint8)
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        rows = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        grid[rows, np.repeat(np.arange(n), lengths)] = flat
        last = np.full((width + 1, n), -1, np.int32)
        state = np.zeros(n, np.int32)
        for i in range(1, width + 1):
            live = int(np.searchsorted(-lengths, -i, "right"))
            state = self._step(state[:live], grid[i - 1, :live].astype(np.int64))
            todo, s = np.arange(live), self.longest[state]
            while len(todo):
                token = self.token_at[s]
                size = self.length[token]
                before = last[i - size, todo]
                fits = size == i
                rest = np.flatnonzero(~fits)
                fits[rest] = self.compatible(before[rest], token[rest])
                last[i, todo[fits]] = token[fits]
                todo, s = todo[~fits], self.longest[self.fail[s[~fits]]]
        counts = np.zeros(n, np.int64)
        at, todo, steps = lengths.copy(), np.arange(n), []
        while len(todo):
            token = last[at[todo], todo]
            steps.append((todo, token, counts[todo].copy()))
            counts[todo] += 1
            at[todo] -= self.length[token]
            todo = todo[at[todo] > 0]
        stop = np.cumsum(counts)
        out = np.zeros(int(stop[-1]), np.uint32)
        for who, token, k in steps:
            out[stop[who] - 1 - k] = token
        return out, counts

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after another; special tokens stand for their content."""
        flat, at = self.shown
        sizes = self.shown_length[ids]
        before = np.cumsum(sizes) - sizes
        return flat[np.repeat(at[ids] - before, sizes) + np.arange(int(sizes.sum()))].tobytes()


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)
