"""Alignment: cases made from its rules, and invariants."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.operators import align as operator
from tidewright.operators.align import Similarity, align

LABELS = "pirako"


def heard(*spans):
    return [{"phoneme": p, "start": a, "stop": b} for p, a, b in spans]


def said(*words):
    """One letter a phoneme."""
    return [{"phoneme": c, "word_start": k == 0, "weight": 0.0} for w in words for k, c in enumerate(w)]


def matrix(**near):
    """Equal labels score 1.5, others -1, but for those given as heard and written label."""
    scores = {(a, t): 1.5 if a == t else -1.0 for a in LABELS for t in LABELS}
    return Similarity(scores | {tuple(k): v for k, v in near.items()}, -1.0)


EQUAL = heard(("p", 0, 40), ("i", 40, 90), ("r", 120, 180))
CASES = {
    "equal sequences match": (matrix(), EQUAL, said("pi", "r"), ["match"] * 3, [("p", 0, 40, 1.5), ("i", 40, 90, 1.5), ("r", 120, 180, 1.5)]),
    "a sound that is not written is a gap": (
        matrix(), heard(("p", 0, 40), ("k", 40, 60), ("i", 60, 90)), said("pi"), ["match", "delete", "match"], [("p", 0, 40, 1.5), ("_", 40, 60, -1.0), ("i", 60, 90, 1.5)],
    ),
    "a similar sound joins the one before": (
        matrix(oi=0.6), heard(("p", 0, 40), ("i", 40, 90), ("o", 90, 130)), said("pi"), ["match", "match", "merge_left"], [("p", 0, 40, 1.5), ("i", 40, 130, 1.045)],
    ),
    "but not over a pause": (
        matrix(oi=0.6), heard(("p", 0, 40), ("i", 40, 90), ("o", 400, 440)), said("pi"), ["match", "match", "delete"], [("p", 0, 40, 1.5), ("i", 40, 90, 1.5), ("_", 400, 440, -1.0)],
    ),
    "labels that are not heard have no length": (
        matrix(), heard(("p", 0, 40), ("a", 40, 100)), said("pika"), ["match", "insert", "insert", "match"], [("p", 0, 40, 1.5), ("i", 40, 40, -1.0), ("k", 40, 40, -1.0), ("a", 40, 100, 1.5)],
    ),
    "a similar label takes half of the sound before": (
        matrix(ir=0.4), heard(("p", 0, 40), ("i", 40, 100), ("a", 100, 160)), said("pira"), ["match", "match", "split_left", "match"],
        [("p", 0, 40, 1.5), ("i", 40, 70, 1.5), ("r", 70, 100, 0.39), ("a", 100, 160, 1.5)],
    ),
    "silences leave no rows": (
        matrix(), heard(("SIL", 0, 20), ("p", 20, 60), ("SIL", 60, 300), ("a", 310, 390), ("SIL", 390, 500)), said("p", "a"), ["delete", "match", "delete", "match", "delete"],
        [("p", 20, 60, 1.5), ("a", 310, 390, 1.5)],
    ),
    "similar labels match": (matrix(ka=0.5), heard(("r", 10, 50), ("k", 50, 130)), said("ra"), ["match", "match"], [("r", 10, 50, 1.5), ("a", 50, 130, 0.5)]),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(name):
    sim, audio, text, ops, rows = CASES[name]
    got = align(sim, audio, text)
    assert got["ops"] == ops
    assert [(r["phoneme"], r["start"], r["stop"], round(r["score"], 3)) for r in got["rows"]] == rows
    assert round(got["min_score"], 3) == min(r[3] for r in rows) and got["has_gaps"] == any(o in ("insert",) or r[0] == "_" for o in ops for r in rows)


def test_bad_inputs():
    sim = matrix()
    assert align(sim, [], said("p"))["error"] and align(sim, None, None)["error"]
    assert align(sim, heard(*(("p", 10 * k, 10 * k + 5) for k in range(500))), said("p"))["error"]


sounds = st.lists(st.tuples(st.sampled_from(LABELS), st.integers(1, 90), st.sampled_from([0, 0, 150])), min_size=1, max_size=12)
words = st.lists(st.text(LABELS, min_size=1, max_size=4), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(sounds, words)
def test_invariants(audio, text):
    at, spans = 0, []
    for label, size, pause in audio:
        spans.append((label, at + pause, at + pause + size))
        at += pause + size
    audio, text = heard(*spans), said(*text)
    got = align(matrix(pi=0.5, ka=0.6), audio, text)
    assert [r["phoneme"] for r in got["rows"] if r["phoneme"] != "_"] == [x["phoneme"] for x in text]
    assert sum(o in ("match", "delete", "merge_left") for o in got["ops"]) == len(audio)
    assert sum(o in ("match", "insert", "split_left") for o in got["ops"]) == len(text)
    starts = [r["start"] for r in got["rows"]]
    assert starts == sorted(starts)


def plain_ops(sim, audio, text):
    """The recurrence, cell by cell over the whole grid, in single precision."""
    f32 = np.float32
    n, m = len(audio), len(text)
    gap, small = sim.gap, f32(0.01)
    apart = [k > 0 and audio[k]["start"] > audio[k - 1]["stop"] or k == 0 and audio[0]["start"] > audio[0]["stop"] for k in range(n)] + [False]
    begins = [x["word_start"] for x in text] + [True]
    total, op = {(0, 0): f32(0)}, {(0, 0): 0}
    for a in range(n + 1):
        for t in range(m + 1):
            ways = []
            if a and t:
                x, y = audio[a - 1]["phoneme"].lower(), text[t - 1]["phoneme"].lower()
                score = f32(-2.1) if x in ("sil", "+nsn+", "+spn+") else sim.table[sim.audio.get(x, len(sim.audio)), sim.text.get(y, len(sim.text))]
                across = gap * f32(1.5) + score * f32(0.5)
                before, after, first, last = apart[a - 1], apart[a], begins[t - 1], begins[t]
                torn = (before and not first or after and first and not last) and not (first and last)
                ways.append((total[a - 1, t - 1] + (across if torn else score), 1))
                if op[a - 1, t] == 1:
                    ways.append((total[a - 1, t] + (across if before else score - small), 3))
                if op[a, t - 1] == 1:
                    ways.append((total[a, t - 1] + (across if after and not last else score - small), 5))
            if a:
                ways.append((total[a - 1, t] + (f32(2.1) + small if audio[a - 1]["phoneme"].lower() == "sil" else gap), 2))
            if t:
                ways.append((total[a, t - 1] + gap, 4))
            if ways:
                total[a, t], op[a, t] = min(ways, key=lambda w: (-w[0], w[1]))
    names, a, t = [], n, m
    while a or t:
        now = op[a, t]
        names.append(["", "match", "delete", "merge_left", "insert", "split_left"][now])
        a, t = a - (now in (1, 2, 3)), t - (now in (1, 4, 5))
    return names[::-1]


def built(rng, n, m):
    at, spans = 0, []
    for _ in range(n):
        start = at + rng.choice([0, 0, 0, 20])
        at = start + rng.randint(0, 60)
        spans.append((rng.choice([*LABELS, "SIL", "+nsn+", "zz"]), start, at))
    return heard(*spans), [{"phoneme": rng.choice([*LABELS, "zz"]), "word_start": k == 0 or rng.random() < 0.4, "weight": 1.0} for k in range(m)]


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_equal_to_the_whole_grid(monkeypatch, cells):
    """Also where the grid is filled again, block by block, on the way back."""
    monkeypatch.setattr(operator, "CELLS", cells)
    rng = random.Random(cells)
    sim = matrix(pi=0.5, ka=0.6, ir=1.0, oi=0.25, ra=-0.5)
    items = [built(rng, rng.randint(1, 16), rng.randint(1, 16)) for _ in range(150)]
    assert [align(sim, a, t)["ops"] for a, t in items] == [plain_ops(sim, a, t) for a, t in items]
    batch = operator.align_batch(sim, pa.array([a for a, _ in items], operator._AUDIO), pa.array([t for _, t in items], operator._TEXT))
    assert batch[0].to_pylist() == [align(sim, a, t)["rows"] for a, t in items]


def test_long_tracks_in_bounded_memory():
    sim, (audio, text) = matrix(pi=0.5), built(random.Random(2), 1500, 1400)
    assert align(sim, audio, text)["error"] == "more than 499 segments"
    tracemalloc.start()
    got = align(sim, audio, text, longest=None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["error"] is None and len(got["ops"]) >= 1500
    assert peak < 12 << 20  # a grid of operations and totals would be 10 MB, one of all scores 40 MB


def test_null_cells():
    sim = matrix()
    got = align(sim, [{"phoneme": None, "start": 0, "stop": 9}, *heard(("p", 9, 20))], [{"phoneme": "p", "word_start": None, "weight": 1.0}])
    assert got["error"] is None and [r["phoneme"] for r in got["rows"]][-1] == "p"
