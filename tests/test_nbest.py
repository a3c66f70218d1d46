"""The k best alignments against all alignments."""

import random

import pyarrow as pa
import pytest

from tidewright.operators import align as align_module
from tidewright.operators import nbest
from tidewright.operators.align import OPS, Similarity, align
from tidewright.operators.nbest import n_best, n_best_tracks

from test_align import built, heard, matrix, said


def all_ways(sim, audio, text):
    """Every way through the grid, as (total in millionths, operations)."""
    one = lambda x: round(float(x) * 1e6)
    apart = [k > 0 and audio[k]["start"] > audio[k - 1]["stop"] or k == 0 and audio[0]["start"] > audio[0]["stop"] for k in range(len(audio))] + [False]
    begins = [x["word_start"] for x in text] + [True]

    def costs(a, t):
        x, y = audio[a]["phoneme"].lower(), text[t]["phoneme"].lower()
        score = type(sim.gap)(-2.1) if x in ("sil", "+nsn+", "+spn+") else sim.table[sim.audio.get(x, len(sim.audio)), sim.text.get(y, len(sim.text))]
        half = type(sim.gap)
        across = sim.gap * half(1.5) + score * half(0.5)
        torn = (apart[a] and not begins[t] or apart[a + 1] and begins[t] and not begins[t + 1]) and not (begins[t] and begins[t + 1])
        less = score - half(0.01)
        return one(across if torn else score), one(across if apart[a] else less), one(across if apart[a + 1] and not begins[t + 1] else less)

    def go(a, t, total, ops):
        if a == len(audio) and t == len(text):
            yield total, ops
            return
        after = ops and ops[-1] == 1
        if a < len(audio) and t < len(text):
            yield from go(a + 1, t + 1, total + costs(a, t)[0], (*ops, 1))
        if a < len(audio):
            loss = type(sim.gap)(2.1) + type(sim.gap)(0.01) if audio[a]["phoneme"].lower() == "sil" else sim.gap
            yield from go(a + 1, t, total + one(loss), (*ops, 2))
            if after:
                yield from go(a + 1, t, total + costs(a, t - 1)[1], (*ops, 3))
        if t < len(text):
            yield from go(a, t + 1, total + one(sim.gap), (*ops, 4))
            if after:
                yield from go(a, t + 1, total + costs(a - 1, t)[2], (*ops, 5))

    return sorted(go(0, 0, 0, ()), key=lambda w: (-w[0], w[1][::-1]))


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_all_ways(seed):
    rng = random.Random(seed)
    sim = matrix(pi=0.5, ka=0.6, ir=1.0, oi=0.25)
    for _ in range(25):
        audio, text = built(rng, rng.randint(1, 4), rng.randint(1, 4))
        want = [(total / 1e6, [OPS[o] for o in ops]) for total, ops in all_ways(sim, audio, text)]
        assert n_best(sim, audio, text, 12) == want[:12]
        assert n_best(sim, audio, text, 100_000) == want


def test_first_is_the_alignment():
    sim = matrix()
    audio, text = heard(("p", 0, 40), ("i", 40, 90), ("r", 120, 180)), said("pi", "r")
    assert n_best(sim, audio, text, 1)[0][1] == align(sim, audio, text)["ops"]


def test_long_items_follow_k():
    audio, text = built(random.Random(1), 120, 110)
    found = n_best(matrix(pi=0.5), audio, text, 20)
    assert len({tuple(o) for _, o in found}) == 20 and [t for t, _ in found] == sorted((t for t, _ in found), reverse=True)


def test_tables(spark):
    schema = "id long, audio array<struct<phoneme:string,start:bigint,stop:bigint>>, text array<struct<phoneme:string,word_start:boolean,weight:float>>, rank string"
    rows = [(1, [("p", 0, 5)], [("p", True, 1.0)], "x"), (2, None, [("p", True, 1.0)], "x"), (3, [], [], "x"), (4, [("p", 0, 5)] * 6, [("p", True, 1.0)], "x")]
    pairs = spark.createDataFrame(rows, schema)
    got = n_best_tracks(pairs, [("p", "p", 2.0)], 2, longest=5).collect()
    assert [(r.id, r.rank, r.total, r.ops) for r in got] == [(1, 1, 2.0, ["match"]), (1, 2, -2.0, ["insert", "delete"])]
    assert n_best_tracks(pairs.where("false"), [("p", "p", 2.0)], 2).count() == 0
    assert Similarity({}).gap == -1.0


def test_items_of_a_batch_at_once(spark, monkeypatch):
    """Items of one shape are filled together: a batch of many takes about as many passes as it has shapes, with the ways of single items."""
    rng = random.Random(11)
    sim = matrix(pi=0.5, ka=0.6)
    rows = [(i, *built(rng, rng.randint(1, 3), rng.randint(1, 3))) for i in range(300)]
    audio, text = (pa.array([r[c] for r in rows], kind) for c, kind in ((1, align_module._AUDIO), (2, align_module._TEXT)))
    passes = []
    monkeypatch.setattr(nbest, "best_ways", lambda lanes, k, real=nbest.best_ways: passes.append(1) or real(lanes, k))
    got = {}
    for item, (rank, total, ops) in nbest.n_best_batch(sim, audio, text, 3):
        for i, r, t, o in zip(item.tolist(), rank.to_pylist(), total.to_pylist(), ops.to_pylist(), strict=True):
            got[i, r] = (t, o)
    assert len(passes) == 9
    for i, heard_, said_ in rows:
        assert [got[i, r] for r in (1, 2, 3) if (i, r) in got] == n_best(sim, heard_, said_, 3)
