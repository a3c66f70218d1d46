"""Trigram models: sums of probabilities, back-off, odd texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ngrams


def test_probabilities_sum_to_one(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e"]
    texts = [(" ".join(rng.choices(words, [5, 3, 2, 1, 1], k=rng.randint(1, 30))),) for _ in range(40)]
    by = ngrams.model(spark.createDataFrame(texts, "text string"))
    grams = [(a, b, c) for a in [*words, "zz"] for b in [*words, "zz"] for c in words]
    got = ngrams.scored(spark.createDataFrame(grams, "a string, b string, c string"), by).collect()
    unseen = math.exp(by.unseen.first().unseen)
    weight = {(r.b, r.c): r.bow for r in by.pairs.collect()}
    single = {r.c: r.bow for r in by.words.collect()}
    sums = {}
    for r in got:
        sums[r.a, r.b] = sums.get((r.a, r.b), 0) + math.exp(r.logp)
    for (a, b), total in sums.items():
        # An unknown word takes what both histories leave to it.
        rest = math.exp((weight.get((a, b)) or 0) + (single.get(b) or 0)) * unseen
        assert total + rest == pytest.approx(1)
    assert {r.used for r in got} >= {1, 2, 3}


def test_cascade(spark):
    by = ngrams.model(spark.createDataFrame([("x y z x y z x y w",), (None,), ("  ",)], "text string"))
    grams = spark.createDataFrame([("x", "y", "z"), ("q", "y", "z"), (None, None, "x"), ("x", "y", "q")], "a string, b string, c string")
    got = {(r.a, r.b, r.c): r for r in ngrams.scored(grams, by, 2.0, 0.5).collect()}
    assert got["x", "y", "z"].logp == pytest.approx(math.log((2 - 0.75) / 3)) and got["x", "y", "z"].used == 3
    assert got["q", "y", "z"].logp == pytest.approx(math.log((2 - 0.75) / 3)) and got["q", "y", "z"].used == 2
    assert got[None, None, "x"].logp == pytest.approx(math.log((3 - 0.75) / 9)) and got[None, None, "x"].used == 1
    assert got["x", "y", "q"].used == 0 and got["x", "y", "z"].score == pytest.approx(2 * got["x", "y", "z"].logp + math.log(0.5))


def test_grams_of_texts(spark):
    texts = spark.createDataFrame([("a  b\tc",), (None,), ("",), ("a",)], "text string")
    assert sorted(map(tuple, ngrams.counted(texts).collect()), key=str) == sorted([("a", "b", "c", 1), ("b", "c", None, 1), ("c", None, None, 1), ("a", None, None, 1)], key=str)
    assert {tuple(r) for r in ngrams.spoken_grams(texts).collect()} == {(None, None, "a", 2), (None, "a", "b", 1), ("a", "b", "c", 1)}
    empty = ngrams.model(texts.where("false"))
    assert ngrams.scored(ngrams.spoken_grams(texts), empty).select(F.sum("used")).first()[0] == 0
    with pytest.raises(ValueError):
        ngrams.model(texts, 1.5)


def test_a_model_shuffles_grams_once(spark, monkeypatch):
    texts = spark.createDataFrame([("x y z x y",), ("y z",)], "text string")
    got = {tuple(r) for r in ngrams.centred(texts).collect()}
    assert got == {("x", None, "y", 1), ("y", "x", "z", 1), ("z", "y", "x", 1), ("x", "z", "y", 1), ("y", "x", None, 1), ("y", None, "z", 1), ("z", "y", None, 1)}
    # All tables of a model come out of one shuffle of packed grams; none is written.
    monkeypatch.setattr(ngrams, "saved", None, raising=False)
    by = ngrams.model(texts)
    assert by.pairs.count() == 3 and by.triples.count() == 3


def test_blocks_of_texts(monkeypatch):
    monkeypatch.setattr(ngrams, "GRAMS", 4)
    got = list(ngrams._dealt(iter(["b a b", "", "a", "  x"])))
    assert got[0] == (["b", "a"], [" a\na ", "b b"])
    assert sum(line.count(" ") for words, around in got for x in around for line in x.split("\n")) == 6


def test_scores_read_what_is_asked_for(spark):
    by = ngrams.model(spark.createDataFrame([("x y z x y",)], "text string"))
    plan = ngrams.scored(spark.createDataFrame([("x", "y", "z")], "a string, b string, c string"), by)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 5


def _both(spark, grams, texts, **more):
    grams, texts = spark.createDataFrame(grams, "a string, b string, c string, n long"), spark.createDataFrame(texts, "text string")
    keyed = lambda rows: {(r.a, r.b, r.c, r.n): (r.used, r.logp and round(r.logp, 9), r.score and round(r.score, 9)) for r in rows.collect()}
    return keyed(ngrams.scores_of_texts(grams, texts, 9.5, 0.7, **more)), keyed(ngrams.scored(grams, ngrams.model(texts), 9.5, 0.7))


def _odd(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "\u00e9\u00df", "\u00a0", "d,", "e" * 300, *(f"w{k}" for k in range(40))]
    texts = ["\t".join(rng.choices(words, [200 // (k + 1) for k in range(len(words))], k=rng.randint(1, 60))) + rng.choice(["", " ", "\n"]) for _ in range(60)]
    grams = {tuple(rng.choices([*words, "zz"], [99 // (k + 1) for k in range(len(words))] + [9], k=3)) for _ in range(600)} | {tuple(w[k : k + 3]) for w in map(str.split, texts[:9]) for k in range(len(w) - 2)}
    return [(*g, k) for k, g in enumerate(sorted(grams))] + [(None, None, "a", 1), (None, "a", "b", 2), (None, None, "zz", 3), (None, "zz", "zz", 4)], [(t,) for t in [*texts, texts[0], None, "", " \n"]]


def test_scores_out_of_packed_grams(spark):
    got, right = _both(spark, *_odd(1))
    assert got == right and len(got) > 300 and {x[0] for x in got.values()} == {0, 1, 2, 3}


def test_cuts_of_buckets_and_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CUT", 500)  # the parts of a bucket are added up
    monkeypatch.setattr(ngrams, "RAREST", 50)  # few words have codes
    got, right = _both(spark, *_odd(2))
    assert got == right
    grams, texts = [("x", "y", "z", 1), ("y", "x", "q", 2)], [("x y z x y",), ("r y s t",)]
    tried = []
    monkeypatch.setattr(ngrams, "_vocabulary", lambda *a, of=ngrams._vocabulary: tried.append(a[2]) or of(*a))
    got, right = _both(spark, grams, texts, bits=5)  # 16 hashes for 7 words: another key where two are equal
    assert got == right and len(tried) > 1


def test_scores_without_words(spark):
    got, right = _both(spark, [("x", "y", "z", 1), (None, None, "z", 2)], [(None,), ("  ",)])
    assert got == right == {("x", "y", "z", 1): (0, None, None), (None, None, "z", 2): (0, None, None)}
    assert _both(spark, [], [("x y",)]) == ({}, {})


@pytest.mark.parametrize("fitting", [1 << 21, 1])
def test_packed_grams_round_trip(monkeypatch, fitting):
    monkeypatch.setattr(ngrams, "FITTING", fitting)
    monkeypatch.setattr(ngrams, "PACKED", 5)
    texts = ["b a b", "", "a", "  x\u00a0y a b"]
    names, codes = zip(*ngrams._blocks(iter([ngrams.pa.record_batch([ngrams.pa.array(texts)], names=["text"])])))
    assert len(names) >= 1 and sum((c > 0).sum() for c in codes) == 7
    word = {int(h): w.decode() for ws in names for h, w in zip(ngrams._hashes(ws, 0, 64), ws) if w} | {0: ""}
    top = ngrams.np.sort(ngrams._hashes([b"a", b"x"], 0, 64))
    count = {}
    for ws, c in zip(names, codes):
        for bucket, cut, data in ngrams._packed(ngrams._hashes(ws, 0, 64), c, top, 3, 2):
            for b, x, y, n in zip(*ngrams._unpacked([data], top)):
                assert (b >> 1) % 3 == bucket and (y >> 32) % 2 == cut
                key = word[x], word[b], word[y]
                count[key] = count.get(key, 0) + int(n)
    assert count == {("", "b", "a"): 1, ("b", "a", "b"): 1, ("a", "b", ""): 2, ("", "a", ""): 1, ("", "x\u00a0y", "a"): 1, ("x\u00a0y", "a", "b"): 1}


def test_trigram_scores_makes_no_model(spark, monkeypatch):
    from tidewright.plans import model_queries as queries

    # A model's tables take most of the time; the query only sums what its grams ask for.
    monkeypatch.setattr(ngrams, "centred", None)
    assert queries.trigram_scores(spark, "/root/testdata/sf0.001").select(F.sum("n")).first()[0] > 0
