"""Words run together are whole inputs of the toxicity network."""

import random

import numpy as np

from tidewright.llm import gru, textops, toxicity


def test_long_runs_are_covered():
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefgh") for _ in range(517))
    texts = ["short words", None, run, f"a {run[:41]} b", "中" * 100, "x" * 40]
    whole, cps, starts, ends, first = toxicity.word_spans(texts)
    words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert max(map(len, words)) == 40 and words[first[0] : first[1]] == ["short", "words"] and words[first[5] : first[6]] == ["x" * 40]
    of_run = {g for w in words[first[2] : first[3]] for g in gru.grams(w)}
    assert {run[i : i + 4] for i in range(len(run) - 3)} <= of_run
    assert words[first[3] : first[4]] == ["a", run[:40], run[20:41], "b"]
    names = textops.segment_hashes(cps, starts, ends)
    assert len(np.unique(names)) == len(set(words))
    assert {"zzz", "zzzz"} <= set(gru.grams("a" * 50 + "zzzz"))
