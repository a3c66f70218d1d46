"""Near duplicates, lines, search, toxicity and the pipeline against plain versions."""

import itertools
import random
import re

import numpy as np

from tidewright.llm import common, editdist, gru, knn, linededup, minhash, toxicity
from tidewright.llm.textops import mix64

rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]


def near_copies():
    """Documents with exact and near copies, chains, and texts without words."""
    out = [(0, ""), (1, None), (2, "one"), (3, "ONE"), (4, " \t "), (5, "two words"), (6, "Two  Words")]
    base = [rng.choice(WORDS) for _ in range(60)]
    for k in range(60):
        base = base.copy()
        if k % 3:
            base[rng.randrange(len(base))] = rng.choice(WORDS)
        out.append((10 + k, " ".join(base)))
    return out + [(100 + k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80)))) for k in range(60)]


def brute_components(docs, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets, parent = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates(spark):
    docs = near_copies()
    df = spark.createDataFrame([(*d, "x") for d in docs] + [(None, "two words", "x")], "doc_id long, text string, key string")
    got = minhash.link_components(df, size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(docs, 2, 80)
    kept = minhash.near_duplicates_removed(df)
    assert kept.columns == df.columns
    want = {i for i, (_, c) in brute_components(docs, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(2000, 2300)] + [(5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[k] == 1000 for k in range(2000, 2300))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(2000):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 20))) for _ in range(2))
        most = rng.randint(0, 20)
        assert editdist.edit_distance(a, b, most) == min(plain(a, b), most + 1)


def test_simhash():
    gen = np.random.default_rng(1)
    sizes = np.array([1, 2, 700, 3, 90_000, 255, 256, 510, 511, 5, *gen.integers(1, 60, 300)])
    stop = np.cumsum(sizes)
    words = mix64(gen.integers(0, 2000, stop[-1]).astype(np.uint64))
    words[706 : 706 + 90_000] = mix64(np.arange(90_000, dtype=np.uint64))
    got = linededup.simhash(words, stop - sizes, stop)
    for begin, end, bits in zip(stop - sizes, stop, got, strict=True):
        distinct = np.unique(words[begin:end] & np.uint64((1 << 40) - 1))
        votes = np.unpackbits(mix64(distinct[:, None] ^ linededup._SALTS).view(np.uint8).reshape(len(distinct), 24), axis=1)
        assert (2 * votes.astype(int).sum(axis=0) > len(distinct)).tolist() == bits.tolist()


def test_lines(spark):
    long = " ".join(rng.choice(WORDS) for _ in range(60))
    near = long.replace(long.split()[30], "other", 1)
    docs = [(0, f"{long}\nown text here\n\n"), (1, f"Own, TEXT here!\n{near}\nfresh"), (2, None), (3, ""), (None, "fresh")]
    df = spark.createDataFrame([(*d, 3, "z") for d in docs], "doc_id long, text string, n_chars long, line string")
    got = {r.doc_id: r.dropped_lines for r in linededup.line_report(df).collect()}
    assert got[0] == [] and 0 in got[1] and got[2] == [] and got[None] == []
    kept = {r.doc_id: r for r in linededup.drop_repeated_lines(df).collect()}
    assert kept[0].text == docs[0][1] and kept[2].text is None and kept[None].text == "fresh"
    assert kept[1].n_chars == len(kept[1].text) and "Own" not in kept[1].text and "fresh" in kept[1].text
    assert linededup.line_report(df.where("false")).count() == 0


def test_search(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(64) * 0.2).tolist()) for i in range(300)] + [(i, [0.5] * 64) for i in range(300, 340)]
    rows += [(400, None), (420, [0.1, None] + [0.0] * 62), (440, [float("nan")] * 64), (None, [0.1] * 64)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int")
    vectors = knn.whole_vectors(df)
    got = knn.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20).collect()
    v = {i: [int(np.floor(64 * float(np.float32(x)))) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    for q in (i for i in v if i % 20 == 0):
        want = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q))[:20]
        assert [(x.score, x.vec_id) for x in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == [(-s, c) for s, c in want]
    assert knn.top_k(vectors.where("false"), vectors, 20).count() == 0


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in gru.fresh_params(3, 3, dim=4, hidden=3, attend=2).items()}
    r = np.random.default_rng(0)
    x, m, w = r.standard_normal((5, 6, 4)), np.arange(5)[:, None] < np.array([5, 3, 1, 0, 4, 2]), np.arange(1.0, 7.0)
    _, cache = gru.forward(p, x, m, keep=True)
    g, _ = gru.backward(p, cache, w)
    for k, d in g.items():
        for i in range(min(5, d.size)):
            hi, lo = ({n: a.copy() for n, a in p.items()} for _ in range(2))
            hi[k].ravel()[i] += 1e-2
            lo[k].ravel()[i] -= 1e-2
            slope = sum(s * float((gru.forward(q, x, m)[0] * w).sum()) for s, q in ((1, hi), (-1, lo))) / 2e-2
            assert abs(slope - d.ravel()[i]) < 1e-4 * (1 + abs(slope))


def toxic_corpus(n=300):
    """Every third document holds bad words somewhere."""
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        bad = i % 3 == 0
        if bad:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(["zzorq", "kwyx", "vuzzy"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    df = spark.createDataFrame([(*d, 1) for d in [*docs, (900, None), (901, ""), (None, "text")]], "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r._score for r in toxicity.score_documents(df, lab).collect()}
    right = sum((got[i] >= 0.5) == bool(t) for i, _, t in labels)
    assert right >= 0.93 * len(labels) and len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    none = {r._score for r in toxicity.score_documents(df, lab.where("false")).collect()}
    assert none == {0.0}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs, labels = toxic_corpus(120)
    docs = [(i, t, "en", "s", len(t)) for i, t in docs]
    docs += [(500, docs[1][1] + "\nmail me@host.com", "en", "s", 9), (501, docs[1][1] + "\nmail me@host.com", "en", "s", 9), (502, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, str(tmp_path))
        assert new.columns == now.columns, name
        new.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.where(F.contains("text", F.lit("@"))).count() == 0
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in now.collect()}
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
