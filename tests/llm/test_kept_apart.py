"""Rows of equal id, built-up texts, clashing names, empty tables: nothing is mixed up or lost."""

import random

import numpy as np

from tidewright.llm import bytebpe, editdist, html_extract, linededup, minhash, textops, toxicity

rng = random.Random(31)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(500)]


def line(n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_built_up_texts_have_their_own_hash():
    sign = [0]
    while len(sign) < 4096:
        sign += [1 - x for x in sign]
    sign = np.array(sign)
    for kind in (np.uint8, np.uint32, np.uint64):
        both = np.concatenate([sign, 1 - sign]).astype(kind) + kind(97)
        a, b = textops.segment_hashes(both, np.array([0, len(sign)]), np.array([len(sign), len(both)]))
        assert a != b


def test_segment_hashes_follow_content_only():
    gen = np.random.default_rng(5)
    symbols = gen.integers(0, 3, 50_000).astype(np.uint32)
    starts = gen.integers(0, 49_000, 4000)
    sizes = np.where(np.arange(4000) % 2, gen.integers(0, 9, 4000), gen.integers(0, 900, 4000))
    seen = {}
    for s, n, h in zip(starts.tolist(), sizes.tolist(), textops.segment_hashes(symbols, starts, starts + sizes).tolist(), strict=True):
        assert seen.setdefault(symbols[s : s + n].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_lines_of_equal_ids_stay_apart(spark):
    first, second, own = line(), line(), line()
    rows = [(1, f"{first}\n{second}", "x"), (2, f"{own}\n{line()}", "x"), (2, f"{line()}\n{second}", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lines string")
    kept = linededup.drop_repeated_lines(df)
    assert kept.columns == df.columns
    texts = {r.text for r in kept.collect()}
    assert rows[0][1] in texts and rows[1][1] in texts and rows[2][1].split("\n")[0] in texts


def test_line_dedup_of_odd_tables(spark):
    schema = "doc_id long, text string, _id string, h long"
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    rows = [(1, long, "a", 1), (2, long + " more", "a", 1), (3, None, "a", 1), (4, "", "a", 1), (5, "!!\n??", "a", 1), (None, long, "a", 1), (7, "x" * 50_000, "a", 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r.text for r in linededup.drop_repeated_lines(df).collect()}
    assert got == {1: long, 2: "", 3: None, 4: "", 5: "!!\n??", None: long, 7: "x" * 50_000}
    assert linededup.drop_repeated_lines(df.where("false")).count() == 0
    same = spark.createDataFrame([(1, long, "a", 1)] * 3, schema)
    assert [r.n_kept for r in linededup.line_report(same).collect()] == [1, 1, 1]  # one document, whatever its copies


def test_large_buckets_are_read_in_bounded_memory():
    keys = np.arange(5000, dtype=np.int64)
    metas = (np.int64(50) << linededup.SIM_BITS) + (keys % 7)
    rows = np.stack([np.zeros(5000, np.int64), keys, metas], 1)
    buckets = linededup.Buckets(80, held=100)
    found = sum(len(buckets.pairs(rows[k : k + 50])[0]) for k in range(0, 5000, 50)) + len(buckets.pairs(rows[:0], end=True)[0])
    assert 4999 <= found <= 2 * 5000 and len(buckets.centres) == 1


def test_upper_bounds_hold():
    for _ in range(300):
        a, b = (" ".join(rng.choice(["a", "bb", "c", "dd", "e", ""]) for _ in range(rng.randint(0, 8))) for _ in range(2))
        far, most = editdist.edit_distance(a, b, 99), rng.randint(0, 9)
        assert editdist.upper_bound(a, b) >= far and editdist.within(a, b, most) == (far <= most)


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    copied, other = line(40), line(40)
    rows = [(1, copied, "a"), (2, copied, "a"), (2, other, "a"), (3, other, "a"), (3, other, "a"), (None, copied, "a"), (9, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _dropped string")
    kept = minhash.near_duplicates_removed(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, copied), (2, other), (0, copied), (9, "")])
    assert minhash.near_duplicates_removed(df.where("false")).count() == 0


def test_raw_text_ends_where_the_page_says():
    page = f"<article><p>{'İ' * 40} {line(30)}</p><script>var a = 1;</script><p>{line(30)}, the end.</p></article>"
    assert "the end." in html_extract.main_text(page) and "var a" not in html_extract.main_text(page)


def test_toxicity_of_odd_tables(spark):
    docs = [(k, line(20) + (" zzorq kwyx" if k % 3 == 0 else ""), 1.0) for k in range(90)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(90)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([*docs, docs[0], (500, None, 1.0), (501, WORDS[0] * 20_000, 1.0), (None, "zzorq", 1.0)], "doc_id long, text string, `_score` double")
    got = toxicity.score_documents(df, labels, score_col="p", windows_col="w")
    assert got.columns == [*df.columns, "p", "w"] and got.count() == 94
    assert {r.p for r in got.where("doc_id = 0").collect()} == {got.where("doc_id = 0").first().p}
    assert toxicity.score_documents(df.where("false"), labels, score_col="p", windows_col="w").count() == 0


def test_hashes_keep_encodings_apart():
    import public_tokenizers

    own = bytebpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    table = textops.WordTable(own.encode_words)
    sign = "a"
    while len(sign) < 2048:
        sign += sign.translate(str.maketrans("ab", "ba"))
    other = sign.translate(str.maketrans("ab", "ba"))
    ids, bounds = textops.byte_bpe_ids([sign, other], table)
    assert [own.decode_bytes(ids[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [sign, other]
