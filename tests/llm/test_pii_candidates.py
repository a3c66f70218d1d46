"""Discovery of personal data that is written with spaces or in long lists."""

from tidewright.llm import pii


def spans(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {r.doc_id: r.spans.split(",") for r in pii.extract(df).collect()}


def test_spaced_numbers_are_discovered(spark):
    seeds = [f"please call me at +1 (017) 555-{7000 + i} today" for i in range(40)]
    seeds += [f"charge my credit card 4{i:03} 1111 1111 {k} now" for i in range(40) for k in range(1000, 1010) if pii.luhn(f"4{i:03}11111111{k}")]
    hidden = {"please call me at (017) 555-7713 today": ("phone", "(017) 555-7713"), "please call me at 0171 555 7713 today": ("phone", "0171 555 7713")}
    bad = next(f"4999 1111 1111 {k}" for k in range(1000, 1010) if not pii.luhn(f"499911111111{k}"))
    hidden[f"charge my credit card {bad} now"] = ("card", bad)
    got = spans(spark, [*seeds, *hidden])
    for k, (text, (kind, span)) in enumerate(hidden.items(), len(seeds)):
        assert got[k] == [f"{kind}:{text.index(span)}:{text.index(span) + len(span)}"], text


def test_members_of_long_lists_are_discovered(spark):
    seeds = [f"please write to mail address u{i}@host{i}.com today" for i in range(40)]
    names = [f"user{i}@localhost" for i in range(12)]
    text = f"please write to mail address {','.join(names)} today"
    got = spans(spark, [*seeds, text])[40]
    assert got == [f"email:{text.index(n)}:{text.index(n) + len(n)}" for n in names]


def test_candidates_are_linear_and_touch_no_base_span():
    for t in ("1 " * 100_000, "1" * 200_000, "a@" * 100_000, "(1" * 100_000, "1-" * 100_000, "1.2.3.4," * 20_000):
        pii.tokens(t, [])
    text = "call +1 (017) 555-7713 or 0171 555 7713"
    assert [text[s:e] for s, e, *_ in pii.tokens(text, pii.base_spans(text))] == ["0171 555 7713"]
