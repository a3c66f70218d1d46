"""Encoders, counts, packing, PII, fingerprints and extraction against libraries and plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidewright.llm import bpe, bytebpe, fingerprint, html_extract, packing, pii, textops, tokencount

POOL = ["'s", "'re", "'ll", "'", "  ", " ", "\n", "\n\n", "\t", " ", "é", "中文", "12", "½", "!", "...", "<|endoftext|>", "🙂", "S", "the", "Th", "ing", "▁", "<s>", "\x00", "a@b.co", "+1 (523) 555-1055", "1.2.3.4", "4111111111111111"]


def texts(seed, n=400, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["", "x" * 3000, " " * 300 + "a", "ab" * 800]


def test_byte_bpe_equals_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib, docs = bytebpe.PrefixEncoder(path), Tokenizer.from_file(path), texts(1)
    ids, bounds = textops.byte_bpe_ids(docs, textops.WordTable(own.encode_words, limit=50))
    for doc, a, b in zip(docs, bounds[:-1], bounds[1:], strict=True):
        want = lib.encode(doc, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert own.decode_bytes(ids[a:b]).decode("utf-8", "replace") == lib.decode(want, skip_special_tokens=False)


def test_token_counts_equal_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, machine, docs = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.UnitTransducer(path), texts(2)
    want = [len(model.encode(d)) for d in docs]
    assert machine.counts(docs).tolist() == want
    assert [machine.count_long(d, 3) for d in docs] == want
    assert [machine.count_long(d, 64) for d in docs] == want


ROWS = [(0, ""), (1, None), (2, "Hello there, you."), (3, "a b " * 900), (3, "a b " * 900), (None, "No id"), (7, "x" * 5000)]


def frame(spark, rows=ROWS):
    """Rows with more columns, of names that operators use inside."""
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, n long")


def test_encoding_frames(spark):
    back = bpe.decode_documents(bpe.encode_documents(frame(spark))).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in ROWS)
    digests = bpe.digest_documents(frame(spark)).collect()
    assert len(digests) == len(ROWS)
    assert {r.decoded_sha256 for r in digests} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    counts = tokencount.count_tokens(frame(spark), limit=2).collect()
    assert len(counts) == len(ROWS) and all(r.over_limit == (r.n_tokens > 2) for r in counts)
    assert bpe.digest_documents(frame(spark, [])).count() == 0 and tokencount.count_tokens(frame(spark, [])).count() == 0


def test_packing(spark):
    own = bytebpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(frame(spark), window=64).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length, p.ids))
    stream = []
    for k in sorted(by_sequence):
        at = 0
        for offset, length, ids in sorted(by_sequence[k]):
            assert offset == at and len(ids) == 4 * length
            at += length
            stream += np.frombuffer(ids, "<u4").tolist()
        assert at == 64 or k == max(by_sequence)
    whole = sorted(own.decode_bytes(np.array(x, np.int64)).decode() for x in _documents(stream))
    assert whole == sorted(t or "" for _, t in ROWS)
    assert packing.pack_documents(frame(spark, [])).count() == 0
    assert {zlib.crc32(p.ids) for p in pieces}


def _documents(stream):
    """Splits at the end id; the texts here do not hold it."""
    out = [[]]
    for i in stream:
        if i == 1:
            out.append([])
        else:
            out[-1].append(i)
    return out[:-1]


def brute_spans(t):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(3)
    pool = [*"aZ9.@-+% ()0123", "4111111111111111", "1.2.3.4", "255.", "@x.co", "+1 (523) 555-1055", "é", "\n", "a.b@c.d"]
    for _ in range(5000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ("1" * 100_000, "a" * 100_000 + "@", "a@" * 50_000, "1." * 50_000, "+1(" * 50_000):
        pii.base_spans(t)


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"please write to mail address u{i}@host{i}.com today") for i in range(40)] + [(99, "please write to mail address odd.user@localhost today"), (100, None), (101, "")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = rows[40][1].index("odd.user")
    assert got[99].spans == f"email:{start}:{start + len('odd.user@localhost')}" and got[99].n_email == 0 and got[99].n_found == 1
    assert got[100].spans == "" and len(got) == 43
    hidden = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert hidden[99] == "please write to mail address [EMAIL] today" and hidden[0] == hidden[99] and hidden[100] is None


def test_fingerprints(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = " ".join(rng.choice(words) for _ in range(400))
    other = " ".join(rng.choice(words) for _ in range(400))
    a, b, c, d = fingerprint.sketches([base, "zz " * 7 + base, other, base])
    assert fingerprint.likeness(a, d) == 1.0 and fingerprint.likeness(a, b) > 0.85 and fingerprint.likeness(a, c) < 0.3
    empty = np.zeros(0, np.uint32)
    assert fingerprint.likeness(empty, empty) == 1.0 and fingerprint.likeness(empty, a) == 0.0
    rows = [(i, t) for i, t in enumerate([base, "", None, other, "short", base, "x" * 4000, "é🙂" * 50])]
    got = {r.doc_id: r for r in fingerprint.compare_with_next(frame(spark, rows), rows_each=2).collect()}
    for i, t in rows:
        t, following = t or "", rows[(i - 1) % len(rows)][1] or ""
        want = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == fingerprint.written(fingerprint.sketches([t])[0])
        assert got[i].near_next == fingerprint.likeness(*fingerprint.sketches([t, following]))
    assert fingerprint.compare_with_next(frame(spark, [])).count() == 0
    assert fingerprint.compare_with_next(frame(spark, [(None, "a")])).count() == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name, with a long slogan</h2></header><nav><ul><li><a href="/a">Menu entry</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept them all, please.</div><div class="ad">Buy this, now, at a very low price.</div>
<article><h1>Title &amp; more</h1><p>First paragraph, with   some
text, and <b>bold</b> words in it &copy; 2020.<p>Second one, which is unclosed, has &lt;tags&gt;.<br>And a line.</p>
<form><input name="q"><p>Subscribe, please, to our very long list.</p></form></article>
<aside><p>Related, reading, and more, of the same, kind.</p></aside>
<section class="comments"><p>Great post, thank you, really, very, much indeed.</p></section>
<footer>&copy; site, all rights, reserved</footer></body></html>"""


@pytest.mark.parametrize("page", [PAGE, PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")])
def test_main_text(page):
    assert html_extract.main_text(page) == "Title & more\n\nFirst paragraph, with some text, and bold words in it © 2020.\n\nSecond one, which is unclosed, has <tags>. And a line."


def test_main_text_edges(spark):
    for page in (None, "", "<", "<p", "<!-- x", "<script>never closed", "<div>" * 5000 + "deep text that is long enough to count"):
        html_extract.main_text(page)
    assert html_extract.main_text("<article><p>Hi.</p></article>") == "Hi."
    rows = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5)], "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html_extract.extract_pages(rows).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(got[1].text)
