"""Pages that an extractor may lose text of, and odd tables of pages."""

import hashlib

import pytest

from tidewright.llm import fingerprint, html_extract

LONG = "This is a long enough sentence, with some commas, and more words to read here. " * 3


def test_a_form_around_the_page_is_the_page():
    text = html_extract.main_text(f"<body><form id=x><div><p>{LONG}</p><p>{LONG}</p></div><input><select><option>z</select></form></body>")
    assert text == "\n\n".join([LONG.strip()] * 2)
    assert "INNER" not in html_extract.main_text(f"<article><p>{LONG}</p><p>{LONG}</p></article><form><p>INNER leave a reply</p></form>")


@pytest.mark.parametrize("name", ["side-by-side", "legal-background", "related-work"])
def test_one_weak_word_among_others_is_no_boilerplate(name):
    assert "INNER" in html_extract.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>INNER {LONG}</p></div></article>")
    assert "INNER" not in html_extract.main_text(f"<article><p>{LONG}</p><div class='{name}'><p><a href=x>INNER {LONG}</a></p></div></article>")


@pytest.mark.parametrize("name", ["sidebar", "related", "legal", "comments", "post-comments", "ad-slot", "cookie-notice", "newsletter-box"])
def test_boilerplate_stays_out(name):
    assert "INNER" not in html_extract.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>INNER {LONG}</p></div></article>")


def test_longer_names_do_not_end_raw_texts():
    page = f"<article><p>{LONG}</p><script>var a = '</scripts>'; code();</script><p>{LONG}</p></article>"
    assert html_extract.main_text(page) == "\n\n".join([LONG.strip()] * 2)
    assert "code" not in html_extract.main_text(f"<p>{LONG}</p><script>code()</script")


def test_deep_pages():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" * 20 + "</div>" * 3000
    assert html_extract.main_text(f"<body>{deep}</body>").count("This is") == 60


def test_odd_tables(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    rows = [(1, "u", "<p>Some text that is long enough to be kept.</p>", "x")] * 2 + [(2, None, None, "x"), (3, "u", "", "x"), (None, "u", long, "x"), (5, "u", "<", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_extract.extract_pages(df).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.text if r.n_chars < 99 else "long") for r in got] == [(1, "Some text that is long enough to be kept.")] * 2 + [(2, ""), (3, ""), (5, "<"), (None, "long")]
    assert got[-1].n_chars == 5000 * (len(LONG) - 1) + 2 * 4999
    assert html_extract.extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("rows_each", [1, 2, 100])
def test_next_documents_of_rows_without_ids(spark, rows_each):
    """Fingerprints: buckets of rows without an id, or of equal ids, have their own first document."""
    texts = [(6, "six " * 30), (5, "five a " * 30), (5, "five b " * 30), (None, "none a " * 30), (None, "none b " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = []
    for (_, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        want.append(hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    got = fingerprint.compare_with_next(df, rows_each=rows_each).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
