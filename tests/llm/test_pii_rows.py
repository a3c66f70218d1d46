"""Masking of rows that share an id, or have none."""

from tidewright.llm import pii


def test_rows_of_one_id_keep_their_own_spans(spark):
    rows = [(i, f"please write to mail address u{i}@host{i}.com today") for i in range(40)]
    odd = [(99, "please write to mail address odd.user@localhost today"), (99, "Hello, please write to mail address two.users@localhost today"), (99, "a clean text that must stay just as long as it was"), (None, "please write to mail address no.id@localhost today")]
    got = [r.text for r in pii.masked(spark.createDataFrame(rows + odd, "doc_id long, text string")).where("doc_id = 99 or doc_id is null").collect()]
    assert sorted(got) == sorted(["please write to mail address [EMAIL] today", "Hello, please write to mail address [EMAIL] today", odd[2][1], "please write to mail address [EMAIL] today"])
