"""Quality, gap closing, recognizer clean-up and timings on small tracks."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import gaps, timeline, tracks

COLUMNS = "id long, slot long, phoneme string, word_start boolean, start long, stop long, score double, active boolean, version int"


@pytest.mark.parametrize(
    ("rows", "version", "want"),
    [
        ([("a", True, 0, 100, 1, True), ("b", False, 100, 200, 1, True)], 1, "Ok"),
        ([("a", True, 0, 100, 1, True), ("b", False, 100, 200, 1, True)], 2, "EditedOk"),
        ([("a", True, 0, 100, 1, True), ("b", False, 100, 200, 1, True), ("c", False, 210, 300, 1, True)], 1, "NeedsCheckError"),
        ([("a", True, 0, 100, 1, True), ("b", False, 100, 200, 1, True), ("k", False, 200, 200, 1, False)], 1, "NeedsCheckWarn"),
        ([("a", True, 0, 100, 1, True), ("b", False, 100, 100, 1, False), ("c", False, 100, 200, 1, True)], 1, "NeedsCheckError"),
        ([("a", True, 0, 100, 1, True), ("_", False, 100, 100, 1, False)], 1, "Ok"),
        ([("a", True, 0, 100, 1, True), ("b", False, 100, 200, 1, True), ("k", False, 200, 200, 1, False)], 2, "EditedWithErrors"),
        ([("a", True, 0, 501, 1, True)], 1, "NeedsCheckWarn"),
        ([("a", True, 0, 15, 1, True), ("b", False, 15, 515, 1, True)], 1, "Ok"),
        ([(c, k == 0, 100 * k, 100 * k + 100, 0.14 if k == 1 else 1.0, True) for k, c in enumerate("abcde")], 1, "Ok"),
        ([(c, k == 0, 100 * k, 100 * k + 100, 0.14 if k == 1 else 1.0, True) for k, c in enumerate("abcd")], 1, "NeedsCheckWarn"),
        ([("a", True, 0, 100, 0.15, True)], 1, "Ok"),
        ([("_", True, 0, 0, 1, False)], 1, "Ok"),
    ],
)
def test_quality(spark, rows, version, want):
    df = spark.createDataFrame([(1, k, p, w, a, b, float(s), act, version) for k, (p, w, a, b, s, act) in enumerate(rows, 1)], COLUMNS)
    assert tracks.track_quality(df).first().quality == want


def seg(p, w, a, b, active):
    return {"phoneme": p, "word_start": w, "start": a, "stop": b, "active": active}


@pytest.mark.parametrize(
    ("rows", "count", "want"),
    [
        ([seg("a", True, 0, 100, True), seg("_", False, 100, 140, False), seg("b", False, 140, 200, True)], 1, [(0, 120), (120, 120), (120, 200)]),
        ([seg("a", True, 0, 100, True), seg("_", False, 100, 140, False), seg("b", True, 200, 300, True)], 1, [(0, 140), (140, 140), (200, 300)]),
        ([seg("a", True, 0, 100, True), seg("_", False, 100, 120, False), seg("_", False, 120, 160, False), seg("b", False, 160, 200, True)], 2, [(0, 135), (135, 135), (135, 135), (135, 200)]),
    ],
)
def test_close_gaps(rows, count, want):
    assert gaps.close_all(rows) == count
    assert [(r["start"], r["stop"]) for r in rows] == want


def test_no_overlap(spark):
    row = spark.sql("SELECT array(named_struct('start', 0L, 'stop', 50L), named_struct('start', 40L, 'stop', 45L), named_struct('start', 60L, 'stop', 70L)) AS s").select(gaps.no_overlap(F.col("s")).alias("s")).first().s
    assert [(x.start, x.stop) for x in row] == [(0, 50), (50, 50), (60, 70)]


def test_recognizer(spark):
    frames = [("<s>", 0, 0), ("AH", 0, 9), ("B", 10, 19), ("SIL", 20, 39), ("C", 40, 49)]
    df = spark.createDataFrame([(1, k, *f) for k, f in enumerate(frames)], "id long, slot int, label string, first_frame long, last_frame long")
    got = [(r.phoneme, r.start, r.stop) for r in tracks.clean_recognised(df).orderBy("slot").collect()]
    assert got == [("AH", 0, 95), ("B", 95, 190), ("SIL", 200, 395), ("C", 400, 490)]


def test_generated(spark):
    df = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c")], "id long, word_no long, i long, raw string")
    got = [(r.phoneme, r.word_start, r.start, r.stop) for r in tracks.generated_timings(df).orderBy("start").collect()]
    assert got == [("a", True, 700, 800), ("b", False, 800, 900), ("c", True, 1000, 1100)]


@pytest.mark.parametrize(
    ("name", "kind", "id_", "seconds"),
    [
        ("0001234567[1.2500]-x.wav", "audio", 1234567, 1.25),
        ("take_12.ogg", "audio", 12, None),
        ("12345678901.wav", "audio", 1234567890, None),
        ("hello.wav", "unlinked", None, None),
        ("4294967296.wav", "unlinked", None, None),
        ("0000000007.phonemes", "phonemes", 7, None),
        ("7.txt", None, None, None),
        ("nodot", None, None, None),
    ],
)
def test_file_names(spark, name, kind, id_, seconds):
    n = F.lit(name)
    r = spark.range(1).select(T.file_kind(n).alias("k"), T.file_id(n).alias("i"), T.file_duration(n).alias("d")).first()
    assert r.k == kind and r.d == seconds
    if kind in ("audio", "phonemes"):
        assert r.i == id_


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.voiceover_actor(F.lit(v))) for v in ("geralt_x_0001", "a_b_c_1", "a_b", "abc", "")] == ["GERALT", "A_B", "A", "ABC", None]
    assert one(T.strip_hints(F.lit("a *b* c"))) == "a  c"
    assert one(T.decode_text(F.lit(' "say ""hi"" now" '))) == 'say "hi" now'
    assert one(T.consecutive_dedup(F.lit("aabbc"))) == "abc"
    assert one(T.meta_value(F.lit(";meta[text=a=b]c]"))) == "a=b]c"
    assert one(T.snap_ms(F.lit(12.5), 5, F.lit(0), F.lit(100))) == 15
    assert one(T.directory_language(F.lit("speech.EN.pack"))) == "en"
    assert one(timeline.normalised(F.array(F.lit(0), F.lit(0)))) == [0, 0]
