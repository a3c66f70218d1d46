"""The public functions: generation, extraction, plugged-in decoders, the dictionary file."""

import pytest
from pyspark.sql import functions as F

from tidewright import api


def lines(spark):
    rows = [(1, "one two", "ANN"), (2, "three", None), (3, "", "BOB")]
    return spark.createDataFrame(rows, "id long, text string, actor string")


def translate(rows):
    """Each letter is a phoneme."""
    spread = F.array_join(F.transform(F.split("text", " "), lambda w: F.btrim(F.regexp_replace(w, "(.)", "$1_"), F.lit("_"))), " ")
    return rows.select("id", spread.alias("translated"))


def test_generate(spark):
    tracks, results = api.generate(lines(spark), translate)
    got = tracks.orderBy("start").collect()
    assert [r.phoneme for r in got] == list("onetwo") and [r.word_start for r in got] == [True, False, False] * 2
    assert all(a.stop <= b.start for a, b in zip(got[:-1], got[1:], strict=True))
    assert {r.id: r.error for r in results.collect()} == {1: None, 2: None, 3: "empty translation"}


def test_extract(spark):
    def recognize(clips):
        labels = F.posexplode(F.array(*map(F.lit, ("SIL", "o", "n", "e", "SIL", "t", "w", "o"))))
        each = clips.select("id", labels.alias("slot", "label"))
        return each.select("id", "slot", "label", (F.col("slot") * 10).alias("first_frame"), (F.col("slot") * 10 + 9).alias("last_frame"))

    scores = [(a, t, 1.0 if a == t else -1.0) for a in "onetw" for t in "onetw"]
    found = api.extract(lines(spark).where("id = 1"), spark.createDataFrame([(1,)], "id long"), translate, recognize, scores).first()
    assert found.error is None and [r.phoneme for r in found.rows] == list("onetwo") and all(r.op == "match" or r.active for r in found.rows)
    assert api.extract(lines(spark).where("id = 2"), spark.createDataFrame([(1,)], "id long"), translate, recognize, scores).first().error == "empty sequence"


def test_process(spark, tmp_path):
    """The whole chain: gate, hints, alignment, closed gaps, quality, files; every kind of failure; results as events."""
    heard = {1: ("SIL", "o", "n", "x", "e", "SIL", "t", "w", "o"), 5: (), 6: ("t", "w", "o")}

    def recognize(clips):
        assert "pcm" in clips.columns and {r.rate for r in clips.select("rate").collect()} == {16000}
        each = clips.select("id", F.posexplode(F.element_at(F.create_map(*(x for k, v in heard.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")))), F.col("id").cast("int"))).alias("slot", "label"))
        return each.select("id", "slot", "label", (F.col("slot") * 10).alias("first_frame"), (F.col("slot") * 10 + 9).alias("last_frame"))

    texts = [(11, "one *loudly* two", "ANN"), (13, "", "BOB"), (14, "x", None), (15, "two", None), (16, "two: a/b", "CID DO")]
    known = spark.createDataFrame(texts, "id long, text string, actor string")
    tone = [0, 100, -200, 300] * 4410
    clips = [("a/1.wav", 44100, 1, 16, tone), ("a/3.wav", 44100, 1, 16, tone), ("a/4.wav", 8000, 1, 16, tone), ("a/5.wav", 16000, 2, 16, tone), ("a/6.wav", 44100, 1, 16, tone)]
    audio = spark.createDataFrame(clips, "audiofile string, rate int, channels int, bits int, pcm array<smallint>")
    rows = [(1, 11, "a/1.wav", False, False), (2, 12, "a/1.wav", False, False), (3, 13, "a/3.wav", False, False), (4, 14, "a/4.wav", False, False), (5, 15, "a/5.wav", False, False),
            (6, 16, "a/6.wav", True, True), (7, 16, "a/6.wav", True, False), (8, 14, "a/8.wav", False, False)]
    tasks = spark.createDataFrame(rows, "task_id long, line_id long, audiofile string, renaming_required boolean, full_rename boolean")
    scores = [(a, t, 1.0 if a == t else -1.0) for a in "onetwx" for t in "onetw"]
    got = {r.task_id: r for r in api.process(tasks, known, audio, translate, recognize, scores, str(tmp_path), "en").collect()}
    assert {k: r.error for k, r in got.items()} == {
        1: None, 2: "no text for line 12", 3: "text to phoneme translator returned empty string.", 4: "expected format >= 16000 Hz, 16 bit, 1 or 2 channel. found 8000 Hz, 16 bit, 1 channel(s)",
        5: "audio phoneme extractor returned empty result.", 6: None, 7: None, 8: "audio not found: a/8.wav",
    }
    assert (got[6].result, got[7].result) == ("0000000016[0.4000]-CID_DO-two__a_b.wav", "0000000016[0.4000]-CID_DO-.wav")
    assert got[1].result == f"{tmp_path}/0000000011.phonemes" and got[1].closed == 1 and got[1].quality in ("Ok", "NeedsCheckWarn", "NeedsCheckError")
    assert [p.name for p in tmp_path.iterdir()] == ["0000000011.phonemes"]
    track = spark.read.format("tracks").load(str(tmp_path)).first()
    assert (track.id, track.version, track.language, track.actor, track.text) == (11, 1, "en", "ANN", "one *loudly* two")
    assert [s.phoneme for s in track.segments if s.active] == list("onetwo") and "l" not in track.translation
    inside = [s for s in track.segments if not s.active]
    assert [s.phoneme for s in inside] == ["_"] and inside[0].start == inside[0].stop  # the sound that is not written has no length
    states = spark.createDataFrame([(k, k) for k in range(1, 9)], "task_id long, applied long")
    results = spark.createDataFrame(list(got.values()), "task_id long, line_id long, operation string, result string, quality string, closed long, error string")
    events = {(r.task_id, r.seq): r.event for r in api.result_events(results, states).collect()}
    assert (events[1, 2], events[1, 3], events[2, 4], events[6, 8]) == ("start", "finished", "fail", "renamed")


def test_public_names():
    import tidewright

    assert all(callable(getattr(tidewright, n)) for n in tidewright.__all__)
    with pytest.raises(AttributeError):
        tidewright.nothing


def test_missing_audio(spark):
    files = spark.createDataFrame([("0000000001[1.5]-x.wav",), ("note.wav",)], "name string")
    assert {r.id for r in api.find_missing_audio(lines(spark), files).collect()} == {2, 3}


def test_decoders(spark, tmp_path):
    (tmp_path / "a.ogg").write_bytes(bytes([1, 2, 3, 4]))
    with pytest.raises(ValueError, match="no decoder"):
        api.load_audio(spark, str(tmp_path / "a.ogg"))
    api.register_decoder("ogg", lambda raw: (100, 2, list(raw)))
    assert api.load_audio(spark, str(tmp_path / "a.ogg")).first().pcm == [2, 4]


def test_dictionary_and_mapping_files(spark, tmp_path):
    labels, path = spark.createDataFrame([("AA",), ("B",)], "label string"), str(tmp_path / "phonemes.dict")
    assert api.refresh_phoneme_dictionary(spark, path, labels)
    assert not api.refresh_phoneme_dictionary(spark, path, labels)
    assert {r.value for r in spark.read.text(path).collect()} == {"AA AA", "B B", "SIL SIL"}
    assert api.refresh_phoneme_dictionary(spark, path, labels.where("label = 'B'"))
    assert open(api.search_actor_mappings_file(str(tmp_path / "new"))).read() == ""


def test_options():
    assert api.one_of(extract=True, generate=False) == "extract"
    for given in ({}, {"generate": 1, "extract": 1}):
        with pytest.raises(ValueError, match="exactly one"):
            api.one_of(**{"generate": 0, "extract": 0} | given)
