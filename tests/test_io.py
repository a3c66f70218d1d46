"""Readers, sinks and streams on small files."""

import wave

import numpy as np
import pytest

from tidewright.operators import catalog
from tidewright.sources import readers, sinks
from tidewright.streaming import tasks


def test_line_catalogue(spark, tmp_path):
    (tmp_path / "a.csv").write_text(";meta[language=en]\n;id|text|actor\n1|Hello|geralt\n; comment\n2|\"say \"\"hi\"\"\"|\n1|Again|ciri\n")
    got = {r.id: (r.lang, r.text, r.actor) for r in readers.line_catalogue(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {1: ("en", "Again", "ciri"), 2: ("en", 'say "hi"', None)}
    (tmp_path / "b.csv").write_text("ID;X;EN;VOICEOVER\n7;q;\"a; b\";geralt_x_0001\n")
    got = readers.line_catalogue(spark, str(tmp_path / "b.csv"), "en").first()
    assert (got.id, got.text, got.actor) == (7, "a; b", "GERALT")
    (tmp_path / "c.csv").write_text(";meta[language=en]\nid|text\nx|y\n")
    with pytest.raises(ValueError, match="line 3"):
        readers.line_catalogue(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError, match="language"):
        readers.line_catalogue(spark, str(tmp_path / "a.csv"), "de")


def test_similarity(spark, tmp_path):
    (tmp_path / "s.csv").write_text("; c\n[T\\A]|AA|B\na|2.0|\nb|0.5|1.0\n")
    got = {(r.text_ph, r.audio_ph): round(r.score, 3) for r in readers.similarity_matrix(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {("a", "AA"): 2.0, ("a", "B"): -1.0, ("b", "AA"): 0.5, ("b", "B"): 1.0}
    for k, bad in enumerate(("a|2.2|1", "a|1", "a|1|1\na|1|1")):
        (tmp_path / f"{k}.csv").write_text(f"[T\\A]|AA|B\n{bad}\n")
        with pytest.raises(ValueError):
            readers.similarity_matrix(spark, str(tmp_path / f"{k}.csv"))


def test_actor_map(spark, tmp_path):
    (tmp_path / "m").write_text("; c\nA:x\nb:y\na:z\n")
    got = readers.actor_mappings(spark, str(tmp_path / "m")).orderBy("pos").collect()
    assert [(r.actor, r.mapped) for r in got] == [("a", "z"), ("b", "y")]
    (tmp_path / "n").write_text("a:b:c\n")
    with pytest.raises(ValueError, match="line 1"):
        readers.actor_mappings(spark, str(tmp_path / "n"))


def test_actor_map_comments(spark, tmp_path):
    (tmp_path / "m").write_text("; first\na:x\n\n  ; second\nb:y\n")
    assert readers.comments(spark, str(tmp_path / "m")) == ["; first", "; second"]


def test_translator_dictionary(spark, tmp_path):
    (tmp_path / "d").write_text("; c\nCleanup = !?-\nword  w_er_d\nfoo f_oo\nword wo\nalone\n")
    words, signs = readers.replacements(spark, str(tmp_path / "d"))
    assert {(r.search, r.replacement) for r in words.collect()} == {("word", "wo"), ("foo", "f_oo")} and signs == "".join(sorted("!?-…*/+\\"))
    words, signs = readers.replacements(spark, str(tmp_path / "none"))
    assert words.isEmpty() and signs == "".join(sorted(readers.CLEANUP))
    (tmp_path / "d").write_text("a b\nother = x\n")
    with pytest.raises(ValueError, match="other = x"):
        readers.replacements(spark, str(tmp_path / "d"))


def test_recognizer_config(spark, tmp_path):
    (tmp_path / "c").write_text("; c\nphonemes = AA B AA C\ncleanup = .,.\ndictionary = x.dict\na = AA\nb = B|AA\n")
    settings, phonemes, letters = readers.recognizer_config(spark, str(tmp_path / "c"))
    assert sorted(r.label for r in phonemes.collect()) == ["AA", "B", "C"] and readers.cleanup_signs(settings) == ",."
    assert {r.letter: r.alternatives for r in letters.collect()} == {"a": "AA", "b": "(AA|B)"}
    for bad, why in (("strange = 1", "unknown key strange"), ("a =", "at least one alternative"), ("a = ZZ", "unknown phoneme: ZZ"), ("a = b = c", "expected 2 columns")):
        (tmp_path / "c").write_text(f"phonemes = AA B\n{bad}\n")
        with pytest.raises(ValueError, match=why):
            readers.recognizer_config(spark, str(tmp_path / "c"))


def test_track_round_trip(spark, tmp_path):
    body = ";meta[language=en]\n;meta[version=2]\n;meta[text=hi]\n;phoneme|start|end|weight|score\n----\na|0|100|1.0|0.9\n;_|100|120|1.0|-1.0\n---\nb|120|200|1.1|1.0\n"
    (tmp_path / "0000000007.phonemes").write_text(body)
    first = readers.tracks(spark, str(tmp_path / "*.phonemes"))
    row = first.first()
    assert (row.id, row.version, [s.active for s in row.segments], [s.word_start for s in row.segments]) == (7, 2, [True, False, True], [True, False, True])
    (tmp_path / "out").mkdir()
    sinks.write_named(sinks.track_files(first), str(tmp_path / "out"))
    again = readers.tracks(spark, str(tmp_path / "out" / "*.phonemes")).first()
    shape = lambda r: [(s.phoneme, s.word_start, s.start, s.stop, s.weight, s.score, s.active) for s in r.segments]
    assert shape(again) == shape(row) and again.version == 2 and again.text == "hi"


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.array([1, 2, 3, 4], "<i2").tobytes())
    row = readers.wav_clips(spark, str(tmp_path / "x.wav")).first()
    assert (row.rate, row.channels, row.pcm) == (16000, 2, [2, 4])


def test_missing_report(spark):
    lines = spark.createDataFrame([(2, "b", "x"), (1, "a", None)], "id long, text string, actor string")
    none = spark.createDataFrame([], "id long")
    got = [r.line for r in sinks.missing_report(catalog.missing_lines(lines, none)).collect()]
    assert got[1] == "; missing lines: 2" and got[3:] == ["0000000001||a", "0000000002|x|b"]
    assert sinks.missing_report(catalog.missing_lines(lines, lines.select("id"))).count() == 0


def test_states():
    assert tasks.next_state("Waiting", "start") == "Processing"
    assert tasks.next_state("Waiting", "finish") == "Waiting"
    assert tasks.next_state("Error", "reset") == "Error" and tasks.next_state("Finished", "reset") == "Waiting"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"task_id": 1, "state": "Waiting"}\n{"task_id": 2, "state": "Error"}\n')
    tasks.process_waiting(spark, str(tmp_path / "in"), "task_id long, state string", lambda x: x, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.task_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
