"""The data sources: pruned file lists, errors, commit and abort."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import catalog
from tidewright.sources import formats, readers, sinks

BODY = ";meta[language=en]\n;meta[version=2]\n;meta[text=hi]\n;phoneme|start|end|weight|score\n----\na|0|100|1.0|0.9\n;_|100|120|1.0|-1.0\n---\nb|120|200|1.1|1.0\n"


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    for k in range(1, 9):
        (tmp_path / f"{k:010d}.phonemes").write_text(BODY if k != 8 else "a|0|1|1.0\n")
    for name in ("0000000001[1.5]-x.wav", "0000000002[x].ogg", "note.wav", "other.txt", "99999999999.wav", ".hidden.wav"):
        (tmp_path / name).write_text("")
    return str(tmp_path)


def reader(folder, **options):
    return formats.Tracks({"path": folder, **options}).reader(None)


def test_names_alone_choose_files(folder):
    assert [f.name for f in reader(folder, kind="phonemes", ids="3, 5,99").files()] == ["0000000003.phonemes", "0000000005.phonemes"]
    assert [f.name for f in reader(folder, ids="1-2", names="*.[wo][ag][vg]").files()] == ["0000000001[1.5]-x.wav", "0000000002[x].ogg"]
    assert [f.name for f in reader(folder, kind="unlinked").files()] == ["99999999999.wav", "note.wav"]
    assert reader(folder, kind="audio,unlinked", ids="7").files() == [] and len(reader(folder).files()) == 12


def test_bodies_of_other_files_are_not_opened(spark, folder):
    rows = spark.read.format("tracks").option("kind", "phonemes")
    # The eighth file cannot be parsed: had it been opened, the read would fail.
    few = rows.option("ids", "1-3").load(folder).select("id", "version", F.size("segments").alias("n"))
    assert sorted(map(tuple, few.collect())) == [(1, 2, 3), (2, 2, 3), (3, 2, 3)]
    # A table that was filtered once is whole when it is used again.
    assert (few.where("id < 2").count(), few.count(), few.join(few.where("id < 2").select("id"), "id", "left_anti").count()) == (1, 3, 2)
    with pytest.raises(Exception, match="body before header"):
        spark.read.format("tracks").load(folder).collect()
    lenient = spark.read.format("tracks").option("onError", "row").load(folder).where("error is not null").collect()
    assert [(r.id, r.error) for r in lenient] == [(8, "line 1: body before header")]


def test_names_mean_what_the_column_functions_say(spark, folder):
    names = ["0000000001[1.5]-x.wav", "0000000002[x].ogg", "note.wav", "other.txt", "99999999999.wav", "12.phonemes", "x_7.wav", "4294967296.wav", "+5.phonemes", "no", "a.b.12.ogg"]
    want = {r.name: (r.kind, r.id, r.duration) for r in catalog.catalogue(spark.createDataFrame([(n,) for n in names], "name string")).collect()}

    class Info:
        size, path = 0, ""

        def __init__(self, name):
            self.base_name = name

    got = {n: (f.kind, f.id, f.seconds) for n in names for f in [formats.named(Info(n))] if f.kind}
    assert got == want and T.MAX_ID == formats.MAX_ID


def test_partitions_by_size(folder):
    parts = reader(folder, kind="phonemes", bytesPerPartition=10_000).partitions()
    assert sum(len(p.files) for p in parts) == 8 and all(len(p.files) <= 2 for p in parts)
    assert len(reader(folder).partitions()) == 1


def test_round_trip(spark, folder, tmp_path):
    first = readers.tracks(spark, f"{folder}/000000000[1-7].phonemes")
    files = sinks.track_files(first)
    out = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "0000000077.phonemes").write_text(BODY)
    (tmp_path / "out" / "0000000001.wav").write_text("kept")
    files.repartition(3).write.format("tracks").mode("append").save(out)
    got = spark.read.format("tracks").load(out).where("kind = 'phonemes'")
    assert sorted(r.id for r in got.collect()) == [*range(1, 8), 77]
    shape = lambda r: [(s.phoneme, s.word_start, s.start, s.stop, s.weight, s.score, s.active) for s in r.segments]
    assert shape(got.where("id = 2").first()) == shape(first.first())
    files.where("name like '%2.phonemes'").write.format("tracks").mode("overwrite").save(out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0000000001.wav", "0000000002.phonemes"]


def test_failed_write_leaves_the_folder(spark, tmp_path):
    formats.register(spark)
    out = tmp_path / "out"
    out.mkdir()
    (out / "0000000001.phonemes").write_text("old")
    bad = spark.createDataFrame([("a.phonemes", "x"), ("b/c.phonemes", "y")], "name string, content string").repartition(2)
    twice = spark.createDataFrame([("a.phonemes", "x"), ("a.phonemes", "y")], "name string, content string").repartition(2)
    for rows in (bad, twice):
        with pytest.raises(Exception):
            rows.write.format("tracks").mode("append").save(str(out))
        assert [(p.name, p.read_text()) for p in out.iterdir()] == [("0000000001.phonemes", "old")]
    with pytest.raises(Exception, match="rows"):
        spark.range(3).write.format("tracks").mode("append").save(str(out))


def test_lines(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.csv").write_text(";meta[language=en]\n;id|text|actor\n1|Hello|geralt\n; comment\nx|bad|\n")
    (tmp_path / "b.csv").write_text(";meta[language=en]\n;id|text|actor\n2|Bye|\n")
    rows = spark.read.format("lines").load(str(tmp_path))
    one = spark.read.format("lines").option("names", "b.*").load(str(tmp_path))
    assert [(r.id, r.lang, r.text, r.actor) for r in one.collect()] == [(2, "en", "Bye", None)]
    with pytest.raises(Exception, match="line 5"):
        rows.collect()
    lenient = spark.read.format("lines").option("onError", "row").load(str(tmp_path))
    assert sorted((r.name, r.line_no, r.error) for r in lenient.where("error is not null").collect()) == [("a.csv", 5, "id is not a number")]
