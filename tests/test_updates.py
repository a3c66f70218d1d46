"""Updates of tasks and tracks, and the pronunciation cascade."""

from pyspark.sql import functions as F

from tidewright.operators import lookup, updates


def test_pronunciation_cascade(spark):
    words = spark.createDataFrame([("a",), ("b",), ("c",), ("o'bee",)], "word string")
    rule = "word string, rule string"
    custom, known = spark.createDataFrame([("a", "A1")], rule), spark.createDataFrame([("a", "A2"), ("b", "B2")], rule)
    mapped = spark.createDataFrame([("b", "B3"), ("c", "C3")], rule)
    letters = spark.createDataFrame([("o", "OO"), ("b", "BB"), ("e", "(E|I)")], "letter string, alternatives string")
    got = {r.word: r.rule for r in lookup.pronounce(words, custom, known, mapped, letters).collect()}
    assert got == {"a": "A1", "b": "B2", "c": "C3", "o'bee": "OO BB (E|I)"}


def test_set_actor_and_save(spark):
    rows = [(1, None, None, 0), (2, "default", "default", 3), (3, "ANN", "ANN", 1)]
    tracks = spark.createDataFrame(rows, "id long, saved_actor string, actor string, version long")
    new, mappings = updates.set_actor(tracks, F.lit("BOB"))
    assert {r.id: r.actor for r in new.collect()} == {1: "BOB", 2: "BOB", 3: "ANN"}
    assert {(r.actor, r.mapped) for r in mappings.collect()} == {("BOB", "BOB"), ("ANN", "BOB")}
    quality = spark.createDataFrame([(1, "good")], "id long, quality string")
    assert {r.id: (r.version, r.quality) for r in updates.saved_track(tracks, quality).collect()} == {1: (1, "good"), 2: (4, None), 3: (2, None)}


def test_selected_text_without_catalogue(spark):
    chosen = spark.createDataFrame([(1,)], "line_id long")
    assert updates.selected_text(chosen, None).first().text == "missing strings provider!"
