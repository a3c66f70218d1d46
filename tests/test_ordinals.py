"""Ordinals over range partitions: equal to one sort, without gathering the table."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import catalog, ordinals, updates
from tidewright.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions", [1, 3, 16, 40])
def test_equal_to_one_sort(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, *range(20)]), rng.choice("abc"), k) for k in range(600)]
    df = spark.createDataFrame(rows, "a int, b string, own int").repartition(7)
    got = ordinals.numbered(df, ["a", F.col("b").desc(), "own"][:1] + [F.length("b"), "b", "own"], "n", partitions=partitions).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(r.a, r.b, r.own) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(1, 601))


def test_ties_are_dealt_to_many_partitions(spark):
    df = spark.range(20_000, numPartitions=8).select(F.lit(7).alias("same"), "id")
    got = ordinals.numbered(df, ["same"], "n", first=0, partitions=16)
    assert got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (20_000, 0, 19_999)
    assert got.where("n <> id").count() == 0  # ties stay in the order they were read


def test_empty_and_single(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert ordinals.numbered(df, ["a"]).collect() == [("x", 1)]
    assert ordinals.numbered(df.where("false"), ["a"], partitions=5).collect() == []


@pytest.mark.parametrize("name", ["task_ids", "selectable_tasks", "task_update", "task_removal", "task_queue_after_removal", "queue_captions", "folder_listing", "action_prepend"])
def test_no_single_partition(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_queue_in_one_pass(spark):
    names = ["0000000001[1.5]-x.wav", "0000000001[1.7]-y.wav", "0000000001.phonemes", "0000000002-x.wav", "0000000002.phonemes", "0000000003.phonemes", "note.wav", "note.wav", "a.txt"]
    files = catalog.catalogue(spark.createDataFrame([(n,) for n in names], "name string"))
    tasks = catalog.task_queue(files)
    got = sorted(tasks.collect(), key=str)
    assert [(r.line_id, r.audiofile, r.phonemefile, r.state, r.renaming_required) for r in got] == [
        (0, "note.wav", None, "UnassignedId", True),
        (0, "note.wav", None, "UnassignedId", True),
        (1, "0000000001[1.5]-x.wav", "0000000001.phonemes", "Finished", False),
        (2, "0000000002-x.wav", "0000000002.phonemes", "Waiting", True),
    ]
    forced = catalog.task_queue(files, force_rename=True).where("line_id = 1").first()
    assert (forced.state, forced.renaming_required) == ("Waiting", True)
    plan = tasks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_removal_keeps_tasks_in_work(spark):
    tasks = spark.createDataFrame([(1, "Waiting"), (2, "Processing"), (3, "Finished")], "id long, state string")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    assert sorted(r.id for r in updates.without(tasks, ids).collect()) == [2, 3]
    assert {r.id: r.error for r in updates.removed(tasks, ids).collect()} == {1: None, 2: "cannot remove task in processing state", 9: "task (9) not found."}
