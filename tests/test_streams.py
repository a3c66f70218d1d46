"""Keyed streams: order, repeats, rejected events, restarts from a checkpoint, and their batch twins."""

import random

import pytest

from tidewright.streaming import endpoints, ordered, queue

rng = random.Random(4)


def play(events):
    task = queue.Task(1)
    for event, detail in events:
        task.apply(event, detail)
    return task


def test_results_count_only_in_work():
    task = play([("add", "a.wav"), ("finished", "p"), ("start", None), ("start", None), ("finished", "p1"), ("fail", "late")])
    assert (task.state, task.phonemefile, task.error, task.rejected) == ("Finished", "p1", None, 3)
    assert task.rejection == "setting result valid only in processed state"


def test_renaming_and_removal():
    task = play([("add", "a.wav"), ("start", None), ("finished", "p"), ("force_rename", None), ("start", None), ("renamed", "b.wav")])
    assert (task.state, task.audiofile, task.renaming_required, task.full_rename) == ("Finished", "b.wav", False, True)
    assert play([("add", "a"), ("start", None), ("renamed", "b")]).state == "Waiting"
    assert play([("add", "a"), ("start", None), ("remove", None)]).rejection == "cannot remove task in processing state"
    assert play([("add_unlinked", "a"), ("force_rename", None)]).state == "UnassignedId"
    assert play([("add", "a"), ("remove", None), ("start", None)]).rejection == "update of unknown task: 1"
    again = play([("add", "a"), ("start", None), ("fail", "x"), ("remove", None), ("add", "b")])
    assert (again.state, again.audiofile, again.error, again.rejected) == ("Waiting", "b", None, 0)
    assert play([("add", "a"), ("odd", None), ("add", "b")]).rejected == 2


def log_rows(tasks=12, longest=40):
    names = ["start", "finished", "renamed", "fail", "force_rename", "remove", "add", "odd"]
    rows = []
    for t in range(tasks):
        for n in range(1, rng.randint(2, longest)):
            rows.append((t, n, "add" if n == 1 else rng.choice(names), None if n % 7 == 0 else f"d{t}.{n}"))
    rows += rng.sample(rows, len(rows) // 5)  # delivered again
    rng.shuffle(rows)
    return rows


def test_restarted_stream_equals_batch(spark, tmp_path):
    rows = log_rows()
    source, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    halves = (rows[: len(rows) // 2], rows[len(rows) // 2 :])
    for half in halves:
        spark.createDataFrame(half, queue.LOG).repartition(3).write.mode("append").parquet(source)
        log = spark.readStream.schema(queue.LOG).option("maxFilesPerTrigger", 2).parquet(source)
        queue.run_queue(log, out, checkpoint)
    want = sorted(map(tuple, queue.folded(spark.createDataFrame(rows, queue.LOG)).collect()))
    assert sorted(map(tuple, queue.current(spark, out).collect())) == want
    plain = {}
    for t, _, event, detail in sorted(set(rows), key=lambda r: r[:2]):
        plain.setdefault(t, queue.Task(t)).apply(event, detail)
    assert [w[1:3] for w in want] == [(plain[w[0]].state, plain[w[0]].audiofile) for w in want]
    # One row for each task and batch, however many events it had.
    assert ordered.all_rows(spark, out, queue.STATES).groupBy("task_id", "batch").count().where("count > 1").isEmpty()
    # A run without new events changes nothing.
    queue.run_queue(spark.readStream.schema(queue.LOG).parquet(source), out, checkpoint)
    assert sorted(map(tuple, queue.current(spark, out).collect())) == want


def test_gaps_hold_events_back(spark):
    rows = [(1, 1, "add", "a"), (1, 3, "start", None), (2, 2, "add", "b"), (None, 1, "add", "c"), (3, None, "add", "c"), (4, 1, None, "c")]
    got = queue.folded(spark.createDataFrame(rows, queue.LOG)).collect()
    assert [(r.task_id, r.state, r.applied) for r in got] == [(1, "Waiting", 1)]
    assert queue.folded(spark.createDataFrame([], queue.LOG)).count() == 0


def test_work_gives_events_for_waiting_tasks(spark):
    states = spark.createDataFrame(
        [(1, 10, "Waiting", "a.wav", False, 1), (2, 20, "Waiting", "b.wav", True, 3), (3, 30, "Waiting", "c.wav", False, 1), (4, 40, "Waiting", "d.wav", False, 1), (5, 10, "Finished", "e.wav", False, 5)],
        "task_id long, line_id long, state string, audiofile string, renaming_required boolean, applied long",
    )
    lines = spark.createDataFrame([(10, "x"), (20, "y"), (40, "z")], "id long, text string")
    rename = spark.createDataFrame([("b.wav", "b2.wav")], "audiofile string, new_name string")
    made = spark.createDataFrame([(10, "a.phonemes", None), (40, None, "no speech")], "line_id long, phonemefile string, error string")
    got = {(r.task_id, r.seq): (r.event, r.detail) for r in queue.work(states, lines, rename, made).collect()}
    assert got == {
        (1, 2): ("start", None), (1, 3): ("finished", "a.phonemes"), (2, 4): ("start", None), (2, 5): ("renamed", "b2.wav"),
        (3, 2): ("start", None), (3, 3): ("fail", "no text for line 30"), (4, 2): ("start", None), (4, 3): ("fail", "no speech"),
    }


def plain_endpoints(votes, window, ratio):
    most, least = endpoints.limits(window, ratio)
    speech, out = False, []
    for n in range(len(votes)):
        count = sum(votes[max(0, n - window + 1) : n + 1])
        if not speech and count > most:
            speech = True
            out.append(("start", max(0, n - window + 1)))
        elif speech and count < least:
            speech = False
            out.append(("end", n - window + 2))
    return out + ([("end", len(votes))] if speech else [])


@pytest.mark.parametrize("window,ratio", [(1, 0.6), (5, 0.6), (10, 0.9)])
def test_endpoints(spark, tmp_path, window, ratio):
    clips = {c: [(k // 9 + c) % 2 == 0 if rng.random() < 0.9 else rng.random() < 0.5 for k in range(rng.randint(1, 90))] for c in range(9)}
    rows = [(c, n, v) for c, votes in clips.items() for n, v in enumerate(votes)]
    want = sorted((c, *e) for c, votes in clips.items() for e in plain_endpoints(votes, window, ratio))
    schema = "clip long, n long, voiced boolean"
    assert sorted(map(tuple, endpoints.endpoints(spark.createDataFrame(rows, schema), window, ratio).collect())) == want
    stream = rows + [(c, len(votes), None) for c, votes in clips.items()]
    rng.shuffle(stream)
    spark.createDataFrame(stream, schema).repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ordered.run_batches(endpoints.speech_events(source, window, ratio), "append", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, ordered.all_rows(spark, str(tmp_path / "out"), endpoints.EVENTS).drop("batch").collect())) == want


def test_limits():
    assert endpoints.limits(10, 0.9) == (9, 1)
    with pytest.raises(ValueError):
        endpoints.limits(0, 0.9)
