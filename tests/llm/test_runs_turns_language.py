"""Periodic runs, conversation repair and language identification against brute force, SQL and held-out labels."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import language, queries, runs, turns

DATA = "/root/testdata/sf0.001"
rng = random.Random(13)


def plain_runs(words):
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def built(n, signs):
    words = [rng.randrange(signs) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 20:
            p, s = rng.randint(1, n // 3), rng.randrange(n)
            for i in range(s + p, min(n, s + rng.randint(2, 6) * p)):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("heavy", [0, 0.3, 32])
def test_runs_equal_brute_force(monkeypatch, heavy):
    monkeypatch.setattr(runs, "HEAVY", heavy)
    for t in range(500):
        words = built(rng.randint(300, 600) if t % 20 == 0 else rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5, 30]))
        got = [tuple(r) for r in runs.find_runs(np.array(words, np.int64)).tolist()]
        assert got == plain_runs(words)


def test_long_texts_of_one_word():
    assert runs.find_runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    assert runs.find_runs(np.tile(np.arange(70), 900)).tolist() == [[0, 63_000, 70]]


def test_runs_of_odd_tables(spark):
    rows = [(1, "a b " * 8), (1, "a b " * 8), (None, "x " * 12 + "y"), (3, None), (4, ""), (5, "\t \n"), (6, "é é " * 12), (7, "q " * 30_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, runs string, start long")
    got = sorted(runs.run_report(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got] == [
        (1, 1, 0, 16, 2, 8000), (1, 1, 0, 16, 2, 8000), (3, 0, None, None, None, None), (4, 0, None, None, None, None), (5, 0, None, None, None, None),
        (6, 1, 0, 12, 1, 12000), (7, 1, 0, 30_000, 1, 30_000_000), (None, 1, 0, 12, 1, 12000),
    ]
    assert got[0].collapsed_sha256 == hashlib.sha256(b"a b").hexdigest() and got[-1].collapsed_sha256 == hashlib.sha256(b"x y").hexdigest()
    assert got[2].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert runs.run_report(df.where("false")).count() == 0


def test_repeated_tails(spark):
    rows = [(k, " ".join(str(rng.randrange(50)) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", runs.with_repeated_tail(F.col("doc_id"), F.col("text")).alias("t"))
    for r in df.collect():
        h, words = zlib.crc32(str(r.doc_id).encode()), r.text.split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r.t.split() == words


def cheapest(kinds):
    """(cost, audit) with whole audit strings, runs of up to three inserts."""
    best = {0: (0, "")}
    for kind in kinds:
        initial, fault = divmod(kind, 4)
        new = {}
        for x, (cost, audit) in best.items():
            for _ in range(4):
                ways = [(x, cost + 4, audit + "D")]
                if fault not in (1, 2):
                    more = 3 * (fault == 3)
                    ways.append((turns._next(x, initial), cost + more, audit + "K"))
                    ways.append((turns._next(x, turns._wanted(x)), cost + 3 + more, audit + "R"))
                for y, *way in ways:
                    if y is not None and (y not in new or tuple(way) < new[y]):
                        new[y] = tuple(way)
                x, cost, audit = turns._next(x, turns._wanted(x)), cost + 3, audit + "I"
        best = new
    ends = []
    for x, (cost, audit) in best.items():
        for _ in range(4):
            ends += [(cost, audit)] if x in (0, 3) else []
            x, cost, audit = turns._next(x, turns._wanted(x)), cost + 3, audit + "I"
    return min(ends)


#: Role and text of a row by (initial, fault); a duplicate takes the text of the conversation's first row.
ROLE = {0: "system", 1: "user", 2: "assistant", 3: "tool"}


@pytest.mark.parametrize("block,piece", [(4, 2), (16, 256), (1 << 17, 3)])
def test_repair_equals_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(turns, "PIECE", piece)  # for the parts that run here; tasks of their own use the default
    rows, want = [], {}
    for conv in [None, *range(25)]:
        kinds, seen = [], set()
        for turn in range(rng.randint(1, 30)):
            initial, fault = rng.choice([0, 1, 1, 2, 2, 3]), rng.choice([0, 0, 0, 1, 2, 3])
            text = {0: f"t{turn}.", 1: " \t", 2: "same!", 3: f"t{turn}, "}[fault]
            fault = 0 if fault == 2 and (initial, text) not in seen else fault
            seen.add((initial, text))
            kinds.append(4 * initial + fault)
            rows.append((conv, turn if turn else None, ROLE[initial], text, 1, "x"))
        want[conv] = (*cheapest(kinds), [sum(k % 4 == f for k in kinds) for f in (1, 2, 3)])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int, block string").repartition(5)
    got = {r.conv_id: r for r in turns.report(df, block=block).collect()}
    assert {c: (r.cost, r.audit, [r.blank, r.duplicate, r.truncated]) for c, r in got.items()} == want
    lines = {}
    for r in turns.repaired(df, block=block).collect():
        lines.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    for c, r in got.items():
        text = "\n".join(t for _, t in sorted(lines.get(c, [])))
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repair_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, kind string"
    long = "word " * 100_000 + "end."
    rows = [(1, 5, "user", "Hi.", "k")] * 3 + [(1, 9, None, None, "k"), (2, None, "user", long, "k"), (2, None, "assistant", "Yes.", "k"), (3, 1, "", "x.", "k")]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in turns.report(df).collect()}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].illegal) == (3, 1, 2, 3)
    assert got[1].cost == cheapest([4, 6, 6, 13])[0] and got[1].audit == cheapest([4, 6, 6, 13])[1]
    assert (got[2].gaps, got[2].audit) == (0, cheapest([8, 4])[1])  # of equal turns the lesser role comes first
    assert got[3].audit == cheapest([12])[1]
    assert turns.report(df.where("false")).count() == 0 and turns.repaired(df.where("false")).count() == 0
    whole = turns.with_all_ids(turns.report(df.where("conv_id = 2")), df).collect()
    assert sorted(r.conv_id for r in whole) == [1, 2, 3]
    assert {r.repaired_sha256 for r in whole if r.conv_id != 2} == {hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_periodic_runs"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    columns = want.columns
    got = queries.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_cross_parsing_equals_brute_force():
    for _ in range(15):
        data = bytes(rng.choice(b"abc") for _ in range(60))
        automaton = language.suffix_automaton(data)
        machine = language.Automata([("x", *automaton)])
        top = automaton[3][0]
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 20))) for _ in range(40)]
        bounds = np.cumsum([0, *map(len, texts)])
        got = machine.costs(np.frombuffer(b"".join(texts), np.uint8), bounds[:-1], bounds[1:])[:, 0]
        for text, cost in zip(texts, got, strict=True):
            want, i = 0.0, 0
            while i < len(text):
                j = i
                while j < len(text) and text[i : j + 1] in data:
                    j += 1
                occurs = sum(data.startswith(text[i:j], k) for k in range(len(data)))
                want += np.log2(top / occurs) if j > i else np.log2(top)
                i = max(j, i + 1)
            assert abs(cost - want) < 1e-3


def test_letters_alone_are_compared():
    raw, bounds, sound = language.normalised(["Ab, c--D 12", None, "12 ...", "éÉ", ""])
    assert [raw[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])] == ["ab c d ", "", "", "éé", ""]
    assert sound.tolist() == [True, False, False, True, False]


def test_language_of_held_out_documents(spark):
    found = queries.op11_language_id(spark, DATA).collect()
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(labels) and held
    assert np.mean([r.lang_pred == labels[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(k, "der die das und ist " * 9, "de", "s") for k in range(9)] + [(k, "the of and with is " * 9, "en", "s") for k in range(9)]
    rows += [(20, None, "en", "s"), (21, "", "de", "s"), (22, "123 ...", "de", "s"), (None, "the and of", None, "s"), (23, "Das UND die " * 20_000, None, "s"), (24, "中文", None, "s")]
    df = spark.createDataFrame(rows, schema)
    found = language.identify(df, language.learn(df))
    got = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert found.count() == len(rows) and got[20] == got[21] == got[22] == ("und", 0.0)
    assert got[None][0] == "en" and got[23][0] == "de" and got[24][0] in ("de", "en")
    assert language.identify(df.where("false"), language.learn(df)).count() == 0
    assert {r.lang_pred for r in language.identify(df, language.learn(df.where("false"))).collect()} == {"und"}
