"""Conversation structure repair by dynamic programming over rank-compressed audits.

Rows get the first fault that applies: blank (no sign but white space), duplicate (role and text seen earlier
in the conversation), truncated (the last sign ends no sentence).  The cheapest edits are sought whose roles'
initials read ``(s?(ua)+)?``: keep (K, 0), rerole to user or assistant (R, 3), delete (D, 4; a must for blank
and duplicate rows) and insert an empty turn (I, 3); a truncated row that stays costs 3 more.  Of equally cheap
repairs the one with the ASCII-least audit (its edits' letters in order) is taken.

A row's macro edit is a run of up to two inserts, then its own edit.  (A longer run holds a user and an
assistant turn that can both go, so it is never cheapest.)  The letters of macro edits are prefix-free codes,
so of two audits over the same rows the smaller one is found by the first macro edit that differs: a layer
needs no audit strings, only each state's cost, its audit's rank among the states, and a parent pointer.

A conversation may hold any share of all rows.  Rows are sorted by conversation and turn over the whole table
(range partitions, which may cut a conversation) and numbered; blocks of numbered rows are worked on one by
one, in pieces of at most ``PIECE`` rows.  A piece gives for each state before it the cost and rank of each
state after it.  Pieces that reach a block's end are folded into one row a block and conversation; those rows
alone meet per conversation, to choose the states at the cuts; then every block follows its parent pointers.

Order and nulls: rows of a conversation go by turn (nulls first), then role, then text (its first 64
characters, then its hash); equal rows cannot be told apart.  A null role or text counts as one space.  A null
id is a conversation of its own.  Very long texts are never gathered: one row at a time is held.  Extra columns
are not read.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, saved

#: Rows of a piece, and of a block of pieces.
PIECE, BLOCK = 256, 1 << 17
#: Signs that are no white space, and costs of the edits.
SIGN = r"[^\x20\x09-\x0D]"
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3

NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: which initial was written last.
START, SYSTEM, USER, ASSISTANT = range(4)
S, U, A, OTHER = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
#: Macro edits in ASCII order of their letters: number of inserts, edit.
MACROS = sorted(((n, e) for n in range(3) for e in "DKR"), key=lambda m: "I" * m[0] + m[1])


def _next(state: int, initial: int) -> int | None:
    """The state after a turn with this initial, None if it may not follow."""
    if initial == S:
        return SYSTEM if state == START else None
    if initial == U:
        return USER if state != USER else None
    return ASSISTANT if initial == A and state == USER else None


def _wanted(state: int) -> int:
    """The initial that user or assistant must have after a state."""
    return A if state == USER else U


def _tables() -> tuple[np.ndarray, np.ndarray, list]:
    """By (initial, fault): cost of (new state, old state and macro edit) and by (old state, macro edit) the inserted turns."""
    m = len(MACROS)
    cost = np.full((16, 4, 4 * m), FAR, np.int64)
    inserted: list[tuple[int, ...]] = []
    middle: list[int] = []
    for x in range(4):
        for n, _ in MACROS:
            state, made = x, []
            for _ in range(n):
                made.append(_wanted(state))
                state = _next(state, made[-1])
            inserted.append(tuple(made))
            middle.append(state)
    for initial in range(4):
        for fault in range(4):
            for x in range(4):
                for j, (n, edit) in enumerate(MACROS):
                    state, price = middle[x * m + j], n * INSERT
                    if edit == "D":
                        target, price = state, price + DELETE
                    elif fault in (BLANK, DUPLICATE):
                        continue
                    else:
                        target = _next(state, initial if edit == "K" else _wanted(state))
                        price += (REROLE if edit == "R" else 0) + (CUT_OFF if fault == TRUNCATED else 0)
                    if target is not None:
                        cost[4 * initial + fault, target, x * m + j] = price
    return cost, inserted, middle


COST, INSERTED, MIDDLE = _tables()
M = len(MACROS)
#: Inserts that end a conversation after a state.
ENDING = {START: (), SYSTEM: (U, A), USER: (A,), ASSISTANT: ()}


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Places of the values of the last axis among themselves."""
    return (keys[..., None, :] < keys[..., :, None]).sum(-1)


def solve_pieces(kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of rows (kind: 4 * initial + fault): cost and rank by (piece, state before, state after), and
    parent pointers by (row, state before, state after)."""
    n = len(starts)
    cost = np.full((n, 4, 4), FAR, np.int64)
    cost[:, range(4), range(4)] = 0
    rank = np.broadcast_to(np.arange(4), (n, 4, 4)).copy()
    parents = np.zeros((len(kinds), 4, 4), np.int8)
    order = np.argsort(-sizes, kind="stable")
    for b in range(0, n, 1024):
        lanes = order[b : b + 1024]
        for k in range(int(sizes[lanes[0]]) if len(lanes) else 0):
            lanes = lanes[sizes[lanes] > k]
            rows = starts[lanes] + k
            before = np.repeat(np.minimum(cost[lanes], FAR) * 64 + rank[lanes] * M, M, axis=2) + np.tile(np.arange(M), 4)
            keys = before[:, :, None, :] + (COST[kinds[rows]] * 64)[:, None, :, :]
            best = keys.argmin(-1)
            least = np.take_along_axis(keys, best[..., None], -1)[..., 0]
            cost[lanes] = np.minimum(least // 64, FAR)
            rank[lanes] = _ranks(np.where(least // 64 < FAR, least % 64, 64 + np.arange(4)))
            parents[rows] = best
    return cost, rank, parents


def _follow(cost: np.ndarray, rank: np.ndarray, more: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and ranks (..., state) carried over a piece (state, state), and the state before for each state after."""
    keys = (np.minimum(cost, FAR) * 4 + rank)[..., :, None] + np.minimum(more, FAR) * 4
    at = keys.argmin(-2)
    least = np.take_along_axis(keys, at[..., None, :], -2)[..., 0, :]
    total = np.minimum(least // 4, FAR)
    inner = ranks[at, np.arange(4)]
    tie = np.where(total < FAR, least % 4 * 4 + inner, 64 + np.arange(4))
    return total, _ranks(tie), at


def _last_state(cost: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The state before the ending inserts (..., state)."""
    ends = np.array([INSERT * len(ENDING[x]) for x in range(4)])
    return ((np.minimum(cost, FAR) + ends) * 4 + rank).argmin(-1)


def _block(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in order; where conversations begin; where pieces begin; how many pieces each conversation has."""
    frame = frame.sort_values("at", ignore_index=True)
    n = len(frame)
    new = np.ones(n, bool)
    new[1:] = (frame["conv"].values[1:] != frame["conv"].values[:-1]) | (frame["noid"].values[1:] != frame["noid"].values[:-1])
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, n))
    counts = -(-sizes // PIECE)
    first = np.cumsum(counts) - counts
    pieces = np.repeat(begins, counts) + PIECE * (np.arange(counts.sum()) - np.repeat(first, counts))
    return frame, begins, pieces, counts


SUMMARY = "noid boolean, conv long, block long, at long, costs array<long>, ranks array<long>"
CHOICE = "noid boolean, conv long, block long, before int, after int, last boolean"
EDITS = "noid boolean, conv long, at long, edit string, before string, role string, after string"


def _summaries(frame: pd.DataFrame) -> pd.DataFrame:
    """The first and last conversation of a block, each as one step from states to states."""
    frame, begins, pieces, counts = _block(frame)
    firsts = np.cumsum(counts) - counts
    out = []
    for c in sorted({0, len(begins) - 1}):
        mine = pieces[firsts[c] : firsts[c] + counts[c]]
        end = begins[c + 1] if c + 1 < len(begins) else len(frame)
        costs, ranks, _ = solve_pieces(frame["kind"].values, mine, np.diff(np.append(mine, end)))
        cost, rank = costs[0], ranks[0]
        for k in range(1, len(mine)):
            cost, rank, _ = _follow(cost, rank, costs[k], ranks[k])
        row = frame.iloc[begins[c]]
        out.append((bool(row["noid"]), int(row["conv"]), int(row["block"]), int(row["at"]), cost.ravel().tolist(), rank.ravel().tolist()))
    return pd.DataFrame(out, columns=["noid", "conv", "block", "at", "costs", "ranks"])


def _chain(costs: list[np.ndarray], ranks: list[np.ndarray]) -> tuple[list[int], int]:
    """The states before each step of the cheapest way from the start, and the last state."""
    cost, rank = np.array([0, FAR, FAR, FAR]), np.arange(4)
    back = []
    for more, inner in zip(costs, ranks, strict=True):
        cost, rank, at = _follow(cost, rank, more, inner)
        back.append(at)
    last = state = int(_last_state(cost, rank))
    befores = []
    for at in reversed(back):
        state = int(at[state])
        befores.append(state)
    return befores[::-1], last


def _choices(frame: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each step of one conversation."""
    frame = frame.sort_values("at", ignore_index=True)
    befores, last = _chain(*([np.array(x).reshape(4, 4) for x in frame[c]] for c in ("costs", "ranks")))
    out = frame[["noid", "conv", "block"]].copy()
    out["before"], out["after"] = befores, [*befores[1:], last]
    out["last"] = np.arange(len(out)) == len(out) - 1
    return out


_LETTERS = {S: "s", U: "u", A: "a"}


def _edits(frame: pd.DataFrame, choices: pd.DataFrame) -> pd.DataFrame:
    """The edit of every row of a block."""
    columns = ["noid", "conv", "at", "edit", "before", "role", "after"]
    if not len(frame):
        return pd.DataFrame({c: [] for c in columns})
    frame, begins, pieces, counts = _block(frame)
    n, kinds = len(frame), frame["kind"].values
    costs, ranks, parents = solve_pieces(kinds, pieces, np.diff(np.append(pieces, n)))
    firsts = np.cumsum(counts) - counts
    chosen = {(bool(r.noid), int(r.conv)): r for r in choices.itertuples(index=False)}
    before, after = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    ending = np.full(len(begins), True)
    single = firsts[counts == 1]
    after[single] = _last_state(costs[single, START], ranks[single, START])
    for c in sorted(set(np.flatnonzero(counts > 1).tolist()) | {0, len(begins) - 1}):
        a, b = firsts[c], firsts[c] + counts[c]
        cut = chosen.get((bool(frame["noid"].values[begins[c]]), int(frame["conv"].values[begins[c]])))
        if cut is None:
            befores, last = _chain(list(costs[a:b]), list(ranks[a:b]))
        else:  # from one given state to another
            ending[c], last = cut.last, cut.after
            cost, rank = np.full(4, FAR), np.arange(4)
            cost[cut.before] = 0
            back = []
            for k in range(a, b):
                cost, rank, at = _follow(cost, rank, costs[k], ranks[k])
                back.append(at)
            befores, state = [], last
            for at in reversed(back):
                state = int(at[state])
                befores.insert(0, state)
        before[a:b], after[a:b] = befores, [*befores[1:], last]
    # Back over the parent pointers, all pieces at once.
    moves = np.zeros(n, np.int64)
    sizes = np.diff(np.append(pieces, n))
    state, lanes = after.copy(), np.argsort(-sizes, kind="stable")
    for k in range(int(sizes.max()) - 1, -1, -1):
        now = lanes[: np.searchsorted(-sizes[lanes], -k, "left")]
        rows = pieces[now] + k
        moves[rows] = parents[rows, before[now], state[now]]
        state[now] = moves[rows] // M
    edit = np.array([e for _, e in MACROS], object)[moves % M]
    inserted = np.array(["".join(_LETTERS[i] for i in x) for x in INSERTED], object)[moves]
    role = np.array([ROLES[USER if _wanted(MIDDLE[j]) == U else ASSISTANT] if MACROS[j % M][1] == "R" else None for j in range(4 * M)], object)[moves]
    tail = np.full(n, "", object)
    last_piece = firsts + counts - 1
    lasts = np.append(begins[1:], n) - 1
    ends = np.array(["".join(_LETTERS[i] for i in ENDING[x]) for x in range(4)], object)[after[last_piece]]
    tail[lasts[ending]] = ends[ending]
    return pd.DataFrame({"noid": frame["noid"], "conv": frame["conv"], "at": frame["at"], "edit": edit, "before": inserted, "role": role, "after": tail}, columns=columns)


def sorted_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The written table (noid, conv, turn, role, text, at, block): rows in order of ``at``, numbered over all partitions."""
    salt, head, mark = F.monotonically_increasing_id().alias("salt"), F.substring("text", 1, 64), F.xxhash64("text")
    salted = rows.select("*", salt)
    order = ["noid", "conv", F.col("turn").asc_nulls_first(), "role", head, mark]
    placed = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").withColumn("at", F.monotonically_increasing_id())
    # A partition's rows have consecutive numbers from a multiple of 2^33 on.
    return saved(placed.select("noid", "conv", "turn", "role", "text", "at", F.shiftright("at", block.bit_length() - 1).alias("block")), "turns")


def faults(placed: DataFrame) -> DataFrame:
    """(noid, conv, at, block, kind): the initial and first fault of every row, without its text."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    last = F.regexp_extract("text", rf"({SIGN})[\x20\x09-\x0D]*\z", 1)
    rows = placed.select("noid", "conv", "at", "block", "role", code.alias("initial"), last.alias("sign"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = rows.where("sign <> ''").groupBy("noid", "conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    fault = (
        F.when(F.col("sign") == "", BLANK)
        .when(F.col("fresh").isNull(), DUPLICATE)
        .when(~F.col("sign").isin(".", "!", "?"), TRUNCATED)
        .otherwise(NO_FAULT)
    )
    return rows.drop("role", "digest").join(first, "at", "left").select("noid", "conv", "at", "block", (4 * F.col("initial") + fault).cast("int").alias("kind"))


def edits(slim: DataFrame) -> DataFrame:
    """(noid, conv, at, edit, before, role, after): each row's edit, the initials of turns inserted before it (and, for
    a conversation's last row, after it), and the role it gets if it is reroled; from a written table of faults()."""
    from ..session import ship

    ship(slim.sparkSession)
    steps = slim.groupBy("block").applyInPandas(_summaries, SUMMARY)
    choices = steps.groupBy("noid", "conv").applyInPandas(_choices, CHOICE)
    return slim.groupBy("block").cogroup(choices.groupBy("block")).applyInPandas(_edits, EDITS)


REPORT = (
    "noid boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Report:
    """Counters, audit and digest of one conversation, row by row."""

    def __init__(self) -> None:
        self.counts = [0] * 4
        self.illegal = self.cost = self.distinct = 0
        self.low = self.high = self.turn = self.initial = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self, initials: str) -> None:
        self.cost += INSERT * len(initials)
        for x in initials:
            self.audit.append("I")
            self.line("user" if x == "u" else "assistant", "")

    def row(self, turn: int | None, role: str, text: str, fault: int, edit: str, before: str, new_role: str | None, after: str) -> None:
        self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.insert(before)
        self.audit.append(edit)
        if edit == "D":
            self.cost += DELETE
        else:
            self.cost += (REROLE if edit == "R" else 0) + (CUT_OFF if fault == TRUNCATED else 0)
            self.line(role if new_role is None else new_role, text)
        self.insert(after)

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of conversations with their edits, from a stream in which a row's edit comes right before the row."""
    edit = None
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(len(batch.schema))), strict=True):
            if r[3] is not None:
                edit = r
            else:
                yield *r[:2], *r[8:], *edit[3:8]


def _stream(placed: DataFrame, slim: DataFrame, done: DataFrame) -> DataFrame:
    """All rows and edits, conversation by conversation, an edit right before its row."""
    made = done.join(slim.select("at", "kind"), "at")
    made = made.select("noid", "conv", "at", "edit", "before", "role", "after", "kind")
    named = made.withColumnRenamed("role", "new_role").unionByName(placed.select("noid", "conv", "at", "turn", "role", "text"), allowMissingColumns=True)
    ordered = named.repartition("noid", "conv").sortWithinPartitions("noid", "conv", "at", F.col("edit").asc_nulls_last())
    return ordered.select("noid", "conv", "at", "edit", "before", "new_role", "after", "kind", "turn", "role", "text")


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    key = F.col(conv_col).cast("long")
    return conversations.select(
        key.isNull().alias("noid"),
        F.coalesce(key, F.lit(0)).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )


def _solved(conversations: DataFrame, columns: tuple[str, ...], block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = sorted_rows(_rows(conversations, *columns), block)
    slim = saved(faults(placed), "faults")
    return placed, slim, edits(slim)


COLUMNS = ("conv_id", "turn", "role", "text")


def repaired(conversations: DataFrame, columns: tuple[str, ...] = COLUMNS, block: int = BLOCK) -> DataFrame:
    """The repaired rows (conv_id, position, role, text) of each conversation; inserted turns have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, position = [], 0, None, 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array([h[k] for h in held], kinds[k]) for k in range(4)], names=["conv_id", "position", "role", "text"])

        for noid, conv, _, role, text, edit, before, new_role, after, _ in _merged(batches):
            if now != (noid, conv):
                now, position = (noid, conv), 0
            lines = [("user" if x == "u" else "assistant", "") for x in before]
            lines += [(new_role or role, text)] if edit != "D" else []
            lines += [("user" if x == "u" else "assistant", "") for x in after]
            for line in lines:
                held.append((None if noid else conv, position, *line))
                position, size = position + 1, size + len(line[1])
            if len(held) >= 10_000 or size >= 1 << 22:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return map_arrow(_stream(*_solved(conversations, columns, block)), run, "conv_id long, position long, role string, text string")


def report(conversations: DataFrame, columns: tuple[str, ...] = COLUMNS, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    The digest is of all repaired rows in order, so one conversation is read by one task, row by row; an audit is
    one letter an edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, report, out = None, None, []
        types = [pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string()]
        names = [x.split()[0] for x in REPORT.split(", ")]

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in out], types[k]) for k in range(len(types))], names=names)

        for noid, conv, turn, role, text, edit, before, new_role, after, kind in _merged(batches):
            if now != (noid, conv):
                if now is not None:
                    out.append((*now, *report.values()))
                now, report = (noid, conv), _Report()
            report.row(turn, role, text, kind % 4, edit, before, new_role, after)
            if len(out) >= 5000:
                yield batch()
                out = []
        if now is not None:
            out.append((*now, *report.values()))
            yield batch()

    placed, slim, done = _solved(conversations, columns, block)
    found = saved(map_arrow(_stream(placed, slim, done), run, REPORT), "repairs")
    discard(placed, slim)
    return found.select(F.when(~F.col("noid"), F.col("conv")).alias("conv_id"), *[x.split()[0] for x in REPORT.split(", ")[2:]])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32('conv_id:turn') % 20, as test cases: 0 drops the row,
    1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user; nulls count as one space."""

    def part(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), harm.alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def with_all_ids(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """found with a row for every id of conversations: zeros, no audit and the digest of nothing, where it has none."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
