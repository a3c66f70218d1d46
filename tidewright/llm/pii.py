"""Personal data: fixed patterns as seeds, and what their contexts reveal.

Base spans (email, ip, card, phone) are found by fixed patterns in whole texts, in
time linear in the text.  They are the seeds of a bootstrap: words around them form
lexical patterns; a graph joins patterns to the instances (identifier-like tokens)
that they surround; Spark scores both in turn over a fixed number of rounds; and
instances that confident patterns agree on, and whose shape suits the kind, become
further spans.  Base spans always stay.

A pattern's confidence for a kind is the summed score of its distinct instances over
their number plus one; it counts from ``least_seeds`` distinct seeds on.  An instance's
score is 1 - product(1 - confidence) over its confident patterns; seeds keep score 1.

Null texts count as empty.  Every row gives a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, saved

KINDS = ["email", "ip", "card", "phone"]
MOST_BROADCAST = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
#: Signs around a token that are not part of it.
_TRIM = "\"'`()[]{}<>,;:!?*&%$#|=.~^"
LONGEST, MOST_DIGITS, GROUPS = 64, 19, 6
#: Parts of a long list; numbers with brackets, hyphens, dots and single spaces; their groups.
_PART = re.compile(r"[^\s,;|<>\"'()\[\]{}=&?/\\]+")
_NUMBER = re.compile(r"(?<![0-9A-Za-z@_])\(?[0-9]++(?:(?=[\x20().-])\x20?[().-]{0,2}\x20?[0-9]++)++(?![A-Za-z@_])")
_SOLID = re.compile(r"[^\x20]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all base spans, by start, then kind."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        if "." in text:
            out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, left, right) of identifier-like pieces (with a digit or @) that touch no taken span.

    They are runs without white space, and runs of digits with single spaces, brackets and hyphens.  A run of over
    LONGEST characters is cut at separators, one of over MOST_DIGITS digits gives its windows of up to GROUPS groups.
    The words to the left of left and to the right of right are the context: that of a list is its members'."""
    found: dict[tuple[int, int], tuple[int, int]] = {}

    def trimmed(begin: int, end: int) -> tuple[int, int]:
        word = text[begin:end]
        begin += len(word) - len(word.lstrip(_TRIM))
        return begin, begin + len(word.strip(_TRIM))

    at = 0
    while m := _MARK.search(text, at):
        begin = m.start()
        gap = _SPACE.search(text, begin)
        end, low = gap.start() if gap else len(text), at
        at = end
        while begin > low and not text[begin - 1].isspace():
            begin -= 1
        if end - begin <= LONGEST:
            span = trimmed(begin, end)
            found[span] = span
        else:
            for x in _PART.finditer(text, begin, end):
                if _MARK.search(x[0]):
                    found.setdefault(trimmed(*x.span()), trimmed(begin, end))
    for m in _NUMBER.finditer(text):
        begin, end = m.span()
        if text[begin] == "(" and ")" not in m[0]:
            begin += 1
        if len(_DIGIT.findall(m[0])) <= MOST_DIGITS:
            found.setdefault((begin, end), (begin, end))
            continue
        groups = [x.span() for x in _SOLID.finditer(text, begin, end)]
        for i in range(len(groups)):
            digits = 0
            for s, e in groups[i : i + GROUPS]:
                digits += len(_DIGIT.findall(text, s, e))
                if digits > MOST_DIGITS:
                    break
                if digits >= 7:
                    found.setdefault((groups[i][0], e), (groups[i][0], e))
    out, k = [], 0
    for (begin, end), around in sorted(found.items()):
        while k < len(taken) and taken[k][1] <= begin:
            k += 1
        if end - begin >= 6 and not any(s < end and e > begin for s, e, _ in taken[k : k + 4]):
            out.append((begin, end, *around))
    return out


def _word(x: str) -> str:
    return "".join("0" if c.isdigit() else c for c in x.strip(_TRIM).lower()) or x[:8]


def _name(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, begin: int, end: int) -> list[int]:
    """Names of the lexical patterns around a span: two words before it; one on each side."""
    left = [""] * 2 + text[max(0, begin - 80) : begin].split()
    right = text[end : end + 60].lstrip(_TRIM).split() + [""]
    a, b, c = _word(left[-2]), _word(left[-1]), _word(right[0])
    return [_name("LL", a, b), _name("LR", b, c)]


def suits(kind: int, token: str) -> bool:
    """Whether a token has the shape of a kind, loosely."""
    digits = len(_DIGIT.findall(token))
    if kind == 0:
        return "@" in token
    if kind == 1:
        return digits >= 4 and 3 <= token.count(".") + token.count(":") <= 7
    if kind == 2:
        return 12 <= digits <= 19 and digits >= 0.75 * len(token)
    return 7 <= digits <= 15 and digits >= 0.5 * len(token)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


_SCHEMA = "doc_id long, text_hash long, part int, pos long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<start int, stop int, kind int, shapes int, name long, patterns array<long>>>"


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: base spans, and all seeds and candidates with their patterns."""
    cell = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("shapes", pa.int32()), ("name", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                piece = batch.slice(a, 1000)
                rows = []
                for text in piece.column(1).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    found = []
                    for s, e, kind in base:
                        found.append((s, e, kind, 0, _name(text[s:e].lower()), contexts(text, s, e)))
                    for s, e, left, right in tokens(text, base):
                        shapes = sum(1 << k for k in range(4) if suits(k, text[s:e]))
                        if shapes:
                            found.append((s, e, -1, shapes, _name(text[s:e].lower()), contexts(text, left, right)))
                    listed = _listed(base)
                    rows.append((*(sum(x[2] == k for x in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed, [dict(zip(("start", "stop", "kind", "shapes", "name", "patterns"), f, strict=True)) for f in found]))
                n = piece.num_rows
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [cell]
                yield pa.record_batch([piece.column(0), piece.column(2), pa.array([part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "text_hash", "part", "pos", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])
                pos += n

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), run, _SCHEMA)


def discovered(table: DataFrame, rounds: int, least_seeds: int, least_confidence: float, least_score: float) -> DataFrame:
    """(name, kind) of the instances that the bootstrap finds."""
    each = table.select(F.explode("found").alias("f")).select("f.name", "f.kind", "f.shapes", F.explode("f.patterns").alias("pattern"))
    graph = saved(each.groupBy("name", "pattern").agg(F.max("kind").alias("kind"), F.max("shapes").alias("shapes")), "graph")
    scores = None
    for _ in range(rounds):
        known = graph if scores is None else graph.join(scores.select("name", F.col("kind").alias("k2"), "score"), "name", "left")
        kind = F.col("kind") if scores is None else F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("k2", F.lit(-1)))
        value = F.lit(1.0) if scores is None else F.when(F.col("kind") >= 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        # Sums per pattern and kind, then per pattern: no group is ever gathered.
        sums = known.groupBy("pattern", kind.alias("k")).agg(F.sum(value).alias("s"), F.sum((F.col("kind") >= 0).cast("int")).alias("seeds"), F.count("*").alias("n"))
        best = sums.groupBy("pattern").agg(F.sum("n").alias("n"), F.max(F.when(F.col("k") >= 0, F.struct("s", "seeds", "k"))).alias("b"))
        sure = best.where(F.col("b").isNotNull()).select("pattern", F.col("b.k").alias("pk"), "b.seeds", (F.col("b.s") / (F.col("n") + 1)).alias("confidence"))
        sure = sure.where(f"seeds >= {least_seeds} and confidence >= {least_confidence}")
        votes = graph.where("kind < 0").join(sure, "pattern").where("shiftright(shapes, pk) & 1 = 1")
        votes = votes.groupBy("name", "pk").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = saved(votes.groupBy("name").agg(F.max(F.struct("score", "pk")).alias("b")).select("name", F.col("b.pk").alias("kind"), "b.score"), "scores")
    return scores.where(F.col("score") >= least_score).select("name", F.col("kind").alias("new_kind"))


def extract(docs: DataFrame, rounds: int = 3, least_seeds: int = 5, least_confidence: float = 0.7, least_score: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): counts are of base spans; spans are all."""
    return _extracted(docs, rounds, least_seeds, least_confidence, least_score).drop("text_hash")


def _extracted(docs: DataFrame, rounds: int = 3, least_seeds: int = 5, least_confidence: float = 0.7, least_score: float = 0.8) -> DataFrame:
    table = saved(scanned(docs), "spans")
    new = discovered(table, rounds, least_seeds, least_confidence, least_score)
    candidates = table.select("part", "pos", F.explode("found").alias("f")).where("f.kind < 0").select("part", "pos", "f.start", "f.stop", "f.name")
    more = candidates.join(new, "name").groupBy("part", "pos").agg(F.collect_list(F.struct("start", "stop", F.col("new_kind").alias("kind"))).alias("more"))
    base = F.transform(F.filter("found", lambda f: f["kind"] >= 0), lambda f: F.struct(f["start"].alias("start"), f["stop"].alias("stop"), f["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(F.transform(F.concat(base, "more"), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["stop"].alias("stop")))), lambda f: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), f["kind"] + 1), f["start"], f["stop"]))
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_join(ordered, ","))
    out = table.join(more, ["part", "pos"], "left")
    return out.select("doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))


def masked(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with every span replaced by its kind in brackets; n_chars, if there, follows the text.

    Further spans are joined by id and hash of the text, as rows of equal id may have different texts; rows where both
    are equal have equal spans.  Base spans are those of the row itself."""
    found = _extracted(docs, **options).where("n_found > 0").groupBy("doc_id", "text_hash").agg(F.min("spans").alias("spans"))
    own = [free_name(docs, x) for x in ("doc", "hash", "spans")]
    found = saved(found.toDF(*own), "found")
    few = found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    same = (F.xxhash64(docs["text"]) == found[own[1]]) & docs["doc_id"].cast("long").eqNullSafe(found[own[0]])
    rows = docs.join(F.broadcast(found) if few else found.hint("merge"), same, "left").select(*(docs[c] for c in docs.columns), own[2])
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                texts.append(mask(text, spans) if text else text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {'bigint' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(rows, run, schema)


def mask(text: str, listed: str | None = None) -> str:
    spans = base_spans(text)
    for x in listed.split(",") if listed else ():
        kind, s, e = x.split(":")
        spans.append((int(s), int(e), KINDS.index(kind)))
    out, at = [], 0
    for s, e, k in sorted(set(spans), key=lambda x: (x[0], -x[1], x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])
