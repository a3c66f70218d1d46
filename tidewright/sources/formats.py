"""Spark data sources: folders of clips and track files, and line catalogues.

``register(spark)`` makes them known; then ``spark.read.format("tracks").load(folder)`` and, for rows (name, content) of
sinks.track_files(), ``.write.format("tracks").mode("append").save(folder)``; ``spark.read.format("lines")`` likewise
reads line catalogues.

A folder is listed once.  Options on what a name tells choose among the names, so the bodies of other files are never
opened: ``kind`` (audio, unlinked, phonemes), ``ids`` (such as "3,5,10-20") and ``names`` (a pattern with * and ?).  The
chosen files are packed into partitions by size.  These are options, not filters that Spark pushes down, because
Spark 4.1 keeps a filter that it once pushed into a Python source with the loaded table, so that the same DataFrame
misses rows when it is used again without that filter.  A write puts each task's files into a staging folder and
moves them when all tasks are done; a failed write leaves the folder as it was.  Folders are paths or URIs that the
executors reach too.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..functions.text import MAX_ID
from .readers import _catalogue_rows, _track

SEGMENT = "struct<slot:int,phoneme:string,word_start:boolean,start:bigint,stop:bigint,weight:double,score:double,active:boolean,info:string>"
_CELLS = ("slot", "phoneme", "word_start", "start", "stop", "weight", "score", "active", "info")
_META = ("language", "actor", "text", "translation", "audio-hypothesis")
#: Bytes of bodies that one partition reads, unless the option bytesPerPartition says otherwise.
BYTES = 32 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Named:
    """A file and what its name tells."""

    name: str
    path: str
    size: int
    kind: str | None
    id: int | None
    seconds: float | None


def named(info: fs.FileInfo) -> Named:
    """The rules of functions.text (file_kind, file_id, file_duration) for one name."""
    name = info.base_name
    stem = name.rsplit(".", 1)[0] if "." in name else None
    found = [m and int(m[1]) for m in (re.match(r"([0-9]{1,10})", stem or ""), re.search(r"([0-9]{1,10})$", stem or ""), re.fullmatch(r"([+]?[0-9]{1,19})", stem or ""))]
    id_ = next((x for x in found if x is not None and x <= MAX_ID), None)
    audio = name.endswith((".wav", ".ogg"))
    kind = ("audio" if id_ is not None else "unlinked") if audio else "phonemes" if name.endswith(".phonemes") and id_ is not None else None
    bracket = re.search(r"\[([^\]]*)", stem or "")
    try:
        seconds = float(bracket[1]) if bracket and kind == "audio" else None
    except ValueError:
        seconds = None
    return Named(name, info.path, info.size or 0, kind, id_ if kind != "unlinked" else None, seconds)


def id_ranges(ids: str) -> list[tuple[int, int]]:
    """The ranges of "3,5,10-20", ends included."""
    parts = (x.strip().split("-", 1) for x in ids.split(",") if x.strip())
    return [(int(p[0]), int(p[-1])) for p in parts]


class Files(ds.InputPartition):
    def __init__(self, files: list[Named]) -> None:
        self.files = files


class FolderReader(ds.DataSourceReader):
    """Chooses files by name and packs them into partitions."""

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("bytesPerPartition", BYTES))
        self.fails = options.get("onError", "fail") == "fail"
        self.names = options.get("names", "*")
        self.kinds = {k.strip() for k in options["kind"].split(",")} if "kind" in options else None
        self.ids = id_ranges(options["ids"]) if "ids" in options else None

    def chosen(self, file: Named) -> bool:
        if self.kinds is not None and file.kind not in self.kinds:
            return False
        if self.ids is not None and (file.id is None or not any(a <= file.id <= b for a, b in self.ids)):
            return False
        return fnmatchcase(file.name, self.names)

    def wanted(self, file: Named) -> bool:
        raise NotImplementedError

    def files(self) -> list[Named]:
        """The files that are to be read, by name."""
        system, path = place(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        named_ = [named(f) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted((f for f in named_ if self.wanted(f) and self.chosen(f)), key=lambda f: f.name)

    def partitions(self) -> Sequence[Files]:
        out: list[list[Named]] = []
        size = self.most
        for f in self.files():
            cost = 4096 + (f.size if f.kind != "audio" and f.kind != "unlinked" else 0)
            if size + cost > self.most or not out:
                out.append([])
                size = 0
            out[-1].append(f)
            size += cost
        return [Files(f) for f in out] or [Files([])]

    def body(self, system: fs.FileSystem, file: Named) -> str:
        with system.open_input_stream(file.path) as f:
            return f.read().decode("utf-8")


class TrackReader(FolderReader):
    def wanted(self, file: Named) -> bool:
        return file.kind is not None

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = place(self.path)
        for f in partition.files:
            head = (f.name, f.kind, f.id, f.seconds)
            if f.kind != "phonemes":
                yield (*head, *[None] * 8)
                continue
            try:
                meta, rows = _track(self.body(system, f))
                cells = [tuple(r[c] for c in _CELLS) for r in rows]
                yield (*head, int(meta["version"]), *(meta.get(k) for k in _META), cells, None)
            except ValueError as e:
                if self.fails:
                    raise ValueError(f"{f.name}: {e}") from e
                yield (*head, *[None] * 7, str(e))


@dataclass
class Staged(ds.WriterCommitMessage):
    names: list[str]


class TrackWriter(ds.DataSourceWriter):
    """Writes rows (name, content) as files: staged by the tasks, moved by the commit, deleted by an abort."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows (name, content) are needed, as sinks.track_files() makes them")
        self.path, self.overwrite, self.staging = options["path"], overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, path = place(self.path)
        system.create_dir(f"{path}/{self.staging}", recursive=True)
        names = []
        for row in iterator:
            if not row.name or "/" in row.name:
                raise ValueError(f"not a file name: {row.name}")
            # A name of its own, so that another attempt of the task does not meet it.
            target = f"{uuid.uuid4().hex}-{row.name}"
            with system.open_output_stream(f"{path}/{self.staging}/{target}") as f:
                f.write(row.content.encode("utf-8"))
            names.append(target)
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        system, path = place(self.path)
        moves = {}
        for staged in (n for m in messages if m for n in m.names):
            name = staged.split("-", 1)[1]
            if name in moves:
                self.abort(messages)
                raise ValueError(f"{name} is written more than once")
            moves[name] = staged
        old = [] if not self.overwrite else [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if named(f).kind == "phonemes"]
        for name, staged in moves.items():
            system.move(f"{path}/{self.staging}/{staged}", f"{path}/{name}")
        for f in old:
            if f.base_name not in moves:
                system.delete_file(f.path)
        self._clear(system, path)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*place(self.path))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        staging = f"{path}/{self.staging}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class Tracks(ds.DataSource):
    """Clips and track files of a folder: name, kind, id and seconds from the name; the rest from track files' bodies."""

    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        meta = ", ".join(f"{k.replace('-', '_')} string" for k in _META)
        return f"name string, kind string, id long, seconds double, version int, {meta}, segments array<{SEGMENT}>, error string"

    def reader(self, schema: StructType) -> TrackReader:
        return TrackReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TrackWriter:
        return TrackWriter(self.options, schema, overwrite)


class LineReader(FolderReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.language = options.get("language")

    def wanted(self, file: Named) -> bool:
        return file.name.endswith((".csv", ".txt"))

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = place(self.path)
        for f in partition.files:
            rows, language = _catalogue_rows(self.body(system, f), self.language)
            for number, id_, text, actor, error in rows:
                if error and self.fails:
                    raise ValueError(f"{f.name}, line {number}: {error}")
                yield f.name, number, id_, language, text, actor, error


class Lines(ds.DataSource):
    """Line catalogues of a folder, either variant, a row a line as it is written; option language as in line_catalogue()."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "name string, line_no int, id long, lang string, text string, actor string, error string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session and its executors."""
    from ..session import ship

    ship(spark)
    for source in (Tracks, Lines):
        spark.dataSource.register(source)
