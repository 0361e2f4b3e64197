"""JSON lines as a data source: byte ranges side by side, every line with its place, errors that name the line.

    register(spark)
    spark.read.format("spanloom_jsonl").option("mode", "validating").load(folder)

A row is (path, part, n, offset, value, error): the file, its byte range, the line's number within the range, the byte where it
begins, the line without its ending, and why it can't be read as a record (null if it can). Modes: failfast ends the read at
the first bad line and names file and line; tolerant leaves bad lines out; validating gives every line that isn't blank or a comment; lines
gives all lines unread; count gives one row for each range, n being its number of lines. Typed columns come from
from_json on value, which runs in the JVM (read_records). Files must be reachable by every executor; they are plain
text, since compressed ones can't be split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.dictionary import small
from ..operators.scratch import Scratch

NAME = "spanloom_jsonl"
MODES = ("failfast", "tolerant", "validating", "lines", "count")
SCHEMA = "path string, part int, n long, offset long, value string, error string"
ARROW = pa.schema([("path", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("offset", pa.int64()), ("value", pa.string()), ("error", pa.string())])
#: Bytes in a range, lines in a batch of rows, characters in a batch.
RANGE, LINES, CHARS = 64 << 20, 10_000, 8 << 20
MARK = "\ufeff"


def opened(path: str) -> tuple[afs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder whose names begin with neither _ nor a dot, in their order."""
    system, own = opened(path)
    prefix = path[: len(path) - len(own)] if "://" in path else ""
    info = system.get_file_info(own)
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in system.get_file_info(afs.FileSelector(own, recursive=True)) if x.is_file and x.base_name[0] not in "_."]
    packed = [x.path for x in found if x.extension in ("gz", "bz2", "zst")]
    if packed:
        raise ValueError(f"{packed[0]}: compressed files can't be read by ranges")
    return sorted((prefix + x.path, x.size) for x in found)


def fault(line: str, comments: bool) -> str | None:
    """Why a line is no record: None if it is one, "" if it is blank or a comment."""
    bare = line.strip()
    if not bare or (comments and bare.startswith("#")):
        return ""
    try:
        value = json.loads(bare)
    except RecursionError:
        return "nested too deeply"
    except ValueError as e:
        return f"malformed JSON: {e.msg} at {e.pos}" if isinstance(e, json.JSONDecodeError) else "malformed JSON"
    if not isinstance(value, dict):
        return "not an object"
    if value.get("text") is None:
        return "no text"
    if not isinstance(value.get("entities", []), list):
        return "entities is not a list"
    return None


class Range(InputPartition):
    """The lines of a file that begin within [start, end)."""

    def __init__(self, path: str, part: int, start: int, end: int) -> None:
        self.path, self.part, self.start, self.end = path, part, start, end


def ranges(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, k, at, min(end, at + size)) for k, at in enumerate(range(start, end, size))]


def line_of(path: str, offset: int) -> int:
    """The number, from 1, of the line that begins at a byte; reads what stands before, so it is for errors only."""
    system, own = opened(path)
    with system.open_input_file(own) as f:
        left, n = offset, 1
        while left and (block := f.read(min(left, 1 << 20))):
            n, left = n + block.count(b"\n"), left - len(block)
    return n


class Lines:
    """What the batch and the stream reader share: the options, and reading a range."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.mode = options.get("mode", "failfast").lower()
        self.comments = options.get("comments", "true").lower() == "true"
        self.size = int(options.get("rangebytes", RANGE))
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if self.size < 1:
            raise ValueError("rangeBytes must be at least 1")

    def lines(self, r: Range) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines that begin within the range; only the last one may reach beyond it."""
        system, own = opened(r.path)
        with system.open_input_file(own) as f:
            at = max(0, r.start - 1)
            f.seek(at)
            pending: list[bytes] = []  # of a line whose ending is yet to come
            inside = r.start == 0
            while True:
                block = f.read(1 << 20)
                *whole, last = block.split(b"\n")
                if whole or not block:
                    whole[:1] = [b"".join([*pending, *whole[:1]])]  # at the end of the file, a last line without an ending
                    pending = []
                for line in whole if block or whole != [b""] else []:
                    if inside and at >= r.end:
                        return
                    if inside:
                        yield at, line
                    inside = True  # the first piece of a later range ends the line before it
                    at += len(line) + 1
                if not block or (inside and at >= r.end):
                    return
                pending.append(last)

    def read_range(self, r: Range) -> Iterator[pa.RecordBatch]:
        if self.mode == "count":
            n = sum(1 for _ in self.lines(r))
            yield pa.RecordBatch.from_pylist([{"path": r.path, "part": r.part, "n": n, "offset": r.start}], schema=ARROW)
            return
        rows: list[dict] = []
        chars = 0
        for n, (offset, raw) in enumerate(self.lines(r)):
            raw = raw.removesuffix(b"\r")
            try:
                value, error = raw.decode().removeprefix(MARK if offset == 0 else ""), None
            except UnicodeDecodeError:
                value, error = raw.decode(errors="replace"), "not UTF-8"
            if self.mode != "lines":
                error = error or fault(value, self.comments)
                if error == "" or (error and self.mode == "tolerant"):
                    continue
                if error and self.mode == "failfast":
                    raise ValueError(f"{r.path}, line {line_of(r.path, offset)}: {error}")
            rows.append({"path": r.path, "part": r.part, "n": n, "offset": offset, "value": value, "error": error})
            chars += len(value)
            if len(rows) >= LINES or chars >= CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class LineReader(Lines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [r for path, size in files(self.path) for r in ranges(path, 0, size, self.size)] or [Range("", 0, 0, 0)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        if r.path:
            yield from self.read_range(r)


class LineStream(Lines, DataSourceStreamReader):
    """Lines as they are appended to files and as files arrive; a last line waits for its ending. An offset is the bytes read of each file."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: end for path, size in files(self.path) if (end := self.whole(path, size))}

    def whole(self, path: str, size: int) -> int:
        """The bytes up to the last line ending."""
        system, own = opened(path)
        with system.open_input_file(own) as f:
            while size:
                at = max(0, size - (1 << 16))
                f.seek(at)
                last = f.read(size - at).rfind(b"\n")
                if last >= 0:
                    return at + last + 1
                size = at
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for path in sorted(end) for r in ranges(path, start.get(path, 0), end[path], self.size)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        yield from self.read_range(r)

    def commit(self, end: dict) -> None:
        pass


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)


def read_lines(spark: SparkSession, path: str, mode: str = "failfast", comments: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The rows of the source (see above)."""
    register(spark)
    return spark.read.format(NAME).option("mode", mode).option("comments", str(comments).lower()).option("rangeBytes", range_bytes).load(path)


def read_records(spark: SparkSession, path: str, schema: str, mode: str = "failfast", comments: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Records in typed columns, with the error of those that have one in validating mode."""
    rows = read_lines(spark, path, mode, comments, range_bytes)
    return rows.select(F.from_json(F.when(F.col("error").isNull(), F.col("value")), schema).alias("r"), "error").select("r.*", "error")


def numbered(spark: SparkSession, path: str, mode: str = "validating", comments: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """read_lines with each line's number in its file, from 1: one pass counts the lines of each range, the other reads them."""
    counts = Scratch(spark, "line-counts").save(read_lines(spark, path, "count", comments, range_bytes).where("path <> ''").select("path", "part", "n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = small(counts.select("path", "part", F.coalesce(before, F.lit(0)).alias("before")))
    rows = read_lines(spark, path, mode, comments, range_bytes).join(first, ["path", "part"])
    return rows.select("path", (F.col("before") + F.col("n") + 1).alias("line"), "offset", "value", "error")
