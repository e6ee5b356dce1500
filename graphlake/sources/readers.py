"""Partitioned readers of files whose lines depend on earlier ones: two header rows, sections of a well log.

Both list files, deal them to tasks by bytes and stream them inside the tasks, so no file is held whole. Register them by
`register`, or call `sources.files`.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a task's files, rows of an Arrow batch, and files that can't be cut because they are compressed.
SPLIT, ROWS, PACKED = 128 << 20, 2_048, (".gz", ".bz2", ".zst", ".lz4", ".br")


def header_names(categories: list[str | None], names: list[str | None]) -> list[str]:
    """Column names of two header rows: the category to the left goes on, repeats get _1, _2, nameless columns col_i."""
    seen: dict[str, int] = {}
    out, category = [], ""
    for i, name in enumerate(names):
        given = (categories[i] or "").strip() if i < len(categories) else ""
        category = given or category
        name = (name or "").strip()
        full = f"{category}_{name}" if category and name else name or f"col_{i}"
        seen[full] = seen.get(full, -1) + 1
        out.append(full if not seen[full] else f"{full}_{seen[full]}")
    return out


@dataclass
class Pieces(InputPartition):
    """Byte ranges (path, start, stop) of files; a stop of -1 is the file's end."""

    ranges: list[tuple[str, int, int]]


def _at(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before such paths)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.index(inner)] if inner in path else ""


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files under a folder; names that begin with a dot or an underscore are no data."""
    system, inner, before = _at(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    return sorted((before + f.path, f.size) for f in found if f is info or not f.base_name.startswith((".", "_")))


def opened(path: str, start: int = 0) -> io.BufferedReader:
    system, inner, _ = _at(path)
    if path.endswith(PACKED):
        return io.BufferedReader(system.open_input_stream(inner, compression="detect"), 1 << 20)
    file = system.open_input_file(inner)
    file.seek(start)
    return io.BufferedReader(file, 1 << 20)


def dealt(files: list[tuple[str, int]], size: int, cut: bool) -> list[Pieces]:
    """Pieces of about `size` bytes: small files together, and with `cut` large ones in several."""
    out, held, room = [], [], size
    for path, length in files:
        if cut and length > size and not path.endswith(PACKED):
            out += [Pieces([(path, at, min(at + size, length))]) for at in range(0, length, size)]
            continue
        if held and length > room:
            out.append(Pieces(held))
            held, room = [], size
        held.append((path, 0, -1))
        room -= length
    return out + ([Pieces(held)] if held else [])


def _lines(path: str, start: int, stop: int) -> Iterator[str]:
    """Lines, with their ends, that begin in [start, stop): a line belongs to the piece that has its first byte."""
    with opened(path, max(start - 1, 0)) as file:
        at = start
        if start:
            at = start - 1 + len(file.readline())
        while stop < 0 or at < stop:
            line = file.readline()
            if not line:
                return
            yield line.decode("utf-8-sig" if at == 0 else "utf-8", "replace")
            at += len(line)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class _Reader(DataSourceReader):
    arrow: pa.Schema

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT))

    def cut(self) -> bool:
        return False

    def partitions(self):
        return dealt(listed(self.path), self.size, self.cut())

    def rows(self, path: str, start: int, stop: int) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition):
        for piece in partition.ranges:
            yield from _batches(self.rows(*piece), self.arrow)


class TwoHeaderReader(_Reader):
    arrow = pa.schema([("file", pa.string()), ("split", pa.int64()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])

    def __init__(self, options):
        super().__init__(options)
        self.headers = str(options.get("headersOnly", "false")).lower() == "true"
        self.multiline = str(options.get("multiLine", "true")).lower() == "true"

    def cut(self) -> bool:
        return not self.multiline and not self.headers

    def rows(self, path, start, stop):
        head = csv.reader(_lines(path, 0, -1))
        first, second = next(head, []), next(head, [])
        names = header_names(first, second)
        if self.headers:
            yield from ((path, 0, i, [(name, None)]) for i, name in enumerate(names))
            return
        body = head if start == 0 and stop < 0 else csv.reader(_lines(path, start, stop))
        if start == 0 and stop >= 0:
            next(body, None), next(body, None)
        for n, record in enumerate(body):
            # what stands beyond the header's columns has no name
            cells = [(name, value) for name, value in zip(names, record) if value.strip()]
            if cells:
                yield path, start, n, cells


class TwoHeaders(DataSource):
    """(file, split, row, cells map): the cells that aren't blank of each row under a file's own two header rows.

    Files may have different headers. A file is one task's work, or with multiLine=false, where no quoted cell has a line
    break, is cut into pieces of splitBytes. headersOnly=true gives a row for each column of each file instead: its
    number and its name as the only key.
    """

    @classmethod
    def name(cls):
        return "two_header_csv"

    def schema(self):
        return "file string, split long, row long, cells map<string, string>"

    def reader(self, schema):
        return TwoHeaderReader(self.options)


class WellLogReader(_Reader):
    arrow = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("line", pa.string()), ("section", pa.string())])

    def __init__(self, options):
        super().__init__(options)
        self.header = str(options.get("headerOnly", "false")).lower() == "true"

    def rows(self, path, start, stop):
        section = None
        for pos, line in enumerate(_lines(path, start, stop)):
            line = line.rstrip("\n").removesuffix("\r").strip(" ")
            if line.startswith("~"):
                section = line.upper()
                if self.header and section.startswith("~A"):
                    return
            yield path, pos, line, section


class WellLog(DataSource):
    """(file, pos, line, section) of well logs: a line's section is the last `~X` line at or before it, null before the first.

    A file's state is carried by the task that streams it. headerOnly=true stops at the `~A` section, which a log ends with:
    its numbers, most of the file, are not read.
    """

    @classmethod
    def name(cls):
        return "well_log"

    def schema(self):
        return "file string, pos long, line string, section string"

    def reader(self, schema):
        return WellLogReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (TwoHeaders, WellLog):
        spark.dataSource.register(source)
