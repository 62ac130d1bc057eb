"""Logs of run directories as a data source of Spark: a task reads byte ranges, and filters on runs prune what is listed."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from weftlog.scratch import written

SCHEMA = "run_dir string, file string, block long, nth long, line string"
#: Bytes of a task, and of one read.
SPLIT, CHUNK = 64 << 20, 1 << 20
#: Bytes that are read at a time beyond the end of a range, where only one line is left.
TAIL = 1 << 14
#: Lines of an Arrow batch, and the bytes from which one is sent early.
BATCH, BATCH_BYTES = 4096, 4 << 20
#: Ends of lines, and the mark that a file may begin with; fixed values.
TERMINATOR, MARK = re.compile(rb"\r\n|\n|\r"), b"\xef\xbb\xbf"


def lines_between(file, start: int, end: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """The lines of a seekable file whose first byte lies from ``start`` to before ``end``, without their ends.

    So adjoining ranges give each line once, wherever they are cut.  Memory is that of a chunk or of the longest line.
    """
    here = at = max(start - 1, 0)  # the byte before tells whether a line begins at ``start``
    file.seek(here)
    rest, begun = b"", start == 0
    while True:
        # a line that goes on is read in ever larger parts, so that it is searched a few times only
        more = file.read(max(min(chunk, end - here), min(chunk, TAIL), len(rest)))
        here += len(more)
        data, done = rest + more, 0
        for found in TERMINATOR.finditer(data):
            if more and found.end() == len(data) and data.endswith(b"\r"):
                break  # its \n may come next
            if begun:
                if at + done >= end:
                    return
                yield data[done : found.start()]
            begun, done = True, found.end()
        rest, at = data[done:], at + done
        if begun and at >= end:
            return
        if not more:
            if begun and rest:
                yield rest
            return


def _tree(pattern: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, what its paths begin with outside of it, and the path."""
    url = urlsplit(pattern)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), "file:", url.path if url.scheme else pattern
    system, path = pafs.FileSystem.from_uri(pattern)
    # object stores count the host as part of the path
    return system, f"{url.scheme}://{'' if path.startswith(url.netloc) else url.netloc}", path


def matches(system: pafs.FileSystem, path: str) -> Iterator[pafs.FileInfo]:
    """What lies under a pattern with ``*``, level by level; names without ``*`` are not listed."""
    parts = path.split("/")
    wild = next((i for i, part in enumerate(parts) if "*" in part), None)
    if wild is None:
        info = system.get_file_info(path)
        if info.type != pafs.FileType.NotFound:
            yield info
        return
    inside = pafs.FileSelector("/".join(parts[:wild]) or "/", allow_not_found=True)
    for info in sorted(system.get_file_info(inside), key=lambda x: x.path):
        if fnmatchcase(info.base_name, parts[wild]):
            yield from matches(system, "/".join([info.path, *parts[wild + 1 :]]))


def encoded(path: str) -> str:
    """A path as Spark writes it in the metadata of a file."""
    return quote(path, safe="/:@!$&'()*+,;=~")


def parts_of(system: pafs.FileSystem, info: pafs.FileInfo) -> list[pafs.FileInfo]:
    """The file, or the files of a folder that stands for one, in order of their names; as in Spark, names with _ or . in front are none."""
    if info.type == pafs.FileType.File:
        return [info]
    inside = [x for x in system.get_file_info(pafs.FileSelector(info.path)) if x.type == pafs.FileType.File and x.base_name[0] not in "_."]
    return sorted(inside, key=lambda x: x.base_name)


@dataclass
class Ranges(InputPartition):
    """(path, run_dir, file, start, end, before) of the ranges that one task reads; ``before`` are the bytes of the file's earlier parts."""

    ranges: list[tuple[str, str, str, int, int, int]]


class RunLogReader(DataSourceReader):
    def __init__(self, root: str, name: str, split: int):
        self.root, self.name, self.split, self.runs = root, name, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality of ``run_dir`` to one or several values; all other filters stay Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("run_dir",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.runs = wanted if self.runs is None else self.runs & wanted
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        """Files cut into ranges of ``split`` bytes; small ones share a task up to that size."""
        system, before, root = _tree(self.root)
        out, room = [], 0
        for run in matches(system, root):
            run_dir = before + encoded(run.path)
            if run.type != pafs.FileType.Directory or (self.runs is not None and run_dir not in self.runs):
                continue
            for info in matches(system, f"{run.path}/{self.name}"):
                file, base = encoded(posixpath.relpath(info.path, run.path)), 0
                for part in parts_of(system, info):
                    for start in range(0, part.size, self.split):
                        end = min(start + self.split, part.size)
                        if not out or end - start > room:
                            out.append(Ranges([]))
                            room = self.split
                        out[-1].ranges.append((part.path, run_dir, file, start, end, base))
                        room -= end - start
                    base += part.size
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system = _tree(self.root)[0]
        for path, run_dir, file, start, end, base in partition.ranges:
            with system.open_input_file(path) as stream:
                lines, size, first = [], 0, 1
                for i, line in enumerate(lines_between(stream, start, end)):
                    lines.append((line.removeprefix(MARK) if base == start == i == 0 else line).decode(errors="replace"))
                    size += len(line)
                    if len(lines) == BATCH or size >= BATCH_BYTES:
                        yield self._batch(run_dir, file, base + start, first, lines)
                        lines, size, first = [], 0, i + 2
                if lines:
                    yield self._batch(run_dir, file, base + start, first, lines)

    @staticmethod
    def _batch(run_dir: str, file: str, block: int, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.repeat(pa.scalar(run_dir), n), pa.repeat(pa.scalar(file), n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["run_dir", "file", "block", "nth", "line"])


class RunLogs(DataSource):
    """``spark.read.format("run_logs")``: lines (run_dir, file, block, nth, line) of files ``name`` in the directories ``root``, both with ``*``.

    ``block`` is where the line's range begins and ``nth`` its place there, from 1.  ``splitBytes`` is the length of a range.  Files
    are plain text in file systems that pyarrow opens; others (and compressed files) are read by ``files.numbered_lines``.  A folder
    in place of a file stands for its parts, in order of their names.
    """

    @classmethod
    def name(cls) -> str:
        return "run_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunLogReader:
        return RunLogReader(self.options["root"], self.options["name"], int(self.options.get("splitBytes", SPLIT)))


def ranged_lines(spark: SparkSession, root: str, name: str, dirs: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """(run_dir, file, lineno, line) as ``files.numbered_lines`` gives them, of some run directories or of all.

    Each byte of a log is read once, by the task of its range: the lines are written with their place in it, and their numbers
    follow from how many lines the ranges before have, a row for each range.  Files of other runs are neither listed nor opened.
    """
    spark.dataSource.register(RunLogs)
    setting = "spark.sql.python.filterPushdown.enabled"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        rows = spark.read.format("run_logs").options(root=root, name=name, splitBytes=split).load()
        rows = written(rows if dirs is None else rows.where(F.col("run_dir").isin(dirs)), "lines", "zstd")
    finally:
        spark.conf.set(setting, was)
    place = ["run_dir", "file", "block"]
    blocks = rows.groupBy(*place).agg(F.max("nth").alias("n"))
    before = F.sum("n").over(Window.partitionBy("run_dir", "file").orderBy("block")) - F.col("n")
    return rows.join(F.broadcast(blocks.select(*place, before.alias("before"))), place).select("run_dir", "file", (F.col("before") + F.col("nth")).alias("lineno"), F.trim("line").alias("line"))
