"""Log text as a Spark data source that reads byte ranges: lines with their places, and whole entries.

A scan by Spark gives a line without its place in the file, and cuts files without regard to entries. This source
cuts every file into ranges of ``range_bytes``. A range owns the lines that begin in it; with
``entries`` it owns the entries whose head begins in it, and reads on to the end of the last one. So every line and
every entry comes out once, in one pass, whatever the ranges are. A head is a line that begins with a time stamp; lines
ahead of a file's first head belong to its first range.

Tasks read blocks of ``BLOCK`` bytes and work on Arrow arrays. Files are plain text in UTF-8; other bytes
become U+FFFD. Lines end with a line feed, or with a carriage return and a line feed.

Paths are those that pyarrow's file systems know: local and mounted folders, ``hdfs://``, ``s3://`` (also as ``s3a://``), ``gs://``.
Patterns are not expanded. The listing of a tree is made where the query is planned, as in every scan.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waybill.functions.logtext import LEVEL, STAMP

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need pyarrow, but not this package

RANGE = 128 << 20  # bytes, at most
LEAST = 4 << 20  # bytes; a tree is cut into no more ranges than there are cores if that leaves less
BLOCK = 4 << 20  # bytes read at a time
LINES = "value string, file_path string, line_start long"
ENTRIES = LINES + ", is_continuation boolean, entry_start long, entry_timestamp string, entry_level string"


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://"):]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _listing(root: str) -> list[tuple[str, str, int]]:
    """Path as a scan spells it, path inside its file system, and length of every file below a root that is not hidden."""
    from pyarrow import fs

    system, base = _opened(root)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    some = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
    # a scan spells local files without an empty host
    head = root.split(base)[0] if "://" in root and not root.startswith("file:") and base in root else "file:"
    out = []
    for f in some:
        inside = f.path[len(base):].strip("/").split("/")
        if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) and "=" not in p for p in inside):
            out.append((head + f.path, f.path, f.size))
    return sorted(out)


class _Lines:
    """The lines of a file that begin at or behind ``start``, in batches: starts (places in the file) and texts."""

    def __init__(self, handle, start: int, size: int, block: int):
        self.handle, self.size, self.block = handle, size, block
        # a line begins at ``start`` if the byte ahead ends a line
        self.at = max(start - 1, 0)
        self.skip = start > 0

    def __iter__(self) -> Iterator[tuple[np.ndarray, pa.Array]]:
        self.handle.seek(self.at)
        kept, at = b"", self.at
        while True:
            data = self.handle.read(self.block) if at + len(kept) < self.size else b""
            whole = kept + data
            last = whole.rfind(b"\n") + 1 if data else len(whole)
            if not whole or (last == 0 and not data):
                return
            if last == 0:  # a line longer than a block
                kept = whole
                continue
            piece, kept = whole[:last], whole[last:]
            yield from self._cut(piece, at)
            at += last
            if not data:
                return

    def _cut(self, piece: bytes, at: int):
        raw = np.frombuffer(piece, np.uint8)
        ends = np.flatnonzero(raw == 10)
        if raw[-1] != 10:
            ends = np.r_[ends, len(raw)]
        starts = np.r_[0, ends[:-1] + 1]
        if self.skip:  # the rest of a line that began ahead of the range
            self.skip = False
            starts, ends = starts[1:], ends[1:]
        if not len(starts):
            return
        stops = ends - (raw[np.maximum(ends - 1, 0)] == 13) * (ends > starts)
        yield starts + at, _texts(piece, raw, starts, stops)


def _texts(piece: bytes, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Slices of a piece of text as strings."""
    lengths = stops - starts
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    data = raw[np.cumsum(inside[:-1]) > 0].tobytes()
    out = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in out.to_pylist()], pa.string())


class RangePartition(InputPartition):
    def __init__(self, ranges: list[tuple[str, str, int, int, int]]):
        self.ranges = ranges


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], entries: bool):
        self.root = options["path"]
        self.size, self.block = int(options.get("range_bytes", 0)), int(options.get("block_bytes", BLOCK))
        self.cores = int(options.get("cores", 1))
        self.entries = entries

    def partitions(self) -> list[RangePartition]:
        """Ranges of long files one by one; short files several at a time."""
        out, held, load = [], [], 0
        files = _listing(self.root)
        length = self.size or min(RANGE, max(LEAST, sum(size for _, _, size in files) // self.cores))
        for shown, path, size in files:
            for start in range(0, size, length):
                stop = min(start + length, size)
                if load + stop - start > length and held:
                    out.append(RangePartition(held))
                    held, load = [], 0
                held.append((shown, path, start, stop, size))
                load += stop - start
        if held:
            out.append(RangePartition(held))
        return out or [RangePartition([])]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.root)
        for shown, path, start, stop, size in partition.ranges:
            with system.open_input_file(path) as handle:
                lines = _Lines(handle, start, size, self.block)
                yield from self._entries(lines, shown, start, stop) if self.entries else self._lines(lines, shown, stop)

    def _lines(self, lines: _Lines, shown: str, stop: int) -> Iterator[pa.RecordBatch]:
        for starts, texts in lines:
            n = int(np.searchsorted(starts, stop))
            if n:
                yield _batch([texts.slice(0, n), _same(shown, n), pa.array(starts[:n])], LINES)
            if n < len(starts):
                return

    def _entries(self, lines: _Lines, shown: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        """Lines with the head of their entry, which is carried down from batch to batch."""
        begun = start == 0  # a later range begins with its first head
        head: tuple = (None, None, None)  # start, stamp and level of the entry so far
        for starts, texts in lines:
            stamps = pc.struct_field(pc.extract_regex(texts, _HEAD), 0)
            is_head = stamps.is_valid().to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(is_head)
            first, last = 0, len(starts)
            if not begun:
                mine = heads[starts[heads] >= start]
                if not len(mine):
                    if len(heads) == 0 or starts[-1] < stop:
                        continue
                    return
                if starts[mine[0]] >= stop:
                    return
                first, begun = int(mine[0]), True
            beyond = heads[(starts[heads] >= stop) & (heads >= first)]
            over = bool(len(beyond))
            if over:
                last = int(beyond[0])
            if last > first:
                yield self._filled(texts, starts, stamps, is_head, first, last, head, shown)
                mine = heads[(heads >= first) & (heads < last)]
                if len(mine):
                    at = int(mine[-1])
                    head = int(starts[at]), stamps[at].as_py(), _levels(texts.slice(at, 1))[0].as_py()
            if over:
                return

    def _filled(self, texts, starts, stamps, is_head, first, last, head, shown) -> pa.RecordBatch:
        n = last - first
        texts, stamps, is_head = texts.slice(first, n), stamps.slice(first, n), is_head[first:last]
        own = pa.array(is_head)
        carried = [
            pc.if_else(own, pa.array(starts[first:last]), pa.scalar(None, pa.int64())), stamps,
            pc.if_else(own, _levels(texts), pa.scalar(None, pa.string())),
        ]
        for i, above in enumerate(head):
            column = carried[i]
            # the first row stands for all that follow without a head
            if not is_head[0] and above is not None:
                column = pa.concat_arrays([pa.array([above], column.type), column.slice(1)])
            carried[i] = pc.fill_null_forward(column)
        return _batch([texts, _same(shown, n), pa.array(starts[first:last]), pa.array(~is_head), *carried], ENTRIES)


# The time stamp and the levels, as in ``logtext``.
_HEAD = "^(?P<t>" + STAMP.removeprefix("^(").removesuffix(")") + ")"
_FIRST_LEVEL = "(?P<l>" + LEVEL.strip("()") + ")"


def _levels(texts: pa.Array) -> pa.Array:
    """First level word of each line, '' if none."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(texts, _FIRST_LEVEL), 0), "")


def _same(text: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(text, pa.string()), n)


def _batch(columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[f.strip().split(" ")[0] for f in schema.split(",")])


class LogLines(DataSource):
    """Option ``path``: a folder or file. Options ``range_bytes`` and ``block_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, entries=False)


class LogEntries(LogLines):
    """As ``log_lines``, with the head of each line's entry."""

    @classmethod
    def name(cls) -> str:
        return "log_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, entries=True)


def _scan(spark: SparkSession, source: type[DataSource], root: str, range_bytes: int, block_bytes: int) -> DataFrame:
    spark.dataSource.register(source)
    sizes = {"range_bytes": range_bytes, "block_bytes": block_bytes, "cores": spark.sparkContext.defaultParallelism}
    return spark.read.format(source.name()).options(**sizes).load(root)


def scan_placed_lines(spark: SparkSession, root: str, range_bytes: int = 0, block_bytes: int = BLOCK) -> DataFrame:
    """Lines of a tree with ``file_path`` and ``line_start``, the byte at which a line begins in its file.

    ``range_bytes`` 0 takes ranges of up to ``RANGE`` bytes that keep all cores busy.
    """
    return _scan(spark, LogLines, root, range_bytes, block_bytes)


def scan_entries(spark: SparkSession, root: str, range_bytes: int = 0, block_bytes: int = BLOCK) -> DataFrame:
    """Lines of a tree with the head line of their entry: its place, its time stamp and its level.

    ``is_continuation`` marks lines without a time stamp; the three entry columns are null ahead of a file's first head.
    """
    return _scan(spark, LogEntries, root, range_bytes, block_bytes)
