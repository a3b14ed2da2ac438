"""Recorded receiver output: byte files of escaped wire frames, read by byte ranges, as a batch or a stream.

An escape byte and a record kind always begin a record: no well-formed body holds such a pair, and a cut record's body ends
before it. So where records begin follows from the bytes nearby, not from where reading began: a task starts a little before
its range, finds out from the run of escape bytes before that whether it stands inside a pair, and keeps the records that end
in its range. Every record ends in one range, whatever the ranges are, and needs no byte after that range, which lets
a stream read a file that is still growing.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed layout: escape 1A, kind 2 (7 bytes) or 3 (14 bytes), 6 tick bytes, 1 signal byte, frame; 1A within is doubled.
# An E3 record and any other escape pair are passed over, junk between records too.
RECORD = re.compile(rb"\x1a(?:2((?:[^\x1a]|\x1a[^23\xe3]){14})|3((?:[^\x1a]|\x1a[^23\xe3]){21})|.)", re.DOTALL)
ESCAPED = re.compile(rb"\x1a(.)", re.DOTALL)
ESCAPE = b"\x1a"
LONGEST = 2 + 2 * 21
TICKS_PER_MICROSECOND = 12
ROWS_PER_BATCH = 50_000
RANGE_BYTES = 32 << 20
FORMAT = "captures"
CAPTURE_SCHEMA = "path string, modified long, position long, frame string, ts12 long, signal double"


def parse_capture(data: bytes, base: int = 0, after: int = 0) -> Iterator[tuple[int, str, int, float]]:
    """Position, frame hex, tick and signal level of every frame that ends after position ``after``; ``data`` begins at ``base``."""
    for match in RECORD.finditer(data):
        body = match.group(1) or match.group(2)
        if body is None or base + match.end() <= after:
            continue
        plain = ESCAPED.sub(rb"\1", body)
        level = plain[6] / 255.0
        yield base + match.start(), plain[7:].hex().upper(), int.from_bytes(plain[:6], "big"), level * level * 255.0


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/a`` and plain paths are local or mounted."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _files(path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of change (microseconds) of a file, of a folder's files or of those that fit its pattern, by name."""
    folder, pattern = (posixpath.split(path) if re.search(r"[*?\[]", posixpath.basename(path)) else (path, "*"))
    system, inside = _opened(folder)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside))
    rows = [(f.path, f.size, (f.mtime_ns or 0) // 1000) for f in found
            if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and not f.base_name.startswith(("_", "."))]
    prefix = folder[: len(folder) - len(inside)] if folder.endswith(inside) and "://" in folder else ""
    return sorted((prefix + name, size, changed) for name, size, changed in rows)


def _aligned(file, start: int) -> int:
    """``start``, or the byte after it where ``start`` is the second of an escape pair: the run of escape bytes before it is odd."""
    run, end, block = 0, start, 64
    while end > 0:
        begin = max(0, end - block)
        file.seek(begin)
        data = file.read(end - begin)
        tail = len(data) - len(data.rstrip(ESCAPE))
        run += tail
        if tail < len(data):
            break
        end, block = begin, block * 4
    return start + run % 2


def read_range(path: str, begin: int, end: int) -> Iterator[tuple[int, str, int, float]]:
    """Frames of a file whose records end after ``begin`` and at most at ``end``."""
    system, inside = _opened(path)
    with system.open_input_file(inside) as file:
        start = _aligned(file, max(0, begin - LONGEST))
        file.seek(start)
        yield from parse_capture(file.read(max(0, end - start)), start, begin)


def _ranges(path: str, begin: int, end: int, changed: int, size: int) -> list[InputPartition]:
    return [InputPartition((path, at, min(at + size, end), changed)) for at in range(begin, end, size)]


def _rows(partition: InputPartition) -> Iterator[pa.RecordBatch]:
    path, begin, end, changed = partition.value
    rows: list = []
    for row in read_range(path, begin, end):
        rows.append(row)
        if len(rows) >= ROWS_PER_BATCH:
            yield _batch(path, changed, rows)
            rows = []
    if rows:
        yield _batch(path, changed, rows)


def _batch(path: str, changed: int, rows: list) -> pa.RecordBatch:
    positions, frames, ticks, signals = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(rows), pa.string()), pa.array([changed] * len(rows), pa.int64()), pa.array(positions, pa.int64()),
         pa.array(frames, pa.string()), pa.array(ticks, pa.int64()), pa.array(signals, pa.float64())],
        names=["path", "modified", "position", "frame", "ts12", "signal"])


class CaptureReader(DataSourceReader):
    """One partition per byte range."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        parts = [p for path, size, changed in _files(self.path) for p in _ranges(path, 0, size, changed, self.size)]
        return parts or [InputPartition(("", 0, 0, 0))]

    def read(self, partition):
        return _rows(partition) if partition.value[0] else iter(())


class CaptureStreamReader(DataSourceStreamReader):
    """What was added since the last batch. The offset is the newest file and the bytes of it that were read: files come in order
    of their names, and only the newest grows."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self):
        return {"file": "", "end": 0}

    def latestOffset(self):
        files = _files(self.path)
        return {"file": files[-1][0], "end": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start, end):
        parts = []
        for path, size, changed in _files(self.path):
            if start["file"] <= path <= end["file"]:
                begin = start["end"] if path == start["file"] else 0
                parts += _ranges(path, begin, end["end"] if path == end["file"] else size, changed, self.size)
        return parts

    def read(self, partition):
        return _rows(partition)

    def commit(self, end):
        pass


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class CaptureWriter(DataSourceArrowWriter):
    """Each task writes files of its own, one per run of rows of one receiver; they get their names when all tasks are done."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        from pyspark import TaskContext

        system, folder = _opened(self.path)
        system.create_dir(folder)
        task, open_file, current, files = TaskContext.get().partitionId(), None, None, []
        try:
            for batch in iterator:
                for receiver, wire in zip(batch.column("receiver").to_pylist(), batch.column("wire").to_pylist()):
                    if open_file is None or receiver != current:
                        if open_file is not None:
                            open_file.close()
                        current = receiver
                        name = f"{re.sub(r'[^A-Za-z0-9_.]', '_', receiver or 'unnamed')}-part-{task:05d}-{uuid.uuid4().hex}.bin"
                        files.append(name)
                        open_file = system.open_output_stream(f"{folder}/_{name}")
                    open_file.write(wire or b"")
        finally:
            if open_file is not None:
                open_file.close()
        return Written(files)

    def commit(self, messages):
        system, folder = _opened(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            system.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages):
        system, folder = _opened(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            system.delete_file(f"{folder}/_{name}")


class CaptureSource(DataSource):
    """Format ``captures``: options ``path`` and ``rangeBytes``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return CAPTURE_SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStreamReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("captures are only added to a folder")
        return CaptureWriter(self.options)


def _named(parsed: DataFrame, started: str | None) -> DataFrame:
    begun = F.col("modified") if started is None else F.unix_micros(F.lit(started).cast("timestamp"))
    ts = F.timestamp_micros(begun + (F.col("ts12") / TICKS_PER_MICROSECOND).cast("long"))
    named = parsed.withColumns({"receiver": F.element_at(F.split("path", "/"), -1), "ts": ts, "source": F.lit("Beast")})
    return named.select("receiver", "position", "frame", "ts12", "signal", "ts", "source", "path")


def read_captures(spark: SparkSession, path: str, started: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of a capture file, of a folder of them or of those that fit a pattern; one task per ``range_bytes``.

    ``receiver`` is the file name, ``path`` the whole path, which tells files of equal names apart. Time is ``started`` (text, or
    the file's modification time) plus the tick count of 12 MHz. A task holds one range's bytes; files may have any size.
    """
    spark.dataSource.register(CaptureSource)
    return _named(spark.read.format(FORMAT).option("rangeBytes", range_bytes).load(path), started)


def read_capture_stream(spark: SparkSession, path: str, started: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same from a folder that files are added to, or whose newest file grows; names must come in order.

    A record cut by the end of the newest file comes with the batch in which it is whole. ``started`` must be given, as a growing
    file's modification time changes.
    """
    spark.dataSource.register(CaptureSource)
    return _named(spark.readStream.format(FORMAT).option("rangeBytes", range_bytes).load(path), started)


def write_captures(df: DataFrame, path: str, receiver: str = "receiver", wire: str = "wire", order=()) -> None:
    """Add files of ``wire`` bytes to the folder ``path``, one or more per task and receiver, rows in ``order`` within a file.

    A null ``wire`` adds nothing. Files of failed or repeated tasks keep a leading underscore, which readers pass over.
    """
    df.sparkSession.dataSource.register(CaptureSource)
    sorted_rows = df.sortWithinPartitions(receiver, *order)
    sorted_rows.select(F.col(receiver).cast("string").alias("receiver"), F.col(wire).cast("binary").alias("wire")).write.format(FORMAT).mode("append").save(path)
