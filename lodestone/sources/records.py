"""Record files: a header, then blocks of rows, each behind its length and checksum and followed by the file's own mark.

A file is ``MAGIC``, the version (a byte), the length of a JSON header (4 bytes, little endian) and the header: the rows' schema, the mark, and
free entries. A block is its length and CRC-32 (4 bytes each), that many bytes of an Arrow stream, and the mark (16 bytes). A
reader of any byte range looks for the first mark at or after its start, and reads the blocks that start within, so a large file is read
by many tasks and each block once. A block that is cut short, or whose checksum is wrong, is an error with the file and place.

The files are those of a folder that all executors see. A batch or micro-batch writes under hidden names, and its commit
renames them; a micro-batch's names hold its number, so one that is written again replaces itself.
"""

from __future__ import annotations

import glob
import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, MAGIC, VERSION, SUFFIX = "records", b"LSRECORD", 1, ".records"
MARK_BYTES, SPLIT_BYTES, LOOK_BYTES = 16, 64 << 20, 1 << 20
#: Longest header and block that a reader believes in.
MOST_HEADER, MOST_BLOCK = 1 << 20, 1 << 30


class RecordError(ValueError):
    """Not a record file, of another version, or damaged."""


def header(path: str) -> tuple[dict, int]:
    """The header and where the first block starts."""
    with open(path, "rb") as f:
        head = f.read(len(MAGIC) + 5)
        if head[: len(MAGIC)] != MAGIC:
            raise RecordError(f"{path} isn't a record file")
        if len(head) < len(MAGIC) + 5:
            raise RecordError(f"{path}: the header is cut short")
        if head[len(MAGIC)] != VERSION:
            raise RecordError(f"{path} has version {head[len(MAGIC)]}, not {VERSION}")
        size = int.from_bytes(head[-4:], "little")
        raw = f.read(size) if size <= MOST_HEADER else b""
        if len(raw) < size or size > MOST_HEADER:
            raise RecordError(f"{path}: the header is cut short")
        return json.loads(raw), f.tell()


def blocks(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks that start in [start, end)."""
    about, first = header(path)
    mark = bytes.fromhex(about["mark"])
    with open(path, "rb") as f:
        at = first if start <= first else _after_mark(f, mark, start - MARK_BYTES)
        while at is not None and at < end:
            f.seek(at)
            head = f.read(8)
            if not head:
                return
            size = int.from_bytes(head[:4], "little")
            if len(head) < 8 or size > MOST_BLOCK:
                raise RecordError(f"{path}: the block at {at} is cut short")
            body = f.read(size + MARK_BYTES)
            if len(body) < size + MARK_BYTES:
                raise RecordError(f"{path}: the block at {at} is cut short")
            if body[size:] != mark or zlib.crc32(body[:size]) != int.from_bytes(head[4:], "little"):
                raise RecordError(f"{path}: the block at {at} is damaged")
            with pa.ipc.open_stream(body[:size]) as stream:
                yield from stream
            at += 8 + size + MARK_BYTES


def _after_mark(f, mark: bytes, start: int) -> int | None:
    """Just after the first mark that begins at or after ``start``; None if there is none."""
    at, held = start, b""
    f.seek(start)
    while piece := f.read(LOOK_BYTES):
        held += piece
        found = held.find(mark)
        if found >= 0:
            return at + found + len(mark)
        cut = max(0, len(held) - len(mark) + 1)
        at, held = at + cut, held[cut:]
    return None


def _listed(path: str) -> list[str]:
    found = [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(glob.escape(path), f"*{SUFFIX}")))
    if not found:
        raise RecordError(f"no record files at {path}")
    return found


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Piece]:
        out = []
        for p in _listed(self.path):
            _, first = header(p)
            size = max(os.path.getsize(p), first + 1)
            starts = [0, *range(first + self.split, size, self.split)]
            out += [Piece(p, a, b) for a, b in zip(starts, [*starts[1:], size])]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        yield from blocks(piece.path, piece.start, piece.end)


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    rows: int


def _write(folder: str, name: str, schema: StructType, batches: Iterator[pa.RecordBatch]) -> Written:
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{name}-{uuid.uuid4().hex}{SUFFIX}")
    mark, rows = os.urandom(MARK_BYTES), 0
    about = json.dumps({"schema": schema.json(), "mark": mark.hex()}).encode()
    try:
        with open(hidden, "wb") as f:
            f.write(MAGIC + bytes([VERSION]) + len(about).to_bytes(4, "little") + about)
            for b in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as stream:
                    stream.write_batch(b)
                body = sink.getvalue().to_pybytes()
                f.write(len(body).to_bytes(4, "little") + zlib.crc32(body).to_bytes(4, "little") + body + mark)
                rows += b.num_rows
            f.flush()
            os.fsync(f.fileno())
    except BaseException:
        os.unlink(hidden)
        raise
    return Written(hidden, rows)


def _shown(hidden: str, number: str) -> str:
    folder, name = os.path.split(hidden)
    return os.path.join(folder, f"part-{number}{SUFFIX}")


def sweep(path: str, grace: float = 86_400.0) -> list[str]:
    """Delete hidden files older than ``grace`` seconds: those of tasks that were killed."""
    gone = [p for p in glob.glob(os.path.join(glob.escape(path), f".*{SUFFIX}")) if os.path.getmtime(p) < time.time() - grace]
    for p in gone:
        os.unlink(p)
    return gone


def _abort(messages: list[Written | None]) -> None:
    for m in messages:
        if m is not None and os.path.exists(m.hidden):
            os.unlink(m.hidden)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, "new", self.schema, batches)

    def commit(self, messages: list[Written | None]) -> None:
        old = glob.glob(os.path.join(glob.escape(self.path), f"*{SUFFIX}")) if self.overwrite else []
        run = uuid.uuid4().hex[:8]
        for i, m in enumerate(messages):
            if m is not None:
                os.replace(m.hidden, _shown(m.hidden, f"{run}-{i:05d}"))
        for p in old:
            os.unlink(p)

    def abort(self, messages: list[Written | None]) -> None:
        _abort(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, "batch", self.schema, batches)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        name = f"batch-{batchId:09d}"
        earlier = set(glob.glob(os.path.join(glob.escape(self.path), f"part-{name}-*{SUFFIX}")))
        shown = set()
        for i, m in enumerate(messages):
            if m is not None:
                target = _shown(m.hidden, f"{name}-{i:05d}")
                os.replace(m.hidden, target)
                shown.add(target)
        for p in earlier - shown:
            os.unlink(p)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _abort(messages)


class Records(DataSource):
    """format("records"); options: path, split (bytes a task reads at most)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        about, _ = header(_listed(self.options["path"])[0])
        return StructType.fromJson(json.loads(about["schema"]))

    def reader(self, schema: StructType) -> Reader:
        for p in _listed(self.options["path"]):
            if StructType.fromJson(json.loads(header(p)[0]["schema"])).simpleString() != schema.simpleString():
                raise RecordError(f"{p} has other columns")
        return Reader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)
