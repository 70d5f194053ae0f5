"""Framed raw logs as a Spark data source.

A record is `QCR1`, metadata length (u32), payload length (u64), JSON metadata, payload, SHA-256 of all before it; numbers
are big-endian. The format is fixed. In audit mode a bad record is a row, else it is an error; metadata that break their
contract make a record corrupt, whatever its checksum.

A segment is read record by record. One that has an index beside it, written at the seal, is read in byte ranges by many
tasks; an index that is torn, or made for another size, is ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import struct
import time
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC, INDEX_MAGIC, VERSION, CHECK = b"QCR1", b"QIX1", 1, 32
HEAD = struct.Struct(">4sIQ")
#: Bytes of a segment that one task reads, if it has an index; what a reader buffers.
STRIDE, BUFFER = 64 << 20, 4 << 20
#: Limits of one record, so that a broken length is not read as a size.
MOST_META, MOST_PAYLOAD = 1 << 20, 1 << 28
SCHEMA = "segment string, frame_offset long, source_id string, recv_wall_ns long, recv_mono_ns long, host_id string, boot_id string, connection_id string, ingest_seq long, channel_hint string, capture_flags array<string>, payload binary, raw_sha256 string, tail_state string"
META = ["source_id", "recv_wall_ns", "recv_mono_ns", "host_id", "boot_id", "connection_id", "ingest_seq", "channel_hint"]


def encode(meta: dict, payload: bytes) -> bytes:
    head = json.dumps(meta, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    body = HEAD.pack(MAGIC, len(head), len(payload)) + head + payload
    return body + hashlib.sha256(body).digest()


def well_formed(meta: object) -> bool:
    """The contract of a record's metadata: exactly these fields, of these types; names not blank, counters not negative."""
    if not isinstance(meta, dict) or set(meta) != {*META, "capture_flags", "schema_version"}:
        return False
    counter = lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 63
    named = lambda x: isinstance(x, str) and bool(x.strip())
    flags = meta["capture_flags"]
    return (
        isinstance(meta["schema_version"], int) and not isinstance(meta["schema_version"], bool) and meta["schema_version"] == VERSION
        and all(named(meta[k]) for k in ("source_id", "host_id", "boot_id", "connection_id")) and all(counter(meta[k]) for k in ("recv_wall_ns", "recv_mono_ns", "ingest_seq"))
        and (meta["channel_hint"] is None or named(meta["channel_hint"]))
        and isinstance(flags, list) and all(named(x) for x in flags) and flags == sorted(set(flags))
    )


def records(stream, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, dict | None, bytes | None, str]]:
    """(offset, metadata, payload, state) of each record of a stream that is at `start`, up to the offset `stop` or the end.

    The last state is CLEAN, or INCOMPLETE or CORRUPT at the first bad offset. One record is held at a time.
    """
    at = start
    while stop is None or at < stop:
        head = stream.read(HEAD.size)
        if not head:
            return
        if len(head) < HEAD.size:
            yield at, None, None, "INCOMPLETE" if head[:4] == MAGIC[: len(head[:4])] else "CORRUPT"
            return
        magic, n, m = HEAD.unpack(head)
        if magic != MAGIC or n > MOST_META or m > MOST_PAYLOAD:
            yield at, None, None, "CORRUPT"
            return
        body, check = stream.read(n + m), stream.read(CHECK)
        if len(body) < n + m or len(check) < CHECK:
            yield at, None, None, "INCOMPLETE"
            return
        try:
            meta = json.loads(body[:n]) if hashlib.sha256(head + body).digest() == check else None
        except ValueError:
            meta = None
        if not well_formed(meta):
            yield at, None, None, "CORRUPT"
            return
        yield at, meta, body[n:], "CLEAN"
        at += HEAD.size + n + m + CHECK


def rows_of(name: str, stream, audit: bool, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    for at, meta, payload, state in records(stream, start, stop):
        if state == "CLEAN":
            yield (name, at, *[meta[k] for k in META], meta["capture_flags"], payload, hashlib.sha256(payload).hexdigest(), state)
        elif audit:
            yield (name, at, *[None] * len(META), None, None, None, state)
        else:
            raise ValueError(f"{name}: {state} record at byte {at}")


def index_bytes(size: int, offsets: list[int]) -> bytes:
    """A segment's index: `QIX1`, the segment's size, offsets of records at which a reader may start, SHA-256 of all before it."""
    body = INDEX_MAGIC + struct.pack(f">{len(offsets) + 1}Q", size, *offsets)
    return body + hashlib.sha256(body).digest()


def read_index(data: bytes, size: int) -> list[int]:
    """Offsets of an index that is whole and made for a segment of this size; else the start alone, which needs no index."""
    body, check = data[:-CHECK], data[-CHECK:]
    if len(body) < 12 or len(body) % 8 != 4 or body[:4] != INDEX_MAGIC or hashlib.sha256(body).digest() != check:
        return [0]
    stated, *offsets = struct.unpack(f">{(len(body) - 4) // 8}Q", body[4:])
    return offsets if stated == size and offsets[:1] == [0] and offsets == sorted(offsets) and offsets[-1] < max(size, 1) else [0]


class Marks:
    """Offsets of records, at least `stride` bytes apart, gathered while a segment is written or read."""

    def __init__(self, stride: int):
        self.stride, self.offsets = stride, [0]

    def add(self, at: int) -> None:
        if at - self.offsets[-1] >= self.stride:
            self.offsets.append(at)


class Segment(InputPartition):
    """A range of a segment's bytes that begins and ends at a record."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None):
        self.path, self.start, self.stop = path, start, stop


def store_of(path: str):
    """(file system, path in it) of a folder: a local path or a URI of any store that pyarrow reaches."""
    if re.match(r"file:/[^/]", path):  # as Hadoop writes local paths
        path = path[5:]
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path))


def sealed(folder: str) -> list[str]:
    """Sealed segments in the order of their names."""
    store, path = store_of(folder)
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".rawlog"))


def ranges(store, path: str) -> list[Segment]:
    """A segment as the ranges of its index; as one range if it has none."""
    size, index = (x.size for x in store.get_file_info([path, f"{path}.index"]))
    offsets = [0]
    if index:
        with store.open_input_stream(f"{path}.index", compression=None) as f:
            offsets = read_index(f.read(), size)
    return [Segment(path, a, b) for a, b in zip(offsets, [*offsets[1:], None], strict=True)]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.audit = options["path"], options.get("audit", "false") == "true"

    def partitions(self):
        store = store_of(self.path)[0]
        return [part for p in sealed(self.path) for part in ranges(store, p)] or [Segment("")]

    def read(self, partition):
        if partition.path:
            with store_of(self.path)[0].open_input_file(partition.path) as f:
                f.seek(partition.start)
                yield from rows_of(partition.path.rsplit("/", 1)[-1], io.BufferedReader(f, BUFFER), self.audit, partition.start, partition.stop)


class StreamReader(DataSourceStreamReader):
    """Sealed segments in name order; an offset is the last name read. Names are given at the seal and only grow."""

    def __init__(self, options: dict):
        self.path, self.audit = options["path"], options.get("audit", "false") == "true"

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        return {"last": max((p.rsplit("/", 1)[-1] for p in sealed(self.path)), default="")}

    def partitions(self, start, end):
        store = store_of(self.path)[0]
        return [part for p in sealed(self.path) if start["last"] < p.rsplit("/", 1)[-1] <= end["last"] for part in ranges(store, p)] or [Segment("")]

    read = Reader.read

    def commit(self, end):
        pass


class Committed(WriterCommitMessage):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n


class Writer(DataSourceWriter):
    """One segment for each partition; it gets its name when the job commits, after all that are there. Nothing is replaced."""

    def __init__(self, options: dict):
        self.path, self.job, self.stride = options["path"], uuid.uuid4().hex, int(options.get("stride", STRIDE))

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = store_of(self.path)
        store.create_dir(path)
        name, n = f"{path}/{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}.part", 0
        marks, at = Marks(self.stride), 0
        with store.open_output_stream(name, compression=None) as f:
            for r in rows:
                meta = {k: r[k] for k in META} | {"schema_version": VERSION, "capture_flags": sorted(set(r["capture_flags"] or []))}
                if not well_formed(meta):
                    raise ValueError(f"a record breaks the metadata contract: {meta}")
                marks.add(at)
                record = encode(meta, bytes(r["payload"]))
                f.write(record)
                n, at = n + 1, at + len(record)
        with store.open_output_stream(f"{name}.index", compression=None) as f:
            f.write(index_bytes(at, marks.offsets))
        return Committed(name, n)

    def commit(self, messages):
        store, path = store_of(self.path)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.path):
            if not m.n:
                store.delete_file(m.path)
                store.delete_file(f"{m.path}.index")
                continue
            last = max((int(p.rsplit("/seg-", 1)[1][:20]) for p in sealed(self.path) if re.search(r"/seg-\d{20}-", p)), default=0)
            final = f"{path}/seg-{max(time.time_ns(), last + 1):020d}-{self.job}.rawlog"
            if store.get_file_info(final).type != fs.FileType.NotFound:
                raise FileExistsError(final)
            store.move(f"{m.path}.index", f"{final}.index")  # first: a segment without its index is read as one range
            store.move(m.path, final)

    def abort(self, messages):
        store, _ = store_of(self.path)
        for m in messages:
            for path in (m.path, f"{m.path}.index") if m is not None else ():
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    store.delete_file(path)


class RawLog(DataSource):
    """spark.read.format("rawlog").option("audit", "true").load(folder)."""

    @classmethod
    def name(cls):
        return "rawlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def raw_frames(spark: SparkSession, folder: str, audit: bool = False) -> DataFrame:
    spark.dataSource.register(RawLog)
    return spark.read.format("rawlog").option("audit", str(audit).lower()).load(folder)


def audit(frames: DataFrame) -> DataFrame:
    """(segment, valid_frames, payload_bytes, tail_state, first_bad_offset, seq and wall spans) of frames read in audit mode.

    What follows a segment's first bad record does not count, though other ranges of the segment were read.
    """
    clean = F.col("tail_state") == "CLEAN"
    bad = frames.where(~clean).groupBy("segment").agg(F.min(F.struct("frame_offset", "tail_state")).alias("bad"))
    first = F.col("bad.frame_offset")
    trusted = frames.select("segment", "frame_offset", "tail_state", F.length("payload").alias("bytes"), "ingest_seq", "recv_wall_ns", "source_id").join(bad, "segment", "left")
    ok = lambda c: F.when(clean & (first.isNull() | (F.col("frame_offset") < first)), c)
    return trusted.groupBy("segment").agg(
        F.count(ok(F.lit(1))).alias("valid_frames"), F.sum(ok(F.col("bytes"))).alias("payload_bytes"),
        F.coalesce(F.max("bad.tail_state"), F.lit("CLEAN")).alias("tail_state"), F.max(first).alias("first_bad_offset"),
        F.min(ok(F.col("ingest_seq"))).alias("first_seq"), F.max(ok(F.col("ingest_seq"))).alias("last_seq"), F.min(ok(F.col("recv_wall_ns"))).alias("first_wall_ns"), F.max(ok(F.col("recv_wall_ns"))).alias("last_wall_ns"),
        F.array_sort(F.collect_set(ok(F.col("source_id")))).alias("sources"),
    )


def scan(path: str, marks: Marks | None = None) -> tuple[str, int, int]:
    """(tail state, whole records, bytes of them) of one segment, read record by record."""
    store, name = store_of(path)
    n = end = 0
    with store.open_input_file(name) as f:
        stream = io.BufferedReader(f, BUFFER)
        for at, _, _, state in records(stream):
            if state != "CLEAN":
                return state, n, at
            if marks:
                marks.add(at)
            n, end = n + 1, stream.tell()
    return "CLEAN", n, end


def index_segment(path: str, stride: int = STRIDE) -> list[int]:
    """Write the index of a clean segment that was sealed without one."""
    store, name = store_of(path)
    marks = Marks(stride)
    state, _, size = scan(path, marks)
    if state != "CLEAN":
        raise ValueError(f"{path} is {state}")
    with store.open_output_stream(f"{name}.index", compression=None) as f:
        f.write(index_bytes(size, marks.offsets))
    return marks.offsets


def recover(path: str) -> str:
    """Cut an incomplete tail off a segment; a corrupt one is left alone. Gives the tail's state.

    The whole records are written beside it and moved over it, so that a second crash loses nothing.
    """
    store, name = store_of(path)
    state, _, left = scan(path)
    if state == "INCOMPLETE":
        with store.open_input_stream(name, compression=None) as f, store.open_output_stream(f"{name}.part", compression=None) as out:
            while left:
                part = f.read(min(left, BUFFER))
                out.write(part)
                left -= len(part)
        store.move(f"{name}.part", name)
    return state
