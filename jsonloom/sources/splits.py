"""Reads large files of JSON values in parallel, a range of bytes a task.

Where a range starts inside a value is not known at first. Each range is scanned under both hypotheses, that its first byte is inside
a string and that it is not; each gives how the nesting changes and how the range ends. Put together range by range, these tell
every range the state it starts in. It then goes to the end of the value that is open there and reads the values that start in it.

Ranges begin behind a byte that no number and no literal has, so that no bare scalar lies across a beginning.

Ranges are as long as asked for, but a task takes as many as make up TASK bytes, or fewer where that leaves cores idle; so tasks grow
with the bytes and not with the ranges, and what is read beside a range is in proportion to it.
"""

from __future__ import annotations

import contextlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.sources.framer import StreamError, ValueFrame, values
from jsonloom.sources.jsonvalues import ROWS, SCHEMA, _Options, _store

SPLIT, CHUNK, PEEK = 128 << 20, 1 << 20, 512
#: Bytes of a task's ranges at least, where there are enough for four tasks a core; tasks of one stage at most.
TASK, TASKS = 32 << 20, 100_000
_HARD = re.compile(rb'[ \t\n\r{}\[\],:"]')
_STRINGS = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]|\\.)*+', re.DOTALL)
_STEPS = np.zeros(256, np.int64)
_STEPS[[0x5B, 0x7B]], _STEPS[[0x5D, 0x7D]] = 1, -1


def _pieces(file, start: int, stop: int | None = None, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes from start to stop, or to the file's end in pieces that grow from size on."""
    file.seek(start)
    while stop is None or start < stop:
        data = file.read(size if stop is None else min(CHUNK, stop - start))
        size = min(CHUNK, 2 * size)
        if not data:
            return
        start += len(data)
        yield data


def boundary(file, at: int, size: int) -> int:
    """The first place from `at` on that has a hard byte before it; 0 and the file's end are places, too."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    at -= 1
    for data in _pieces(file, at, None, PEEK):
        m = _HARD.search(data)
        if m:
            return at + m.end()
        at += len(data)
    return size


def transition(pieces: Iterator[bytes], string: bool) -> tuple[int, int, bool, bool]:
    """Of bytes that start inside a string or not: how much deeper they end, the lowest depth on the way, whether they end inside a
    string, and whether the string that was open at the start ends."""
    depth = low = 0
    closed, cut = not string, b""  # cut: a backslash whose escape goes on in the next piece
    for data in pieces:
        data, cut = cut + data, b""
        if string:
            end = _REST.match(data).end()
            if end == len(data):
                continue
            if data[end] != 0x22:
                cut = data[end:]
                continue
            data, string, closed = data[end + 1 :], False, True
        rest = _STRINGS.sub(b"", data)
        quote = rest.find(b'"')  # of a string that does not end here
        if quote >= 0:
            end = _REST.match(rest, quote + 1).end()
            rest, cut, string = rest[:quote], rest[end:], True
        steps = np.cumsum(_STEPS[np.frombuffer(rest, np.uint8)])
        if len(steps):
            low, depth = min(low, depth + int(steps.min())), depth + int(steps[-1])
    return depth, low, string, closed


def range_values(pieces: Iterator[bytes], start: int, stop: int, depth: int, string: bool, most: int) -> Iterator[tuple[int, bytes | None]]:
    """Offset and source of the values that start in the range; at a fault the offset of its value, with None, and no more."""
    if depth or string:
        frame = ValueFrame(0x5B if depth else 0x22)
        frame.depth, frame.string, frame.started = depth, string, True
        for data in pieces:
            end = frame.scan(data, 0)
            if end >= 0:
                start, pieces = start + end, itertools.chain([data[end:]], pieces)
                break
            start += len(data)
        else:
            return
    try:
        for offset, raw in values(pieces, most) if start < stop else ():
            if start + offset >= stop:
                return
            yield start + offset, raw
    except StreamError as e:
        if start + e.offset < stop:
            yield start + e.offset, None


def read_values_split(spark: SparkSession, path: str, mode: str = "FAILFAST", max_value_bytes: int = 0, split_bytes: int = SPLIT) -> DataFrame:
    """The rows of the source jsonvalues, from files that are read in ranges of about so many bytes, each by a task of its own, twice.
    Memory is bounded by the longest value. ordinal is NULL: input_offset orders a file's rows.

    STOP and PERMISSIVE leave out what follows a file's first fault, which takes a third reading."""
    options = _Options({"path": path, "mode": mode})
    files = [(f.path, f.size) for f in options.files() if f.size]
    whole = sum(size for _, size in files)
    cores = spark.sparkContext.defaultParallelism
    share = max(split_bytes, min(TASK, whole // (4 * cores)), whole // TASKS) // split_bytes * split_bytes  # bytes of a task's ranges
    shares = [(path, size, a, min(a + share, size)) for path, size in files for a in range(0, size, share)]
    tasks = max(1, min(len(shares), TASKS))
    shares = [(n % tasks, *x) for n, x in enumerate(shares)]

    @contextlib.contextmanager
    def opened():
        """A function that opens files; the last one stays open until another is asked for."""
        last: list = [None, None]

        def get(file: str):
            if last[0] != file:
                if last[1]:
                    last[1].close()
                last[:] = file, _store(path)[0].open_input_file(file)
            return last[1]

        try:
            yield get
        finally:
            if last[1]:
                last[1].close()

    def scan(found):
        with opened() as get:
            for b in found:
                for file, size, start, stop in zip(*[b.column(n).to_pylist() for n in ("path", "size", "start", "stop")]):
                    f, out = get(file), []
                    high = boundary(f, start, size)
                    for end in range(start + split_bytes, stop + split_bytes, split_bytes):
                        low, high = high, boundary(f, min(end, stop), size)
                        out.append((file, low, high, *transition(_pieces(f, low, high), False), *transition(_pieces(f, low, high), True)))
                        if len(out) == ROWS:
                            yield pa.record_batch([pa.array(x) for x in zip(*out)], scanned.names)
                            out = []
                    if out:
                        yield pa.record_batch([pa.array(x) for x in zip(*out)], scanned.names)

    def fold(group: pa.Table) -> pa.Table:
        depth, string, out = 0, False, []
        for x in sorted(group.to_pylist(), key=lambda x: (x["low"], x["high"])):
            more, lowest, end, closed = (x[f"{k}{int(string)}"] for k in ("depth", "lowest", "string", "closed"))
            inside = not closed or (depth > 0 and depth + lowest > 0)  # no value starts here
            if not inside and x["low"] < x["high"]:
                out.append((x["path"], x["low"], x["high"], depth, string))
            depth, string = depth + more, end
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(known.types)], names=known.names)

    def read(found):
        with opened() as get:
            texts, offsets, paths = [], [], []
            for b in found:
                for file, low, high, depth, string in zip(*[b.column(i).to_pylist() for i in range(5)]):
                    f = get(file)
                    for offset, raw in range_values(_pieces(f, low, None, min(CHUNK, high - low + PEEK)), low, high, depth, string, max_value_bytes):
                        if raw is None and options.mode == "FAILFAST":
                            raise StreamError(offset, f"not a value, in {file}")
                        texts.append(None if raw is None else raw.decode())
                        offsets.append(offset)
                        paths.append(file)
                        if len(texts) == ROWS:
                            yield rows_batch(texts, offsets, paths)
                            texts, offsets, paths = [], [], []
            yield rows_batch(texts, offsets, paths)

    def rows_batch(texts, offsets, paths):
        return pa.record_batch([pa.array(texts, pa.string()), pa.array(offsets, pa.int64()), pa.nulls(len(texts), pa.int64()), pa.array(paths, pa.string())], ["value", "input_offset", "ordinal", "path"])

    kinds = {"depth": pa.int64(), "lowest": pa.int64(), "string": pa.bool_(), "closed": pa.bool_()}
    scanned = pa.schema([("path", pa.string()), ("low", pa.int64()), ("high", pa.int64()), *((f"{k}{i}", t) for i in (0, 1) for k, t in kinds.items())])
    known = pa.schema([("path", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("depth", pa.int64()), ("string", pa.bool_())])
    ddl = lambda s: ", ".join(f"{f.name} {({'int64': 'long', 'bool': 'boolean'}).get(str(f.type), str(f.type))}" for f in s)
    listed = spark.createDataFrame(shares, "id long, path string, size long, start long, stop long")
    states = spark.range(0, tasks, 1, tasks).join(F.broadcast(listed), "id").mapInArrow(scan, ddl(scanned))
    states = states.groupBy("path").applyInArrow(fold, ddl(known))
    rows = states.repartition(tasks).mapInArrow(read, SCHEMA)
    if options.mode == "FAILFAST":
        return rows
    first = rows.where("value is null").groupBy("path").agg(F.min("input_offset").alias("_first"))
    rows = rows.join(first, "path", "left").where("_first is null or input_offset < _first or (value is null and input_offset = _first)").drop("_first")
    rows = rows.select("value", "input_offset", "ordinal", "path")
    return rows if options.mode == "PERMISSIVE" else rows.where("value is not null")
