"""The data source "jsonvalues": files of JSON values in any framing, as rows value, input_offset, ordinal, path.

Each file is a partition, read a buffer at a time, so memory is bounded by the longest value, not by the file. Paths are local ones
or URIs of a store that Arrow opens (s3, gs, hdfs, file). read_values takes any path that Spark reads, a file's bytes at once.
"""

from __future__ import annotations

import fnmatch
import itertools
import os
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from jsonloom.sources.framer import StreamError, values

SCHEMA = "value string, input_offset long, ordinal long, path string"
CHUNK, ROWS = 64 * 1024, 10_000


def _rows(chunks, path: str, most: int, mode: str) -> Iterator[tuple]:
    """STOP: the values before a file's first fault; PERMISSIVE: after them a row with NULL as value at the fault; FAILFAST
    raises after them."""
    n = 0
    try:
        for offset, raw in values(chunks, most):
            yield raw.decode(), offset, n, path
            n += 1
    except StreamError as e:
        if mode == "FAILFAST":
            raise
        if mode == "PERMISSIVE":
            yield None, e.offset, n, path


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + re.sub(r"^file:/*", "", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Options:
    def __init__(self, options: dict):
        self.most = int(options.get("maxvaluebytes", options.get("maxValueBytes", 0)))
        self.size = max(512, int(options.get("buffersize", options.get("bufferSize", CHUNK))))
        self.mode = options.get("mode", "FAILFAST").upper()
        if self.mode not in ("FAILFAST", "STOP", "PERMISSIVE"):
            raise ValueError(f"mode {self.mode}: FAILFAST, STOP or PERMISSIVE")
        self.path = options.get("path", "")
        if not self.path:
            raise ValueError("path is missing")

    def files(self) -> list[fs.FileInfo]:
        """A folder's files, but for those whose names start with . or _; a file; or the files that a pattern with * or ? fits."""
        store, path = _store(self.path)
        if "*" in path or "?" in path:
            root = re.split(r"[*?]", path)[0].rpartition("/")[0]
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
            found = [f for f in found if fnmatch.fnmatch(f.path, path) and f.path.count("/") == path.count("/")]
        else:
            info = store.get_file_info(path)
            found = [info] if info.type != fs.FileType.Directory else [f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name[0] not in "._"]
        return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)

    def rows(self, partition: File) -> Iterator[tuple]:
        def chunks():
            with _store(self.path)[0].open_input_stream(partition.path, compression=None) as f:
                while data := f.read(self.size):
                    yield data

        return _rows(chunks(), partition.path, self.most, self.mode)


class ValuesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self):
        return [File(f.path) for f in self.options.files()]

    def read(self, partition):
        if partition is not None:  # a folder without files has no partitions
            yield from self.options.rows(partition)


class ValuesStreamReader(DataSourceStreamReader):
    """New files of a folder, in order of the time they were last written and then of their names, whatever their names are. The
    offset is the last file's time and path. Files must be complete when they appear and must not change; a file that appears
    must not be older than those that have been read (so write to the folder, or touch what is moved there)."""

    def __init__(self, options: dict):
        self.options = _Options(options)

    def _ordered(self) -> list[tuple[int, str]]:
        return sorted((f.mtime_ns or 0, f.path) for f in self.options.files())

    def initialOffset(self):
        return {"time": -1, "path": ""}

    def latestOffset(self):
        last = self._ordered()[-1:]
        return {"time": last[0][0], "path": last[0][1]} if last else self.initialOffset()

    def partitions(self, start, end):
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [File(path) for time, path in self._ordered() if low < (time, path) <= high]

    def read(self, partition):
        yield from self.options.rows(partition)


class JsonValues(DataSource):
    @classmethod
    def name(cls):
        return "jsonvalues"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ValuesReader(dict(self.options))

    def streamReader(self, schema):
        return ValuesStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonValues)


def read_values(spark: SparkSession, path: str, mode: str = "FAILFAST", max_value_bytes: int = 0) -> DataFrame:
    """The same rows from any path that Spark reads; a file's bytes are held at once, its rows ROWS at a time."""
    import pyarrow as pa

    names = ["value", "input_offset", "ordinal", "path"]

    def each(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                found = _rows([content], file, max_value_bytes, mode.upper())
                while rows := list(itertools.islice(found, ROWS)):
                    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(each, SCHEMA)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One value a line, which Spark can split within files: rows value and valid; blank lines are left out."""
    from jsonloom.functions.columns import json_valid

    lines = spark.read.text(path).where(F.trim("value", F.lit(" \t\r")) != "")
    return lines.withColumn("valid", json_valid("value"))


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists", escape_html: bool = True) -> None:
    """Each row as one compact JSON object a line."""
    from jsonloom.operators.codec import json_encode

    df.select(json_encode(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, escape_html).alias("value")).write.mode(mode).text(path)


def decode_values(df: DataFrame, schema, mode: str = "STOP", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Typed rows of read_values: doc, and error (see json_decode_result), input_offset, ordinal, path, and the columns in keep.

    STOP: of each file the rows before the first value that does not fit, as faults of a stream are sticky; PERMISSIVE: all rows,
    each with its own error; FAILFAST raises."""
    from jsonloom.operators.codec import json_decode, json_decode_result

    if mode == "FAILFAST":
        return df.select(json_decode("value", schema, mode, **options).alias("doc"), "input_offset", "ordinal", "path", *keep)
    rows = df.withColumn("_r", json_decode_result("value", schema, **options))
    if mode == "STOP":
        # the first fault of each file, a number; files are joined with it, so a file's rows need not meet in one task
        bad = F.col("_r.error").isNotNull() | F.col("value").isNull()
        first = rows.where(bad).groupBy("path").agg(F.min("input_offset").alias("_first"))
        rows = rows.join(first, "path", "left").where("_first is null or input_offset < _first")
    return rows.select(F.col("_r.value").alias("doc"), F.col("_r.error").alias("error"), "input_offset", "ordinal", "path", *keep)
