"""Helpers shared by the corpus operators: shared-folder tables, text batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are not in a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ become blanks, A-Z become a-z; bytes from 0x80 on stay.
WORD_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)

#: Rows and bytes that Python gets at once, at most (one row may have more bytes).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def word_list(data: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 bytes after lower-casing A-Z."""
    return data.translate(WORD_TABLE).split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what an Arrow batch holds when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a temporary one will do on one machine
    (tests); on a cluster executors could not see it, and an error says so."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="jsonloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more, lazily neither."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the text's UTF-8 bytes; columns with other names don't come along."""
    return df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("body"))


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with all columns but those named renamed, so that none clashes with what an operator adds."""
    return docs.toDF(*[c if c in names else f"_column{i}" for i, c in enumerate(docs.columns)])


def restored(df: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """The columns of docs, after aside() with the same names."""
    return df.select(*[F.col(f"`{c}`") if c in names else F.col(f"_column{i}").alias(c) for i, c in enumerate(docs.columns)])


_caches: list[Callable[[], None]] = []
_owner = [""]


def worker_cache(clear: Callable[[], None]) -> None:
    """Registers what empties a cache that a Python worker keeps between tasks."""
    _caches.append(clear)


def claim(owner: str) -> None:
    """Called where a task starts: a worker that went on from another operator first gives back what that one has kept."""
    if _owner[0] != owner:
        for clear in _caches:
            clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)  # freed pages would count as the worker's
        _owner[0] = owner


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def batches(schema: pa.Schema, arrays: Iterator[list]) -> Iterator[pa.RecordBatch]:
    for x in arrays:
        yield pa.record_batch([a if isinstance(a, pa.Array) else pa.array(a, t.type) for a, t in zip(x, schema)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long and each edge in both directions: rows (node, root), root the least node.

    Each round a node hears its neighbours' labels; the least goes to the node and to the node that its label names, and then
    labels are followed by one step. So whole trees hang themselves on others, and the rounds grow with the logarithm of a
    component's size, also along a chain. Each round is written to the shared folder. All aggregates are minima, which Spark
    combines before the shuffle, and all joins are on keys that are unique on one side, so a hub with very many edges is split
    by adaptive skew handling.
    """
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = (
            edges.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        near = labels.join(heard, "node")
        told = F.array(F.struct("node", "root", F.least("root", "heard").alias("next")), F.struct(F.col("root").alias("node"), F.lit(None).cast("long").alias("root"), F.col("heard").alias("next")))
        next_ = near.select(F.inline(told)).groupBy("node").agg(F.max("root").alias("root"), F.min("next").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = stored(next_.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            return labels.select("node", "root")
