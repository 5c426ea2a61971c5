"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix; DataFrame functions only.

1. Rows fall into source partitions by a hash of the row; each partition's rows are counted.
2. The matrix: going through the partitions, each draws how many of its rows go to each shard from the multivariate
   hypergeometric distribution over the places that are left. Rows sum to the partitions' counts, columns to the exact shard
   sizes. It has (partitions x shards) numbers, whatever the texts.
3. Each partition permutes its rows (order by a hash); the matrix' cumulated counts cut that order into shards.
4. Rows meet in their shard, and another hash permutes them there. A shard's order is cut into ranges of that hash, ranked
   separately and shifted by the counts before them, so no task holds a whole shard.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonloom.llm.common import documents, shared_folder, stored

#: Rows that a source partition, or a range of a shard, is meant to hold.
ROWS_A_PART = 200_000
#: numpy draws from fewer places than this.
NUMPY = 10**9
#: Rows of the matrix in one plan.
PIECE = 4096


def matrix(counts: list[int], shards: int, seed: int) -> list[np.ndarray]:
    """For each partition, the numbers of its rows that go to each shard; shard sizes differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = []
    for n in counts:
        out.append(_drawn(rng, left, n))
        left = left - out[-1]
    return out


def _drawn(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows get places in each shard, all free places being alike: shard by shard, against all that follow."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, good in enumerate(left.tolist()):
        rest -= good
        out[s] = hypergeometric(rng, good, rest, n)
        n -= int(out[s])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n places drawn from good + bad ones are good.

    From NUMPY on by inversion: the probabilities follow from those of their neighbours, from the mode outwards; 12 standard
    deviations and 60 places away they are below what a double can tell from 0."""
    if good + bad < NUMPY:
        return int(rng.hypergeometric(good, bad, n))
    low, high, total = max(0, n - bad), min(good, n), good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    width = int(12 * (n * (good / total) * (bad / total)) ** 0.5) + 60
    low, high = max(low, mode - width), min(high, mode + width)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)  # of p(k + 1) / p(k)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def _bounds(spark: SparkSession, order: list[int], rows: list[np.ndarray]) -> DataFrame:
    """The matrix as a table: _part and _bounds, its row cumulated. Long ones are written in pieces, so plans stay short; Spark
    broadcasts the table only if it is below its threshold."""

    def piece(at: int) -> DataFrame:
        plan = [{"_part": p, "_bounds": np.cumsum(row).tolist()} for p, row in zip(order[at : at + PIECE], rows[at : at + PIECE])]
        row = F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<_part: bigint, _bounds: array<bigint>>>")).alias("_row")
        return spark.range(1).select(row).select("_row.*")

    if len(order) <= PIECE:
        return piece(0)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for at in range(0, len(order), PIECE):
        piece(at).write.mode("append").parquet(path)
    return spark.read.schema("_part bigint, _bounds array<bigint>").parquet(path)


def shuffle(rows: DataFrame, keys: list[Column], shards: int = 16, seed: int = 42, parts: int | None = None) -> DataFrame:
    """rows with shard (0 to shards - 1; counts differ by one at most) and slot (gapless from 0 within the shard).

    keys identify a row; they are hashed, and rows that agree in all keys are interchangeable. Null keys count like other
    values. An empty table gives an empty one. rows are read three times: pass something cheap or stored."""
    spark = rows.sparkSession
    total = rows.count()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // ROWS_A_PART))
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *keys)
    rows = rows.withColumn("_part", F.pmod(hashed("part"), F.lit(parts)))
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts)
    bounds = _bounds(spark, order, matrix([counts[p] for p in order], shards, seed))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(hashed("local"), *keys)))
    placed = ranked.join(bounds, "_part").withColumn("shard", F.size(F.filter("_bounds", lambda b: b < F.col("_rank"))))
    spans = max(1, parts // shards)
    placed = placed.withColumn("_order", hashed("shard")).withColumn("_span", F.shiftrightunsigned("_order", 1) % F.lit(spans))
    placed = stored(placed.drop("_part", "_rank", "_bounds"))
    sizes = placed.groupBy("shard", "_span").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_span")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("shard", "_span").orderBy("_order", *keys))
    slots = placed.withColumn("_at", within).join(before, ["shard", "_span"])
    return slots.withColumn("slot", F.col("_at") + F.col("_before") - 1).drop("_order", "_span", "_at", "_before")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row. A null text has no bytes (size 1, text_crc32 0, that
    of the empty text); repeated rows are placed each for itself; null doc_ids count like others; an empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stored(documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    out = shuffle(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
