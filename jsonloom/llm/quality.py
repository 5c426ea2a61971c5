"""Quality classifier: kernel ridge regression by random Fourier features, with isotonic calibration.

A text's statistics are standardised and mapped to FEATURES cosines, whose inner products approximate a Gaussian kernel. Each
partition of the labelled rows sums its normal equations; the sums are added and solved on the driver. Ridge scores of rows
that the solution has not seen are calibrated by isotonic regression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm.common import column, documents, small_batches, stored
from jsonloom.llm.langid import held_out

FEATURES, RIDGE, PARTS = 384, 1e-3, 16
#: Labelled rows that the classifier is fitted on, at most about (chosen by a hash of the doc_id).
TRAINING_ROWS = 60_000
#: Characters that are counted each by itself.
MARKS = b"!|#$%&*.,?@/<>{}="
UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
BLANKS = b" \t\n\r\x0b\x0c"
HIGH = bytes(range(128, 256))


def statistics(data: bytes) -> list[float]:
    """Numbers that describe a text; all are finite, for empty texts too."""
    n, words, lines = len(data), data.split(), data.split(b"\n")
    share = lambda chars: (n - len(data.translate(None, chars))) / n if n else 0.0
    distinct, w = set(words), len(words)
    ends = {x[-1:] for x in distinct}
    return [
        np.log1p(n),
        np.log1p(w),
        np.log1p(len(lines)),
        sum(map(len, words)) / w if w else 0.0,
        len(distinct) / w if w else 1.0,
        np.log1p(w / len(distinct)) if w else 0.0,
        len(set(lines)) / len(lines),
        len(ends) / (len(distinct) or 1),
        *(share(x) for x in (UPPER, LOWER, DIGITS, BLANKS, HIGH)),
        *(min(1.0, 5 * data.count(x) / (w or 1)) ** 0.5 for x in (MARKS[i : i + 1] for i in range(len(MARKS)))),
    ]


SIZE = len(statistics(b""))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, and x (the statistics as doubles); a null text counts as empty."""
    kept = ["doc_id", *keep]

    def each(found):
        for b in found:
            x = [np.array(statistics(v or b"")).tobytes() for v in column(b, "body")]
            yield pa.record_batch([*[b.column(k) for k in kept], pa.array(x, pa.binary())], [*kept, "x"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept) + ", x binary"
    return docs.select(*kept, F.col("text").cast("binary").alias("body")).mapInArrow(each, schema)


class Model:
    def __init__(self, mean, scale, weights, knots, levels):
        self.mean, self.scale, self.weights, self.knots, self.levels = mean, scale, weights, knots, levels
        rng = np.random.default_rng(11)
        self.w, self.b = rng.standard_normal((SIZE, FEATURES)) / np.sqrt(SIZE) * 2, rng.uniform(0, 2 * np.pi, FEATURES)

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(x), 1))], axis=1)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), self.knots, self.levels), 0, 1)


def matrix(batch, name: str = "x") -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, name)), np.float64).reshape(-1, SIZE)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the least-squares rising step function, by pooling adjacent violators; equal scores are one point.

    All levels are drawn towards one half by the same share, half a row of all, so that they keep their order and no score is
    quite certain."""
    at, inverse = np.unique(score, return_inverse=True)
    mean, weight = np.bincount(inverse, y) / np.bincount(inverse), np.bincount(inverse).astype(float)
    pools: list[list[float]] = []
    for i in range(len(at)):
        pools.append([mean[i], weight[i], i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, _, last = pools.pop()
            p = pools[-1]
            p[:] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2], last]
    knots = np.array([at[int((p[2] + p[3]) // 2)] for p in pools])
    return knots, (np.array([p[0] for p in pools]) * len(y) + 0.5) / (len(y) + 1)


def fit(labelled: DataFrame, most_rows: int = TRAINING_ROWS) -> Model:
    """From rows with doc_id, x and quality (0 or 1; null labels don't count), about most_rows of them.

    Four fifths of them give the normal equations, summed in each of PARTS partitions; one fifth calibrates. Without rows,
    all scores are one half."""
    labelled = labelled.where("quality is not null")
    total = labelled.count()
    if total > most_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < (most_rows * (1 << 30)) // total)
    rows = stored(labelled.select("x", F.col("quality").cast("double").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0).alias("calibrates")).repartition(PARTS))

    def moments(found):
        s = np.zeros((2, SIZE))
        n = 0
        for b in found:
            x = matrix(b)
            s += [x.sum(0), (x * x).sum(0)]
            n += len(x)
        yield pa.record_batch([pa.array([n]), pa.array([s.tobytes()])], ["n", "s"])

    parts = rows.mapInArrow(moments, "n long, s binary").collect()
    n, s = sum(r["n"] for r in parts), sum((np.frombuffer(bytes(r["s"])).reshape(2, SIZE) for r in parts), np.zeros((2, SIZE)))
    mean = s[0] / max(n, 1)
    scale = np.sqrt(np.maximum(s[1] / max(n, 1) - mean**2, 1e-12))
    scale[scale < 1e-5] = 1
    model, width = Model(mean, scale, None, None, None), FEATURES + SIZE + 1
    if not n:
        model.weights, model.knots, model.levels = np.zeros(width), np.zeros(1), np.full(1, 0.5)
        return model

    def equations(found):
        a, c = np.zeros((width, width)), np.zeros(width)
        for b in found:
            z = model.map(matrix(b))
            a += z.T @ z
            c += z.T @ b.column("y").to_numpy()
        yield pa.record_batch([pa.array([a.tobytes()]), pa.array([c.tobytes()])], ["a", "c"])

    parts = rows.where("not calibrates").mapInArrow(equations, "a binary, c binary").collect()
    a = sum((np.frombuffer(bytes(r["a"])).reshape(width, width) for r in parts), np.zeros((width, width)))
    c = sum((np.frombuffer(bytes(r["c"])) for r in parts), np.zeros(width))
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, n / 100) * np.eye(width), c)

    def ridge(found):
        for b in found:
            yield pa.record_batch([pa.array(model.ridge(matrix(b))), b.column("y")], ["score", "y"])

    unseen = rows.where("calibrates").mapInArrow(ridge, "score double, y double").toPandas()
    if not len(unseen):
        unseen = rows.mapInArrow(ridge, "score double, y double").toPandas()
    model.knots, model.levels = isotonic(unseen["score"].to_numpy(), unseen["y"].to_numpy())
    return model


def scored(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, and score (0 to 1) from rows with x."""
    kept, shared = ["doc_id", *keep], rows.sparkSession.sparkContext.broadcast(model)

    def each(found):
        for b in found:
            yield pa.record_batch([*[b.column(k) for k in kept], pa.array(shared.value.score(matrix(b)))], [*kept, "score"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in kept) + ", score double"
    return rows.mapInArrow(each, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row. Labels of held-out rows are not read; a null doc_id has no label and is
    not held out. Null and empty texts have statistics, hence scores, of their own; repeated rows are scored each for itself;
    several labels of a document count each. Without labels all scores are one half."""
    small_batches(spark)
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    rows = stored(features(docs, "held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "quality")
    model = fit(rows.join(labels, "doc_id"))
    return scored(rows, model, "held_out").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
