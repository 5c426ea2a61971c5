"""Document fingerprints: MinHash over five-word shingles.

A shingle's hash combines its words' 64-bit hashes; each of PERMUTATIONS universal hashes (multiply and add modulo 2**64) runs
over all shingles of a text in numpy, and the least value of each, cut to 16 bits, is the signature. Near-duplicates meet in
bands of the signature, joined in Spark (large bands are compared in blocks), and their shingle sets' Jaccard similarity is
verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm.common import batches, claim, column, components, discard, documents, small_batches, stored

PERMUTATIONS, SHINGLE = 128, 5
#: Words whose hashes a worker remembers, and how many bytes they may have.
CACHE, CACHED = 400_000, 64
#: Bands of the signature: with four values each, a pair of similarity 0.8 misses all of them once in 10**7.
BANDS = 32
#: Bands with more nodes are compared in blocks of about so many, over so many shingles at once.
HOT, BLOCK, COLUMNS = 32, 1024, 2048
#: Pairs whose signatures agree in less than the similarity minus this are not fetched; a pair of 0.8 falls below once in 10**10.
SLACK = 0.25
#: Nodes are broadcast up to so many, shuffled beyond.
BROADCAST_IDS = 1_000_000
#: Rows that a range of doc_ids is meant to hold. Beyond MOST_RANGES ranges, whose edges are literals of the plan, ranges get longer:
#: they are sorted on disk and gone through row by row, so that takes time, not memory.
ROWS_A_RANGE, MOST_RANGES = 20_000, 10_000

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED:
            if len(self) > CACHE:
                self.clear()
            self[word] = h
        return h


def shingle_hashes(data: bytes, words: Words, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of n words (A-Z lower-cased, split at blanks); fewer words are one run, none give none."""
    listed = data.lower().split()
    h = np.fromiter(map(words.__getitem__, listed), np.uint64, len(listed))
    n = min(n, len(h)) or 1
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(out) + i]) * _C
        out ^= out >> np.uint64(29)
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Without shingles, a value of its own (all ones)."""
    if not len(hashes):
        return np.full(PERMUTATIONS, 0xFFFF, np.uint16)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        x = _A * hashes[i : i + 512]
        x += _B
        np.minimum(least, x.min(1), out=least)
    return (least * _C >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def text_of(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def edited(text: str, follower: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the follower."""
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


def _below(edges: list[int], value: Column) -> Column:
    """How many edges lie above the value, looked up in two steps."""
    step = max(1, int(len(edges) ** 0.5))
    blocks = [edges[i : i + step] for i in range(0, len(edges), step)]
    above = lambda xs: F.size(F.filter(xs, lambda e: e > value))
    if not edges:
        return F.lit(0)
    coarse = above(F.array(*[F.lit(b[-1]) for b in blocks]))
    fine = F.element_at(F.array(*[F.array(*[F.lit(e) for e in b]) for b in blocks], F.array().cast("array<bigint>")), coarse + 1)
    return coarse * step + above(fine)


def with_followers(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows of docs in ranges of falling doc_id: part, guest (1: the first of the following range, not a row of this one),
    doc_id, body. Null doc_ids come last; rows with equal doc_id are in order of their text's bytes. The follower of the last
    row is the first. Each text is shuffled once; besides, one text for each range."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    total = docs.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(total // ROWS_A_RANGE, MOST_RANGES))
    at = [i / parts for i in range(parts - 1, 0, -1)]
    edges = docs.agg(F.percentile_approx("doc_id", at, 20 * parts)).first()[0] if at and total else None
    edges = sorted(set(edges or []), reverse=True)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(edges) + 1)).otherwise(_below(edges, F.col("doc_id")))
    firsts = sorted((r["part"], r["first"]) for r in docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    host = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}  # the first range's first row follows the last range
    ids = [x for _, x in firsts if x is not None]
    first = docs.where(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if len(ids) < len(firsts) else F.lit(False)))
    first = first.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")).groupBy("doc_id").agg(F.min("body").alias("body"))
    of = F.create_map(*[F.lit(x) for pair in host.items() for x in pair]) if host else None
    rows = rows.select(part.alias("part"), F.lit(0).alias("guest"), "doc_id", "body")
    if host:
        rows = rows.union(first.select(of[part].alias("part"), F.lit(1).alias("guest"), "doc_id", "body"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "body"), parts


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The edited text takes its end from the document that follows in falling doc_id. A null text is an empty one; a text without
    words has a fingerprint of its own, like that of other such texts only. An only document follows itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, _ = with_followers(docs)

    def each(found):
        words, last, schema = Words(), None, None
        for b in found:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("n_chars", pa.int64()), *((k, pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            out = [[] for _ in schema]
            for part, guest, doc, body in zip(column(b, "part"), column(b, "guest"), column(b, "doc_id"), column(b, "body")):
                now = (part, doc, body.decode("utf-8", "replace"), signature(shingle_hashes(body, words)))
                if last and last[0] == part:
                    _, k, text, sig = last
                    new = edited(text, now[2]).encode()
                    new_sig = signature(shingle_hashes(new, words))
                    for x, v in zip(out, (k, len(text), hashlib.sha256(new).hexdigest(), text_of(sig), text_of(new_sig), likeness(sig, new_sig), likeness(sig, now[3]))):
                        x.append(v)
                last = None if guest else now
            yield from batches(schema, [out])

    return rows.mapInArrow(each, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingle hashes (sorted, each once)."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def forest(nodes: np.ndarray, sets: list[np.ndarray], least: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of the pairs (one of left, one of right: places in nodes) of this Jaccard similarity."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    found, column_of, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    place = np.cumsum(n > 1) - 1
    kept = n[column_of] > 1
    row, place = row[kept], place[column_of[kept]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, (i, i + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[a:b], place[a:b] - i] = 1
        both += has[left] @ has[right].T
    near = both >= least * (sizes[left][:, None] + sizes[right][None, :] - both.astype(np.float64))
    of_left, of_right = np.full(len(nodes), -1), np.full(len(nodes), -1)
    of_left[left], of_right[right] = np.arange(len(left)), np.arange(len(right))
    seen, out = np.zeros(len(nodes), bool), []
    for first in range(len(nodes)):
        if seen[first]:
            continue
        seen[first], todo = True, [first]
        while todo:
            x = todo.pop()
            hit = np.zeros(len(nodes), bool)
            if of_left[x] >= 0:
                hit[right[near[of_left[x]]]] = True
            if of_right[x] >= 0:
                hit[left[near[:, of_right[x]]]] = True
            new = np.flatnonzero(hit & ~seen)
            seen[new] = True
            todo += new.tolist()
            out.append((np.full(len(new), nodes[x]), nodes[new]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def set_roots(docs: DataFrame, least: float = 0.8, n: int = SHINGLE, more: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, doc (a hash of doc_id and text) and node (its shingle set) of each row; node and root of the nodes that links of this Jaccard similarity reach.

    more: another operator's groups (band, node), each once, of the rows (doc, node); they are compared like the signature's bands.

    Pairs of a band of at most HOT nodes are filtered by their signatures, then verified by their shingles. In larger ones the
    sets are compared in blocks of about BLOCK, each pair of blocks in a task of its own that counts what sets have in common
    by products of matrices and gives the edges of a spanning forest: the rows grow with the nodes, not with their pairs."""
    kind = docs.schema["doc_id"].dataType
    doc_type = pa.string() if kind.typeName() == "string" else pa.int64()
    schema = pa.schema([("doc_id", doc_type), ("doc", pa.int64()), ("node", pa.int64()), ("signature", pa.binary())])

    def each(found):
        claim("minhash")
        words = Words()
        for b in found:
            sets = [np.unique(shingle_hashes(x or b"", words, n)) for x in column(b, "body")]
            yield from batches(schema, [[b.column("doc_id").cast(doc_type), b.column("doc"), [set_id(s) for s in sets], [signature(s).tobytes() for s in sets]]])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.col("text").cast("binary").alias("body"))
    rows = stored(rows.mapInArrow(each, f"doc_id {kind.simpleString()}, doc long, node long, signature binary"))
    nodes = rows.select("node", "signature").dropDuplicates(["node"])

    def bands(found):
        width = 2 * PERMUTATIONS // BANDS
        for b in found:
            node, sigs = b.column("node").to_numpy(), column(b, "signature")
            keys = np.array([[xxhash.xxh64_intdigest(s[i * width : (i + 1) * width], i) for i in range(BANDS)] for s in sigs], np.uint64).reshape(-1)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.repeat(node, BANDS))], ["band", "node"])

    banded = nodes.mapInArrow(bands, "band long, node long")
    if more:
        banded = banded.union(more(rows.select("doc", "node")))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(banded.join(sizes, "band"))
    ids = stored(met.select("node").distinct())
    signatures = stored(nodes.join(ids, "node"))
    sets = sets_of(docs, ids, n)

    def alike(found):
        for b in found:
            x, y = (np.frombuffer(b"".join(column(b, c)), np.uint16).reshape(-1, PERMUTATIONS) for c in "xy")
            keep = pa.array((x == y).sum(1) >= (least - SLACK) * PERMUTATIONS, pa.bool_())
            yield pa.record_batch([b.column(c).filter(keep) for c in "ab"], ["a", "b"])

    def verify(found):
        for b in found:
            keep = []
            for x, y in zip(column(b, "x"), column(b, "y")):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(c).filter(keep) for c in "ab"], ["a", "b"])

    cold = met.where(F.col("n") <= HOT)
    pairs = cold.select("band", F.col("node").alias("a")).join(cold.select("band", F.col("node").alias("b")), "band").where("a < b")
    met_pairs = stored(pairs.select("a", "b").distinct())
    sides = lambda pairs, of: pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select("a", "b", "x", "y")
    pairs = stored(sides(met_pairs, signatures).mapInArrow(alike, "a long, b long"))
    links = sides(pairs, sets).mapInArrow(verify, "a long, b long")

    blocks = F.ceil(F.col("n") / BLOCK)
    hot = met.where(F.col("n") > HOT).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    hot = hot.select("band", "node", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    hot = hot.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node")

    def compared(group):
        node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        a, b = forest(node, found, least, np.flatnonzero(block == p), np.flatnonzero(block == q))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    spanned = hot.join(sets, "node").groupBy("band", "p", "q").applyInArrow(compared, "a long, b long")
    links = stored(links.union(spanned).distinct())
    discard(met, ids, signatures, sets, met_pairs, pairs)
    return rows.select("doc_id", "doc", "node"), components(links.union(links.select("b", "a")))


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """node and shingles (sorted 64-bit hashes) of these nodes (stored), from another pass over the texts."""
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in ids.toLocalIterator()], np.int64)) if few else None)

    def each(found):
        claim("minhash")
        words = Words()
        for b in found:
            sets = [np.unique(shingle_hashes(x or b"", words, n)) for x in column(b, "body")]
            new = {set_id(s): s for s in sets}
            if wanted.value is not None:
                new = {k: new[k] for k in np.intersect1d(wanted.value, np.fromiter(new, np.int64, len(new))).tolist()}
            yield pa.record_batch([pa.array(list(new), pa.int64()), pa.array([s.tobytes() for s in new.values()], pa.binary())], ["node", "shingles"])

    found = docs.select(F.col("text").cast("binary").alias("body")).mapInArrow(each, "node long, shingles binary")
    found = found if few else found.join(ids, "node", "left_semi")
    return stored(found.dropDuplicates(["node"]))


def near_duplicates(docs: DataFrame, least: float = 0.8, n: int = SHINGLE) -> DataFrame:
    """doc_id and class_id (the smallest doc_id that links of Jaccard similarity `least` or more reach) of each row.

    Rows with equal shingle sets (equal texts among them) are one node, as are texts without words. A null doc_id is no class's
    smallest."""
    rows, roots = set_roots(docs, least, n)
    classed = rows.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    ids = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return classed.join(ids, "root").select("doc_id", "class_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row; see fingerprints."""
    small_batches(spark)
    return fingerprints(documents(spark, sf_dir))
