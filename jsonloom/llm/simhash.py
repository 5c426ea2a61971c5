"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code of all 64 bits: the product of four perfect codes, two binary Golay codes [23, 12],
a Hamming code [15, 11] and a repetition code [3, 1]. In a perfect code each word has exactly one home within the covering
radius, so each fingerprint has exactly one home anchor, of 2**36. A fingerprint within `bits` of another one differs from it
in t1 .. t4 bits of the four blocks, t1 + .. + t4 <= bits, hence lies within each block's radius + t of the other's home there:
fingerprints are replicated to the anchors within those radii (about 165 for two bits, whatever the data) and compared with
the fingerprints at home there, over all 64 bits. As the anchors cover all bits, an anchor's fingerprints agree but for a few
bits: what is compared grows with the fingerprints, not with their square.

Only distinct fingerprints are replicated, so copies cost nothing; a fingerprint has at most 64 + 2016 others within two
bits, so links are linear in the number of distinct fingerprints however large a group of near copies is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm import minhash
from jsonloom.llm.common import batches, claim, column, components, documents, small_batches, stored, texts

#: First bit, length, generator polynomial and covering radius of the perfect cyclic codes; the polynomials are
#: x^11+x^10+x^6+x^5+x^4+x^2+1 (Golay), x^4+x+1 (Hamming) and x^2+x+1 (repetition).
BLOCKS = ((0, 23, 0b110001110101, 3), (23, 23, 0b110001110101, 3), (46, 15, 0b10011, 1), (61, 3, 0b111, 1))
SEED = 42


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Runs of n words, repeats included; fewer words are one run, none give none."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(n)))]


def fingerprint(data: bytes | None, n: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    found = shingles((data or b"").lower().split(), n)  # bytes: A-Z only, and blanks are \x20 \x09-\x0D
    counts, step = np.zeros(64, np.int64), 1 << 14
    for i in range(0, len(found), step):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found[i : i + step]), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row. A null text has no words: 0."""
    schema = pa.schema([("doc_id", docs.schema["doc_id"].dataType.typeName() == "string" and pa.string() or pa.int64()), ("fp", pa.int64())])

    def each(found):
        claim("simhash")
        for b in found:
            fps = np.fromiter((fingerprint(x, n) for x in column(b, "body")), np.uint64, b.num_rows)
            yield [b.column("doc_id").cast(schema[0].type), pa.array(fps.view(np.int64))]

    return texts(docs, "doc_id").mapInArrow(lambda x: batches(schema, each(x)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndrome(x: np.ndarray, length: int, generator: int) -> np.ndarray:
    """Remainder by the generator: 0 for code words, and one value for each way to be off."""
    x, degree = x.astype(np.int64), generator.bit_length() - 1
    for k in range(length - 1, degree - 1, -1):
        x ^= np.where(x >> k & 1, generator << (k - degree), 0)
    return x


@lru_cache(maxsize=16)
def _offsets(length: int, generator: int, radius: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The error patterns of weight up to radius + bits by syndrome, lightest first; how many bits each needs beyond the radius;
    [t, syndrome]: where the syndrome's patterns that need up to t - 1 bits end (t = 0: where they begin)."""
    patterns, layer = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
    for _ in range(min(length, radius + bits)):
        layer = np.unique(np.concatenate([layer[layer >> k & 1 == 0] | 1 << k for k in range(length)]))
        patterns.append(layer)
    p = np.concatenate(patterns)
    need, syn = np.maximum(np.bitwise_count(p).astype(np.int64) - radius, 0), _syndrome(p, length, generator)
    order = np.lexsort((p, np.bitwise_count(p), syn))
    p, need, syn = p[order], need[order], syn[order]
    rank, all_ = syn * (bits + 1) + need, np.arange(1 << generator.bit_length() - 1) * (bits + 1)
    return p, need, np.stack([np.searchsorted(rank, all_ + t) for t in range(bits + 2)])


def _block(fp: np.ndarray, at: int, length: int) -> np.ndarray:
    return (fp >> np.uint64(at)).astype(np.int64) & ((1 << length) - 1)


def home(fp: np.ndarray) -> np.ndarray:
    """The one anchor within the covering radius in all blocks."""
    fp, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for at, length, generator, radius in BLOCKS:
        block = _block(fp, at, length)
        p, _, ends = _offsets(length, generator, radius, 0)
        out |= (block ^ p[ends[0][_syndrome(block, length, generator)]]).astype(np.uint64) << np.uint64(at)
    return out.view(np.int64)


def anchors(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and anchors: all anchors at which a fingerprint within `bits` may be at home. Block by block, with the bits that the
    blocks before have left over."""
    fp = fp.view(np.uint64)
    row, word, left = np.arange(len(fp)), np.zeros(len(fp), np.uint64), np.full(len(fp), bits)
    for at, length, generator, radius in BLOCKS[::-1]:
        p, need, ends = _offsets(length, generator, radius, bits)
        block = _block(fp, at, length)
        syn = _syndrome(block, length, generator)[row]
        n = ends[left + 1, syn] - ends[0, syn]
        of = np.repeat(np.arange(len(row)), n)
        which = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + ends[0, syn][of]
        row, left = row[of], left[of] - need[which]
        word = word[of] | (block[row] ^ p[which]).astype(np.uint64) << np.uint64(at)
    return row, word.view(np.int64)


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that differ in 1 to `bits` bits, each in both directions.

    Spark takes replicate's rows for as many as it gets, about a hundredth; the hint keeps them from being broadcast for that."""

    def replicate(found):
        claim("simhash")
        for b in found:
            fp = b.column("fp").to_numpy()
            for i in range(0, len(fp), 500):
                part = fp[i : i + 500]
                row, anchor = anchors(part, bits)
                yield pa.record_batch([pa.array(anchor), pa.array(part[row])], ["anchor", "b"])

    def at_home(found):
        for b in found:
            fp = b.column("fp").to_numpy()
            yield pa.record_batch([pa.array(home(fp)), pa.array(fp)], ["anchor", "a"])

    guests = distinct.mapInArrow(replicate, "anchor long, b long")
    homes = distinct.mapInArrow(at_home, "anchor long, a long")
    off = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return homes.join(guests.hint("merge"), "anchor").where((F.col("a") != F.col("b")) & (off <= bits)).select("a", "b").distinct()


def classes(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """The rows of distinct fingerprints (column fp, a stored table) and root, the same for all fingerprints that links reach."""
    roots = components(stored(links(distinct.select("fp"), bits)))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def verified(docs: DataFrame, n: int, bits: int, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, doc (a hash of doc_id and text) and root (of the shingle sets that links of this Jaccard similarity reach) of each
    row; doc and fp, each doc once.

    The sets of each class of fingerprints are compared with each other, in blocks where they are many. A similarity of 0.8 is
    often more than a few bits off, so sets that meet in a MinHash band are compared besides."""
    fps = fingerprints(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), n)
    fps = stored(fps.select(F.col("doc_id").alias("doc"), "fp").dropDuplicates(["doc"]))
    of_fp = stored(classes(stored(fps.select("fp").distinct()), bits))

    def together(rows: DataFrame) -> DataFrame:
        return rows.join(fps, "doc").join(of_fp, "fp").select(F.xxhash64(F.lit("simhash"), "root").alias("band"), "node").distinct()

    rows, roots = minhash.set_roots(docs, least, n, together)
    return rows.join(roots, "node", "left").select("doc_id", "doc", F.coalesce("root", "node").alias("root")), fps


def clusters(docs: DataFrame, n: int = 3, bits: int = 2, verify: float | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach, itself included) of each row.

    Documents without words (null or blank texts too) have fingerprint 0 and link like any other. Rows with equal texts have
    equal fingerprints. A null doc_id stays null and is no component's smallest; a component of null ids has id null. An empty
    table gives an empty one. verify: link by this Jaccard similarity of the shingle sets, see verified; equal fingerprints alone
    then link nothing."""
    if verify is not None:
        rows, of_doc = verified(docs, n, bits, verify)
        classed = rows.join(of_doc, "doc")
        ids = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return classed.join(ids, "root").select("doc_id", "fp", "component_id")
    fps = stored(fingerprints(docs, n))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = classes(distinct, bits)
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(ids, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, least: float = 0.8, n: int = 5, bits: int = 2) -> DataFrame:
    """doc (a hash of doc_id and text) of the first row of each class of clusters(verify=least): by doc_id, null ones last, then by that hash."""
    rows, _ = verified(docs, n, bits, least)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc")
    return rows.select("root", place.alias("place")).groupBy("root").agg(F.min("place").alias("place")).select("place.doc")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row; see clusters for nulls, empty texts and repeated rows."""
    small_batches(spark)
    out = clusters(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
