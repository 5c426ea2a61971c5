"""Packing along a space-filling curve.

Each document's token ids are hashed to a vector of term weights, projected to three dimensions by a fixed Gaussian matrix and
placed on a Hilbert curve. Documents are range-sorted by their place on it and laid end to end; every 4,096 ids are a
sequence, so neighbours on the curve share sequences and no sequence but the last ones needs padding. What is left over at the
end is cut into powers of two, which need none either.

The tokenised documents are written to the shared folder once. Ranges come from quantiles of the sort key, whose low bits are
a hash of the doc_id, so a third of all rows with one text spreads over many ranges. A range's first id is known from the
ranges' token counts, so each range is packed on its own.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm.common import batches, claim, column, documents, small_batches, stored, texts, worker_cache

LENGTH, END, BITS, BUCKETS = 4096, 2, 10, 256
#: Token ids that a range is meant to hold.
IDS_A_RANGE = 4_000_000
#: Beyond so many ranges, ranges grow (their quantiles and counts are held by one process). A range is sorted on disk and laid
#: row by row, so a longer one takes time, not memory.
MOST_RANGES = 50_000
#: Blank-separated chunks whose ids a worker remembers, at most, and their bytes.
CACHE, CACHE_BYTES = 350_000, 16_000_000
#: Bytes of text that are cut into chunks at once.
AT_ONCE = 2_500_000
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]{0,4})")
#: Bytes that part chunks; other white space stays in a chunk, and the tokenizer sees to it.
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks:
    """Token ids of texts. The vocabulary drops white space, so a text's ids are its blank-separated chunks' ids in a row.

    Of a batch's chunks only the different ones (by a 64-bit hash) are looked up among those that the worker remembers; the ids
    of all are gathered in numpy. A chunk of Latin-1 letters and at most four marks after them is two words to the vocabulary,
    which lower-cases: chunks that differ in case or marks share what is encoded. All other chunks, those that hold an added token
    like <|endoftext|> among them, go through the tokenizer as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words that the vocabulary neither cuts nor changes: its merges alone, and with its spelling of bytes
        self.plain, self.spelled = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spelled.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.type = "<u2" if len(self.ends) <= 1 << 16 else "<u4"
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0  # bytes of the chunks
        self.stems: dict[str, bytes] = {"": b""}
        self.flat, self.first = np.zeros(0, self.type), np.zeros(1, np.int64)

    def encode(self, found: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> None:
        """Stems that the vocabulary takes as one word each: many are encoded as one text, which is cut after each word's end."""
        for tokenizer, part in ((self.plain, [w for w in words if w.isascii()]), (self.spelled, [w for w in words if not w.isascii()])):
            found = tokenizer.encode_batch_fast([" ".join(part[i : i + 100]) for i in range(0, len(part), 100)], add_special_tokens=False)
            ids = np.concatenate([np.zeros(0, self.type), *(np.array(e.ids, self.type) for e in found)])
            raw, last = ids.tobytes(), (ids.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            whole = len(last) == len(part)
            self.stems.update(zip(part, (raw[a:b] for a, b in zip([0, *last], last)) if whole else (x.tobytes() for x in self.encode(part))))

    def learn(self, new: list[bytes]) -> None:
        decoded = [w.decode("utf-8", "replace") for w in new]
        cut = [m and (m[1].lower(), m[2]) for m in map(PLAIN.fullmatch, decoded)]
        words = list({x for two in cut if two for x in two}.difference(self.stems))
        self.encode_words(words)
        whole = iter(self.encode([w for w, two in zip(decoded, cut) if two is None]))
        stems = self.stems
        parts = [stems[two[0]] + stems[two[1]] if two else next(whole).tobytes() for two in cut]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.flat.itemsize
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.held += sum(map(len, new))
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(parts), self.type)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def ids(self, bodies: list[bytes]) -> list[np.ndarray]:
        """Of each text (UTF-8) its ids: unsigned 16-bit numbers if all of the vocabulary's are below 65,536, else 32-bit."""
        out, at = [], 0
        while at < len(bodies):
            stop, size = at, 0
            while stop < len(bodies) and size < AT_ONCE:
                size += len(bodies[stop])
                stop += 1
            out += self._ids(bodies[at:stop])
            at = stop
        return out

    def _ids(self, bodies: list[bytes]) -> list[np.ndarray]:
        if len(self.number) > CACHE or self.held > CACHE_BYTES:
            self.forget()
        joined = b"\n".join([b"", *bodies, b"       \n"])
        blank = BLANK[np.frombuffer(joined, np.uint8)]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, stop = edges[::2], edges[1::2]
        which = pd.factorize(span_hashes(joined, start, stop))[0]  # numbers in order of appearance
        at = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        if not spans_equal(joined, start, stop, at[which]):
            which = pd.factorize(np.array([joined[a:b] for a, b in zip(start.tolist(), stop.tolist())], object))[0]
            at = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        chunks = [joined[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())]
        number = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        fresh = np.flatnonzero(number < 0)
        number[fresh] = len(self.number) + np.arange(len(fresh))
        self.learn([chunks[i] for i in fresh.tolist()])
        number = number[which]
        size = self.first[number + 1] - self.first[number]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.first[number] - before, size) + np.arange(size.sum())]
        texts_end = np.cumsum([len(x) + 1 for x in bodies])
        ends = np.concatenate([before, [len(ids)]])[np.searchsorted(start, texts_end, side="left")]
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def span_hashes(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop] for many spans, eight bytes at a time; data needs eight bytes after the last span."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    h, on, at = (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), np.arange(len(start)), start
    h ^= h >> np.uint64(32)
    while len(on):
        left = stop[on] - at
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        x = (h[on] ^ eight[at] & mask) * np.uint64(0x9E3779B97F4A7C15)
        h[on] = x ^ x >> np.uint64(29)
        more = left > 8
        on, at = on[more], at[more] + 8
    return h * np.uint64(0xBF58476D1CE4E5B9)


def spans_equal(data: bytes, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the one whose number other gives; data needs eight bytes after the last span."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    on = np.flatnonzero(other != np.arange(len(start)))
    a, b, left = start[on], start[other[on]], (stop - start)[on]
    if (left != (stop - start)[other[on]]).any():
        return False
    while len(a):
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        if ((eight[a] ^ eight[b]) & mask).any():
            return False
        more = left > 8
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
    return True


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


worker_cache(chunks.cache_clear)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, 3))


def vector(ids: np.ndarray) -> np.ndarray:
    """Three coordinates between 0 and 1 from the hashed, log-weighted ids."""
    buckets = (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)
    weights = np.log1p(np.bincount(buckets, minlength=BUCKETS))
    norm = np.sqrt((weights * weights).sum())
    x = (weights / norm if norm else weights) @ _projection()
    return 1 / (1 + np.exp(-1.702 * x))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), each coordinate below 2**bits; Skilling's transposition."""
    x, dims = points.astype(np.int64).T.copy(), points.shape[1]
    q = 1 << bits - 1
    while q > 1:
        for i in range(dims):
            hit, t = (x[i] & q) != 0, (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(hit, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros(points.shape[0], np.int64), 1 << bits - 1
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(points.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def tokenised(docs: DataFrame, path: str, end: int | None = END) -> DataFrame:
    """doc_id, ids (little-endian unsigned, as Chunks has them), n, and key: the place on the curve, then bits of the doc_id's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(found):
        claim("packing")
        schema = None
        vocabulary = chunks(path)
        tail = np.array([] if end is None else [end], vocabulary.type)
        for b in found:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("ids", pa.binary()), ("n", pa.int64()), ("key", pa.int64())])
            ids = [np.concatenate([x, tail]) for x in vocabulary.ids([x or b"" for x in column(b, "body")])]
            points = np.stack([vector(x) for x in ids]) if ids else np.zeros((0, 3))
            place = hilbert(np.minimum(points * (1 << BITS), (1 << BITS) - 1).astype(np.int64))
            low = [int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=4).digest(), "little") for k in column(b, "doc_id")]
            yield pa.record_batch([b.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(place << 32 | np.array(low, np.int64), pa.int64())], schema=schema)

    return texts(docs, "doc_id").mapInArrow(each, f"doc_id {kind}, ids binary, n long, key long")


def cuts(total: int, length: int) -> list[int]:
    """Starts of the sequences after the last full one, and the end: what is left, in powers of two."""
    at, rest = total - total % length, total % length
    out = [at]
    while rest:
        size = 1 << rest.bit_length() - 1
        out.append(out[-1] + size)
        rest -= size
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int | None = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (the piece's, unsigned 32-bit).

    Null and empty texts have no ids but the end id. Repeated rows are packed each for itself; among rows with equal doc_id
    and ids the order does not matter. doc_id may be null. An empty table gives no rows."""
    spark, path = docs.sparkSession, path or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = stored(tokenised(docs, path, end))
    total = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(total // IDS_A_RANGE + 1, MOST_RANGES))
    at = [i / parts for i in range(1, parts)]
    edges = np.unique(np.array((made.agg(F.percentile_approx("key", at, 20 * parts)).first()[0] if total and at else None) or [], np.int64))

    def ranged(found):
        for b in found:
            yield b.append_column("part", pa.array(np.searchsorted(edges, b.column("key").to_numpy(), side="left"), pa.int64()))

    counted = made.select("n", "key").mapInArrow(ranged, "n long, key long, part long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    base, first = {}, 0
    for r in sorted(counted, key=lambda r: r["part"]):
        base[r["part"]], first = first, first + r["n"]
    tail, kind_of_id = cuts(total, length), chunks(path).type

    def lay(found):
        claim("packing.lay")
        part, here, schema = None, 0, None
        for b in found:
            schema = schema or pa.schema([b.schema.field("doc_id"), *((k, pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])
            out = [[] for _ in schema]
            for doc, ids, p in zip(column(b, "doc_id"), column(b, "ids"), column(b, "part")):
                if p != part:
                    part, here = p, base[p]
                ids = np.frombuffer(ids, kind_of_id).astype("<u4").tobytes()
                n, start = len(ids) // 4, 0
                while start < n:
                    if here < tail[0]:
                        sequence, offset = divmod(here, length)
                        room = length - offset
                    else:
                        i = int(np.searchsorted(tail, here, side="right"))
                        sequence, offset, room = tail[0] // length + i - 1, here - tail[i - 1], tail[i] - here
                    size = min(room, n - start)
                    piece = ids[4 * start : 4 * (start + size)]
                    for x, v in zip(out, (doc, start, size, zlib.crc32(piece), n, sequence, offset, piece)):
                        x.append(v)
                    start, here = start + size, here + size
            yield from batches(schema, [out])

    dealt = made.mapInArrow(ranged, f"doc_id {kind}, ids binary, n long, key long, part long").select("part", "key", "doc_id", "ids")
    laid = dealt.repartition(parts, "part").sortWithinPartitions("part", "key", "doc_id", "ids")
    return laid.mapInArrow(lay, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece; see pack."""
    small_batches(spark)
    return pack(documents(spark, sf_dir)).drop("ids")
