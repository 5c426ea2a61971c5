"""Benchmark decontamination with an FM-index for each shard of the documents.

The symbols are the benchmark's words. A shard's text is made of the documents' runs of such words; any other word ends a
run, and runs shorter than the shortest window can hold none and stay out, so the index is exact and small. All windows are
searched backwards at once through a wavelet matrix over the Burrows-Wheeler transform; their places come from sampled suffix
positions (every 16th, and each run's first, so that walks never leave a run) and are merged to spans of words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonloom.llm.common import WORD_TABLE, claim, column, documents, small_batches, word_list

WINDOW, SAMPLE = 13, 16
#: Symbols that a shard may have, but for the document that it ends with; bytes of text that a task holds at once.
SYMBOLS, BYTES = 1_000_000, 24_000_000
#: Bytes of benchmark text that are searched for at once; a larger benchmark is worked off in blocks, for each shard one after
#: the other, and only one block's windows are in memory.
BENCHMARK_BYTES = 4_000_000
RUN = re.compile(rb"[^ ]+")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; zeros (the ends of runs) count as different from each other, in order of their places."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + zero.sum())
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (max(int(rank.max()), n) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if not n or new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.pad(packed, (0, 16 - len(packed) % 8)).tobytes(), "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: symbols 1 .. symbols, with a 0 before, between and after runs."""
        order = suffix_array(text)
        before = text[order - 1]
        self.n = len(text)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.levels = []
        for level in range(int(symbols).bit_length() - 1, -1, -1):
            bit = (before >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int((~bit).sum())))
            before = np.concatenate([before[~bit], before[bit]])
        sampled = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i of the transform."""
        first, last = np.zeros_like(i), i
        for level, bits, zeros in self.levels:
            one = symbol >> level & 1 == 1
            r, s = bits.rank(first), bits.rank(last)
            first, last = np.where(one, zeros + r, first - r), np.where(one, zeros + s, last - s)
        return last - first

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one, r = bits.get(i), bits.rank(i)
            out |= one.astype(np.int64) << level
            i = np.where(one, zeros + r, i - r)
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows of all phrases [phrase, symbol from its end], all at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1]):
            on = np.flatnonzero((lengths > j) & (high > low))
            c = phrases[on, j].astype(np.int64)
            low[on], high[on] = self.less[c] + self.rank(c, low[on]), self.less[c] + self.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, steps, todo = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(todo):
            done = self.sampled.get(row[todo])
            at = todo[done]
            out[at] = self.places[self.sampled.rank(row[at])] + steps
            todo = todo[~done]
            c = self.symbol(row[todo])
            row[todo] = self.less[c] + self.rank(c, row[todo])
            steps += 1
        return out


class Windows:
    """The benchmark's distinct windows over its own vocabulary, shorter ones filled up with zeros, last words first; and the
    items that have each: owners[starts[i] : starts[i + 1]] are places in names."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int):
        self.symbol: dict[bytes, int] = {}
        self.names = sorted({k for k, _ in items if k is not None})
        place = {k: i for i, k in enumerate(self.names)}
        rows, lengths, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for item, body in items:
            words = word_list(body or b"")
            ids = np.fromiter((self.symbol.setdefault(w, len(self.symbol) + 1) for w in words), np.int32, len(words))
            if not len(ids):
                continue
            size = min(width, len(ids))
            new = np.zeros((len(ids) - size + 1, width), np.int32)
            new[:, :size] = np.lib.stride_tricks.sliding_window_view(ids, size)[:, ::-1]
            rows.append(new)
            lengths.append(np.full(len(new), size))
            owners.append(np.full(len(new), place.get(item, -1), np.int32))
        rows, lengths, owners = np.concatenate(rows), np.concatenate(lengths), np.concatenate(owners)
        raw = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * width))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        self.phrases, self.lengths = rows[first], lengths[first]
        self.shortest = int(self.lengths.min()) if len(first) else 0
        pairs = np.unique(which[owners >= 0].astype(np.int64) << 32 | owners[owners >= 0])
        self.owners = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.starts = np.searchsorted(pairs >> 32, np.arange(len(first) + 1))

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.starts[window] : self.starts[window + 1]].tolist()]


def shard_hits(windows: Windows, ids: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Of each document (symbols of its words, 0: not in the benchmark) the merged spans [start, end) and the items found."""
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in ids]
    text, doc, word, start, size = [np.zeros(1, np.int64)], [], [], [], 1
    for d, x in enumerate(ids):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (x > 0).view(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1).ravel() >= windows.shortest]:
            text += [x[a:b], text[0]]
            doc.append(d)
            word.append(a)
            start.append(size)
            size += b - a + 1
    if not doc:
        return out
    index = FMIndex(np.concatenate(text), len(windows.symbol))
    low, high = index.search(windows.phrases, windows.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    row = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]
    place = index.locate(row)
    run = np.searchsorted(start, place, side="right") - 1
    doc, first = np.array(doc)[run], np.array(word)[run] + place - np.array(start)[run]
    last = first + windows.lengths[which]
    order = np.lexsort((first, doc))
    for d, a, b in zip(doc[order].tolist(), first[order].tolist(), last[order].tolist()):
        spans = out[d][0]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    pairs = np.unique(doc * len(low) + which)
    for d, w in zip((pairs // len(low)).tolist(), (pairs % len(low)).tolist()):
        out[d][1].update(windows.items(w))
    return out


def _blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The benchmark in blocks of about so many bytes."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // most) or 1
    if n == 1:
        return [benchmark]
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.where(block == k) for k in range(n)]


def removal_spans(docs: DataFrame, benchmark: DataFrame, *keep: str, width: int = WINDOW, most: int = BENCHMARK_BYTES, cut: bool = False) -> DataFrame:
    """The columns in keep, body (the text's bytes; cut: without the spans), n_words, spans (array of structs start, end: words from start to end - 1 are hit; merged, in
    order) and items (item_ids with a window in the text, as strings, sorted) of each row of docs.

    A null text has no words. Items with null text or without words have no windows; windows of an item with null item_id
    hit but are not listed. Repeated rows and ties are treated alike, each for itself. Empty tables give no spans, or no rows.
    """
    shared = []
    for block in _blocks(benchmark, most):
        rows = block.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).collect()
        shared.append(docs.sparkSession.sparkContext.broadcast(Windows([(r[0], None if r[1] is None else bytes(r[1])) for r in rows], width)))
        shared[-1].__dict__.pop("_value", None)  # the driver holds one block's windows at a time, too
    names = [*keep, "body", "n_words", "spans", "items"]
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]

    def each(found):
        claim("fmindex")
        held, size = [], 0
        for b in found:
            held.append(b)
            size += b.column("body").nbytes
            if size > BYTES:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    def flush(held):
        bodies = [x or b"" for b in held for x in column(b, "body")]
        n, spans, items = [0] * len(bodies), [[] for _ in bodies], [set() for _ in bodies]
        for block in shared:
            windows = block.value
            symbol, at, first = windows.symbol.get, 0, 0
            while at < len(bodies):  # shards of so many symbols
                ids, symbols = [], 0
                while at < len(bodies) and symbols <= SYMBOLS:
                    words = word_list(bodies[at])
                    ids.append(np.fromiter((symbol(w, 0) for w in words), np.int32, len(words)))
                    symbols += int(np.count_nonzero(ids[-1]))
                    at += 1
                for i, (x, (s, found)) in enumerate(zip(ids, shard_hits(windows, ids)), first):
                    n[i] = len(x)
                    spans[i] += s
                    items[i] |= found
                first = at
            if len(shared) > 1:
                del windows, symbol
                block.__dict__.pop("_value", None)
        spans, first = [merged(s) for s in spans], 0
        for b in held:
            part = slice(first, first + b.num_rows)
            first += b.num_rows
            texts = b.column("body")
            if cut and any(spans[part]):
                texts = pa.array([without(x, s) if s else x for x, s in zip(column(b, "body"), spans[part])], pa.binary())
            found = ([{"start": p, "end": q} for p, q in s] for s in spans[part])
            yield pa.record_batch([*[b.column(k) for k in keep], texts, *[pa.array(x, t) for x, t in zip((n[part], list(found), [sorted(i) for i in items[part]]), kinds)]], names)

    rows = docs.select(*keep, F.col("text").cast("binary").alias("body"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), *T._parse_datatype_string("spans array<struct<start:bigint,end:bigint>>, items array<string>").fields])
    return rows.mapInArrow(each, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, and without what stands between them."""
    places = [m.span() for m in RUN.finditer(body.translate(WORD_TABLE))]
    for a, b in reversed(spans):
        body = body[: places[a][0]] + body[places[b - 1][1] :]
    return body


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row; see removal_spans for nulls, empty texts,
    repeated rows and empty tables."""
    small_batches(spark)
    found = removal_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id")
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))).alias("contaminated"),
    )
