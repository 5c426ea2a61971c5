"""Line dedup by a segment-partition edit join.

Two lines within `tau` edits share, by the pigeonhole principle, one of the tau + 1 segments that the shorter one is cut into,
at nearly the same place. Each line puts its segments in an index keyed by (its length, the segment's number and content), and
probes the index for its own length and the tau lengths below with the substrings that can match (those whose shift agrees
with an alignment within tau edits on both sides). Pairs that meet are verified by a banded bit-parallel edit distance; linked
lines form classes, and of each class one line, the first by (doc_id, line number), stays.

A key that over HOT lines share would give a square of pairs. For tau = 1 its lines go on to a finer index: cut into more
segments, two lines within one edit agree in all of them but one, so the keys are the lines without one segment. That is
exact for any number of segments, and it ends where a segment is a single byte: lines of one length that agree but for one
byte are all within one edit of each other, and each is linked to one of them; a line that is longer by one byte is linked to
the lines that it is without one of its bytes. For more edits the lines of such a key are compared in blocks, each pair of
blocks in a task that gives edges which span its classes: time grows with the key's pairs of lines, rows with its lines.

Lines are runs between line feeds, without blanks at their ends; empty lines are neither counted nor removed. Lines of any
length match within `tau` edits; `fuzzy`, 0 in the query and in the pipeline, is a length below which only equal lines match.
Lengths, segments and edits are in bytes. Lines are identified by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm.common import aside, claim, column, components, discard, documents, restored, small_batches, stored, worker_cache

TAU, FUZZY, HOT, FINER = 1, 0, 64, 16
#: Bytes of lines whose keys are computed at once (one line may have more); a hash's prefix sums take 24 times as many.
AT_ONCE = 1 << 19
#: Sets of keys or line hashes are broadcast up to so many, shuffled beyond.
BROADCAST_ROWS = 1_000_000
#: Lines and bytes of them in a block, about, where a hot key's lines are compared (tau > 1).
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Lines whose keys a task remembers to have given.
SEEN = 400_000
BLANKS = b" \t\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """Starts and lengths of the tau + 1 segments of a line; the last ones are longer by one if they can't be even."""
    short, longer = length // (tau + 1), length % (tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        size = short + (i >= tau + 1 - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, tau: int) -> list[tuple[int, int, int, int]]:
    """For a line of this length: (indexed length, segment, start, size) of the substrings that can match a segment.

    By the multi-match-aware rule: segment i's start shifts by at most i edits on its left, and by what the length difference
    allows after at most tau - i edits on its right."""
    out = []
    for other in range(max(0, length - tau), length + 1):
        more = length - other
        for i, (at, size) in enumerate(segments(other, tau)):
            low = max(0, at - i, at + more - (tau - i))
            high = min(length - size, at + i, at + more + (tau - i))
            out += [(other, i, start, size) for start in range(low, high + 1)]
    return out


def within(a: bytes, b: bytes, tau: int) -> bool:
    """Whether the edit distance is at most tau.

    What both have in common at the front and the end is left out. On the rest the band of 2 * tau + 1 diagonals is one bit
    vector for each number of edits: bit k says that, after j bytes of b, j + k - tau bytes of a can be matched."""
    if abs(len(a) - len(b)) > tau:
        return False
    n = min(len(a), len(b))
    front = _common(a, b, n)
    back = _common(a[:front - len(a) - 1 : -1] if front else a[::-1], b[:front - len(b) - 1 : -1] if front else b[::-1], n - front)
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i + tau
    full = (1 << 2 * tau + 1) - 1
    states = [full & (1 << tau + d + 1) - (1 << tau) for d in range(tau + 1)]
    for j, c in enumerate(b):
        match, new = places.get(c, 0) >> j & full, []
        for d, s in enumerate(states):
            x = s & match
            if d:
                less = states[d - 1]
                x |= less | less >> 1 | new[d - 1] << 1 & full  # a byte replaced, inserted, left out
            new.append(x)
        states = new
        if not states[tau]:
            return False
    return bool(states[tau] >> (len(a) - len(b) + tau) & 1)


def _common(a: bytes, b: bytes, most: int) -> int:
    """Length of the common front, by halving."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


worker_cache(_powers.cache_clear)


class Rolled:
    """Hashes of any substrings of some lines, from prefix sums of byte * BASE**place modulo 2**64."""

    def __init__(self, lines: list[bytes]):
        data = np.frombuffer(b"".join(lines), np.uint8)
        self.power, self.back = _powers(1 << (len(data) + 1).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        self.first = np.cumsum(self.sizes) - self.sizes

    def lengths(self, least: int):
        """(length, rows) of the lines that have at least so many bytes."""
        order = np.argsort(self.sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.sizes[order])) + 1) if len(order) else []:
            if self.sizes[part[0]] >= least:
                yield int(self.sizes[part[0]]), part

    def hash(self, part: np.ndarray, at: int, size: int) -> np.ndarray:
        begin = self.first[part] + at
        return (self.sums[begin + size] - self.sums[begin]) * self.back[begin]


def groups(lines: list[bytes], most: int = AT_ONCE):
    """Slices of the lines of about so many bytes."""
    first, size = 0, 0
    for i, x in enumerate(lines):
        if size and size + len(x) > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(x)
    if first < len(lines):
        yield slice(first, len(lines))


def _mixed(h: np.ndarray, *tags: int) -> np.ndarray:
    for t in tags:
        h = (h ^ np.uint64((t + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ h >> np.uint64(32)
    return h


def _gathered(found: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    empty = np.zeros(0, np.int64)
    if not found:
        return empty, empty.view(np.uint64), empty
    rows, keys, sides = zip(*found)
    return np.concatenate(rows), np.concatenate(keys), np.repeat(sides, [len(r) for r in rows])


def segment_keys(lines: list[bytes], tau: int, fuzzy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and side of all lines of at least fuzzy bytes; side 1: an index key, which is a probe too; 0: a probe only."""
    rolled, found = Rolled(lines), []
    for length, part in rolled.lengths(fuzzy):
        own = {(length, i, at, size) for i, (at, size) in enumerate(segments(length, tau))}
        for other, i, at, size in sorted(own | {p for p in probes(length, tau) if p[0] >= fuzzy}):
            found.append((part, _mixed(rolled.hash(part, at, size), other, i), int((other, i, at, size) in own)))
    return _gathered(found)


def finer_keys(lines: list[bytes], pieces: int, fuzzy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As segment_keys for one edit: of each line cut into `pieces` segments the hashes of all but one. A line that is longer by
    one byte probes with one byte more left out."""
    rolled, found = Rolled(lines), []
    for length, part in rolled.lengths(fuzzy):
        for other in (length, length - 1):
            if other < fuzzy:
                continue
            for i, (at, size) in enumerate(segments(other, pieces - 1)):
                stop = at + size + length - other
                h = rolled.hash(part, 0, at) * np.uint64(0xD6E8FEB86659FD93) + rolled.hash(part, stop, length - stop)
                found.append((part, _mixed(h, other, i), int(other == length)))
    return _gathered(found)


def deletion_keys(lines: list[bytes], fuzzy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As segment_keys: side 1 is the whole line, side 0 the line without one of its bytes."""
    rolled, found = Rolled(lines), []
    for length, part in rolled.lengths(fuzzy):
        found.append((part, _mixed(rolled.hash(part, 0, length), length), 1))
        for at in range(length if length > fuzzy else 0):
            h = rolled.hash(part, 0, at) + rolled.hash(part, at + 1, length - at - 1) * rolled.power[at]
            found.append((part, _mixed(h, length - 1), 0))
    return _gathered(found)


def split_lines(body: bytes | None) -> list[bytes]:
    return [x.strip(BLANKS) for x in body.split(b"\n")] if body else []


def line_ids(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines)).view(np.int64)


#: Rows of the table that one pass over the documents writes.
PLACE, KEY, DOCUMENT = 0, 1, 2


def parsed(docs: DataFrame, tau: int, fuzzy: int) -> DataFrame:
    """One pass over the texts: kind PLACE: a line's id, doc (a hash of doc_id and text) and position; KEY: a line's id, key (in
    doc) and side (in pos); DOCUMENT: the number of lines (in pos)."""

    def each(found):
        claim("linedup")
        names, seen = ["kind", "doc_id", "doc", "pos", "id"], set()
        table = lambda kind, ids, doc, pos, line: pa.record_batch([pa.array(np.full(len(doc), kind, np.int8)), ids, pa.array(doc), pa.array(pos), pa.array(line)], names)
        for b in found:
            doc_ids, docs_ = b.column("doc_id"), b.column("doc").to_numpy()
            split = [split_lines(x) for x in column(b, "body")]
            n = np.array([len(x) for x in split], np.int64)
            lines = [x for ls in split for x in ls]
            row = np.repeat(np.arange(len(split)), n)
            pos = np.arange(len(lines)) - np.repeat(np.cumsum(n) - n, n)
            full = np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)))
            lines, row, pos = [lines[i] for i in full.tolist()], row[full], pos[full]
            ids = line_ids(lines)
            yield table(PLACE, doc_ids.take(pa.array(row)), docs_[row], pos, ids)
            yield table(DOCUMENT, doc_ids, docs_, np.bincount(row, minlength=len(split)).astype(np.int64), np.zeros(len(split), np.int64))
            which = pd.factorize(ids)[0]
            at = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)) if len(ids) else np.zeros(0, np.int64)
            at = np.array([i for i, x in zip(at.tolist(), ids[at].tolist()) if x not in seen], np.int64)
            if len(seen) < SEEN:
                seen.update(ids[at].tolist())
            new, new_ids = [lines[i] for i in at.tolist()], ids[at]
            for part in groups(new):
                r, key, side = segment_keys(new[part], tau, fuzzy)
                yield table(KEY, pa.nulls(len(r), doc_ids.type), key.view(np.int64), side, new_ids[part][r])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.col("text").cast("binary").alias("body"))
    return stored(rows.mapInArrow(each, f"kind byte, doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc long, pos long, id long"))


def _small(df: DataFrame) -> DataFrame:
    """df (stored), marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def met(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of key, id, side: the pairs (a < b) of ids that meet at keys of at most HOT lines; the ids that meet at others, with
    those keys."""
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("side").alias("side"))
    shared = stored(shared.where("low != high and side = 1").select("key"))
    held = stored(keys.join(_small(shared), "key").distinct())
    sizes = held.groupBy("key").agg(F.count("*").alias("n"))
    rows = held.join(sizes, "key")
    cold = rows.where(F.col("n") <= HOT)
    index = cold.where("side = 1").select("key", F.col("id").alias("a"))
    probe = cold.select("key", F.col("id").alias("b"), "side")
    pairs = index.join(probe, "key").where("a < b or (side = 0 and a > b)")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hot = stored(rows.where(F.col("n") > HOT).select("key", "id", "side"))
    discard(shared, held)
    return pairs, hot


def bodies_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and body (bytes) of the lines with these ids (stored), from another pass over the texts."""
    few = ids.count() <= BROADCAST_ROWS
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in ids.toLocalIterator()], np.int64)) if few else None)

    def each(found):
        claim("linedup")
        given: set[int] = set()
        for b in found:
            lines = [x for body in column(b, "body") for x in split_lines(body) if x]
            hashes = line_ids(lines)
            rows = np.arange(len(lines))
            if wanted.value is not None:
                at = np.minimum(np.searchsorted(wanted.value, hashes), max(0, len(wanted.value) - 1))
                rows = np.flatnonzero(wanted.value[at] == hashes) if len(wanted.value) else rows[:0]
            new = {hashes[i]: lines[i] for i in rows.tolist() if hashes[i] not in given}
            if len(given) < SEEN:
                given.update(new)
            yield pa.record_batch([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], ["id", "body"])

    found = docs.select(F.col("text").cast("binary").alias("body")).mapInArrow(each, "id long, body binary")
    found = found if few else found.join(ids, "id", "left_semi")
    return stored(found.groupBy("id").agg(F.first("body").alias("body")))


def finer(bodies: DataFrame, hot: DataFrame, pieces: int, fuzzy: int) -> DataFrame:
    """Candidate pairs among hot lines for one edit, by indexes of more and more segments."""
    pairs = None
    while True:
        lines = bodies.join(_small(stored(hot.select("id").distinct())), "id")
        longest = lines.agg(F.max(F.octet_length("body"))).first()[0]
        if longest is None:
            return pairs

        def keyed(lines, keys):
            def each(found):
                for b in found:
                    ids, lines_ = b.column("id").to_numpy(), column(b, "body")
                    for part in groups(lines_, AT_ONCE // 16):
                        r, key, side = keys(lines_[part])
                        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids[part][r]), pa.array(side)], ["key", "id", "side"])

            return lines.mapInArrow(each, "key long, id long, side long")

        new, hot = met(keyed(lines, partial(finer_keys, pieces=pieces, fuzzy=fuzzy)))
        pairs = new if pairs is None else pairs.union(new)
        if pieces > longest:  # index lines at a key agree but for one byte; a longer line has one of them as it is
            index = hot.where("side = 1")
            least = index.groupBy("key").agg(F.min("id").alias("a"))
            star = index.join(least, "key").where("a != id").select("a", F.col("id").alias("b"))
            lines = bodies.join(_small(stored(hot.select("id").distinct())), "id")
            keys = stored(keyed(lines, partial(deletion_keys, fuzzy=fuzzy)))
            whole = _small(stored(keys.where("side = 1").select("key", F.col("id").alias("a"))))
            longer = keys.where("side = 0").select("key", F.col("id").alias("b")).join(whole, "key").select("a", "b")
            return pairs.union(star.union(longer).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        pieces *= FINER


def verified(pairs: DataFrame, bodies: DataFrame, tau: int) -> DataFrame:
    """Those of the pairs within tau edits, in both directions."""

    def check(found):
        for b in found:
            keep = pa.array([within(x, y, tau) for x, y in zip(column(b, "x"), column(b, "y"))], pa.bool_())
            yield pa.record_batch([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    both = pairs.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b")
    good = stored(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
    return good.union(good.select("b", "a"))


def forest(ids: list[int], lines: list[bytes], left: list[int], right: list[int], tau: int) -> list[tuple[int, int]]:
    """Edges that span the classes which links (one line of left, one of right: places in lines) within tau edits make."""
    root, out = list(range(len(lines))), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    right = sorted(right, key=lambda i: len(lines[i]))
    sizes = [len(lines[i]) for i in right]
    for i in left:
        n = len(lines[i])
        for j in right[bisect_left(sizes, n - tau) : bisect_right(sizes, n + tau)]:
            x, y = find(i), find(j)
            if x != y and within(lines[i], lines[j], tau):
                root[x] = y
                out.append((ids[i], ids[j]))
    return out


def spanned(hot: DataFrame, bodies: DataFrame, tau: int) -> DataFrame:
    """Edges, in both directions, that span the classes of lines within tau edits among those of each hot key."""
    rows = hot.select("key", "id").distinct()
    sizes = rows.join(bodies.select("id", F.octet_length("body").alias("size")), "id").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = sizes.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    rows = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.select("key", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id")

    def compared(group):
        block, p, q = column(group, "block"), group.column("p")[0].as_py(), group.column("q")[0].as_py()
        left, right = ([i for i, x in enumerate(block) if x == side] for side in (p, q))
        found = forest(column(group, "id"), column(group, "body"), left, right, tau)
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate("ab")})

    edges = stored(rows.join(bodies, "id").groupBy("key", "p", "q").applyInArrow(compared, "a long, b long").distinct())
    return edges.union(edges.select("b", "a"))


def line_links(docs: DataFrame, keys: DataFrame, tau: int, fuzzy: int) -> DataFrame:
    """Pairs (a, b) of ids of different lines within tau edits, each in both directions. keys: key, id, side.

    All pairs that meet at keys of at most HOT lines; of those at others, pairs that reach the same lines."""
    pairs, hot = met(keys)
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(hot.select("id")).distinct())
    bodies = bodies_of(docs, ids)
    if tau > 1:
        out = verified(pairs, bodies, tau)
        out = out.union(spanned(hot, bodies, tau)) if hot.limit(1).count() else out
        discard(pairs, hot, ids, bodies)
        return out
    more = finer(bodies, hot, FINER, fuzzy) if hot.limit(1).count() else None
    out = verified(pairs if more is None else pairs.union(more).distinct(), bodies, tau)
    discard(pairs, hot, ids, bodies)
    return out


def removals(docs: DataFrame, tau: int = TAU, fuzzy: int = FUZZY) -> DataFrame:
    """doc_id, doc (a hash of doc_id and text: rows that agree in both are one document and lose the same lines), n_lines and
    removed (sorted positions of its removed lines, NULL if none) of each row.

    Of each class of equal or linked lines the first by (doc_id, position) stays; null doc_ids come first. A document's own
    later copies of a line go too. Null and empty texts have no lines."""
    table = parsed(docs, tau, fuzzy)
    keys = table.where(F.col("kind") == KEY).select(F.col("doc").alias("key"), "id", F.col("pos").alias("side"))
    roots = components(line_links(docs, keys, tau, fuzzy))
    places = table.where(F.col("kind") == PLACE).select("id", F.struct("doc_id", "pos", "doc").alias("place"))
    ids = places.groupBy("id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ids = ids.join(roots.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or root is not null")
    ids = stored(ids.select("id", F.coalesce("root", "id").alias("root"), "first"))
    kept = ids.groupBy("root").agg(F.min("first").alias("kept"))
    of_id = stored(ids.select("id", "root").join(kept, "root").select("id", "kept"))
    gone = places.join(_small(of_id), "id").where(~F.col("place").eqNullSafe(F.col("kept")))
    gone = gone.groupBy(F.col("place.doc").alias("doc")).agg(F.sort_array(F.collect_set("place.pos")).alias("removed"))
    return table.where(F.col("kind") == DOCUMENT).select("doc_id", "doc", F.col("pos").alias("n_lines")).join(gone, "doc", "left")


def without_lines(docs: DataFrame, tau: int = TAU, fuzzy: int = FUZZY) -> DataFrame:
    """docs without the removed lines, and without documents that had lines and lose all. Columns stay; n_chars is counted
    anew where it is one."""
    gone = removals(docs, tau, fuzzy).where("removed is not null").select(F.col("doc").alias("_doc"), F.col("removed").alias("_removed"), F.col("n_lines").alias("_n"))
    names = ("doc_id", "text", "n_chars")
    rows = aside(docs, *names).withColumn("_key", F.xxhash64("doc_id", "text"))
    rows = rows.join(stored(gone.dropDuplicates(["_doc"])), F.col("_key") == F.col("_doc"), "left")
    rows = rows.where("_removed is null or size(_removed) < _n")
    places = lambda lines: F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size(lines).cast("bigint") - 1), "_removed")
    left = lambda lines: F.array_join(F.transform(places(lines), lambda i: F.get(lines, i.cast("int"))), "\n")
    kept = F.transform(F.array(F.split("text", "\n")), left)[0]  # the text is split once, and the time is linear in its lines
    rows = rows.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return restored(rows, docs, *names)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, removed (the positions, comma-joined)."""
    small_batches(spark)
    rows = removals(documents(spark, sf_dir))
    n = F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size("removed")).cast("long")
    return rows.select("doc_id", "n_lines", n.alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
