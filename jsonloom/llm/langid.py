"""Language identification by segmentation-marginalised unigrams.

For each language the pieces of a fixed public vocabulary have probabilities. A word's probability is the sum, over all ways
to cut it into pieces, of the products of the pieces' probabilities; a forward pass over its characters finds it without
listing the ways. A text's is the product over its words. The probabilities are fitted by expectation maximisation with a
forward-backward pass over the distinct words of the labelled documents.

Words are runs of letters of any length, lower-cased. Passes work on whole batches of words of one length in numpy, block by
block of places; what has been summed is scaled again and again, so no length underflows. A worker remembers the scores of the
words it has met. Languages are worked off in blocks of LANGUAGES, so their number is not bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm.common import batches, claim, column, documents, small_batches, stored, texts, worker_cache
from jsonloom.llm.tokencount import MARK, default_vocabulary, pieces

WORDS = re.compile(r"[^\W\d_]+")
SMOOTH, ROUNDS = 0.05, 2
#: Words that a worker remembers, times languages.
CACHE = 1_200_000
#: Characters of words, and places in them, that one step of a pass works on; places after which sums are scaled anew.
AT_ONCE, PLACES, SCALED = 100_000, 4096, 8
#: Languages that a pass works on at once.
LANGUAGES = 64
#: Labelled documents that the probabilities are fitted on, about (chosen by a hash of the doc_id).
TRAINING_ROWS = 20_000


class Lattice:
    """Finds the vocabulary's pieces in words: ids 0 .. size - 1, `size` for a single character that is no piece, size + 1 for none."""

    def __init__(self, vocabulary: list[str]):
        vocabulary = list(dict.fromkeys(vocabulary))
        self.size, self.longest = len(vocabulary), max(map(len, vocabulary))
        h = np.array([self._mix(self._roll(np.array([list(map(ord, p))], np.uint64))) for p in vocabulary], np.uint64).ravel()
        self.ids = np.argsort(h)
        self.keys = h[self.ids]
        slots = (self.keys >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << 20))
        self.deep = int(np.bincount(slots).max())
        self.keys = np.concatenate([self.keys, np.zeros(self.deep, np.uint64)])
        self.ids = np.concatenate([self.ids, np.zeros(self.deep, np.int64)])

    @staticmethod
    def _roll(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, j] + np.uint64(1)
        return h

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)

    def arcs(self, codes: np.ndarray, first: int, stop: int) -> list[np.ndarray]:
        """codes: words of one length, [word, place]. For each piece length l from 1, the ids of the pieces at [word, start] for
        starts from first to stop - 1, as far as they fit."""
        n, out = codes.shape[1], []
        h = np.zeros((len(codes), stop - first), np.uint64)
        for l in range(1, min(n - first, self.longest) + 1):
            h = h[:, : min(stop, n - l + 1) - first] * np.uint64(0x9E3779B97F4A7C15) + codes[:, first + l - 1 : min(stop + l - 1, n)] + np.uint64(1)
            mixed = self._mix(h)
            at = self.first[(mixed >> np.uint64(44)).astype(np.int64)]
            found = np.full(h.shape, self.size + (l > 1), np.int64)
            for d in range(self.deep):
                hit = self.keys[at + d] == mixed
                found[hit] = self.ids[at[hit] + d]
            out.append(found)
        return out

    def _parts(self, words: list[str]):
        """Rows and codes of words of one length, some at a time."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, rows in by_length.items():
            step = max(1, min(4096, AT_ONCE // n))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                yield np.array(part), np.array([list(map(ord, words[i])) for i in part], np.uint64)

    def _forward(self, codes: np.ndarray, chances, shape: tuple) -> tuple:
        """For each place the sum over all segmentations up to it, in logarithms; gives them one by one."""
        n = codes.shape[1]
        sums, scale = {0: np.ones(shape)}, np.zeros(shape)
        for first in range(0, n, PLACES):
            arcs = [chances(a) for a in self.arcs(codes, first, min(n, first + PLACES))]
            for p in range(first, min(n, first + PLACES)):
                here = sums.pop(p)
                yield np.log(np.maximum(here, 1e-300)) + scale
                for l, chance in enumerate(arcs, 1):
                    if p + l > n or p - first >= chance.shape[1]:
                        break
                    more = here * chance[:, p - first]
                    sums[p + l] = sums[p + l] + more if p + l in sums else more
                if p % SCALED == SCALED - 1:
                    most = np.maximum(np.maximum.reduce(list(sums.values())), 1e-300)
                    scale = scale + np.log(most)
                    sums = {k: v / most for k, v in sums.items()}
        yield np.log(np.maximum(sums[n], 1e-300)) + scale

    def log_likelihoods(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log P(word) in each language: table has a row for each id, a column for each language."""
        out = np.zeros((len(words), table.shape[1]))
        for part, codes in self._parts(words):
            for last in self._forward(codes, lambda ids: table[ids], (len(part), table.shape[1])):
                pass
            out[part] = last
        return out

    def expected(self, words: list[str], language: np.ndarray, count: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected numbers of each piece, [id, language], over all segmentations of words that occur `count` times."""
        out = np.zeros(table.shape)
        flat, width = out.reshape(-1), table.shape[1]
        for part, codes in self._parts(words):
            n, lang = codes.shape[1], language[part]
            chances = lambda ids, lang=lang: table[ids, lang[:, None]]
            before = np.stack(list(self._forward(codes, chances, (len(part),))))
            after, scale, sums = np.zeros((n + 1, len(part))), np.zeros(len(part)), {n: np.ones(len(part))}
            for first in range((n - 1) // PLACES * PLACES, -1, -PLACES):
                arcs = self.arcs(codes, first, min(n, first + PLACES))
                chance = [chances(a) for a in arcs]
                for p in range(min(n, first + PLACES) - 1, first - 1, -1):
                    sums[p] = sum(sums[p + l] * c[:, p - first] for l, c in enumerate(chance, 1) if p - first < c.shape[1])
                    after[p] = np.log(np.maximum(sums[p], 1e-300)) + scale
                    sums.pop(p + self.longest, None)
                    if p % SCALED == 0:
                        most = np.maximum(np.maximum.reduce(list(sums.values())), 1e-300)
                        scale = scale + np.log(most)
                        sums = {k: v / most for k, v in sums.items()}
                for l, (ids, c) in enumerate(zip(arcs, chance), 1):
                    fit = ids.shape[1]
                    share = np.exp(before[first : first + fit] + after[first + l : first + l + fit] - before[n]).T
                    np.add.at(flat, (ids * width + lang[:, None]).ravel(), (share * c * count[part][:, None]).ravel())
        out[self.size + 1] = 0
        return out


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(pieces(path))


worker_cache(lattice.cache_clear)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


class Model:
    """Languages in order, their log priors, and for each language the pieces that have been counted (sorted by language): pieces
    and counts. All other pieces have the count SMOOTH alone."""

    def __init__(self, path: str, size: int, languages: list[str], prior: np.ndarray, piece=(), lang=(), count=()):
        self.path, self.size, self.languages, self.prior = path, size, languages, prior
        lang = np.asarray(lang, np.int64)
        order = np.argsort(lang, kind="stable")
        self.piece, self.lang, self.count = np.asarray(piece, np.int64)[order], lang[order], np.asarray(count, float)[order]

    def blocks(self) -> list[tuple[int, int]]:
        return [(i, min(i + LANGUAGES, len(self.languages))) for i in range(0, len(self.languages), LANGUAGES)]

    def table(self, first: int, stop: int) -> np.ndarray:
        """Piece probabilities [id, language] of the languages from first to stop - 1. Uniform before any counts."""
        out = np.full((self.size + 2, stop - first), SMOOTH)
        a, b = np.searchsorted(self.lang, (first, stop))
        out[self.piece[a:b], self.lang[a:b] - first] += self.count[a:b]
        out[self.size + 1] = 0
        return out / out.sum(0)


def fit(labelled: DataFrame, path: str | None = None, most_rows: int = TRAINING_ROWS, rounds: int = ROUNDS) -> Model:
    """From rows with doc_id, text and lang (rows without text or lang don't count), about most_rows of them.

    Only sums by language and piece, and the languages' names and row counts, come to the driver."""
    spark, path = labelled.sparkSession, path or default_vocabulary()
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = labelled.count()
    if total > most_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < (most_rows * (1 << 30)) // total)
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count_words(found):
        claim("langid")
        for b in found:
            seen: dict[str, Counter] = {}
            for lang, body in zip(column(b, "lang"), column(b, "body")):
                seen.setdefault(lang, Counter()).update(words_of(body.decode("utf-8", "replace")))
            for lang, n in seen.items():
                yield from batches(schema, [[[lang] * len(n), list(n), list(n.values())]])

    counted = texts(labelled, "lang").mapInArrow(count_words, "lang string, word string, n long")
    counted = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    priors = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(priors)
    prior = np.log(np.array([priors[x] for x in languages], float) / max(1, sum(priors.values())))
    model = Model(path, lattice(path).size, languages, prior)
    for _ in range(rounds if languages else 0):
        now = spark.sparkContext.broadcast(model)

        def expect(found):
            claim("langid")
            m = now.value
            index = {x: i for i, x in enumerate(m.languages)}
            block, total, table = -1, None, None

            def sums():
                ids, lang = np.nonzero(total)
                return pa.record_batch([pa.array(ids), pa.array(lang + block * LANGUAGES), pa.array(total[ids, lang])], ["piece", "lang", "n"])

            for b in found:  # sorted by language
                lang = np.array([index[x] for x in column(b, "lang")], np.int64)
                words, n = [MARK + w for w in column(b, "word")], b.column("n").to_numpy().astype(float)
                for k in sorted(set((lang // LANGUAGES).tolist())):
                    if k != block:
                        if total is not None:
                            yield sums()
                        block, table = k, m.table(k * LANGUAGES, min((k + 1) * LANGUAGES, len(m.languages)))
                        total = np.zeros(table.shape)
                    of = np.flatnonzero(lang // LANGUAGES == k)
                    total += lattice(path).expected([words[i] for i in of.tolist()], lang[of] - k * LANGUAGES, n[of], table)
            if total is not None:
                yield sums()

        got = counted.sortWithinPartitions("lang").mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        model = Model(path, model.size, languages, prior, got["piece"], got["lang"], got["n"])
    return model


class Scores:
    """log P of lists of words in some languages; remembers words."""

    def __init__(self, finder: Lattice, table: np.ndarray):
        self.finder, self.table, self.row = finder, table, {}
        self.scores = np.zeros((max(1, CACHE // table.shape[1]), table.shape[1]), np.float32)

    def __call__(self, listed: list[list[str]]) -> np.ndarray:
        words = list(dict.fromkeys(w for ws in listed for w in ws))
        fresh = [w for w in words if w not in self.row]
        if len(self.row) + len(fresh) > len(self.scores):
            self.row, fresh = {}, words
            if len(fresh) > len(self.scores):
                self.scores = np.zeros((len(fresh), self.table.shape[1]), np.float32)
        for i in range(0, len(fresh), 50_000):
            part, at = fresh[i : i + 50_000], len(self.row)
            self.scores[at : at + len(part)] = self.finder.log_likelihoods([MARK + w for w in part], self.table)
            self.row.update(zip(part, range(at, at + len(part))))
        return np.array([self.scores[[self.row[w] for w in ws]].sum(0, dtype=np.float64) for ws in listed]).reshape(len(listed), -1)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, lang_pred, and score: the posterior probability of lang_pred.

    Texts that are null or have no letter, and all texts where nothing was learned, are `und` with score 0. Ties go to the
    first language in order."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), ["doc_id", *keep]
    schema_text = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept) + ", lang_pred string, score double"

    def each(found):
        claim("langid")
        m, finder = shared.value, lattice(shared.value.path)
        blocks, held = m.blocks(), None
        for b in found:
            listed, ok = [], []
            for body in column(b, "body"):
                text = (body or b"").decode("utf-8", "replace")
                listed.append(words_of(text))
                ok.append(any(map(str.isalpha, text)) and bool(blocks))
            best, mass, which = np.full(len(listed), -np.inf), np.zeros(len(listed)), np.zeros(len(listed), np.int64)
            for first, stop in blocks:
                held = held if held and len(blocks) == 1 else Scores(finder, m.table(first, stop))
                totals = m.prior[first:stop] + held(listed)
                top = totals.argmax(1)
                new = np.maximum(best, totals[np.arange(len(listed)), top])
                which = np.where(new > best, first + top, which)
                mass = mass * np.exp(best - new) + np.exp(totals - new[:, None]).sum(1)
                best = new
            names = [m.languages[i] if x else "und" for i, x in zip(which.tolist(), ok)]
            values = np.where(ok, 1 / np.maximum(mass, 1.0), 0.0)
            cols = [b.column("body").view(pa.string()) if k == "text" else b.column(k) for k in kept]
            yield pa.record_batch([*cols, pa.array(names, pa.string()), pa.array(values, pa.float64())], [*kept, "lang_pred", "score"])

    moved = [k for k in kept if k != "text"]  # the text comes back from its bytes
    return docs.select(*moved, F.col("text").cast("binary").alias("body")).mapInArrow(each, schema_text)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row. Learns from text and lang of documents that are not held out; a null doc_id
    is not held out. Null texts, texts without letters, and all texts where nothing was learned are und; repeated rows are
    predicted each for itself."""
    small_batches(spark)
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = fit(docs.where("not held_out").select("doc_id", "text", "lang"))
    return identify(docs, model, "held_out")
