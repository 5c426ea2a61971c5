import itertools
import math
import random

import numpy as np

from jsonloom.llm import langid


def all_segmentations(word, probability, unknown):
    """Sum over all ways to cut the word, by listing them."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        pieces, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                pieces.append(word[last:i])
                last = i
        pieces.append(word[last:])
        total += math.prod(probability.get(p, unknown if len(p) == 1 else 0.0) for p in pieces)
    return total


def test_forward_algorithm():
    rng = random.Random(1)
    for _ in range(20):
        vocabulary = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(12)})
        finder = langid.Lattice(vocabulary)
        table = np.random.default_rng(1).random((len(vocabulary) + 2, 2)) / 10
        table[-1] = 0
        words = ["".join(rng.choice("abcéx") for _ in range(rng.randint(1, 9))) for _ in range(15)]
        got = finder.log_likelihoods(words, table)
        for w, row in zip(words, got):
            for k in range(2):
                want = all_segmentations(w, {v: table[i, k] for i, v in enumerate(vocabulary)}, table[len(vocabulary), k])
                assert abs(row[k] - math.log(max(want, 1e-300))) < 1e-9


def test_expected_counts():
    vocabulary = ["a", "b", "ab", "ba", "aba"]
    finder, table = langid.Lattice(vocabulary), np.array([[0.3], [0.2], [0.2], [0.2], [0.1], [0.01], [0.0]])
    got = finder.expected(["abab"], np.zeros(1, int), np.array([3.0]), table)[:, 0]
    weights, counts = 0.0, np.zeros(7)
    for cuts in itertools.product([False, True], repeat=3):
        pieces, last = [], 0
        for i, c in enumerate([*cuts, True], 1):
            if c:
                pieces.append("abab"[last:i])
                last = i
        p = math.prod(table[vocabulary.index(x), 0] if x in vocabulary else 0 for x in pieces)
        weights += p
        for x in pieces:
            if x in vocabulary:
                counts[vocabulary.index(x)] += p
    assert np.allclose(got, 3 * counts / weights)


def test_words_of_any_length(monkeypatch):
    """Blocks of places and scaling change nothing; sums of thousands of characters don't underflow."""
    rng = random.Random(2)
    vocabulary = ["a", "b", "ab", "ba", "aba", "bbbb"]
    finder, table = langid.Lattice(vocabulary), np.array([[0.3, 0.1], [0.2, 0.1], [0.2, 0.3], [0.1, 0.2], [0.1, 0.2], [0.1, 0.1], [1e-7, 1e-7], [0, 0]])
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 7, 8, 9, 23, 24, 25, 60, 60, 5000)]

    def plain(word, k):
        logs = [0.0]
        for p in range(1, len(word) + 1):
            terms = []
            for l in range(1, min(p, 4) + 1):
                piece = word[p - l : p]
                q = table[vocabulary.index(piece), k] if piece in vocabulary else table[len(vocabulary), k] * (l == 1)
                if q:
                    terms.append(logs[p - l] + math.log(q))
            logs.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
        return logs[-1]

    want = np.array([[plain(w, k) for k in range(2)] for w in words])
    whole, counts = finder.log_likelihoods(words, table), finder.expected(words, np.arange(10) % 2, np.arange(10.0), table)
    assert np.allclose(whole, want, rtol=1e-9)
    assert want[-1, 0] < -2000
    lengths = np.array([len(v) for v in vocabulary] + [1, 0])
    assert np.allclose(lengths @ counts, [sum(len(w) * i for i, w in enumerate(words) if i % 2 == k) for k in range(2)])
    for places, at_once in ((3, 10), (7, 100), (8, 1)):
        monkeypatch.setattr(langid, "PLACES", places)
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        assert np.allclose(finder.log_likelihoods(words, table), whole)
        assert np.allclose(finder.expected(words, np.arange(10) % 2, np.arange(10.0), table), counts)


def test_any_number_of_languages(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "concat(lang, '-', doc_id % 3) lang")
    one = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    two = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert one.keys() == two.keys() and all(one[k].lang_pred == two[k].lang_pred and abs(one[k].score - two[k].score) < 1e-4 for k in one)


def test_whole_query_against_plain_expectation_maximisation(spark, sf):
    import zlib
    from collections import Counter

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys(langid.pieces(langid.default_vocabulary())))}
    words = lambda text: ["\u2581" + w for w in langid.re.findall(r"[^\W\d_]+", text.lower())]
    counts, rows = {}, Counter()
    for r in docs:
        if not held[r.doc_id] and r.text is not None and r.lang is not None:
            rows[r.lang] += 1
            counts.setdefault(r.lang, Counter()).update(words(r.text))
    size, longest = len(vocabulary), max(map(len, vocabulary))

    def arcs(word, p):  # pieces that end at p
        for l in range(1, min(p, longest) + 1):
            i = vocabulary.get(word[p - l : p], size if l == 1 else None)
            if i is not None:
                yield p - l, i

    def forward(word, table):
        alpha = [1.0]
        for p in range(1, len(word) + 1):
            alpha.append(sum(alpha[a] * table[i] for a, i in arcs(word, p)))
        return alpha

    tables = {}
    for lang, found in counts.items():
        table = [1 / (size + 1)] * (size + 1)
        for _ in range(langid.ROUNDS):
            new = [langid.SMOOTH] * (size + 1)
            for word, n in found.items():
                alpha, beta = forward(word, table), [0.0] * len(word) + [1.0]
                for p in range(len(word), 0, -1):
                    for a, i in arcs(word, p):
                        beta[a] += table[i] * beta[p]
                for p in range(1, len(word) + 1):
                    for a, i in arcs(word, p):
                        new[i] += n * alpha[a] * table[i] * beta[p] / alpha[-1]
            total = sum(new)
            table = [x / total for x in new]
        tables[lang] = table
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    assert got.keys() == held.keys()
    for r in docs[::3]:
        x = got[r.doc_id]
        assert x.held_out == held[r.doc_id]
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        logs = {k: math.log(rows[k] / sum(rows.values())) + sum(math.log(max(forward(w, t)[-1], 1e-300)) for w in words(r.text)) for k, t in tables.items()}
        best = max(sorted(logs), key=logs.get)
        assert x.lang_pred == best
        assert abs(x.score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 0


def test_odd(odd, none):
    model = langid.fit(odd)
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd, model).collect()}
    assert {(1, True), (2, True), (3, True), (7, True), (4, False), (5, False), (9, False)} <= got
    assert langid.identify(none, model).collect() == []
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_prediction_uses_the_text_only(spark, odd):
    model = langid.fit(odd)
    a = {r.doc_id: r.score for r in langid.identify(odd.where("doc_id = 5"), model).collect()}
    b = {r.doc_id: r.score for r in langid.identify(odd.where("doc_id = 5").selectExpr("doc_id", "text", "'zz' lang"), model).collect()}
    assert a == b
