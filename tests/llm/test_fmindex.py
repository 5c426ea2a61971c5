import hashlib
import random
import re

import numpy as np
import pytest

from jsonloom.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for k, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners is not None:
                    hit.update(range(i, i + size))
                    found |= {str(x) for x in owners if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append(repr((k, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))))
    return sorted(out)


def result(spark, docs, benchmark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(repr(tuple(r)) for r in fmindex.op5_decontamination(spark, str(tmp_path)).collect())


def test_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    got = sorted(repr(tuple(r)) for r in fmindex.op5_decontamination(spark, sf).collect())
    assert got == want and any("True" in x for x in got)


def test_odd(spark, odd, none, tmp_path):
    some = [r.text for r in odd.where("doc_id = 5").collect()][0].split()
    items = [(1, " ".join(some[20:50])), (2, " ".join(some[30:36]).upper()), (3, None), (4, "!!"), (None, " ".join(some[100:120])), (11, " ".join(some[20:50])), (11, "zz"), (5, "x́")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert result(spark, odd, benchmark, tmp_path / "a") == brute([(r.doc_id, r.text) for r in odd.collect()], items)
    assert result(spark, none, benchmark, tmp_path / "b") == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert result(spark, odd, nothing, tmp_path / "c") == brute([(r.doc_id, r.text) for r in odd.collect()], [])


def test_benchmark_in_blocks(spark, odd):
    some = [r.text for r in odd.where("doc_id = 5").collect()][0].split()
    benchmark = spark.createDataFrame([(i, " ".join(some[i : i + 20])) for i in range(0, 150, 9)], "item_id long, text string")
    once, often = (sorted(map(repr, fmindex.removal_spans(odd, benchmark, "doc_id", most=n).drop("body").collect())) for n in (10**9, 200))
    assert once == often


def test_shards_of_few_symbols(spark, odd, monkeypatch):
    some = [r.text for r in odd.where("doc_id = 5").collect()][0].split()
    benchmark = spark.createDataFrame([(i, " ".join(some[i : i + 20])) for i in range(0, 150, 9)], "item_id long, text string")
    whole = sorted(map(repr, fmindex.removal_spans(odd, benchmark, "doc_id", cut=True).collect()))
    windows = fmindex.Windows([("a", " ".join(some).encode()), ("b", " ".join(some[50:]).encode()), (None, b"own words"), ("c", None)], 13)
    assert len(windows.phrases) == len(some) - 12 + 1 and sum(len(windows.items(i)) for i in range(len(windows.phrases))) == 2 * len(some) - 50 - 24
    monkeypatch.setattr(fmindex, "SYMBOLS", 10)
    monkeypatch.setattr(fmindex, "BYTES", 100)
    found = [fmindex.shard_hits(windows, [])]
    assert found == [[]]
    assert sorted(map(repr, fmindex.removal_spans(odd, benchmark, "doc_id", cut=True).collect())) == whole


@pytest.mark.parametrize("symbols", [1, 2, 5, 40])
def test_index(symbols):
    rng = random.Random(symbols)
    runs = [[rng.randint(1, symbols) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    text = np.array([0, *(x for r in runs for x in (*r, 0))])
    index = fmindex.FMIndex(text, symbols)
    small = np.array([3, 1, 2, 1, 2, 0])
    assert [small[i:].tolist() for i in fmindex.suffix_array(small)] == [[0], [1, 2, 0], [1, 2, 1, 2, 0], [2, 0], [2, 1, 2, 0], [3, 1, 2, 1, 2, 0]]
    for _ in range(50):
        run = rng.choice(runs)
        a = rng.randrange(len(run))
        phrase = run[a : a + rng.randint(1, 13)]
        if rng.random() < 0.3:
            phrase = phrase[:-1] + [rng.randint(1, symbols)]
        low, high = index.search(np.array([phrase[::-1]]), np.array([len(phrase)]))
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert places == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)].tolist() == phrase]


def test_cutting_spans():
    text = "One two, THREE four; fivé six.".encode()
    assert fmindex.without(text, [(1, 3), (4, 5)]) == b"One  four;  six."
    assert fmindex.merged([(5, 7), (1, 3), (2, 4), (4, 5)]) == [(1, 7)]
