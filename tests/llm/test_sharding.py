import math
import zlib

import numpy as np

from jsonloom.llm import sharding


def check(out, rows, shards=16):
    sizes = [0] * shards
    slots = [set() for _ in range(shards)]
    for r in out:
        sizes[r.shard] += 1
        slots[r.shard].add(r.slot)
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(s == set(range(n)) for s, n in zip(slots, sizes))
    want = sorted(repr((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for k, t in rows)
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in out) == want


def test_documents(spark, sf, rows):
    out = sharding.op10_sharding(spark, sf).collect()
    check(out, [(r[0], r[1]) for r in rows])
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    again = sharding.op10_sharding(spark, sf).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_odd_and_none(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        check(sharding.op10_sharding(spark, f"{tmp_path}/{name}").collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_matrix_margins():
    counts = [0, 5, 1000, 3, 777]
    got = sharding.matrix(counts, 16, 1)
    assert [sum(r) for r in got] == counts
    columns = [sum(r[s] for r in got) for s in range(16)]
    assert max(columns) - min(columns) <= 1


def test_large_urns_have_the_exact_distribution(monkeypatch):
    left = np.array([10**9, 10**9, 2 * 10**9])
    got = sharding._drawn(np.random.default_rng(1), left, 4000)
    assert got.sum() == 4000 and abs(got[2] - 2000) < 200
    assert sharding.hypergeometric(np.random.default_rng(1), 10**10, 0, 77) == 77
    assert sharding.hypergeometric(np.random.default_rng(1), 0, 10**10, 77) == 0
    assert abs(sharding.hypergeometric(np.random.default_rng(1), 3 * 10**9, 47 * 10**9, 200_000) - 12_000) < 800
    monkeypatch.setattr(sharding, "NUMPY", 1)
    rng, (good, bad, n), draws = np.random.default_rng(2), (30, 50, 25), 20_000
    seen = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(draws)], minlength=26)
    want = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(26)]) * draws
    often = want > 5
    assert ((seen - want) ** 2 / want)[often].sum() < 45  # chi square with about 14 degrees of freedom
    assert seen[~often].sum() < 40


def test_long_matrices_are_written_in_pieces(spark, odd, tmp_path, monkeypatch):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    whole = sorted(map(repr, sharding.op10_sharding(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(sharding, "PIECE", 1)
    assert sorted(map(repr, sharding.op10_sharding(spark, str(tmp_path)).collect())) == whole


def test_order_is_shuffled(spark, sf):
    out = [r.doc_id for r in sharding.op10_sharding(spark, sf).orderBy("shard", "slot").collect()]
    rising = sum(a < b for a, b in zip(out, out[1:]))
    assert 0.35 * len(out) < rising < 0.65 * len(out)
