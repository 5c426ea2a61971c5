import numpy as np
import xxhash

from jsonloom.llm import simhash


def brute(text, n=3):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, bits=2):
    """rows: doc_id, fingerprint. By pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for k, f in rows:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return {(k, f): least.get(find(f)) for k, f in rows}


def check(docs, **more):
    rows = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    want = classes(rows)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.clusters(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, f, want[k, f])) for k, f in rows)


def test_documents(documents):
    check(documents)


def test_odd(odd):
    check(odd)


def test_none(none):
    assert simhash.clusters(none).collect() == []


def test_anchors_cover_all_bits():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    at_home = simhash.home(fp)
    assert (simhash.home(at_home) == at_home).all()  # an anchor is its own home
    for bits in (0, 1, 2, 3):
        row, anchor = simhash.anchors(fp, bits)
        of = [set(anchor[row == i].tolist()) for i in range(len(fp))]
        assert len(row) == sum(map(len, of))  # each anchor once
        for i, f in enumerate(fp.tolist()):
            for _ in range(20):
                g = f
                for b in rng.choice(64, rng.integers(0, bits + 1), replace=False).tolist():
                    g ^= 1 << b
                assert simhash.home(np.array([g], np.uint64))[0] in of[i]
    assert 150 < len(simhash.anchors(fp, 2)[0]) / len(fp) < 180


def test_links_of_near_fingerprints(spark):
    import random

    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ 7 << rng.randrange(60)}
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if 1 <= (a ^ b).bit_count() <= 2}


def test_replicated_fingerprints_are_not_broadcast(spark):
    from jsonloom.llm.common import stored

    distinct = stored(spark.range(2000).selectExpr("xxhash64(id) fp", "id least"))
    for df in (distinct, distinct.limit(3)):
        links = simhash.links(df.select("fp"))
        links.collect()
        assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_verified_clusters_keep_different_short_texts_apart(spark):
    a = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, a), (2, a), (3, a.replace("w7 ", "v7 "))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.clusters(docs, n=5, bits=64 - 62, verify=0.8).collect()}
    assert got[1] == got[2] == 1 and got[3] in (1, 3)


def test_query(spark, sf):
    out = {r.doc_id: r for r in simhash.op1_simhash(spark, sf).collect()}
    assert all(len(r.fingerprint) == 16 and r.component_id <= k for k, r in out.items())


def test_verified_clusters_keep_equal_fingerprints_of_different_texts_apart(spark):
    rows = [(k, "0 " * 50 + " ".join(f"u{k}x{i}" for i in range(40))) for k in range(4)]
    got = simhash.clusters(spark.createDataFrame([*rows, (9, rows[2][1])], "doc_id long, text string"), n=5, verify=0.8).collect()
    assert len({r.fp for r in got}) == 1
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 9: 2}
