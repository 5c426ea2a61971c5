import hashlib
import random

import numpy as np
import pytest

from jsonloom.llm import minhash


def shingles(text, n=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def key(row):
    return (row[0] is None, -(row[0] or 0), (row[1] or "").encode())


def check(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=key)
    want = []
    for i, (k, text) in enumerate(rows):
        text, follower = text or "", rows[(i + 1) % len(rows)][1] or ""
        new = minhash.edited(text, follower)
        want.append(repr((k, len(text), hashlib.sha256(new.encode()).hexdigest())))
    got = minhash.fingerprints(docs).collect()
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(want)
    by_text = {}
    texts = {}
    for k, text in rows:
        texts.setdefault(k, []).append(text or "")
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts[r.doc_id]) == 1:
            assert by_text.setdefault(texts[r.doc_id][0], r.fingerprint) == r.fingerprint
    return got


def test_documents(documents):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    after = {r.doc_id: rows[(i + 1) % len(rows)].text for i, r in enumerate(rows)}
    texts = {r.doc_id: r.text for r in rows}
    off = []
    for r in check(documents):
        a, b = shingles(texts[r.doc_id]), shingles(after[r.doc_id])
        off += [r.near_next - jaccard(a, b), r.near_edited - jaccard(a, shingles(minhash.edited(texts[r.doc_id], after[r.doc_id])))]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.06


def test_odd(odd):
    got = {r.doc_id: r for r in check(odd)}
    assert got[2].fingerprint == got[1].fingerprint == got[3].fingerprint == "ffff" * 128


def test_one_and_none(spark, none):
    assert minhash.fingerprints(none).collect() == []
    r = minhash.fingerprints(spark.createDataFrame([(3, "abc def")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()


def test_near_duplicates(spark, odd, none):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(rng.randint(1, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(120)] = "x"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A b"), (103, "A b")]
    sets = {k: shingles(t or "") for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted((k, find(k)) for k, _ in rows)
    assert len(minhash.near_duplicates(odd).collect()) == odd.count()
    assert minhash.near_duplicates(none).collect() == []


def near_copies(rng, groups=6, size=25):
    """Texts of a few groups, changed in some words each, with similarities on both sides of 0.8."""
    out = []
    for g in range(groups):
        base = [f"w{g}x{i}" for i in range(150)]
        for _ in range(size):
            words = list(base)
            for i in rng.sample(range(150), rng.randint(0, 6)):
                words[i] = f"v{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out


def brute_classes(rows, least=0.8, n=5):
    sets = {k: {tuple(t.lower().split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("hot, block", [(32, 1024), (3, 8), (10**6, 1024)])
def test_near_copies_by_pairs_and_by_blocks(spark, monkeypatch, hot, block):
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    rows = list(enumerate(near_copies(random.Random(4))))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
