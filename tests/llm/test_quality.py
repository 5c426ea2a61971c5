import numpy as np

from jsonloom.llm import quality


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op6_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.9


def test_isotonic():
    rng = np.random.default_rng(1)
    score = rng.integers(0, 30, 400) / 30
    y = (rng.random(400) < score).astype(float)
    knots, levels = quality.isotonic(score, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    # least squares among rising functions: max-min formula
    at = np.unique(score)
    mean = lambda a, b: y[(score >= a) & (score <= b)].mean()
    want = [max(min(mean(a, b) for b in at if b >= x) for a in at if a <= x) for x in at]
    want = (np.array(want) * len(y) + 0.5) / (len(y) + 1)
    assert np.allclose(sorted({round(w, 10) for w in want}), levels)


def test_isotonic_keeps_the_order_of_small_and_large_pools():
    score = np.concatenate([[0.0], np.full(100, 0.5), [1.0]])
    y = np.concatenate([[0.0], np.arange(100) < 10, [1.0]])
    _, levels = quality.isotonic(score, y)
    assert len(levels) == 3 and (np.diff(levels) > 0).all() and 0 < levels[0] and levels[-1] < 1


def test_whole_query_against_a_plain_fit(spark, sf):
    """Statistics, fold, ridge and calibration once more, in one process and from the tables themselves."""
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in docs}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs and not held[r.doc_id] and r.quality is not None]
    fold = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in docs], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 'fold'), 5) = 0").collect()}
    x = {k: np.array(quality.statistics(t)) for k, t in docs.items()}
    m = np.array([x[k] for k, _ in labels])
    y, unseen = np.array([q for _, q in labels], float), np.array([fold[k] for k, _ in labels])
    scale = m.std(0)
    scale[scale < 1e-5] = 1
    model = quality.Model(m.mean(0), scale, None, None, None)
    z = model.map(m[~unseen])
    model.weights = np.linalg.solve(z.T @ z + quality.RIDGE * max(1.0, len(y) / 100) * np.eye(z.shape[1]), z.T @ y[~unseen])
    ridge = model.ridge(m[unseen])
    at = np.unique(ridge)
    mean = lambda a, b: y[unseen][(ridge >= a) & (ridge <= b)].mean()
    level = np.array([max(min(mean(a, b) for b in at if b >= v) for a in at if a <= v) for v in at])
    pools = [np.flatnonzero(level == v) for v in np.unique(level)]
    knots, levels = at[[(p[0] + p[-1]) // 2 for p in pools]], (np.array([level[p[0]] for p in pools]) * unseen.sum() + 0.5) / (unseen.sum() + 1)
    got = {r.doc_id: r for r in quality.op6_quality(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        want = float(np.clip(np.interp(model.ridge(x[k][None])[0], knots, levels), 0, 1))
        assert r.held_out == held[k] and abs(r.score - want) < 1e-4 and r.predicted == int(r.score >= 0.7)


def test_ridge_solves_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, quality.SIZE))
    y = (x[:, 0] + x[:, 1] > 1).astype(int)
    rows = spark.createDataFrame([(i, bytearray(v.tobytes()), int(q)) for i, (v, q) in enumerate(zip(x, y))], "doc_id long, x binary, quality int")
    model = quality.fit(rows)
    fold = [r[0] for r in rows.selectExpr("pmod(xxhash64(doc_id, 'fold'), 5) = 0").collect()]
    z, t = model.map(x)[~np.array(fold)], y[~np.array(fold)]
    want = np.linalg.solve(z.T @ z + quality.RIDGE * 3.0 * np.eye(z.shape[1]), z.T @ t)
    assert np.allclose(model.weights, want, atol=1e-6)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.8


def test_odd_and_none(spark, odd, none):
    rows = quality.features(odd)
    model = quality.fit(rows.selectExpr("doc_id", "x", "cast(null as int) quality"))
    assert {r.score for r in quality.scored(rows, model).collect()} == {0.5}
    assert quality.scored(quality.features(none), model).collect() == []
    one = quality.fit(rows.selectExpr("doc_id", "x", "1 quality"))
    assert all(r.score > 0.5 for r in quality.scored(rows, one).collect())
    assert np.isfinite(quality.statistics(b"")).all()
