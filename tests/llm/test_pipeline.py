import corpus_pipeline
from test_fmindex import brute as windows_hit
from test_linedup import brute as lines_gone
from test_packing import check as check_pieces
from test_simhash import brute as fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)

    kept = keep(stages["language"](spark, docs, sf))
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lined = keep(stages["lines"](spark, kept, sf))
    gone = {}
    for x in lines_gone(rows, 1, 0):
        k, n, m, at = eval(x)
        gone[k] = (n, {int(i) for i in at.split(",") if i})
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k][1]) for k, t in rows if not gone[k][0] or len(gone[k][1]) < gone[k][0]}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect() if gone[r.doc_id][1])

    near = keep(stages["near_duplicates"](spark, lined, sf))
    fps = {r.doc_id: fingerprint(r.text, 5) for r in lined.collect()}
    least = {}
    for k, f in fps.items():
        least[f] = min(k, least.get(f, k))
    left = {r.doc_id for r in near.collect()}
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    texts = {r.doc_id: r.text for r in lined.collect()}
    for k in set(fps) - left:  # each that went has a near copy among those before it
        assert any(j < k and (fps[j] ^ fps[k]).bit_count() <= 2 for j in fps)
    for k in left:
        for j in left:
            if j < k and (fps[j] ^ fps[k]).bit_count() <= 2:
                a, b = shingles(texts[j]), shingles(texts[k])
                assert len(a & b) < 0.8 * len(a | b)

    clean = keep(stages["decontaminate"](spark, near, sf))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {eval(x)[0]: eval(x) for x in windows_hit([(r.doc_id, r.text) for r in near.collect()], bench)}
    assert {r.doc_id for r in clean.collect()} == {k for k, x in hits.items() if not x[5]}
    before = {r.doc_id: r.text for r in near.collect()}
    assert all((r.text == before[r.doc_id]) == (hits[r.doc_id][2] == 0) for r in clean.collect())

    check_pieces_without_ids(clean, stages["pack"](spark, clean, sf).collect())


def check_pieces_without_ids(docs, pieces):
    from jsonloom.llm import packing

    found = packing.pack(docs).collect()
    check_pieces(docs, found)
    assert sorted(repr(tuple(p)[:-1]) for p in found) == sorted(repr(tuple(p)) for p in pieces)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100


def test_odd(spark, odd, none, sf, tmp_path):
    """What each stage keeps of rows with nulls, ties, repeats and long texts, by brute force, with all columns as they were."""
    from jsonloom.llm import langid
    from test_minhash import jaccard, shingles

    stages, others = dict(corpus_pipeline.STAGES), [c for c in odd.columns if c not in COLUMNS]
    rows = [r.asDict() for r in odd.collect()]
    found = {repr(sorted(r.items(), key=str)) for r in rows}
    whole = lambda docs: sorted(repr(sorted(r.asDict().items(), key=str)) for r in docs.collect())

    kept = stages["language"](spark, odd, sf)
    scores = langid.identify(odd, langid.fit(odd.where("not coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)"))).collect()
    assert kept.columns == odd.columns and set(whole(kept)) <= found
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in scores if r.lang_pred != "und" and r.score >= 0.5)

    lined = stages["lines"](spark, odd, sf).collect()
    texts = {}
    for x in lines_gone([(r["doc_id"], r["text"]) for r in rows], 1, 0):
        k, n, m, at = eval(x)
        texts.setdefault(k, []).append((n, {int(i) for i in at.split(",") if i}))
    cut = lambda r: next((n, gone) for n, gone in texts[r["doc_id"]] if n == sum(bool(x.strip(" \t\r\x0b\x0c")) for x in (r["text"] or "").split("\n")))
    singles = [r for r in rows if len(texts[r["doc_id"]]) == 1]
    want = [(r["doc_id"], r["text"] if not cut(r)[1] else "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in cut(r)[1])) for r in singles if not cut(r)[0] or len(cut(r)[1]) < cut(r)[0]]
    of_singles = {repr(r["doc_id"]) for r in singles}
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text)) for r in lined if repr(r.doc_id) in of_singles)
    assert all(r[c] == rows[0][c] for r in lined for c in others)

    near = stages["near_duplicates"](spark, odd, sf)
    left = near.collect()
    assert set(whole(near)) <= found and near.columns == odd.columns
    for i, a in enumerate(left):  # none that stays is like another, all that go are like one that stays
        assert all(jaccard(shingles(a.text or ""), shingles(b.text or "")) < 0.8 for b in left[:i])
    assert all(any(jaccard(shingles(r["text"] or ""), shingles(b.text or "")) >= 0.8 for b in left) for r in rows)

    some = rows[4]["text"].split()
    spark.createDataFrame([(1, " ".join(some[20:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = stages["decontaminate"](spark, odd, str(tmp_path))
    hits = {eval(x)[0]: eval(x) for x in windows_hit([(r["doc_id"], r["text"]) for r in rows], [(1, " ".join(some[20:50]))])}
    assert sorted(whole(clean)) == sorted(repr(sorted(r.items(), key=str)) for r in rows if some[20] not in (r["text"] or "") or " ".join(some[20:50]) not in r["text"])
    assert hits[5][5] and clean.columns == odd.columns
    half = odd.selectExpr(*[f"`{c}`" if c != "text" else "concat(text, repeat(' fill', 2000)) text" for c in odd.columns])
    cut_rows = stages["decontaminate"](spark, half, str(tmp_path)).where("doc_id = 5").collect()
    assert cut_rows[0].text.split() == some[:20] + some[50:] + ["fill"] * 2000 and cut_rows[0].n_chars == len(cut_rows[0].text)

    check_pieces_without_ids(odd, stages["pack"](spark, odd, sf).collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == []


def test_near_duplicates_are_all_that_brute_force_finds(spark, sf):
    import random

    from test_minhash import brute_classes, near_copies

    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(near_copies(random.Random(6), 3, 20))]
    same = "0 " * 50  # most five-word runs are one and the same, the rest are not: equal fingerprints
    rows += [(100 + k, same + " ".join(f"u{k}x{i}" for i in range(40)), "en", "a", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf).collect()}
    assert left == set(brute_classes([r[:2] for r in rows]).values())


def test_rows_that_share_a_doc_id(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (1, b, "en", "a", 1), (2, a, "en", "a", 1), (None, b, "en", "a", 1), (None, c, "en", "a", 1), (None, c, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf).collect()
    assert sorted(map(repr, left)) == sorted(map(repr, docs.where("doc_id = 1 or text like 'c%'").distinct().collect()))


def test_near_duplicates_of_near_fingerprints_need_no_band(spark, sf, monkeypatch):
    import random

    from jsonloom.llm import minhash
    from test_minhash import jaccard, shingles

    monkeypatch.setattr(minhash, "BANDS", 1)  # the whole signature: only sets that agree in all of it meet
    rng, texts = random.Random(2), []
    for g in range(4):
        words = [f"w{g}x{i}" for i in range(300)]
        texts.append(" ".join(words))
        for _ in range(3):  # one word changed, fingerprint within two bits
            copy = texts[-1]
            while (fingerprint(copy, 5) ^ fingerprint(" ".join(words), 5)).bit_count() > 2 or copy in texts:
                i = rng.randrange(300)
                copy = " ".join([*words[:i], f"v{rng.randrange(10**6)}", *words[i + 1 :]])
            assert jaccard(shingles(copy), shingles(" ".join(words))) > 0.9
            texts.append(copy)
    signatures = {minhash.signature(minhash.shingle_hashes(t.encode(), minhash.Words())).tobytes() for t in texts}
    assert len(signatures) > 10
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in left) == [0, 4, 8, 12]
