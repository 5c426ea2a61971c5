import random

import pytest

from jsonloom.llm import linedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, line, edits):
    out = bytearray(line)
    for _ in range(edits):
        i = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 1 / 3:
            out.insert(i, rng.choice(b"abc"))
        elif out:
            i = min(i, len(out) - 1)
            if kind < 2 / 3:
                del out[i]
            else:
                out[i] = rng.choice(b"abc")
    return bytes(out)


def test_distance_and_segments():
    rng = random.Random(1)
    for _ in range(4000):
        tau = rng.randint(1, 4)
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14)))
        b = mutated(rng, a, rng.randint(0, 5))
        near = distance(a, b) <= tau
        assert linedup.within(a, b, tau) is near
        if near and a != b and min(len(a), len(b)) > tau:
            for keys in [linedup.segment_keys([a, b], tau, 0)] + [linedup.finer_keys([a, b], m, 0) for m in (2, 3, 7, 40)] * (tau == 1):
                at = lambda row, index, keys=keys: {k for r, k, s in zip(*keys) if r == row and s >= index}
                assert at(0, 1) & at(1, 0) or at(1, 1) & at(0, 0), (a, b, tau)


def brute(rows, tau, fuzzy):
    """rows: doc_id, text. The documents' removed positions, by all pairs of lines."""
    lines = {}
    for k, text in rows:
        for pos, line in enumerate((text or "").encode().split(b"\n")):
            line = line.strip(linedup.BLANKS)
            if line:
                lines.setdefault(line, []).append((k is not None, k if k is not None else 0, pos))
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted((x for x in lines if len(x) >= fuzzy), key=len)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if len(b) - len(a) > tau:
                break
            if (len(a) < 400 or a[:50] == b[:50] or a[-50:] == b[-50:]) and linedup.within(a, b, tau):
                root[find(a)] = find(b)
    first = {}
    for x, places in lines.items():
        first[find(x)] = min([*places, *([first[find(x)]] if find(x) in first else [])])
    out = []
    for k, text in rows:
        found = [x.strip(linedup.BLANKS) for x in (text or "").encode().split(b"\n")] if text else []
        gone = [p for p, x in enumerate(found) if x and first[find(x)] != (k is not None, k if k is not None else 0, p)]
        out.append((k, sum(map(bool, found)), len(gone), ",".join(map(str, gone))))
    return sorted(map(repr, out))


def result(docs, tau=linedup.TAU, fuzzy=linedup.FUZZY):
    return sorted(repr((r.doc_id, r.n_lines, len(r.removed or []), ",".join(map(str, r.removed or [])))) for r in linedup.removals(docs, tau, fuzzy).collect())


def test_documents(documents, rows):
    assert result(documents) == brute([(r[0], r[1]) for r in rows], 1, 0)


def test_odd(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()], 1, 0)


@pytest.mark.parametrize("hot", [2, 64])
def test_short_lines_match_like_long_ones(spark, monkeypatch, hot):
    monkeypatch.setattr(linedup, "HOT", hot)
    base = ["nineteen bytes line", "twenty bytes of line", "yes", "a", "0123456789"]
    lines = [*base, "nineteen bytes linE", "twenty bytes of linE", "yet", "b", "ab", "é", "0123456789x", "something else", "012345678"]
    rows = list(enumerate(lines)) + [(50, "\n".join(lines))]
    rows += [(100 + k, "\n".join(c * n for n in range(1, 5))) for k, c in enumerate("pqrstuvwxyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == brute(rows, 1, 0)


def test_none(none):
    assert result(none) == []
    assert linedup.without_lines(none).collect() == []


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_near_lines(spark, tau):
    rng = random.Random(tau)
    base = [bytes(rng.choice(b"abcd ef") for _ in range(rng.randint(6, 40))).strip() or b"x" for _ in range(25)]
    rows = [(k, "\n".join(mutated(rng, rng.choice(base), rng.randint(0, 4)).decode() for _ in range(rng.randint(0, 5)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs, tau, 8) == brute(rows, tau, 8)


def test_hot_segments_go_to_finer_indexes(spark, monkeypatch):
    monkeypatch.setattr(linedup, "HOT", 5)
    rng = random.Random(8)
    half = "the same long beginning of many lines "
    rows = [(k, half + "".join(rng.choice("abcdefgh") for _ in range(30)) + half[::-1]) for k in range(60)]
    rows += [(100 + k, rows[0][1][:50] + c + rows[0][1][51:]) for k, c in enumerate("ijklmnopqrstuvwxyz")]  # a star at one byte
    rows += [(200 + k, rows[k][1][:60] + "!" + rows[k][1][60:]) for k in range(0, 60, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == brute(rows, 1, 0)


@pytest.mark.parametrize("tau", [2, 3])
def test_hot_keys_for_more_edits(spark, monkeypatch, tau):
    monkeypatch.setattr(linedup, "HOT", 3)
    monkeypatch.setattr(linedup, "BLOCK", 16)
    monkeypatch.setattr(linedup, "BLOCK_BYTES", 2000)
    rng = random.Random(tau)
    half = "the same long beginning of many lines "
    rows = [half + "".join(rng.choice("abcd") for _ in range(8)) + half[::-1] for k in range(60)]
    rows += [mutated(rng, rng.choice(rows[:60]).encode(), rng.randint(1, tau + 1)).decode() for _ in range(60)]
    rows += ["", "x", "xy", "xyz", half * 40, half * 40 + "ab", None] + rows[:3]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs, tau, 0) == brute(rows, tau, 0)


def test_text_without_lines(spark):
    rows = [(1, "first line that is long enough\nsecond\n\nshared line of this and that"), (2, "shared line of this and thaT\nown words here and there"), (3, "shared line of this and that"), (4, None), (5, "")]
    out = {r.doc_id: (r.text, r.n_chars) for r in linedup.without_lines(spark.createDataFrame([(k, t, len(t or "")) for k, t in rows], "doc_id long, text string, n_chars long")).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("own words here and there", 24), 4: (None, 0), 5: ("", 0)}


@pytest.mark.parametrize("hot", [5, 64])
def test_hot_keys_of_lines_of_two_lengths(spark, monkeypatch, hot):
    monkeypatch.setattr(linedup, "HOT", hot)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    rows = []
    for where in ("north", "south", "east", "west", "upper", "lower"):
        gate = f"The parcel was left at gate {{}} by the {where} entrance"
        rows += [gate.format(x) for x in letters] + [gate.format(x + y) for x, y in zip(letters + letters[:12], "0123456789" * 7)]
        rows += [gate.format(x) for x in ("%&", "%&/", "%&/(", "é")]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert result(docs) == brute(list(enumerate(rows)), 1, 0)
