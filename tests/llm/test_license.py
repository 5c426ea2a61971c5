import random
import re
import time

import pytest

from jsonloom.llm import license as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(docs):
    want = sorted(repr((r.doc_id, *brute(r.text))) for r in docs.collect())
    got = lic.licenses(docs).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == want
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs)
    check(odd)
    assert lic.licenses(none).collect() == []


@pytest.mark.parametrize("text", ["MIT License", "mit license mit LICENSE", "mit-license, Apache\nLicense", "xmit license", "mit licenses", "GNU general public license general public license", "mit", "license mit license", "é mit license", ""])
def test_places(text):
    n, base, base_labels, *_ = lic.scan(text.encode())
    at = [w for w, _ in base]
    assert (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels))) == brute(text)


@pytest.mark.parametrize(
    ("text", "names", "choices"),
    [
        ("MIT", ["MIT"], ["MIT"]),
        ("MIT OR Apache-2.0", ["Apache-2.0", "MIT"], ["Apache-2.0", "MIT"]),
        ("MIT and ISC or BSD-3-Clause", ["BSD-3-Clause", "ISC", "MIT"], ["BSD-3-Clause", "ISC+MIT"]),
        ("MIT and (ISC or BSD-3-Clause)", ["BSD-3-Clause", "ISC", "MIT"], ["BSD-3-Clause+MIT", "ISC+MIT"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0-only", "MIT"], ["GPL-2.0-only/Classpath-exception-2.0", "MIT"]),
        ("(MIT) */", ["MIT"], ["MIT"]),
    ],
)
def test_expressions(text, names, choices):
    assert lic.evaluate(text) == (names, choices)


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "MIT)", "()", "MIT AND OR ISC"])
def test_malformed(text):
    assert lic.evaluate(text) is None


def test_tags():
    n, base, base_labels, labels, choices, score = lic.scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1+\ncode")
    assert not base and labels == {"mit", "apache", "lgpl"} and score > 0.9
    assert choices == ["Apache-2.0+LGPL-2.1+ | LGPL-2.1++MIT"] or len(choices) == 1


@pytest.mark.parametrize(
    ("tag", "labels"),
    [
        ("whatever I like", set()), ("NOASSERTION", set()), ("NONE", set()), ("MIT OR whatever", set()), ("mitten", set()),
        ("BSD-3-Clause-Clear", {"bsd"}), ("CC-BY-NC-SA-4.0", {"cc"}), ("CC0-1.0", {"cc"}), ("BSL-1.0", {"boost"}), ("GPL-3.0-or-later", {"gpl"}),
        ("Zlib and X11", {"zlib", "x11"}), ("LicenseRef-ours", {"own-terms"}), ("0BSD", {"0bsd"}), ("MPL-2.0+", {"mpl"}), ("MIT-0", {"mit"}),
    ],
)
def test_only_known_licences_count(tag, labels):
    *_, found, choices, score = lic.scan(f"# SPDX-License-Identifier: {tag}".encode())
    assert found == labels and bool(choices) == bool(labels) == (score > 0)


@pytest.mark.parametrize(
    ("text", "short"),
    [
        ("MIT", "MIT"),
        ("mit OR Apache-2.0 or mit", "(Apache-2.0 | mit)"),
        ("(MIT or ISC) and BSD-3-Clause and Zlib", "(BSD-3-Clause+Zlib+(ISC | MIT))"),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", "(GPL-2.0-only/Classpath-exception-2.0 | MIT)"),
        ("(MIT or ISC) with (x-1 and y-1)", "((ISC | MIT)/(x-1+y-1))"),
        ("MIT OR", None),
    ],
)
def test_outlines(text, short):
    assert lic.outline(text) == (short and (set(lic.evaluate(text)[0]), short))


def choices_of(short):
    """All choices of an outline, as evaluate lists them."""
    text = short.replace("(", " ( ").replace(")", " ) ").replace(" | ", " or ").replace("+", " and ").replace("/", " with ")
    return lic.evaluate(text)


def test_outlines_and_choices_agree():
    rng = random.Random(8)

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["MIT", "ISC", "Zlib", "X11", "NTP", "GPL-2.0 with Foo-1"])
        op = rng.choice([" and ", " or "])
        return "(" + op.join(expression(depth - 1) for _ in range(rng.randint(2, 3))) + ")"

    for _ in range(300):
        text = expression(3)
        assert choices_of(lic.outline(text)[1]) == lic.evaluate(text)


@pytest.mark.parametrize(
    "tag",
    [
        " and ".join(f"(mit-{2 * i} or mit-{2 * i + 1})" for i in range(3000)),
        " or ".join(f"gpl-{i}" for i in range(50_000)),
        "(" * 50_000 + "mit" + ")" * 50_000,
        "".join(f"(mit-{i} {'and' if i % 2 else 'or'} " for i in range(20_000)) + "isc" + ")" * 20_000,
        "".join(f"(mit-{i} or " for i in range(20_000)) + "isc" + ")" * 20_000,
    ],
)
def test_long_expressions_take_linear_time(tag):
    start = time.process_time()
    *_, labels, choices, score = lic.scan(f"SPDX-License-Identifier: {tag}".encode())
    assert labels and len(choices) == 1 and len(choices[0]) < 2 * len(tag) and score > 0.9
    assert time.process_time() - start < 5
