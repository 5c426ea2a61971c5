import json
import os
import random

import pytest

from jsonloom.functions import documents as D
from jsonloom.functions import grammar as G
from jsonloom.functions import numbers as N
from jsonloom.functions import pointer as P
from jsonloom.functions import spans as S

#: Documents and verdicts by the grammar of RFC 8259.
ACCEPTED = ["null", " true ", "0", "-0", "1e99999", "-1.5E+3", '""', '"\\u00e9\\n"', '"\\ud83d\\ude00"', "[]", "{}", "[1,[2],{}]", '{"a":1,"a":2}', "\t[\r\n]\n", '" "', "[0.1e-5]"]
REJECTED = ["", " ", "nul", "True", "NaN", "Infinity", "-", "+1", "01", "1.", ".5", "1e", "1e+", "0x1", "[1,]", "[,1]", "[1 2]", "[", "]", "{", '{"a"}', '{"a":}', '{"a":1,}', "{a:1}", "{1:2}", "'a'", '"a', '"\\x"', '"\\u12"', '"\\ud800"', '"\\ud800\\u0041"', '"\\udc00"', '"\t"', "1 2", "[1] x", "﻿1", "/**/1", "\x0c1", "\xa01"]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(text):
    assert G.valid(text)
    G.parse(text.encode())


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    assert not G.valid(text)
    with pytest.raises(G.JsonSyntaxError):
        G.parse(text.encode())


@pytest.mark.parametrize(
    ("text", "offset", "line", "column", "message"),
    [
        ("", 0, 1, 1, "expected value"),
        ("[1,", 3, 1, 4, "expected value"),
        ('{"a":1,}', 7, 1, 8, "expected object key string"),
        ('{"a" 1}', 5, 1, 6, "expected colon after object key"),
        ('{"a":1 2}', 7, 1, 8, "expected comma or closing brace in object"),
        ("[1 2]", 3, 1, 4, "expected comma or closing bracket in array"),
        ("[1", 2, 1, 3, "unterminated array"),
        ('{"a":1', 6, 1, 7, "unterminated object"),
        ("tru", 0, 1, 1, "invalid literal"),
        ("-x", 0, 1, 1, "invalid number"),
        ("[1.]", 1, 1, 2, "invalid number fraction"),
        ("1e", 0, 1, 1, "invalid number exponent"),
        ('"abc', 4, 1, 5, "unterminated string"),
        ('"\\', 2, 1, 3, "unterminated escape sequence"),
        ('"\\q"', 1, 1, 2, "invalid escape sequence"),
        ('"\\u12"', 1, 1, 2, "invalid unicode escape"),
        ('"\\ud800x"', 1, 1, 2, "missing low surrogate"),
        ('"\\ud800\\u0041"', 1, 1, 2, "invalid low surrogate"),
        ('"\\udc00"', 1, 1, 2, "unexpected low surrogate"),
        ('"a\nb"', 2, 1, 3, "unescaped control byte in string"),
        ("[é", 1, 1, 2, "unexpected byte 'Ã' while parsing value"),
        ("\n\n x", 3, 3, 2, "unexpected byte 'x' while parsing value"),
        ("1 2", 2, 1, 3, "unexpected data after top-level value"),
        ('["é", x]', 7, 1, 8, "unexpected byte 'x' while parsing value"),  # bytes, not characters
    ],
)
def test_diagnosis(text, offset, line, column, message):
    with pytest.raises(G.JsonSyntaxError) as e:
        G.parse(text.encode())
    assert (e.value.offset, e.value.line, e.value.column, e.value.message) == (offset, line, column, message)


def test_invalid_utf8():
    with pytest.raises(G.JsonSyntaxError) as e:
        G.parse(b'"ok \xc3\xa9 \xff"')
    assert (e.value.offset, e.value.message) == (7, "invalid UTF-8 in string")
    with pytest.raises(G.JsonSyntaxError):
        G.parse(b'"\xed\xa0\x80"')


@pytest.mark.parametrize(("depth", "ok"), [(9_999, True), (10_000, True), (10_001, False)])
def test_depth(depth, ok):
    text = "[" * depth + "]" * depth
    assert G.valid(text) is ok
    objects = '{"a":' * depth + "1" + "}" * depth
    assert G.valid(objects) is ok


def document(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.5:
        return rng.choice([None, True, False, rng.randint(-(10**20), 10**20), rng.random() * 10 ** rng.randint(-9, 9), "".join(rng.choice('ab"\\/\n\té😀 <') for _ in range(rng.randint(0, 6)))])
    if kind < 0.75:
        return [document(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{rng.randint(0, 9)}": document(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_properties_of_random_documents():
    rng = random.Random(4)
    for _ in range(400):
        value = document(rng)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        data = text.encode()
        tape = G.parse(data)
        assert G.valid(text) and json.loads(tape.raw(0)) == value
        assert json.loads(D.compact(data)) == value
        for prefix, step in (("", "  "), ("\t", " ")):
            assert D.compact(D.indent(data, prefix, step)) == D.compact(data)
        canonical = D.canonicalize(data)
        assert D.canonicalize(canonical.encode()) == canonical and json.loads(canonical) == value
        assert D.contains(D.model(text), D.model(text))
        # every truncation and every changed byte agrees between the two parsers
        for _ in range(5):
            cut = text[: rng.randint(0, len(text))]
            if rng.random() < 0.5 and cut:
                i = rng.randrange(len(cut))
                cut = cut[:i] + rng.choice('{}[],:"0e.-\\ux ') + cut[i + 1 :]
            try:
                G.parse(cut.encode())
                ok = True
            except G.JsonSyntaxError:
                ok = False
            assert G.valid(cut) is ok, cut


def test_tape_counts():
    tape = G.parse(b'{"a":[1,{"b":null}],"c":"x"}')
    assert len(tape) == 1 + 2 * 3 + 2
    assert [tape.count[i] for i in range(len(tape)) if tape.kind[i] in (G.ARRAY, G.OBJECT)] == [2, 2, 1]


RFC = '{"foo": ["bar", "baz"], "": 0, "a/b": 1, "c%d": 2, "e^f": 3, "g|h": 4, "i\\\\j": 5, "k\\"l": 6, " ": 7, "m~n": 8}'


@pytest.mark.parametrize(
    ("pointer", "raw"),
    [("", RFC), ("/foo", '["bar", "baz"]'), ("/foo/0", '"bar"'), ("/", "0"), ("/a~1b", "1"), ("/c%d", "2"), ("/e^f", "3"), ("/g|h", "4"), ("/i\\j", "5"), ('/k"l', "6"), ("/ ", "7"), ("/m~0n", "8"), ("/foo/-", None), ("/foo/2", None), ("/foo/0/x", None), ("/nope", None)],
)
def test_pointers(pointer, raw):
    tape = G.parse(RFC.encode())
    for find in (P.get, P.get_first):
        at = find(tape, P.compile_pointer(pointer))
        assert (None if at is None else tape.raw(at).decode()) == raw


@pytest.mark.parametrize("pointer", ["/foo/01", "/foo/00", "/foo/1e0", "/foo/ 1", "/foo/-1", "/foo/99999999999999999999"])
def test_bad_indexes(pointer):
    with pytest.raises(P.PointerError):
        P.get(G.parse(RFC.encode()), P.compile_pointer(pointer))


@pytest.mark.parametrize("pointer", ["foo", "/a~", "/a~2", "~0"])
def test_bad_pointers(pointer):
    with pytest.raises(P.PointerError):
        P.compile_pointer(pointer)


@pytest.mark.parametrize(
    ("doc", "pointer", "raw"),
    [('{"~1":5,"~01":6,"/":7}', "/~01", "5"), ('{"~1":5,"~01":6,"/":7}', "/~1", "7"), ('{"0":10,"01":11,"-":12,"1e0":13}', "/01", "11"), ('{"0":10,"01":11,"-":12}', "/-", "12"), ('{"caf\\u00e9":1}', "/café", "1"), ('{"g\\uD834\\uDD1Eclef":3}', "/g\U0001d11eclef", "3"), ('{"":{"":[5,6]}}', "///1", "6"), ("5", "/a", None)],
)
def test_pointer_keys(doc, pointer, raw):
    tape = G.parse(doc.encode())
    at = P.get(tape, P.compile_pointer(pointer))
    assert (None if at is None else tape.raw(at).decode()) == raw


@pytest.mark.parametrize(("pointer", "last", "first"), [("/dup", "{}", '{"x":1}'), ("/dup/x", None, "1"), ("/dup/y", None, None), ("", '{"dup":{"x":1},"dup":{}}', '{"dup":{"x":1},"dup":{}}')])
def test_duplicates(pointer, last, first):
    tape = G.parse(b'{"dup":{"x":1},"dup":{}}')
    for find, want in ((P.get, last), (P.get_first, first)):
        at = find(tape, P.compile_pointer(pointer))
        assert (None if at is None else tape.raw(at).decode()) == want


def test_field_cursor():
    tape = G.parse(b'{"a":1,"b":2,"a":3}')
    cursor = P.FieldCursor(tape)
    found = [cursor.find(k) for k in ("a", "a", "a", "b", "x", "a")]
    assert [None if i is None else tape.raw(i) for i in found] == [b"1", b"3", b"1", b"2", None, b"1"]


@pytest.mark.parametrize(("a", "b"), [("1", "1.0"), ("1e2", "100"), ("-0", "0"), ("0.10", "1e-1"), ("1e400", "10e399"), ("123456789012345678901234567890", "1.2345678901234567890123456789e29"), ("1e-99999999999999999999", "10e-100000000000000000000")])
def test_equal_numbers(a, b):
    assert N.canonical(a) == N.canonical(b)


def test_different_numbers():
    spellings = ["0", "1", "-1", "10", "0.1", "1e400", "1e401", "9007199254740992", "9007199254740993", "1e" + "9" * 5000]
    assert len({N.canonical(x) for x in spellings}) == len(spellings)


@pytest.mark.parametrize(("value", "text"), [(1.0, "1"), (-0.0, "-0"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1e-6, "0.000001"), (1e-7, "1e-7"), (123.456, "123.456"), (5e-324, "5e-324"), (1.5e300, "1.5e+300")])
def test_float_text(value, text):
    assert N.float_text(value) == text and float(text) == value


def test_float_text_round_trip():
    rng = random.Random(9)
    for _ in range(3000):
        x = rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300)
        assert float(N.float_text(x)) == x
    assert N.float_text(0.1, 32) == "0.1"
    with pytest.raises(ValueError):
        N.float_text(float("nan"))


@pytest.mark.parametrize(
    ("source", "want"),
    [('{"a":1e2,"b":-0,"c":1.50,"d":100}', '{"a":1e2,"b":-0,"c":1.50,"d":100}'), ('{"b":1,"a":9,"a":8}', '{"a":9,"a":8,"b":1}'), ('{"\\u0062":1,"a":2}', '{"a":2,"b":1}'), ('{"b":"  ","a":1}', '{"a":1,"b":"\\u2028\\u2029"}'), ('{"z":{"b":1,"a":2},"y":[{"d":1,"c":2}]}', '{"y":[{"c":2,"d":1}],"z":{"a":2,"b":1}}'), ('{"Z":1,"a":2,"0":3,"~":4}', '{"0":3,"Z":1,"a":2,"~":4}'), ('{"\U0001f600":2,"ﬀ":1}', '{"ﬀ":1,"\U0001f600":2}')],
)
def test_canonicalize(source, want):
    assert D.canonicalize(source.encode()) == want


def test_indent():
    assert D.indent(b' {"a":[1,[]],"b":{}, "c":"x\\/"}\r\n ', "> ", "\t").decode() == '{\n> \t"a": [\n> \t\t1,\n> \t\t[]\n> \t],\n> \t"b": {},\n> \t"c": "x\\/"\n> }\r\n '


#: Haystack, needle, verdict of jsonb containment with exact numbers.
CONTAINMENT = [
    ('{"a":1,"b":2}', '{"a":1}', True), ('{"a":1}', '{"b":1}', False), ('{"a":{"b":1,"c":2}}', '{"a":{"b":1}}', True), ('{"a":{"b":1}}', '{"b":1}', False),
    ('{"a":[1,2]}', '{"a":[2]}', True), ('{"a":[1,2]}', '{"a":1}', False), ("[1,2,3]", "[3,1,1]", True), ("[1.0]", "1", True), ("1", "[1]", False),
    ("[[1,2]]", "[[1]]", True), ("[[1]]", "1", False), ('{"a":1,"a":2}', '{"a":1}', False), ('{"a":1}', '{"a":2,"a":1}', True), ("1e400", "10e399", True),
    ('"\\u0061"', '"a"', True), ("[true]", "[1]", False), ("null", "null", True), ("{}", "[]", False), ("[{}]", "[{}]", True), ('[{"a":1,"b":2}]', '[{"b":2}]', True),
]


@pytest.mark.parametrize(("haystack", "needle", "want"), CONTAINMENT)
def test_containment(haystack, needle, want):
    assert D.contains(D.model(haystack), D.model(needle)) is want


def test_spans_agree_with_the_tape():
    rng = random.Random(6)
    pointers = [P.compile_pointer(x) for x in ("", "/k1", "/k2/0", "/0", "/1/k3", "/k4/k5", "/-", "/k1/k1/k1", "/01")]
    for _ in range(300):
        text = json.dumps(document(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.5:
            text = text.replace('"k2"', '"k1"')
        tape = G.parse(text.encode())
        for pointer in pointers:
            try:
                at = P.get(tape, pointer)
                want = None if at is None else tape.raw(at).decode()
            except P.PointerError:
                with pytest.raises(P.PointerError):
                    S.get(text, pointer)
                continue
            assert S.get(text, pointer) == want
        good = {p.text: p for p in pointers if p.text != "/01"}
        try:
            want = {k: S.get(text, p) for k, p in good.items()}
        except P.PointerError:
            with pytest.raises(P.PointerError):
                S.get_many(text, good)
        else:
            assert S.get_many(text, good) == want
        if text.lstrip()[0] == "{":
            assert [(k, text[a:b]) for k, a, b in S.members(text, 0)] == [(tape.text(k), tape.raw(v).decode()) for k, v in tape.members(0)]


@pytest.mark.skipif("JSON_TEST_SUITE" not in os.environ, reason="JSON_TEST_SUITE names the folder of the public parsing suite's files")
def test_public_parsing_suite():
    """Files y_ are valid, n_ are not; of the i_ ones, which implementations may decide, numbers and nesting are valid here."""
    names = sorted(os.listdir(os.environ["JSON_TEST_SUITE"]))
    assert names
    for name in names:
        with open(os.path.join(os.environ["JSON_TEST_SUITE"], name), "rb") as f:
            data = f.read()
        try:
            got = G.valid(data.decode())
        except UnicodeDecodeError:
            got = False
        assert got == (name[0] == "y" or name.startswith("i_number_") or name == "i_structure_500_nested_arrays.json"), name


def test_a_document_is_checked_once(monkeypatch):
    """The functions of a row share what was found, in bounded memory; faults are found anew."""
    calls = []
    loads = G._loads
    monkeypatch.setattr(G, "_loads", lambda text: calls.append(text) or loads(text))
    text = '{"checked":"once"}'
    assert [G.valid(text) for _ in range(5)] == [True] * 5 and len(calls) == 1
    assert [G.valid("{") for _ in range(2)] == [False] * 2
    for i in range(3 * G._KEPT):
        assert G.valid(f"[{i}]")
    assert len(G._young) + len(G._old) <= 2 * G._KEPT
    long = '"' + "x" * G._LONGEST + '"'
    assert G.valid(long) and long not in G._young


def test_repeated_keys_are_seen():
    for text, want in (('{"a":1,"b":{"a":[{"c":1},{"c":1}]}}', True), ('{"a":1,"a":2}', False), ('[{"b":{"x":1,"\\u0078":2}}]', False), ("{} x", False), ("[NaN]", False), ("7", True), ("{}", True)):
        assert G.surely_distinct(text) is want


def test_children_by_one_match():
    """Sources of members and elements, whatever the depth, are those that a walk finds."""
    rng = random.Random(3)

    def made(depth):
        blank = rng.choice(["", " ", "\n\t"])
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return rng.choice(["1", "-2.50e+3", "true", "null", '"a"', '"]\\\\"', '"{\\","', '"\\u00e9, :"', '"é"', '""'])
        if kind < 6:
            return "[" + blank + (blank + "," + blank).join(made(depth - 1) for _ in range(rng.randrange(4))) + blank + "]"
        return "{" + blank + ",".join(rng.choice(['"k"', '"\\u006b"', '"}"', '"\\""']) + blank + ":" + blank + made(depth - 1) + blank for _ in range(rng.randrange(4))) + "}"

    for _ in range(2000):
        for text, at in ((made(7), 0), (" " + made(7), 1)):
            assert G.valid(text)
            if text[at] == "{":
                assert S.pairs(text, at) == [(text[i:j], text[a:b]) for _, i, j, a, b in S.members_with_keys(text, at)]
            elif text[at] == "[":
                assert S.items(text, at) == [text[a:b] for a, b in S.elements(text, at)]
