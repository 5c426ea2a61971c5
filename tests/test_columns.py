import json
import math

import pytest
from pyspark.sql import functions as F

from jsonloom.functions import columns as C
from jsonloom.functions.grammar import JsonSyntaxError  # noqa: F401
from jsonloom.plans.rewrite import Get, with_gets

DOCS = ['{"a":[1,{"b":"x\\u00e9"}],"n":1.50,"n":2}', "[1, 2.0 ,null]", " true ", '"t\\n"', "12", "-0", "1e400", "18446744073709551615", "9223372036854775808", "1.0", "{bad", "", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string")


def col(docs, c):
    return [r[0] for r in docs.orderBy("id").select(c.alias("x")).collect()]


def test_validity(docs):
    assert col(docs, C.json_valid("doc")) == [True] * 10 + [False, False, None]
    found = col(docs, C.json_validate("doc"))
    assert found[0].ok and found[0].offset is None
    assert (found[10].ok, found[10].offset, found[10].line, found[10].column, found[10].message) == (False, 1, 1, 2, "expected object key string")
    assert found[11].message == "expected value" and found[12] is None
    assert col(docs, C.json_entry_count("doc")) == [11, 4, 1, 1, 1, 1, 1, 1, 1, 1, None, None, None]


def test_selection(docs):
    none = [None] * 12
    assert col(docs, C.json_get("doc", "/a/1/b")) == ['"x\\u00e9"', *none]
    assert col(docs, C.json_get("doc", "/n")) == ["2", *none]
    assert col(docs, C.json_get_first("doc", "/n")) == ["1.50", *none]
    assert col(docs, C.json_get("doc", "/1"))[:2] == [None, "2.0"]
    assert col(docs, C.json_get_key("doc", "n"))[0] == "2"
    assert col(docs, C.json_get_index("doc", 1))[:2] == [None, "2.0"]
    assert col(docs, C.json_get_index("doc", -1))[1] is None
    assert col(docs, C.json_fields("doc", ["n", "n", "a"]))[0] == ["1.50", "2", '[1,{"b":"x\\u00e9"}]']
    row = col(docs, C.json_extract_many("doc", {"first": "/a/0", "n": "/n"}))[0]
    assert (row["first"], row["n"]) == ("1", "2")
    assert col(docs, C.json_to_map_raw("doc"))[0] == {"a": '[1,{"b":"x\\u00e9"}]', "n": "2"}
    assert col(docs, C.json_elements("doc"))[1] == ["1", "2.0", "null"]
    assert [tuple(m) for m in col(docs, C.json_members("doc"))[0]] == [("a", '[1,{"b":"x\\u00e9"}]'), ("n", "1.50"), ("n", "2")]


def test_scan_first_leaves_the_tail_alone(spark):
    df = spark.createDataFrame([(0, '{"a":1,"b":'), (1, '{"b":[1,')], "id int, doc string")
    assert col(df, C.json_get_first("doc", "/a")) == ["1", None]
    assert col(df, C.json_get("doc", "/a")) == [None, None]


def test_column_gather(spark):
    df = spark.createDataFrame([(0, '[{"k":1.10},{"j":2},5,{"k":null}]'), (1, "{}")], "id int, doc string")
    assert col(df, C.json_column("doc", "k")) == [["1.10", None, None, "null"], None]


def test_failfast(docs):
    with pytest.raises(Exception, match="expected object key string"):
        docs.where("id = 10").select(C.json_get("doc", "/a", mode=C.FAILFAST)).collect()
    with pytest.raises(Exception, match="leading zero"):
        docs.limit(1).select(C.json_get("doc", "/a/01", mode=C.FAILFAST)).collect()


def test_accessors(docs):
    assert col(docs, C.json_kind("doc")) == ["object", "array", "bool", "string", "number", "number", "number", "number", "number", "number", "object", "invalid", "invalid"]
    assert col(docs, C.json_bool("doc"))[2] is True
    assert col(docs, C.json_int64("doc"))[3:10] == [None, 12, 0, None, None, None, None]
    assert [None if x is None else int(x) for x in col(docs, C.json_uint64("doc"))[4:10]] == [12, None, None, 2**64 - 1, 2**63, None]
    floats = col(docs, C.json_float64("doc"))
    assert floats[4] == 12.0 and math.copysign(1, floats[5]) == -1 and floats[6] is None and floats[9] == 1.0
    assert col(docs, C.json_number_text("doc"))[6:10] == ["1e400", "18446744073709551615", "9223372036854775808", "1.0"]
    assert col(docs, C.json_is_integer("doc"))[4:] == [True, True, False, True, True, False, False, False, False]
    assert col(docs, C.json_text("doc"))[2:5] == [None, "t\n", None]
    assert col(docs, C.json_string_bytes("doc"))[3] is None
    assert col(docs, C.json_array_len("doc"))[:3] == [None, 3, None]
    assert col(docs, C.json_object_len("doc"))[:2] == [3, None]
    assert col(docs, C.json_is_null("doc"))[:2] == [False, False]


def test_numbers_do_not_end_before_a_line_feed(spark):
    df = spark.createDataFrame([(0, "7\n8"), (1, "NaN"), (2, "1d"), (3, "+7")], "id int, doc string")
    for f in (C.json_int64, C.json_float64, C.json_number_text, C.json_uint64):
        assert col(df, f("doc")) == [None] * 4


def test_predicates(docs, spark):
    assert col(docs, C.json_contains("doc", '{"a":[{"b":"xé"}],"n":2.0}'))[:3] == [True, False, False]
    pairs = spark.createDataFrame([(0, "[1.0]", "1"), (1, None, "1"), (2, "{", "1")], "id int, a string, b string")
    assert col(pairs, C.json_contains(F.col("a"), F.col("b"))) == [True, None, None]
    numbers = spark.createDataFrame([(0, "1.0"), (1, "1"), (2, "10e-1"), (3, '"1"')], "id int, doc string")
    assert numbers.groupBy(C.json_number_canon("doc").alias("n")).count().where("n = '1e0'").first()["count"] == 3


def test_transforms(docs):
    assert col(docs, C.json_compact("doc"))[1] == "[1,2.0,null]"
    assert col(docs, C.json_indent("doc", "", " "))[1] == "[\n 1,\n 2.0,\n null\n]"
    assert col(docs, C.json_canonicalize("doc"))[0] == '{"a":[1,{"b":"xé"}],"n":1.50,"n":2}'
    assert col(docs, C.json_normalize("doc"))[10:12] == ["null", "null"]
    kept = docs.select(F.to_json(C.json_to_variant("doc", numbers="string")).alias("x"), "id").orderBy("id").collect()
    assert json.loads(kept[0].x) == {"a": ["1", {"b": "xé"}], "n": "2"}


def test_constructors(spark):
    df = spark.range(1)
    out = df.select(C.json_object("a<", F.lit("1"), "b", C.json_array(F.lit("true"), F.lit(None), C.json_quote(F.lit('q"<'))))).first()[0]
    assert json.loads(out) == {"a<": 1, "b": [True, None, 'q"<']}
    with pytest.raises(ValueError):
        C.json_object("a")


def test_shared_pass(docs):
    out = with_gets(docs, {"first": Get("doc", "/a/0", C.json_int64), "n": Get("doc", "/n"), "again": Get("doc", "/n", C.json_float64)})
    assert out.columns == ["id", "doc", "first", "n", "again"]
    assert out.where("id = 0").select("first", "n", "again").first() == (1, "2", 2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pushdown_past_the_functions(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'").select(C.json_get("props", "/k").alias("k"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "ReadSchema: struct<event_type:string,props:string>" in plan


def test_sql(spark):
    from jsonloom.functions.sql import register

    names = register(spark)
    assert {"json_get", "json_each_array", "json_kind"} <= set(names)
    row = spark.sql("""SELECT json_get('{"a":[1.50]}', '/a/0') a, json_valid('[1,]') v, json_contains('[1.0]', '1') c, json_kind(' "x"') k, json_int64('7') i, json_bool('true') b""").first()
    assert tuple(row) == ("1.50", False, True, "string", 7, True)
    rows = spark.sql("""SELECT d.id, e.* FROM VALUES (1, '[1,"a"]'), (2, '[]') d(id, doc), LATERAL json_each_array(doc) e""").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "1", "number"), (1, 1, '"a"', "string")]


def test_one_python_pass(spark, sf):
    """Joins and filters on a selected key evaluate it once."""
    from jsonloom import catalog

    for name in ("json_key_join", "json_key_semi", "json_get_group_count", "json_get_array_index", "json_range_join", "json_each_array_explode"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


def test_get_first_leaves_early_and_validates_what_it_has_passed(spark):
    import random

    from jsonloom.functions import grammar as G
    from jsonloom.functions import pointer as P
    from jsonloom.functions import spans as S

    rng = random.Random(9)
    pieces = ['{"a":', "[1,", '"b"', ":", ",", "]", "}", "1", "tru", "true", "null", '"a"', " ", "{}", "[]", '"\\ud800"', '"\\u0061":', "01", '{"a":{"a":1},"a":[2,3]}']
    pointers = [P.compile_pointer(p) for p in ("", "/a", "/a/a", "/a/1", "/0", "/a/x", "/1/a")]

    def slowly(text, pointer):
        try:
            tape = G.parse(text.encode())
            i = P.get_first(tape, pointer)
            return None if i is None else tape.raw(i).decode()
        except P.PointerError:
            return "index"
        except G.JsonSyntaxError as e:
            if e.tape is not None and len(e.tape):
                try:
                    i = P.get_first(e.tape, pointer)
                except P.PointerError:
                    return "index"
                if i is not None and e.tape.end[i] >= 0:
                    return e.tape.raw(i).decode()
            return "fault"

    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        pointer = rng.choice(pointers)
        try:
            got = S.get_first(text, pointer)
        except S.Unsure:
            continue
        assert got == slowly(text, pointer), (text, pointer.text)
    assert S.get_first('{"a":1,"b":oops', P.compile_pointer("/a")) == "1"


def test_contains_join_against_all_pairs(spark):
    import random

    from jsonloom.functions import documents as D
    from jsonloom.operators.containment import contains_join

    rng = random.Random(4)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.5:
            return rng.choice(["1", "1.0", "2", '"a"', '"\\u0061"', "true", "null", "10e-1"])
        if kind < 0.75:
            return "[" + ",".join(value(depth - 1) for _ in range(rng.randint(0, 3))) + "]"
        return "{" + ",".join(f'"{rng.choice("ab")}":{value(depth - 1)}' for _ in range(rng.randint(0, 3))) + "}"

    docs = [(i, value(3)) for i in range(120)] + [(900, None), (901, "[1,")]
    needles = [(i, value(2)) for i in range(60)] + [(900, None), (901, "{")]
    found = contains_join(spark.createDataFrame(docs, "d int, doc string"), "doc", spark.createDataFrame(needles, "n int, needle string"), "needle")
    want = [(i, j) for i, a in docs[:-2] for j, b in needles[:-2] if D.contains(D.model(a), D.model(b))]
    assert sorted((r.d, r.n) for r in found.collect()) == sorted(want) and len(want) > 100


def test_terms_of_deep_documents_take_linear_time():
    import time

    from jsonloom.operators.containment import probe, terms

    key = "k" * 1000
    deep = "".join(f'{{"{key}{i}":' for i in range(9000)) + "1" + "}" * 9000
    start = time.process_time()
    assert probe(deep) in terms(deep) and len(terms(deep)) == 9001
    assert time.process_time() - start < 10


def test_sql_functions(spark):
    from jsonloom.functions.sql import register

    register(spark)
    row = spark.sql("""SELECT json_text('"a\\\\u0062"') t, json_text('1') none, json_float64(' 1e2 ') f, json_float64('1e999') inf, json_uint64('18446744073709551615') u, json_uint64('-0') minus,
        json_number_text('1.50') n, json_array_len('[1,[2]]') l, json_object_len('{"a":1,"a":2}') m, json_get_key('{"a":1,"a":2}', 'a') k, json_get_index('[5,6]', '1') i,
        json_members('{"a":[1]}')[0].value v, json_is_null(' null') z, json_is_integer('1.0') w, json_encode(named_struct('a', 1, 'b', array('x'))) e, json_get('[1', '/0') bad""").first()
    assert (row.t, row.none, row.f, row.inf, int(row.u), row.minus, row.n, row.l, row.m, row.k, row.i) == ("ab", None, 100.0, None, 2**64 - 1, None, "1.50", 2, 2, "2", "6")
    assert (row.v, row.z, row.w, row.e, row.bad) == ("[1]", True, False, '{"a":1,"b":["x"]}', None)
