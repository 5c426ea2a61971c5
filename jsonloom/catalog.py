"""The library's queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

Only events.props holds JSON there, and only flat objects. Richer documents are put together from integer and plain string
columns, so that their text is the same in Spark and in DuckDB.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonloom.functions import columns as C
from jsonloom.operators import codec as K
from jsonloom.operators.containment import contains_join
from jsonloom.operators.generators import JsonEachArray, JsonEachObject, JsonTape
from jsonloom.plans.rewrite import Get, once, with_gets
from jsonloom.sources import jsonvalues
from jsonloom.sources.splits import read_values_split
from jsonloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: An event as a nested document: spelled numbers, escapes, blanks, nulls, a nested object and an array of objects.
DOC_SQL = """'{ "id":' || event_id || ',"u":{"id":' || user_id || ',"n":null} , "t":["' || event_type || '",' || (event_id % 7) || ',true,[ ]],"s":"a\\u00e9\\"b",
"f":' || (event_id % 100) || '.50,"items":[{"k":' || (event_id % 5) || '},{"j":1},{"k":"' || event_type || '"}],"p":' || props || '}'"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Events by their key, four tasks a core: where Python does most of the work, a file of few row groups must not leave cores idle."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "event_id")


def _text(*parts: str) -> Column:
    """Literals and, where a part starts with =, SQL expressions, one after the other."""
    return F.concat(*[F.expr(p[1:]).cast("string") if p.startswith("=") else F.lit(p) for p in parts])


def document() -> Column:
    return _text(
        '{ "id":', "=event_id", ',"u":{"id":', "=user_id", ',"n":null} , "t":["', "=event_type", '",', "=event_id % 7",
        ',true,[ ]],"s":"a\\u00e9\\"b",\n"f":', "=event_id % 100", '.50,"items":[{"k":', "=event_id % 5", '},{"j":1},{"k":"', "=event_type", '"}],"p":', "=props", "}",
    )


def docs(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    e = events(spark, sf_dir)
    return (spread(e) if even else e).select("event_id", "user_id", "event_type", document().alias("doc"))


WITH_DOCS = f"WITH d AS (SELECT event_id, user_id, event_type, {DOC_SQL} AS doc FROM events) "


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


# Validity


@query("SELECT json_extract_string(props, '/k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_get_group_count(spark, sf):
    e = events(spark, sf).select(once(C.json_checked_get("props", "/k")).alias("x")).where("x.valid")
    return e.groupBy(F.col("x.value").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS n_valid FROM events GROUP BY 1""")
def json_valid_count(spark, sf):
    broken = F.when(F.expr("event_id % 3 = 0"), F.concat(document(), F.lit(" x"))).otherwise(document())
    e = events(spark, sf).select("event_type", C.json_valid(broken).alias("v"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("int")).alias("n_valid"))


@query("""SELECT event_id, length('[' || event_id || ',') AS "offset", 1 AS line, length('[' || event_id || ',') + 1 AS "column", 'unexpected byte ''x'' while parsing value' AS message
FROM events""")
def json_validate_offset(spark, sf):
    e = events(spark, sf).select("event_id", C.json_validate(_text("[", "=event_id", ",x]")).alias("v"))
    return e.select("event_id", "v.offset", "v.line", "v.column", "v.message")


@query(WITH_DOCS + "SELECT event_type, 34 * count(*) AS entries FROM d GROUP BY 1")
def json_entry_count(spark, sf):
    return docs(spark, sf).groupBy("event_type").agg(F.sum(C.json_entry_count("doc")).alias("entries"))


# Selection


@query(WITH_DOCS + "SELECT event_id, CAST(json_extract(doc, '/u/id') AS VARCHAR) AS uid, json_extract_string(doc, '/t/0') AS t0 FROM d")
def json_get_nested(spark, sf):
    return docs(spark, sf).select("event_id", C.json_get("doc", "/u/id").alias("uid"), C.json_text(C.json_get("doc", "/t/0")).alias("t0"))


@query(WITH_DOCS + "SELECT event_id % 7 AS i, count(*) AS n FROM d WHERE CAST(json_extract(doc, '/t/1') AS BIGINT) >= 3 GROUP BY 1")
def json_get_array_index(spark, sf):
    d = docs(spark, sf).select(once(C.json_int64(C.json_get("doc", "/t/1"))).alias("i"))
    return d.where("i >= 3").groupBy("i").agg(F.count("*").alias("n"))


@query(WITH_DOCS + """SELECT count(*) AS n, count(json_extract(doc, '/nope')) AS absent, count(*) FILTER (CAST(json_extract(doc, '/u/n') AS VARCHAR) = 'null') AS nulls,
count(json_extract(doc, '/t/9')) AS beyond FROM d""")
def json_get_missing_is_null(spark, sf):
    return docs(spark, sf).agg(F.count("*").alias("n"), F.count(C.json_get("doc", "/nope")).alias("absent"), F.sum(C.json_is_null(C.json_get("doc", "/u/n")).cast("int")).alias("nulls"), F.count(C.json_get("doc", "/t/9")).alias("beyond"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS first, CAST(user_id AS VARCHAR) AS last FROM events")
def json_get_first(spark, sf):
    twice = _text('{"a":', "=event_id", ',"a":', "=user_id", "}")
    e = events(spark, sf).select("event_id", twice.alias("doc"))
    return e.select("event_id", C.json_get_first("doc", "/a").alias("first"), C.json_get("doc", "/a").alias("last"))


@query(WITH_DOCS + """SELECT event_id, CAST(json_extract(doc, '/id') AS VARCHAR) AS id, CAST(json_extract(doc, '/u/id') AS VARCHAR) AS uid, CAST(json_extract(doc, '/p/k') AS VARCHAR) AS k,
(event_id % 100) || '.50' AS f FROM d""")
def json_extract_many(spark, sf):
    found = C.json_extract_many("doc", {"id": "/id", "uid": "/u/id", "k": "/p/k", "f": "/f"})
    return docs(spark, sf).select("event_id", found.alias("x")).select("event_id", "x.*")


@query(WITH_DOCS + "SELECT event_id, CAST(json_extract(doc, '/id') AS BIGINT) AS id, CAST(json_extract(doc, '/p/k') AS BIGINT) AS k FROM d")
def json_shared_gets(spark, sf):
    out = with_gets(docs(spark, sf), {"id": Get("doc", "/id", C.json_int64), "k": Get("doc", "/p/k", C.json_int64)})
    return out.select("event_id", "id", "k")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS a, CAST(event_id % 5 AS VARCHAR) AS second FROM events")
def json_key_and_index(spark, sf):
    e = events(spark, sf).select("event_id", _text('{"a":', "=user_id", "}").alias("o"), _text("[0,", "=event_id % 5", "]").alias("l"))
    return e.select("event_id", C.json_get_key("o", "a").alias("a"), C.json_get_index("l", 1).alias("second"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS one, CAST(user_id AS VARCHAR) AS two, CAST(event_id AS VARCHAR) AS three FROM events")
def json_field_cursor(spark, sf):
    e = events(spark, sf).select("event_id", C.json_fields(_text('{"a":', "=event_id", ',"a":', "=user_id", "}"), ["a", "a", "a"]).alias("f"))
    return e.select("event_id", F.col("f")[0].alias("one"), F.col("f")[1].alias("two"), F.col("f")[2].alias("three"))


@query(WITH_DOCS + "SELECT event_id, CAST(json_extract(doc, '/id') AS VARCHAR) AS id, replace(CAST(json_extract(doc, '/p') AS VARCHAR), ' ', '') AS p FROM d")
def json_map_probe(spark, sf):
    m = docs(spark, sf).select("event_id", C.json_to_map_raw("doc").alias("m"))
    return m.select("event_id", F.col("m")["id"].alias("id"), C.json_compact(F.col("m")["p"]).alias("p"))


@query("SELECT event_id, CAST(event_id % 5 AS VARCHAR) AS k0, CAST(NULL AS VARCHAR) AS k1, '\"' || event_type || '\"' AS k2 FROM events")
def json_column_gather(spark, sf):
    k = docs(spark, sf).select("event_id", C.json_column(C.json_get("doc", "/items"), "k").alias("k"))
    return k.select("event_id", F.col("k")[0].alias("k0"), F.col("k")[1].alias("k1"), F.col("k")[2].alias("k2"))


# Accessors


@query("""SELECT kind, count(*) AS n FROM (SELECT unnest(['number', 'object', 'array', 'string', 'number', 'array', 'object']) AS kind FROM events) GROUP BY 1""")
def json_kind_histogram(spark, sf):
    raws = C.json_members("doc")
    return docs(spark, sf).select(F.explode(raws).alias("m")).groupBy(C.json_kind("m.value").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '/k') AS BIGINT)) AS BIGINT) AS total, min(event_id % 100) AS low FROM events GROUP BY 1")
def json_int64_sum(spark, sf):
    e = events(spark, sf).select("event_type", C.json_int64(C.json_get("props", "/k")).alias("k"), F.expr("event_id % 100").alias("r"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.min("r").alias("low"))


@query("SELECT event_type, CAST(sum(event_id % 100) + 0.5 * count(*) AS DOUBLE) AS total FROM events GROUP BY 1")
def json_float64_sum(spark, sf):
    d = docs(spark, sf).select("event_type", C.json_float64(C.json_get("doc", "/f")).alias("f"))
    return d.groupBy("event_type").agg(F.sum("f").alias("total"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS i, CAST(CASE WHEN event_id % 2 = 0 THEN event_id END AS DECIMAL(20,0)) AS u, event_id % 2 = 0 AS whole,
CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_id || '.0' END AS spelled FROM events""")
def json_number_accessors(spark, sf):
    raw = F.when(F.expr("event_id % 2 = 0"), _text("=event_id")).otherwise(_text("=event_id", ".0"))
    e = events(spark, sf).select("event_id", raw.alias("raw"))
    return e.select("event_id", C.json_int64("raw").alias("i"), C.json_uint64("raw").alias("u"), C.json_is_integer("raw").alias("whole"), C.json_number_text("raw").alias("spelled"))


@query(WITH_DOCS + "SELECT event_type, json_extract_string(doc, '/s') AS s, count(*) AS n, count(*) FILTER (CAST(json_extract(doc, '/t/2') AS BOOLEAN)) AS yes FROM d GROUP BY 1, 2")
def json_text_decode(spark, sf):
    d = docs(spark, sf).select("event_type", C.json_text(C.json_get("doc", "/s")).alias("s"), C.json_bool(C.json_get("doc", "/t/2")).alias("b"))
    return d.groupBy("event_type", "s").agg(F.count("*").alias("n"), F.sum(F.col("b").cast("int")).alias("yes"))


@query(WITH_DOCS + "SELECT event_id, CAST(json_array_length(doc, '/t') AS INT) AS items, CAST(len(json_keys(doc)) AS INT) AS members FROM d")
def json_lengths(spark, sf):
    return docs(spark, sf).select("event_id", C.json_array_len(C.json_get("doc", "/t")).alias("items"), C.json_object_len("doc").alias("members"))


@query("SELECT n_nationkey, 2 AS items, 2 AS members, true AS same, false AS more, CAST(n_nationkey AS VARCHAR) AS last FROM nation")
def json_deep_documents(spark, sf):
    """As deep as documents may be, and numbers of 1,501 digits: where recursion and the built-in parser's limits end."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.expr("repeat('[', 9998)").alias("a"), F.expr("repeat(']', 9998)").alias("z"), F.expr("repeat('7', 1501)").alias("digits"))
    deep = F.concat(F.lit("["), "a", "digits", "z", F.lit(","), F.col("n_nationkey").cast("string"), F.lit("]"))
    n = n.select("n_nationkey", deep.alias("doc"), F.concat(F.lit('{"x":'), "a", "digits", "z", F.lit(',"y":1}')).alias("obj"), F.concat(F.lit("["), "a", F.lit("[]"), "z", F.lit("]")).alias("other"))
    return n.select("n_nationkey", C.json_array_len("doc").alias("items"), C.json_object_len("obj").alias("members"), C.json_contains(F.col("doc"), F.col("doc")).alias("same"), C.json_contains(F.col("doc"), F.col("other")).alias("more"), C.json_get("doc", "/1").alias("last"))


@query(WITH_DOCS + "SELECT event_id, CAST(json_extract(doc, '/u/id') AS VARCHAR) AS uid, CAST(event_id AS VARCHAR) AS id FROM d")
def json_get_trusted(spark, sf):
    """The second document breaks off behind what is selected: an early exit does not see that."""
    d = docs(spark, sf).select("event_id", "doc", _text('{"a":[0,{"b":', "=event_id", '}],"c":tru').alias("broken"))
    return d.select("event_id", C.json_get("doc", "/u/id", trusted=True).alias("uid"), C.json_get_first("broken", "/a/1/b", trusted=True).alias("id"))


# Generators


@query("""SELECT event_id, pos, raw FROM (SELECT event_id, unnest(['"' || event_type || '"', CAST(event_id % 7 AS VARCHAR), 'true', '[ ]']) AS raw, unnest([0, 1, 2, 3]) AS pos FROM events)""")
def json_each_array_explode(spark, sf):
    d = docs(spark, sf).select("event_id", F.inline(C.json_each_array(C.json_get("doc", "/t"))))
    return d.select("event_id", "pos", "raw")


@query("""SELECT event_id, pos, key FROM (SELECT event_id, unnest(['id', 'u', 't', 's', 'f', 'items', 'p']) AS key, unnest([0, 1, 2, 3, 4, 5, 6]) AS pos FROM events)""")
def json_each_object_explode(spark, sf):
    return docs(spark, sf).select("event_id", F.inline(C.json_each_object("doc"))).select("event_id", "pos", "key")


@query("SELECT event_id, '\"' || event_type || '\"' AS first, 7 AS members FROM events")
def json_table_functions(spark, sf):
    d = docs(spark, sf, even=True).select("event_id", "doc", C.json_get("doc", "/t").alias("t"))
    first = d.lateralJoin(JsonEachArray(F.col("t").outer())).where("pos = 0").select("event_id", F.col("raw").alias("first"))
    members = d.lateralJoin(JsonEachObject(F.col("doc").outer())).groupBy("event_id").agg(F.count("*").cast("int").alias("members"))
    return first.join(members.hint("merge"), "event_id")  # as many rows as events: never broadcast


@query("SELECT event_id, event_id + user_id AS total, event_type AS name, 7 AS members FROM events")
def json_forward_cursor(spark, sf):
    def each(cursor):
        total, name, members = 0, None, 0
        cursor.begin_object()
        while (key := cursor.next_field()) is not None:
            members += 1
            if key == "id":
                total += cursor.int64()
            elif key == "u":
                cursor.begin_object()
                while (inner := cursor.next_field()) is not None:
                    if inner == "id":
                        total += cursor.int64()
                    else:
                        assert cursor.null()
            elif key == "t":
                cursor.begin_array()
                while cursor.next_element():
                    if name is None:
                        name = cursor.string()
                    else:
                        cursor.skip()
            else:
                cursor.skip()
        return {"total": total, "name": name, "members": members}

    kind = T.StructType([T.StructField("total", T.LongType()), T.StructField("name", T.StringType()), T.StructField("members", T.IntegerType())])
    return docs(spark, sf).select("event_id", C.json_walk("doc", each, kind).alias("x")).select("event_id", "x.*")


@query(WITH_DOCS + "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(doc)) AS k FROM d) GROUP BY 1")
def json_object_keys(spark, sf):
    return docs(spark, sf).select(F.explode(F.transform(C.json_members("doc"), lambda m: m["key"])).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, id AS entry_id, parent AS parent_id, kind FROM (SELECT event_id, unnest([0, 1, 2, 3, 4]) AS id, unnest([NULL, 0, 0, 2, 2]) AS parent,
unnest(['object', 'string', 'array', 'number', 'string']) AS kind FROM events)"""
)
def json_tape_relation(spark, sf):
    e = events(spark, sf).select("event_id", _text('{"a":[', "=event_id", ',"', "=event_type", '"]}').alias("doc"))
    return e.lateralJoin(JsonTape(F.col("doc").outer())).select("event_id", "entry_id", "parent_id", "kind")


# Predicates


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 = 3 GROUP BY 1")
def json_contains_filter(spark, sf):
    d = docs(spark, sf).where(C.json_contains("doc", '{"t":[3.0]}'))
    return d.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT n.n_nationkey AS n_nationkey, count(*) AS n FROM events e JOIN nation n ON e.event_id % 25 = n.n_nationkey GROUP BY 1")
def json_contains_join(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", _text('{"a":', "=n_nationkey", ".0}").alias("needle"))
    e = events(spark, sf).select(_text('{"b":[', "=event_id", '],"a":', "=event_id % 25", "}").alias("doc"))
    return contains_join(e, "doc", nations, "needle").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT event_id % 50 AS v, count(*) AS n FROM events GROUP BY 1")
def json_number_canon_group(spark, sf):
    spelled = F.when(F.expr("event_id % 2 = 0"), _text("=event_id % 50", ".00")).otherwise(_text("=event_id % 50", "0e-1"))
    e = events(spark, sf).select(spelled.alias("raw"))
    g = e.groupBy(C.json_number_canon("raw").alias("c")).agg(F.count("*").alias("n"), F.min(C.json_float64("raw")).cast("bigint").alias("v"))
    return g.select("v", "n")


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS same FROM events")
def json_string_equality(spark, sf):
    e = events(spark, sf).select(C.json_string_equal(_text('"', "=event_type", '"'), F.lit('"\\u0063lick"')).alias("same"))
    return e.agg(F.count("*").alias("n"), F.sum(F.col("same").cast("int")).alias("same"))


# Transforms

_COMPACT_SQL = """'{"id":' || event_id || ',"u":{"id":' || user_id || ',"n":null},"t":["' || event_type || '",' || (event_id % 7) || ',true,[]]}'"""


def _loose() -> Column:
    return _text(' {"id" : ', "=event_id", ',\n"u":{"id":', "=user_id", ' ,"n":null},"t":[ "', "=event_type", '",\t', "=event_id % 7", ",true,[ ]]} ")


@query(f"SELECT event_id, {_COMPACT_SQL} AS doc FROM events")
def json_compact(spark, sf):
    return events(spark, sf).select("event_id", C.json_compact(_loose()).alias("doc"))


@query("""SELECT event_id, '{' || chr(10) || '  "a": [' || chr(10) || '    ' || event_id || ',' || chr(10) || '    {}' || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS doc FROM events""")
def json_indent(spark, sf):
    return events(spark, sf).select("event_id", C.json_indent(_text('{"a":[', "=event_id", ", { } ]}\n")).alias("doc"))


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT event_type, event_id % 10 FROM events)""")
def json_canonicalize_distinct(spark, sf):
    either = F.when(F.expr("event_id % 20 < 10"), _text('{"t":"', "=event_type", '", "n":', "=event_id % 10", "}")).otherwise(_text('{"n" :', "=event_id % 10", ',"t":"', "=event_type", '"}'))
    return events(spark, sf).select(C.json_canonicalize(either).alias("c")).distinct().agg(F.count("*").alias("n"))


@query("""SELECT event_id, '{"b":"é/' || event_type || '","a":[1.50,' || event_id || ']}' AS doc FROM events""")
def json_normalize(spark, sf):
    return events(spark, sf).select("event_id", C.json_normalize(_text('{ "b":"\\u00e9\\/', "=event_type", '", "a":[1.50,', "=event_id", "]}")).alias("doc"))


@query(WITH_DOCS + "SELECT event_id, CAST(json_extract(doc, '/u/id') AS BIGINT) AS uid, json_extract_string(doc, '/t/0') AS t FROM d")
def json_variant(spark, sf):
    d = docs(spark, sf, even=True).select("event_id", C.json_to_variant("doc").alias("v"))
    return d.select("event_id", F.variant_get("v", "$.u.id", "bigint").alias("uid"), F.variant_get("v", "$.t[0]", "string").alias("t"))


# Typed decoding and encoding


@query(WITH_DOCS + "SELECT event_id, CAST(json_extract(doc, '/id') AS BIGINT) AS id, CAST(json_extract(doc, '/u/id') AS BIGINT) AS uid, CAST(json_extract(doc, '/f') AS DOUBLE) AS f, json_extract_string(doc, '/s') AS s FROM d")
def json_decode_struct(spark, sf):
    x = docs(spark, sf).select("event_id", K.json_decode("doc", "ID bigint, u struct<id: bigint>, f double, s string").alias("x"))
    return x.select("event_id", F.col("x.ID").alias("id"), F.col("x.u.id").alias("uid"), "x.f", "x.s")


@query("SELECT event_id, unnest([event_id % 5, NULL, event_id]) AS k FROM events")
def json_decode_array_inline(spark, sf):
    raw = _text('[{"k":', "=event_id % 5", '},{"j":1},{"k":', "=event_id", "}]")
    return events(spark, sf).select("event_id", F.inline(K.json_decode_array(raw, "struct<k: bigint>")))


@query("SELECT event_id, key, value FROM (SELECT event_id, unnest([event_id % 10, 100]) AS key, unnest([user_id, event_id]) AS value FROM events)")
def json_decode_map(spark, sf):
    raw = _text('{"', "=event_id % 10", '":', "=user_id", ',"100":0,"100":', "=event_id", "}")
    return events(spark, sf).select("event_id", F.explode(K.json_decode(raw, "map<bigint, bigint>")).alias("key", "value"))


@query("SELECT event_id, event_id AS id, user_id AS x, 'expected number' AS reason, 's[1]' AS path FROM events")
def json_decode_inline_extras(spark, sf):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("rest", T.MapType(T.StringType(), T.LongType()), True, {"json.inline": True})])
    e = events(spark, sf).select("event_id", K.json_decode(_text('{"id":', "=event_id", ',"x":', "=user_id", "}"), schema).alias("v"), K.json_decode_result(_text('{"s":[1,"', "=event_type", '"]}'), "s array<bigint>").alias("r"))
    return e.select("event_id", "v.id", F.col("v.rest")["x"].alias("x"), "r.error.reason", "r.error.path")


@query("SELECT event_id, event_id AS value, length(CAST(event_id AS VARCHAR)) + 1 AS consumed FROM events")
def json_decode_prefix(spark, sf):
    x = events(spark, sf).select("event_id", K.json_decode_prefix(_text(" ", "=event_id", " {{{"), "bigint").alias("x"))
    return x.select("event_id", "x.value", "x.consumed")


@query("SELECT event_id, event_id AS a, user_id AS b FROM events")
def json_merge(spark, sf):
    kind = "struct<a: bigint, b: bigint>"
    old = F.expr("named_struct('a', event_id, 'b', CAST(0 AS BIGINT))")
    x = events(spark, sf).select("event_id", K.json_merge_into(old, _text('{"b":', "=user_id", "}"), kind).alias("x"))
    return x.select("event_id", "x.a", "x.b")


@query("""SELECT event_id, '{"id":' || event_id || ',"type":"\\u003c' || event_type || '\\u003e","half":' || (event_id % 10) || '.5,"none":null,"tags":["a",' || '"' || event_type || '"]}' AS doc FROM events""")
def json_encode_struct(spark, sf):
    s = F.struct(F.col("event_id").alias("id"), F.concat(F.lit("<"), "event_type", F.lit(">")).alias("type"), F.expr("(event_id % 10) + 0.5D").alias("half"), F.lit(None).cast("string").alias("none"), F.array(F.lit("a"), F.col("event_type")).alias("tags"))
    return events(spark, sf).select("event_id", K.json_encode(s).alias("doc"))


@query("""SELECT event_id, '{"1":"' || event_type || '","a":null,"b":"x"}' AS doc FROM events""")
def json_encode_map_sorted(spark, sf):
    m = F.create_map(F.lit("b"), F.lit("x"), F.lit("1"), F.col("event_type"), F.lit("a"), F.lit(None).cast("string"))
    return events(spark, sf).select("event_id", K.json_encode(m).alias("doc"))


@query("SELECT event_id, user_id, event_type, props FROM events")
def json_round_trip(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "event_type", "props")
    back = e.select(K.json_decode(K.json_encode(F.struct(*e.columns)), e.schema, mode=C.FAILFAST).alias("x"))
    return back.select("x.*")


def _fields(*fields: tuple) -> T.StructType:
    """Fields of name, type (DDL) and metadata without its json. in front."""
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind, True, {f"json.{k}": v for k, v in (meta or {}).items()}) for name, kind, meta in fields])


@query("SELECT event_id, event_type AS bytes, event_id AS quoted, event_id % 2 = 0 AS flag, event_id AS second, CAST(0 AS BIGINT) AS third, 3 AS size FROM events")
def json_decode_scalars(spark, sf):
    """Bytes as base64, scalars in quotes, arrays of a fixed length."""
    schema = _fields(("b", "binary", None), ("n", "bigint", {"string": True}), ("f", "boolean", {"string": True}), ("a", "array<bigint>", {"length": 3}))
    raw = _text('{"b":"', "=base64(cast(event_type as binary))", '","n":"', "=event_id", '","f":"', "=event_id % 2 = 0", '","a":[1,', "=event_id", "]}")
    x = events(spark, sf).select("event_id", K.json_decode(raw, schema, C.FAILFAST).alias("x"))
    return x.select("event_id", F.col("x.b").cast("string").alias("bytes"), F.col("x.n").alias("quoted"), F.col("x.f").alias("flag"), F.col("x.a")[1].alias("second"), F.col("x.a")[2].alias("third"), F.size("x.a").alias("size"))


@query("SELECT event_id, user_id AS outer_id, event_type AS inner_v, CAST(NULL AS BIGINT) AS clash FROM events")
def json_decode_embedded(spark, sf):
    """Of equal names the shallowest counts; equal ones at one depth cancel out."""
    left, right = _fields(("id", "bigint", None), ("v", "string", None), ("z", "bigint", None)), _fields(("z", "bigint", None))
    schema = _fields(("id", "bigint", None), ("left", left, {"embed": True}), ("right", right, {"embed": True}))
    x = events(spark, sf).select("event_id", K.json_decode(_text('{"id":', "=user_id", ',"v":"', "=event_type", '","z":5}'), schema, C.FAILFAST).alias("x"))
    return x.select("event_id", F.col("x.id").alias("outer_id"), F.col("x.left.v").alias("inner_v"), F.coalesce("x.left.z", "x.right.z").alias("clash"))


@query("""SELECT event_id, '{' || CASE WHEN event_id % 2 <> 0 THEN '"a":' || (event_id % 2) || ',' ELSE '' END || CASE WHEN event_id % 3 <> 0 THEN '"b":"x",' ELSE '' END || '"N":"' || event_id || '","raw":[1,{}],"bytes":"YWI=","list":[1,null]}' AS doc FROM events""")
def json_encode_omitted(spark, sf):
    schema = _fields(("a", "bigint", {"omitempty": True}), ("b", "string", {"omitzero": True}), ("n", "bigint", {"string": True, "name": "N"}), ("no", "bigint", {"ignore": True}), ("raw", "string", {"raw": True}), ("bytes", "binary", None), ("list", "array<bigint>", None))
    s = F.expr("named_struct('a', event_id % 2, 'b', if(event_id % 3 <> 0, 'x', ''), 'n', event_id, 'no', user_id, 'raw', '[ 1, { } ]', 'bytes', X'6162', 'list', array(1L, NULL))")
    return events(spark, sf).select("event_id", K.json_encode(s, schema).alias("doc"))


@query("""SELECT event_id, '{"ts":"' || rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z"}' AS doc, epoch_us(ts) AS us FROM events""")
def json_time_round_trip(spark, sf):
    e = events(spark, sf).select("event_id", F.struct("ts").alias("s"))
    e = e.select("event_id", K.json_encode("s").alias("doc"))
    return e.select("event_id", "doc", F.unix_micros(K.json_decode("doc", "ts timestamp", C.FAILFAST)["ts"]).alias("us"))


@query("""SELECT event_id, '{"v":' || props || ',"list":[' || event_id || ',"' || event_type || '",null]}' AS doc, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '"' || event_type || '"' ELSE 'null' END AS dynamic FROM events""")
def json_encode_dynamic(spark, sf):
    """Values whose type only the row tells: columns that hold JSON already, and a VARIANT's own JSON."""
    any_ = F.expr("CASE event_id % 3 WHEN 0 THEN cast(event_id as string) WHEN 1 THEN concat('\"', event_type, '\"') ELSE 'null' END")
    listed = C.json_array(F.col("event_id").cast("string"), C.json_quote("event_type"), F.lit(None).cast("string"))
    return events(spark, sf).select("event_id", C.json_object("v", "props", "list", listed).alias("doc"), F.to_json(C.json_to_variant(any_)).alias("dynamic"))


@query("""SELECT event_id, upper(event_type) AS text, event_id + 1 AS number, '{"t":"' || event_type || '","n":' || event_id || '}' AS doc FROM events""")
def json_codec_hooks(spark, sf):
    """Registered hooks: one on a string's text, one on a value's source, both ways."""
    K.register_codec("catalog.upper", decode=str.upper, encode=str.lower, text=True)
    K.register_codec("catalog.next", decode=lambda raw: int(raw) + 1, encode=lambda v: str(v - 1))
    schema = _fields(("t", "string", {"codec": "catalog.upper"}), ("n", "bigint", {"codec": "catalog.next"}))
    x = events(spark, sf).select("event_id", K.json_decode(_text('{"t":"', "=event_type", '","n":', "=event_id", "}"), schema, C.FAILFAST).alias("x"))
    return x.select("event_id", F.col("x.t").alias("text"), F.col("x.n").alias("number"), K.json_encode("x", schema).alias("doc"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS uid, event_type AS name, CAST(event_id % 100 + 0.5 AS DOUBLE) AS half, 3 AS items, 7 AS members, true AS has FROM events")
def json_sql_functions(spark, sf):
    from jsonloom.functions.sql import register

    register(spark)
    d = docs(spark, sf, even=True).select("event_id", "doc")
    return d.selectExpr("event_id", "json_get(doc, '/id') id", "json_get_first(doc, '/u/id') uid", "json_text(json_get(doc, '/t/0')) name", "json_float64(json_get(doc, '/f')) half", "json_array_len(json_get_key(doc, 'items')) items", "json_object_len(doc) members", "json_contains(doc, '{\"t\":[true]}') has")


# JSON keys in relational operators


@query("SELECT c.c_mktsegment AS segment, count(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY 1")
def json_key_join(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    keyed = docs(spark, sf).select(once(C.json_int64(C.json_get("doc", "/u/id"))).alias("uid"))
    return keyed.join(customers, F.col("uid") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def json_key_semi(spark, sf):
    some = spark.read.parquet(f"{sf}/customer.parquet").where("c_nationkey < 5").select("c_custkey")
    keyed = docs(spark, sf).select("event_id", once(C.json_int64(C.json_get("doc", "/u/id"))).alias("uid"))
    return keyed.join(some, F.col("uid") == F.col("c_custkey"), "left_semi").select("event_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def json_key_anti(spark, sf):
    some = spark.read.parquet(f"{sf}/customer.parquet").where("c_nationkey < 5").select("c_custkey")
    keyed = docs(spark, sf).select("event_id", once(C.json_int64(C.json_get("doc", "/u/id"))).alias("uid"))
    return keyed.join(some, F.col("uid") == F.col("c_custkey"), "left_anti").select("event_id")


@query("SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY event_id) AS r FROM (SELECT event_id, CAST(json_extract(props, '/k') AS BIGINT) AS k FROM events)")
def json_window_rank(spark, sf):
    e = events(spark, sf).select("event_id", C.json_int64(C.json_get("props", "/k")).alias("k"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("event_id")))


@query("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(json_extract(props, '/k') AS BIGINT) % 4 AS k FROM events) GROUP BY ROLLUP (event_type, k)")
def json_rollup(spark, sf):
    e = events(spark, sf).select("event_type", (C.json_int64(C.json_get("props", "/k")) % 4).alias("k"))
    return e.rollup("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT event_id, k FROM (SELECT event_id, CAST(json_extract(props, '/k') AS BIGINT) AS k FROM events) ORDER BY k DESC, event_id LIMIT 20")
def json_topk(spark, sf):
    e = events(spark, sf).select("event_id", C.json_int64(C.json_get("props", "/k")).alias("k"))
    return e.orderBy(F.desc("k"), "event_id").limit(20)


@query("SELECT DISTINCT CAST(json_extract(props, '/k') AS VARCHAR) AS k FROM events UNION SELECT CAST(n_nationkey AS VARCHAR) FROM nation")
def json_union(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"))
    return events(spark, sf).select(C.json_get("props", "/k").alias("k")).unionByName(nations).distinct()


@query("SELECT CAST(json_extract(props, '/k') AS VARCHAR) AS k FROM events EXCEPT SELECT CAST(n_nationkey AS VARCHAR) FROM nation")
def json_except(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"))
    return events(spark, sf).select(C.json_get("props", "/k").alias("k")).subtract(nations)


@query("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(json_extract(props, '/k') AS BIGINT) % 4 AS k FROM events) GROUP BY CUBE (event_type, k)")
def json_cube(spark, sf):
    e = events(spark, sf).select("event_type", (C.json_int64(C.json_get("props", "/k")) % 4).alias("k"))
    return e.cube("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT CAST(json_extract(props, '/k') AS VARCHAR) AS k FROM events INTERSECT SELECT CAST(n_nationkey AS VARCHAR) FROM nation")
def json_intersect(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"))
    return events(spark, sf).select(C.json_get("props", "/k").alias("k")).intersect(nations)


@query("SELECT event_type, count(DISTINCT json_extract_string(props, '/k')) AS keys, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_count_distinct(spark, sf):
    e = events(spark, sf).select("event_type", C.json_get("props", "/k").alias("k"), "user_id")
    return e.groupBy("event_type").agg(F.countDistinct("k").alias("keys"), F.countDistinct("user_id").alias("users"))


@query("SELECT e.event_id, n.n_nationkey FROM events e JOIN nation n ON CAST(json_extract(e.props, '/k') AS BIGINT) BETWEEN n.n_nationkey * 4 AND n.n_nationkey * 4 + 1")
def json_range_join(spark, sf):
    # the range is cut into buckets of its width, so it is an equi-join with a filter
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey"), F.col("n_nationkey").cast("long").alias("bucket"))
    e = events(spark, sf).select("event_id", once(C.json_int64(C.json_get("props", "/k"))).alias("k"))
    e = e.withColumn("bucket", F.floor(F.col("k") / 4))
    return e.join(nations, "bucket").where("k - 4 * bucket <= 1").select("event_id", "n_nationkey")


@query("SELECT event_id, k, lag(k) OVER (PARTITION BY event_type ORDER BY event_id) AS before, sum(k) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS three FROM (SELECT event_id, event_type, CAST(json_extract(props, '/k') AS BIGINT) AS k FROM events)")
def json_window_frame(spark, sf):
    e = events(spark, sf).select("event_id", "event_type", C.json_int64(C.json_get("props", "/k")).alias("k"))
    w = Window.partitionBy("event_type").orderBy("event_id")
    return e.select("event_id", "k", F.lag("k").over(w).alias("before"), F.sum("k").over(w.rowsBetween(-2, 0)).alias("three"))


# Sources, sinks and streams


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; where none is set, a temporary one on one machine, an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir()}/json-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, props FROM events")
def json_ndjson_roundtrip(spark, sf):
    e, folder = events(spark, sf).select("event_id", "user_id", "event_type", "props"), _folder(spark)
    jsonvalues.write_ndjson(e, folder)
    lines = jsonvalues.read_ndjson(spark, folder).where("valid")
    return lines.select(K.json_decode("value", e.schema, mode=C.FAILFAST).alias("x")).select("x.*")


@query("SELECT event_id AS id, 'object' AS kind FROM events UNION ALL SELECT event_id % 10, 'array' FROM events")
def json_concat_reader(spark, sf):
    folder = _folder(spark)
    stuck = _text('{"id":', "=event_id", "}[", "=event_id % 10", "] ").alias("value")
    spread(events(spark, sf)).select(stuck).write.text(folder)
    v = jsonvalues.read_values(spark, folder)
    id_ = F.coalesce(C.json_int64(C.json_get("value", "/id", C.PERMISSIVE)), C.json_int64(C.json_get_index("value", 0)))
    return v.select(id_.alias("id"), C.json_kind("value").alias("kind"))


@query("SELECT event_id, event_id AS id FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 0")
def json_typed_values(spark, sf):
    folder = _folder(spark)
    line = F.when(F.expr("event_id % 3 = 0"), _text('{"id":"', "=event_id", '"}')).otherwise(_text('{"id":', "=event_id", "}"))
    spread(events(spark, sf)).select(line.alias("value")).write.text(folder)
    values = jsonvalues.read_values(spark, folder)
    found = jsonvalues.decode_values(values, "id bigint", C.PERMISSIVE, keep=("value",))
    id_ = C.json_get("value", "/id")
    return found.select(F.coalesce(C.json_int64(id_), C.json_text(id_).try_cast("bigint")).alias("event_id"), "doc.id")


@query("SELECT event_id AS id, 'object' AS kind FROM events UNION ALL SELECT event_id % 10, 'array' FROM events UNION ALL SELECT event_id % 3, 'number' FROM events UNION ALL SELECT NULL, 'bool' FROM events")
def json_values_source(spark, sf):
    """The registered source: objects, arrays, numbers and literals stuck together."""
    jsonvalues.register(spark)
    folder = _folder(spark)
    spread(events(spark, sf)).select(_text('{"id":', "=event_id", "}[", "=event_id % 10", "]", "=event_id % 3", " true").alias("value")).write.text(folder)
    v = spark.read.format("jsonvalues").option("bufferSize", "4096").load(folder).select("value")
    kind = C.json_kind("value")
    id_ = F.when(kind == "number", C.json_int64("value")).when(kind == "array", C.json_int64(C.json_get_index("value", 0))).when(kind == "object", C.json_int64(C.json_get("value", "/id")))
    return v.select(id_.alias("id"), kind.alias("kind"))


@query("SELECT event_id, event_type AS name FROM events")
def json_split_reader(spark, sf):
    """Files in ranges of 20,000 bytes: documents of several lines, strings with brackets and quotes in them."""
    folder = _folder(spark)
    e = events(spark, sf).select(_text('{"id":\n', "=event_id", ',"x":"[{\\"","t":["', "=event_type", '"]}').alias("value"))
    e.write.text(folder)
    v = read_values_split(spark, f"{folder}/*.txt", split_bytes=20_000)
    x = v.select(C.json_extract_many("value", {"id": "/id", "t": "/t/0"}).alias("x"))
    return x.select(C.json_int64("x.id").alias("event_id"), C.json_text("x.t").alias("name"))


@query("SELECT event_id, user_id FROM events")
def json_values_stream(spark, sf):
    """The registered source as a stream: typed events to files, in two runs that go on from one checkpoint. The second run's files
    have names before the first's."""
    source, sink, checkpoint = (_folder(spark) for _ in range(3))
    e = events(spark, sf).select("event_id", _text('{"event_id":', "=event_id", ',"user_id":', "=user_id", "}").alias("value"))
    for half, name in ((0, "z"), (1, "a")):
        e.where(F.col("event_id") % 2 == half).select("value").write.text(f"{source}/{name}")
        typed = streams.decoded(streams.read_values_stream(spark, f"{source}/*/*.txt"), T._parse_datatype_string("event_id bigint, user_id bigint"))
        run = typed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
        run.awaitTermination()
    return spark.read.parquet(sink)


@query("SELECT CAST(ts AS DATE) AS day, CAST(json_extract(props, '/k') AS BIGINT) % 5 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_stream_windows(spark, sf):
    e = events(spark, sf)
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parque[t]")
    counts = streams.windowed_counts(stream, "props", "/k", "ts", "1 day", "1 day")
    sink = _folder(spark)
    run = streams.write_batches(counts, sink, _folder(spark))
    run.awaitTermination()
    k = C.json_int64("key") % 5
    return spark.read.parquet(sink).groupBy(F.to_date("window.start").alias("day"), k.alias("k")).agg(F.sum("n").alias("n"))
