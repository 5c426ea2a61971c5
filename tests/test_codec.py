import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonloom.operators import codec as K


def field(name_, kind, nullable=True, **meta):
    return T.StructField(name_, kind, nullable, {f"json.{k}": v for k, v in meta.items()})


EVENT = T.StructType([field("id", T.LongType()), field("name", T.StringType()), field("enabled", T.BooleanType())])


def decode(schema, text, **options):
    return K.Decoder(schema, **options).decode(text)


def fault(schema, text, **options):
    with pytest.raises(K.DecodeError) as e:
        decode(schema, text, **options)
    return e.value.offset, e.value.path, e.value.reason


def test_example():
    assert decode(EVENT, '{"id":7,"name":"launch","enabled":true}') == {"id": 7, "name": "launch", "enabled": True}


def test_error_path():
    batch = T.StructType([field("events", T.ArrayType(EVENT))])
    assert fault(batch, '{"events":[{"id":1},{"id":"two"}]}') == (26, "events[1].id", "expected number")
    assert fault(T.StructType([field("m", T.MapType(T.StringType(), T.ArrayType(T.ByteType())))]), '{"m":{"k":[1,300]}}') == (13, "m.k[1]", "integer overflow")


@pytest.mark.parametrize(
    ("kind", "text", "value"),
    [(T.ByteType(), "-128", -128), (T.LongType(), "9223372036854775807", 2**63 - 1), (T.DecimalType(20, 0), "18446744073709551615", decimal.Decimal(2**64 - 1)), (T.DoubleType(), "1e308", 1e308), (T.StringType(), '"\\u00e9"', "é"), (T.BinaryType(), '"aGk="', b"hi"), (T.BinaryType(), "[104,105]", b"hi"), (T.ArrayType(T.LongType()), "[]", []), (T.ArrayType(T.LongType()), "null", None)],
)
def test_values(kind, text, value):
    assert decode(kind, text) == value


@pytest.mark.parametrize(
    ("kind", "text"),
    [(T.ByteType(), "128"), (T.LongType(), "1.0"), (T.LongType(), "1e2"), (T.LongType(), '"1"'), (T.LongType(), "9223372036854775808"), (T.DecimalType(20, 0), "-1"), (T.DecimalType(20, 0), "18446744073709551616"), (T.DoubleType(), "1e400"), (T.FloatType(), "1e39"), (T.StringType(), "1"), (T.BooleanType(), "0"), (T.BinaryType(), '"*"'), (T.ArrayType(T.LongType()), "{}"), (EVENT, "[]")],
)
def test_misfits(kind, text):
    fault(kind, text)


def test_field_matching():
    schema = T.StructType([field(n, T.LongType()) for n in ("Name", "NAME", "Kelvin", "ſcore", "plain")])
    assert decode(schema, '{"NAME":1,"name":2,"Kelvin":3,"Score":4,"PLAIN":5}') == {"Name": 2, "NAME": 1, "Kelvin": 3, "ſcore": 4, "plain": 5}
    assert decode(schema, '{"name":2}', case_sensitive=True)["Name"] is None
    assert K.folded("ß") != K.folded("ss")


def test_unknown_and_inline():
    assert fault(EVENT, '{"x":1}', disallow_unknown=True)[2] == 'unknown field "x"'
    schema = T.StructType([field("id", T.LongType()), field("rest", T.MapType(T.StringType(), T.LongType()), inline=True)])
    assert decode(schema, '{"id":1,"a":2,"b":3,"a":4}', disallow_unknown=True) == {"id": 1, "rest": {"a": 4, "b": 3}}


def test_quoted_numbers_and_lengths():
    schema = T.StructType([field("n", T.LongType(), string=True), field("b", T.BooleanType(), string=True), field("f", T.ArrayType(T.LongType()), length=3)])
    assert decode(schema, '{"n":"007","b":"true","f":[1,2,3,4]}') == {"n": 7, "b": True, "f": [1, 2, 3]}
    assert decode(schema, '{"n":"null","f":[1]}') == {"n": None, "b": None, "f": [1, 0, 0]}
    for text in ('{"n":7}', '{"n":"+7"}', '{"n":""}', '{"n":"7.0"}'):
        fault(schema, text)


def test_spellings():
    schema = T.StructType([field("n", T.StringType(), number=True), field("r", T.StringType(), raw=True)])
    assert decode(schema, '{"n":1.50,"r":{"a" : 1}}') == {"n": "1.50", "r": '{"a" : 1}'}


def test_map_keys():
    assert decode(T.MapType(T.LongType(), T.StringType()), '{"1":"a","01":"b"}') == {1: "b"}
    fault(T.MapType(T.ByteType(), T.StringType()), '{"300":"a"}')
    with pytest.raises(K.UnsupportedTypeError):
        K.Decoder(T.MapType(T.DoubleType(), T.StringType()))


def test_nulls_and_merging():
    inner = T.StructType([field("x", T.LongType()), field("y", T.LongType())])
    schema = T.StructType([field("a", T.LongType()), field("s", inner)])
    assert decode(schema, '{"a":null}', nulls="zero") == {"a": 0, "s": {"x": 0, "y": 0}}
    assert decode(schema, '{"s":{"x":1},"s":{"y":2}}') == {"a": None, "s": {"x": 1, "y": 2}}
    old = {"a": 5, "s": {"x": 1, "y": 1}}
    assert K.Decoder(schema).decode('{"s":{"y":9}}', old) == {"a": 5, "s": {"x": 1, "y": 9}}


def test_embedding():
    low = T.StructType([field("id", T.LongType()), field("v", T.StringType())])
    schema = T.StructType([field("id", T.LongType()), field("base", low, embed=True)])
    assert decode(schema, '{"id":1,"v":"x"}') == {"id": 1, "base": {"id": None, "v": "x"}}
    clash = T.StructType([field("p", T.StructType([field("z", T.LongType())]), embed=True), field("q", T.StructType([field("z", T.LongType())]), embed=True)])
    assert K.resolve(clash) == []


def test_times():
    found = decode(T.TimestampType(), '"2024-02-29T12:00:00.5+02:00"')
    assert found == datetime.datetime(2024, 2, 29, 10, 0, 0, 500000, datetime.timezone.utc)
    assert K.time_text(found) == "2024-02-29T10:00:00.5Z"


def test_columns(spark):
    df = spark.createDataFrame([(0, '{"ID":7,"name":"a"}'), (1, '{"id":"x"}'), (2, "{"), (3, None)], "id int, doc string")
    rows = df.orderBy("id").select(K.json_decode("doc", EVENT).alias("v"), K.json_decode_result("doc", EVENT).alias("r")).collect()
    assert rows[0].v.id == 7 and rows[0].v["name"] == "a" and rows[1].v is None and rows[3].v is None
    assert (rows[1].r.error.path, rows[1].r.error.reason, rows[1].r.error.offset) == ("id", "expected number", 6)
    assert rows[2].r.error.type == "json"
    with pytest.raises(Exception, match="expected number"):
        df.where("id = 1").select(K.json_decode("doc", EVENT, mode="FAILFAST")).collect()


def test_prefix_arrays_and_merge_columns(spark):
    df = spark.createDataFrame([(0, ' [1,2] {"x'), (1, "null")], "id int, doc string")
    found = df.orderBy("id").select(K.json_decode_prefix("doc", "array<bigint>").alias("p")).collect()
    assert (found[0].p.value, found[0].p.consumed) == ([1, 2], 6)
    rows = df.where("id = 0").select(F.lit('[{"a":1},{"a":2}]').alias("d")).select(F.inline(K.json_decode_array("d", "struct<a:bigint>"))).collect()
    assert [r.a for r in rows] == [1, 2]
    old = spark.createDataFrame([((1, {"k": 1}), '{"m":{"j":2}}')], "o struct<a:bigint,m:map<string,bigint>>, d string")
    assert old.select(K.json_merge_into("o", "d", "struct<a:bigint,m:map<string,bigint>>").alias("x")).first().x.m == {"k": 1, "j": 2}


def test_encode(spark):
    df = spark.sql("""SELECT named_struct('a', 1.0D, 'b', CAST(NULL AS STRING), 'c', map('z', 1, 'a', 2), 'd', array(1e21D, -0.0D), 'e', '<&> ',
        'f', X'6869', 'g', TIMESTAMP '2024-01-02 03:04:05.120', 'h', CAST(0.1 AS FLOAT), 'i', array(), 'j', true) s""")
    assert df.select(K.json_encode("s")).first()[0] == '{"a":1,"b":null,"c":{"a":2,"z":1},"d":[1e+21,-0],"e":"\\u003c\\u0026\\u003e\\u2028","f":"aGk=","g":"2024-01-02T03:04:05.12Z","h":0.1,"i":[],"j":true}'
    with pytest.raises(Exception, match="unsupported float value NaN"):
        spark.sql("SELECT named_struct('a', double('NaN')) s").select(K.json_encode("s")).collect()


def test_encode_metadata(spark):
    schema = T.StructType([field("a", T.LongType(), omitempty=True), field("b", T.StringType(), omitzero=True), field("n", T.LongType(), string=True, name="N"), field("x", T.StringType(), raw=True), field("rest", T.MapType(T.StringType(), T.LongType()), inline=True), field("no", T.LongType(), ignore=True)])
    encode = K._encoder(schema, {}, True, "")
    assert encode({"a": 0, "b": "", "n": 5, "x": "[ 1 ]", "rest": {"q": 1, "p": 2}, "no": 3}) == '{"N":"5","x":[1],"p":2,"q":1}'
    df = spark.createDataFrame([((1, "u", 5, "{}", {}, 3),)], T.StructType([T.StructField("s", schema)]))
    assert df.select(K.json_encode("s", schema)).first()[0] == '{"a":1,"b":"u","N":"5","x":{}}'


def test_codecs():
    K.register_codec("upper", decode=str.upper, encode=str.lower, text=True)
    schema = T.StructType([field("u", T.StringType(), codec="upper")])
    assert decode(schema, '{"u":"abc"}') == {"u": "ABC"}
    assert K._encoder(schema, {}, True, "")({"u": "ABC"}) == '{"u":"abc"}'


def test_round_trip(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").limit(200)
    schema = orders.schema
    out = orders.select(F.struct(*orders.columns).alias("s")).select("s", K.json_decode(K.json_encode("s", schema), schema).alias("t")).collect()
    assert all(r.s == r.t for r in out) and len(out) == 200
    assert all(json.loads(r[0])["o_orderstatus"] for r in orders.select(K.json_encode(F.struct(*orders.columns))).collect())
