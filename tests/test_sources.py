import random

import pytest
from pyspark.sql.types import StructType

from jsonloom.sources import framer, jsonvalues


def read(data, sizes=None, most=0):
    """Values by the stream reader over chunks of the given sizes; the fault, if any."""
    chunks, at = [], 0
    for n in sizes or [len(data)]:
        chunks.append(data[at : at + n])
        at += n
    chunks.append(data[at:])
    out = []
    try:
        for offset, raw in framer.values(chunks, most):
            out.append((offset, raw.decode()))
    except framer.StreamError as e:
        return out, e
    return out, None


def test_framing():
    found, fault = read(b'1 "two" true null [3,4]{"five":5} 6.5')
    assert [r for _, r in found] == ["1", '"two"', "true", "null", "[3,4]", '{"five":5}', "6.5"] and fault is None
    assert [o for o, _ in found] == [0, 2, 8, 13, 18, 23, 34]


@pytest.mark.parametrize(
    ("data", "want"),
    [(b"truefalse", ["true", "false"]), (b"nulltrue1", ["null", "true", "1"]), (b"1-2", ["1", "-2"]), (b"1e+5-3E-2[1]", ["1e+5", "-3E-2", "[1]"]), (b'1"a"2', ["1", '"a"', "2"])],
)
def test_scalars_stuck_together(data, want):
    """A literal ends with its last byte, a number before a sign that is no exponent's; at any torn place."""
    assert [r for _, r in read(data)[0]] == want and read(data)[1] is None
    for k in range(1, len(data)):
        assert [r for _, r in read(data, [k])[0]] == want
    assert [r for _, r in read(data, [1] * len(data))[0]] == want


@pytest.mark.parametrize("data", [b"", b" \n\t \r\n"])
def test_clean_end(data):
    assert read(data) == ([], None)


@pytest.mark.parametrize(
    ("data", "good", "offset"),
    [(b'{"a":1}\n{"a":', 1, 8), (b'{"a":1}{"b":tru}\n', 1, 7), (b"[1]]", 1, 3), (b"1 2 x", 2, 4), (b'"abc', 0, 0), (b"01", 0, 0), (b"1 truefals", 2, 6), (b"1 tru", 1, 2), (b"1.e", 0, 0)],
)
def test_faults_keep_what_came_before(data, good, offset):
    found, fault = read(data)
    assert len(found) == good and fault is not None and fault.offset == offset


def test_limit():
    found, fault = read(b'[1]{"name":"' + b"x" * 10_000 + b'"}', [512] * 20, most=2048)
    assert len(found) == 1 and "limit" in str(fault) and fault.offset == 3


def test_work_is_linear_in_a_chunk():
    """What follows a value in its chunk is not copied for each value."""
    import time

    data = b"".join(b'{"id":%d}[%d] ' % (i, i % 10) for i in range(150_000))

    def seconds(size):
        began = time.process_time()
        assert sum(1 for _ in framer.values(data[a : a + size] for a in range(0, len(data), size))) == 300_000
        return time.process_time() - began

    assert seconds(len(data)) < 1.8 * seconds(4096)


def test_torn_reads():
    rng = random.Random(7)
    pieces = [b'{"a":"\\"}{"}', b"[[],[1,2]]", b"-1.5e3 ", b"true ", b'"\\\\"', b"null\n", '"é😀"'.encode(), b"{}", b"7 "]
    for _ in range(300):
        data = b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        if rng.random() < 0.3:
            data = data[: rng.randint(0, len(data))]
        whole = read(data)
        for _ in range(3):
            sizes = [rng.randint(1, 6) for _ in range(len(data))]
            torn = read(data, sizes)
            assert torn[0] == whole[0] and (torn[1] is None) == (whole[1] is None)
            assert torn[1] is None or torn[1].offset == whole[1].offset


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.json").write_text('{"a":2}{"a":3}\n[4]')
    (tmp_path / "b.json").write_text('1 {"b":tru} 2')
    return str(tmp_path)


def test_data_source(spark, folder):
    jsonvalues.register(spark)
    rows = lambda mode: sorted((r.path[-6:], r.ordinal, r.value, r.input_offset) for r in spark.read.format("jsonvalues").option("mode", mode).load(folder).collect())
    good = [("a.json", 0, '{"a":2}', 0), ("a.json", 1, '{"a":3}', 7), ("a.json", 2, "[4]", 15), ("b.json", 0, "1", 0)]
    assert rows("STOP") == good
    assert rows("PERMISSIVE") == [*good, ("b.json", 1, None, 2)]
    with pytest.raises(Exception, match="value at input offset 2"):
        rows("FAILFAST")
    found = sorted((r.path[-6:], r.ordinal, r.value, r.input_offset) for r in jsonvalues.read_values(spark, folder, "STOP").collect())
    assert found == good


def test_ndjson_round_trip(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(100)
    path = f"{tmp_path}/out"
    jsonvalues.write_ndjson(events, path)
    from jsonloom.operators.codec import json_decode

    back = jsonvalues.read_ndjson(spark, path)
    assert back.where("valid").count() == 100
    again = back.select(json_decode("value", events.schema).alias("e")).select("e.*")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, events.collect()))


def test_streams(spark, folder, tmp_path):
    from jsonloom.streaming import streams

    stream = streams.read_values_stream(spark, folder, "STOP")
    typed = streams.decoded(stream.where("value like '{%'"), StructType().add("a", "long"))
    query = streams.write_ndjson_stream(typed, f"{tmp_path}-out", f"{tmp_path}-check")
    assert query.awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}-out").collect()) == ['{"a":2}', '{"a":3}']


def test_windowed_stream(spark, sf, tmp_path):
    from jsonloom.streaming import streams

    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    counts = streams.windowed_counts(stream, "props", "/k", "ts", "30 days", "1 day")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    assert query.awaitTermination(60)
    assert spark.sql("select sum(n) from windowed").first()[0] == events.count()


def test_generators(spark):
    from jsonloom.functions.sql import register

    register(spark)
    rows = spark.sql("""SELECT e.* FROM json_each_object('{"b":1,"a":[2],"b":"\\\\u0041"}') e""").collect()
    assert [tuple(r) for r in rows] == [(0, "b", '"b"', "1", "number"), (1, "a", '"a"', "[2]", "array"), (2, "b", '"b"', '"\\u0041"', "string")]
    tape = spark.sql("""SELECT t.* FROM json_tape('{"a":[1,"x"]}') t""").collect()
    assert [(r.entry_id, r.parent_id, r.depth, r.key, r.ordinal, r.kind, r.next, r["count"], r.is_key) for r in tape] == [
        (0, None, 0, None, None, "object", 5, 1, False),
        (1, 0, 1, "a", 0, "string", 2, 0, True),
        (2, 0, 1, "a", 0, "array", 5, 2, False),
        (3, 2, 2, None, 0, "number", 4, 0, False),
        (4, 2, 2, None, 1, "string", 5, 0, False),
    ]
    before = spark.sql("SELECT e.raw FROM json_each_array('[1,2,x]', 'PERMISSIVE') e").collect()
    assert [r.raw for r in before] == ["1", "2"]
    with pytest.raises(Exception, match="expected array"):
        spark.sql("SELECT * FROM json_each_array('{}')").collect()


def test_typed_values(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1} {"a":"x"} {"a":3}')
    (tmp_path / "b.json").write_text('{"a":4}{"a":5}{')
    values = jsonvalues.read_values(spark, str(tmp_path), "PERMISSIVE")
    stop = jsonvalues.decode_values(values, "a bigint")
    assert sorted((r.path[-6:], r.doc.a) for r in stop.collect()) == [("a.json", 1), ("b.json", 4), ("b.json", 5)]
    each = jsonvalues.decode_values(values.where("value is not null"), "a bigint", "PERMISSIVE").where("error is not null").collect()
    assert [(r.ordinal, r.error.path, r.error.reason) for r in each] == [(1, "a", "expected number")]
    with pytest.raises(Exception, match="expected number"):
        jsonvalues.decode_values(values, "a bigint", "FAILFAST").collect()


def test_stream_offsets_follow_the_time_of_writing(tmp_path):
    import os

    (tmp_path / "m.json").write_text("1")
    reader = jsonvalues.ValuesStreamReader({"path": str(tmp_path)})
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert [p.path[-6:] for p in reader.partitions(start, first)] == ["m.json"]
    for k, name in enumerate(("a.json", "b.json")):  # names before the first one's
        (tmp_path / name).write_text("2")
        os.utime(tmp_path / name, ns=(first["time"] + 10, first["time"] + 10))
    second = reader.latestOffset()
    assert [p.path[-6:] for p in reader.partitions(first, second)] == ["a.json", "b.json"]
    assert [p.path[-6:] for p in reader.partitions(start, first)] == ["m.json"] and reader.partitions(second, second) == []


def test_paths(tmp_path):
    for name in ("x/a.json", "x/b.txt", "y/c.json", "x/_d.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    names = lambda path: [f.path[-6:] for f in jsonvalues._Options({"path": path}).files()]
    assert names(f"{tmp_path}/x") == ["a.json", "/b.txt"] or len(names(f"{tmp_path}/x")) == 2
    assert names(f"file://{tmp_path}/*/*.json") == names(f"{tmp_path}/*/*.json") and len(names(f"{tmp_path}/*/*.json")) == 3
    assert names(f"{tmp_path}/x/a.json") == ["a.json"] and names(f"{tmp_path}/nothing*") == []


def test_cursor():
    from jsonloom.sources.cursor import CursorError, ValueCursor

    c = ValueCursor(' {"a" : [1, -2.5e1 ,"x\\u0041", null, true,{}] ,"b":{"c":[[]]}, "d":18446744073709551615} ')
    assert c.kind() == "object"
    c.begin_object()
    assert c.next_field() == "a" and c.kind() == "array"
    c.begin_array()
    seen = []
    while c.next_element():
        kind = c.kind()
        seen.append(c.number_text() if kind == "number" else c.string() if kind == "string" else c.null() if kind == "null" else c.bool() if kind == "bool" else c.raw())
    assert seen == ["1", "-2.5e1", "xA", True, True, "{}"]
    assert c.next_field() == "b"
    with pytest.raises(CursorError, match="expected number"):
        c.int64()
    c.skip()
    with pytest.raises(CursorError, match="read to its end"):
        c.finish()
    assert c.next_field() == "d" and c.uint64() == 2**64 - 1 and c.next_field() is None
    c.finish()
    for text, read_ in (("1.0", "int64"), ("-0", "uint64"), ("1e999", "float64"), ('"a"', "bool"), ("1", "string"), ("[1]", "begin_object"), ("9223372036854775808", "int64")):
        with pytest.raises(CursorError):
            getattr(ValueCursor(text), read_)()
    left = ValueCursor("[1,2]")
    left.begin_array()
    assert left.next_element()
    with pytest.raises(CursorError):  # the element has not been read
        left.next_element()
    deep = ValueCursor("[" * 9999 + "]" * 9999)
    deep.skip()
    deep.finish()


def test_ranges_give_what_one_reader_gives(monkeypatch):
    import io

    from jsonloom.sources import splits

    monkeypatch.setattr(splits, "CHUNK", 3)
    rng = random.Random(11)
    pieces = [b'{"a":"\\"}{[,"}', b"[[],[1,2]]", b"-1.5e3 ", b"true ", b'"\\\\"', b"null\n", '"é [ \\" ]"'.encode(), b"{}", b"7 ", b"[[[[[[1]]]]]]", b'"long string with : , and blanks"', b"12345678901234567890 ", b"]", b'"', b"tru"]
    for _ in range(400):
        good = rng.random() < 0.7
        data = b"".join(rng.choice(pieces[: 12 if good else None]) for _ in range(rng.randint(1, 12)))
        want, fault = read(data)
        file, step = io.BytesIO(data), rng.randint(1, 20)
        edges = [splits.boundary(file, a, len(data)) for a in [*range(0, len(data), step), len(data)]]
        assert edges == sorted(edges)
        depth, string, found, faults = 0, False, [], []
        for low, high in zip(edges, edges[1:]):
            more, lowest, end, closed = splits.transition(splits._pieces(file, low, high), string)
            if closed and not (depth > 0 and depth + lowest > 0) and low < high:
                for offset, raw in splits.range_values(splits._pieces(file, low), low, high, depth, string, 0):
                    if raw is None:
                        faults.append(offset)
                    else:
                        found.append((offset, raw.decode()))
            depth, string = depth + more, end
        first = min(faults, default=len(data) + 1)
        assert [x for x in found if x[0] < first] == want, data
        assert (fault is None) == (not faults) and (fault is None or fault.offset == first), data


@pytest.mark.parametrize("mode", ["STOP", "PERMISSIVE"])
def test_split_files(spark, folder, mode):
    from jsonloom.sources.splits import read_values_split

    rows = lambda df: sorted((r.path[-6:], r.input_offset, r.value) for r in df.collect())
    jsonvalues.register(spark)
    want = rows(spark.read.format("jsonvalues").option("mode", mode).load(folder))
    for size in (1, 4, 1000):
        assert rows(read_values_split(spark, folder, mode, split_bytes=size)) == want
    with pytest.raises(Exception, match="value at input offset 2"):
        read_values_split(spark, folder, split_bytes=3).collect()


def test_tasks_grow_with_the_bytes_and_not_with_the_ranges(spark, tmp_path, monkeypatch):
    """Also with more shares than tasks may be, no value is lost; and little is read beside a range."""
    import io

    from jsonloom.sources import splits

    (tmp_path / "a.json").write_bytes(b"".join(b'{"id":%d,"x":"]"}\n' % i for i in range(5000)))
    (tmp_path / "b.json").write_bytes(b"7 ")
    split = splits.read_values_split(spark, str(tmp_path), split_bytes=100)
    assert split.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 2
    monkeypatch.setattr(splits, "TASKS", 3)
    few = splits.read_values_split(spark, str(tmp_path), split_bytes=100)
    assert few.rdd.getNumPartitions() <= 3
    for df in (split, few):
        assert df.count() == df.select("value").distinct().count() == 5001

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            out = super().read(size)
            self.n += len(out)
            return out

    file = Counted(b"[1] " * 1_000_000)
    assert splits.boundary(file, 2_000_001, 4_000_000) == 2_000_001 and file.n <= 4096


def test_folders_must_be_shared_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from jsonloom import catalog

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert "/json-" in catalog._folder(session("local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        catalog._folder(session("spark://host:7077"))
