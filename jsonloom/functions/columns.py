"""JSON operators over string columns.

Documents are ordinary string columns. What Catalyst can express exactly is built from its functions (kinds, scalars, lengths);
the rest runs in Arrow UDFs, which work once on each distinct document of a batch. NULL documents give NULL. A selected value
is the exact span of its source as a string: absent is NULL, JSON null is 'null'.

Where a document breaks the grammar, or a pointer's token is no array index, `mode` decides: PERMISSIVE (default) gives NULL,
FAILFAST raises.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jsonloom.functions import documents as D
from jsonloom.functions import grammar as G
from jsonloom.functions import pointer as P
from jsonloom.functions import spans as S
from jsonloom.functions.numbers import canonical

PERMISSIVE, FAILFAST = "PERMISSIVE", "FAILFAST"
SPANS = T.ArrayType(T.StringType())
DIAGNOSIS = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("offset", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("message", T.StringType())])
MEMBERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))

ELEMENTS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(k, T.StringType()) for k in ("raw", "kind"))]))
FIELDS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(k, T.StringType()) for k in ("key", "raw_key", "raw", "kind"))]))

_NUMBER = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
_INTEGER = r"\A-?(0|[1-9][0-9]*)\z"
_UNSIGNED = r"\A(0|[1-9][0-9]*)\z"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare(kind: T.DataType) -> T.DataType:
    """The type without field metadata, which Arrow results don't carry."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, bare(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(bare(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(bare(kind.keyType), bare(kind.valueType), kind.valueContainsNull)
    return kind


def per_document(each: Callable, out: T.DataType, mode: str = FAILFAST) -> Callable[[Column | str], Column]:
    """A column function that applies each(text) to the distinct documents of a batch. In PERMISSIVE mode ValueError is NULL."""
    out = bare(out)
    kind = to_arrow_type(out)

    def one(text: str):
        try:
            return each(text)
        except ValueError:
            if mode == FAILFAST:
                raise
            return None

    def batch(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        found = column.dictionary_encode()
        return pa.array([one(x) for x in found.dictionary.to_pylist()], kind).take(found.indices)

    batch.__annotations__ = {"column": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(batch, out)
    return lambda c: udf(_column(c))


def per_pair(each: Callable, out: T.DataType, mode: str = FAILFAST) -> Callable[..., Column]:
    kind = to_arrow_type(out)

    def one(a: str | None, b: str | None):
        if a is None or b is None:
            return None
        try:
            return each(a, b)
        except ValueError:
            if mode == FAILFAST:
                raise
            return None

    def batch(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(list(map(one, left.to_pylist(), right.to_pylist())), kind)

    batch.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(batch, out)
    return lambda a, b: udf(_column(a), _column(b))


def _parse(text: str) -> G.Tape:
    return G.parse(text.encode("utf-8", "surrogatepass"))


def _valid(text: str) -> str:
    """The text, if it is valid; else its fault is raised."""
    if not G.valid(text):
        _parse(text)
    return text


def _got(text: str, pointer: P.Pointer) -> str | None:
    """What the pointer selects in a valid text."""
    try:
        return S.get(text, pointer)
    except RecursionError:
        tape = _parse(text)
        return _span(tape, P.get(tape, pointer))


def _object(text: str) -> list[tuple[str, str]] | None:
    """Decoded keys and sources of a valid text's members, if it is an object."""
    start = len(text) - len(text.lstrip(" \t\n\r"))
    if text[start] != "{":
        return None
    try:
        return [(S.key_text(k), v) for k, v in S.pairs(text, start)]
    except RecursionError:
        tape = _parse(text)
        return [(tape.text(k), tape.raw(v).decode()) for k, v in tape.members(0)]


def _array(text: str) -> list[str] | None:
    start = len(text) - len(text.lstrip(" \t\n\r"))
    if text[start] != "[":
        return None
    try:
        return S.items(text, start)
    except RecursionError:
        tape = _parse(text)
        return [tape.raw(i).decode() for i in tape.elements(0)]


def _children(text: str, bracket: str, mode: str) -> list[tuple]:
    """Key, key's source, value's source and kind of the root's children; None as keys of elements."""
    if G.valid(text):
        try:
            start = len(text) - len(text.lstrip(" \t\n\r"))
            if text[start] == bracket:
                return S.children(text, start)
        except RecursionError:
            pass
    fault = None
    try:
        tape = _parse(text)
    except G.JsonSyntaxError as e:
        tape, fault = e.tape, e
    kind, found = G.ARRAY if bracket == "[" else G.OBJECT, []
    if tape is not None and len(tape):
        if tape.kind[0] != kind:
            fault = G.JsonSyntaxError(tape.data, tape.start[0], f"expected {kind}")
        elif kind == G.ARRAY:
            found = [(None, None, tape.raw(v).decode(), tape.kind[v]) for v in tape.elements(0) if tape.end[v] >= 0]
        else:
            found = [(tape.text(k), tape.raw(k).decode(), tape.raw(v).decode(), tape.kind[v]) for k, v in tape.members(0) if tape.end[v] >= 0]
    if fault is not None and mode == FAILFAST:
        raise fault
    return found


def _count(text: str, bracket: str) -> int | None:
    """Children of a valid text's root, if it is of this kind."""
    start = len(text) - len(text.lstrip(" \t\n\r"))
    if text[start] != bracket:
        return None
    try:
        return len((S.items if bracket == "[" else S.pairs)(text, start))
    except RecursionError:
        return _parse(text).count[0]


def _span(tape: G.Tape, i: int | None) -> str | None:
    return None if i is None else tape.raw(i).decode()


# Validity


def json_valid(c: Column | str) -> Column:
    """Whether the text is exactly one RFC 8259 value, at most 10,000 deep, with blanks around it."""
    return per_document(G.valid, T.BooleanType())(c)


def json_validate(c: Column | str) -> Column:
    """ok, offset, line, column and message; only what fails the fast check is parsed for its fault."""

    def each(text: str):
        if G.valid(text):
            return {"ok": True}
        try:
            _parse(text)
        except G.JsonSyntaxError as e:
            return {"ok": False, "offset": e.offset, "line": e.line, "column": e.column, "message": e.message}
        return {"ok": True}

    return per_document(each, DIAGNOSIS)(c)


def json_entry_count(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """1 + array elements + 2 * object members over the whole document."""
    return per_document(lambda x: len(_parse(x)), T.IntegerType(), mode)(c)


# Selection


def json_get(c: Column | str, pointer: str, mode: str = PERMISSIVE, trusted: bool = False) -> Column:
    """What the JSON Pointer selects; of duplicate keys the last counts. The whole document is validated.

    trusted: the documents are known to be valid (results on others are unspecified)."""
    del trusted  # one pass finds spans and faults alike, so there is nothing to leave out
    compiled = P.compile_pointer(pointer)
    return per_document(lambda x: _got(_valid(x), compiled), T.StringType(), mode)(c)


def json_get_first(c: Column | str, pointer: str, mode: str = PERMISSIVE, trusted: bool = False) -> Column:
    """As json_get, but the first member under which the rest of the pointer resolves counts, and what stands behind the
    selected value is not validated."""
    del trusted
    compiled = P.compile_pointer(pointer)

    def each(text: str):
        try:
            return S.get_first(text, compiled)
        except (S.Unsure, RecursionError):
            pass  # a fault, whose place the tape tells, or more than the C scanner takes
        try:
            tape = _parse(text)
            return _span(tape, P.get_first(tape, compiled))
        except G.JsonSyntaxError as e:
            if e.tape is None or not len(e.tape):
                raise
            found = P.get_first(e.tape, compiled)
            if found is None or e.tape.end[found] < 0:
                raise
            return _span(e.tape, found)

    return per_document(each, T.StringType(), mode)(c)


def json_extract_many(c: Column | str, pointers: dict[str, str], mode: str = PERMISSIVE) -> Column:
    """A struct with a field for each pointer, all from one pass over the document."""
    compiled = {k: P.compile_pointer(v) for k, v in pointers.items()}
    out = T.StructType([T.StructField(k, T.StringType()) for k in pointers])

    def each(text: str):
        _valid(text)
        try:
            return S.get_many(text, compiled)
        except RecursionError:
            tape = _parse(text)
            return {k: _span(tape, P.get(tape, p)) for k, p in compiled.items()}

    return per_document(each, out, mode)(c)


def json_checked_get(c: Column | str, pointer: str) -> Column:
    """A struct of valid (as json_valid) and value (as json_get), from one pass. A token that is no index has value NULL."""
    compiled = P.compile_pointer(pointer)

    def each(text: str):
        if not G.valid(text):
            return {"valid": False, "value": None}
        try:
            return {"valid": True, "value": _got(text, compiled)}
        except P.PointerError:
            return {"valid": True, "value": None}

    return per_document(each, T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("value", T.StringType())]))(c)


def json_each_array(c: Column | str, mode: str = FAILFAST) -> Column:
    """An array's elements in order as structs pos, raw, kind, for F.inline (rows) or F.inline_outer. PERMISSIVE: an invalid
    document gives what stands before the fault, another kind of root nothing; FAILFAST raises."""
    return per_document(lambda x: [{"pos": pos, "raw": r[2], "kind": r[3]} for pos, r in enumerate(_children(x, "[", mode))], ELEMENTS)(c)


def json_each_object(c: Column | str, mode: str = FAILFAST) -> Column:
    """An object's members in order, duplicates kept, as structs pos, key, raw_key, raw, kind; as json_each_array."""
    each = lambda x: [dict(zip(("pos", "key", "raw_key", "raw", "kind"), (pos, *r))) for pos, r in enumerate(_children(x, "{", mode))]
    return per_document(each, FIELDS)(c)


def json_walk(c: Column | str, each: Callable, out: T.DataType, mode: str = PERMISSIVE) -> Column:
    """each(cursor) of every document, cursor a ValueCursor over it that each must have gone through to the end. Where a walk meets
    another kind than it expects, or leaves something over, mode decides."""
    from jsonloom.sources.cursor import ValueCursor

    def walk(text: str):
        cursor = ValueCursor(_valid(text))
        found = each(cursor)
        cursor.finish()
        return found

    return per_document(walk, out, mode)(c)


def json_get_key(c: Column | str, key: str, mode: str = PERMISSIVE) -> Column:
    """The last member with this decoded key; other kinds than objects have none."""
    def each(text: str):
        return dict(_object(_valid(text)) or ()).get(key)

    return per_document(each, T.StringType(), mode)(c)


def json_get_index(c: Column | str, index: int, mode: str = PERMISSIVE) -> Column:
    """The array's element; negative, beyond the end, or no array: absent."""

    def each(text: str):
        found = _array(_valid(text)) or ()
        return found[index] if 0 <= index < len(found) else None

    return per_document(each, T.StringType(), mode)(c)


def json_fields(c: Column | str, keys: list[str], mode: str = PERMISSIVE) -> Column:
    """For each key the first match at or after a cursor that wraps once; a hit moves it on, a miss to the front."""

    def each(text: str):
        tape = _parse(text)
        cursor = P.FieldCursor(tape)
        return [_span(tape, cursor.find(k)) for k in keys]

    return per_document(each, SPANS, mode)(c)


def json_to_map_raw(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """An object's members as a map of raw spans, for many lookups; the last duplicate counts. No object: NULL."""

    def each(text: str):
        found = _object(_valid(text))
        return None if found is None else list(dict(found).items())

    return per_document(each, T.MapType(T.StringType(), T.StringType()), mode)(c)


def json_column(c: Column | str, key: str, mode: str = PERMISSIVE) -> Column:
    """Of an array, each element's value for the key, in place; NULL where the element has none. No array: NULL."""
    def each(text: str):
        found = _array(_valid(text))
        return None if found is None else [dict(_object(x) or ()).get(key) for x in found]

    return per_document(each, SPANS, mode)(c)


def json_elements(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """An array's elements as raw spans; no array: NULL."""
    return per_document(lambda x: _array(_valid(x)), SPANS, mode)(c)


def json_members(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """An object's members in order, duplicates kept: decoded keys and raw spans; no object: NULL."""

    def each(text: str):
        found = _object(_valid(text))
        return None if found is None else [{"key": k, "value": v} for k, v in found]

    return per_document(each, MEMBERS, mode)(c)


# Accessors on a selected (valid) value: Catalyst alone, but for strings with escapes


def _bare(c: Column | str) -> Column:
    return F.trim(_column(c), F.lit(" \n\r\t"))


def json_kind(c: Column | str) -> Column:
    """null, bool, number, string, array or object by the first byte; NULL and what can't start a value: invalid."""
    first = F.substring(F.ltrim(_column(c), F.lit(" \n\r\t")), 1, 1)
    return (
        F.when(first == "n", "null").when(first.isin("t", "f"), "bool").when(first == '"', "string").when(first == "[", "array")
        .when(first == "{", "object").when(first.rlike(r"\A[-0-9]\z"), "number").otherwise("invalid")
    )


def json_is_null(c: Column | str) -> Column:
    return F.coalesce(_bare(c) == "null", F.lit(False))


def json_bool(c: Column | str) -> Column:
    raw = _bare(c)
    return F.when(raw == "true", True).when(raw == "false", False)


def json_number_text(c: Column | str) -> Column:
    """The number's own spelling."""
    raw = _bare(c)
    return F.when(raw.rlike(_NUMBER), raw)


def json_is_integer(c: Column | str) -> Column:
    """Whether the spelling is an integer's, whatever its size."""
    return F.coalesce(_bare(c).rlike(_INTEGER), F.lit(False))


def json_int64(c: Column | str) -> Column:
    """Integer spellings in range; 1.0 and 1e2 are none."""
    raw = _bare(c)
    return F.when(raw.rlike(_INTEGER), raw).try_cast("bigint")


def json_uint64(c: Column | str) -> Column:
    """As DECIMAL(20,0); any minus, even -0, is absent."""
    raw = _bare(c)
    value = F.when(raw.rlike(_UNSIGNED) & (F.length(raw) <= 20), raw).try_cast("decimal(20,0)")
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)


def json_float64(c: Column | str) -> Column:
    """Correctly rounded; beyond the range: absent."""
    raw = _bare(c)
    value = F.when(raw.rlike(_NUMBER), raw).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


@lru_cache(maxsize=1)
def _unescape() -> Callable:
    def each(raw: str):
        text = json.loads(raw)
        text.encode()
        return text

    return per_document(each, T.StringType(), PERMISSIVE)


def json_text(c: Column | str) -> Column:
    """A string's decoded text; without escapes Catalyst cuts the quotes off. Other kinds: absent."""
    raw = _bare(c)
    string = raw.startswith('"') & raw.endswith('"') & (F.length(raw) >= 2)
    escaped = F.when(string & raw.contains("\\"), raw)
    return F.when(~string, F.lit(None).cast("string")).when(~raw.contains("\\"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(_unescape()(escaped))


def json_string_bytes(c: Column | str) -> Column:
    """A string's text if it has no escapes."""
    raw = _bare(c)
    return F.when(raw.startswith('"') & raw.endswith('"') & (F.length(raw) >= 2) & ~raw.contains("\\"), F.substring(raw, F.lit(2), F.length(raw) - 2))


def json_array_len(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """Elements of an array, to any depth and with numbers of any length; other kinds and (PERMISSIVE) invalid documents: NULL."""
    return per_document(lambda x: _count(_valid(x), "["), T.IntegerType(), mode)(c)


def json_object_len(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """Members of an object, duplicates counted, as json_array_len."""
    return per_document(lambda x: _count(_valid(x), "{"), T.IntegerType(), mode)(c)


# Predicates


def json_contains(haystack: Column | str, needle: Column | str, mode: str = PERMISSIVE) -> Column:
    """Containment as jsonb's @>, with exact numbers. A plain string as needle is a literal, parsed once."""
    if isinstance(needle, str):
        wanted = D.model(needle)
        return per_document(lambda x: D.contains(D.model(x), wanted), T.BooleanType(), mode)(haystack)
    return per_pair(lambda a, b: D.contains(D.model(a), D.model(b)), T.BooleanType(), mode)(haystack, needle)


def json_number_canon(c: Column | str) -> Column:
    """One spelling for all spellings of a number, so that equality, grouping and joins are exact; other kinds: NULL."""
    return per_document(canonical, T.StringType())(json_number_text(c))


def json_number_equal(a: Column | str, b: Column | str) -> Column:
    return json_number_canon(a) == json_number_canon(b)


def json_string_equal(a: Column | str, b: Column | str) -> Column:
    """Equality of decoded strings, without Unicode normalization."""
    return json_text(a) == json_text(b)


# Transforms


def json_compact(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """Without blanks between tokens, tokens verbatim."""
    return per_document(lambda x: D.compact(x.encode()).decode(), T.StringType(), mode)(c)


def json_indent(c: Column | str, prefix: str = "", indent: str = "  ", mode: str = PERMISSIVE) -> Column:
    return per_document(lambda x: D.indent(x.encode(), prefix, indent).decode(), T.StringType(), mode)(c)


def json_canonicalize(c: Column | str, mode: str = PERMISSIVE) -> Column:
    """Members sorted by their decoded key's bytes, all duplicates kept; strings written anew, numbers verbatim."""
    return per_document(lambda x: D.canonicalize(x.encode()), T.StringType(), mode)(c)


def json_normalize(c: Column | str) -> Column:
    """Compact with strings written anew and numbers verbatim; an invalid document becomes null."""

    def each(text: str):
        try:
            return D.normalize(text.encode())
        except ValueError:
            return "null"

    return per_document(each, T.StringType())(c)


def json_to_variant(c: Column | str, numbers: str = "exact") -> Column:
    """The document as VARIANT. numbers="exact" leaves them to Spark (decimals up to 38 digits, else doubles); "string" keeps
    each number's spelling as a string. Of duplicate keys the last counts. Invalid documents: NULL; so are those that VARIANT
    can't hold, by Spark's limits and not by the grammar: over 1,000 containers inside each other, numbers of over 1,000
    characters (numbers="string" has no such bound), values beyond 128 MB. json_get and json_decode go on where VARIANT ends."""

    def each(text: str):
        if numbers == "exact" and G.surely_distinct(text):
            return text
        tape = _parse(text)
        scalar = lambda kind, raw: D.quoted(raw.decode()) if kind == G.NUMBER and numbers == "string" else raw.decode()
        obj = lambda members: "{" + ",".join(D.quoted(k) + ":" + v for k, v in dict(members).items()) + "}"
        return G.fold(tape, scalar, lambda v: "[" + ",".join(v) + "]", obj)

    return F.try_parse_json(per_document(each, T.StringType(), PERMISSIVE)(c))


# Constructors: wrong nesting can't be written


def json_raw(c: Column | str) -> Column:
    """A column that already holds JSON, for json_array and json_object; NULL becomes null."""
    return F.coalesce(_column(c), F.lit("null"))


def json_quote(c: Column | str, escape_html: bool = False) -> Column:
    """A string as a JSON string token."""
    return per_document(lambda x: D.quoted(x, escape_html), T.StringType())(c)


def json_array(*items: Column | str) -> Column:
    """An array of JSON columns."""
    return F.concat(F.lit("["), F.concat_ws(",", *[json_raw(x) for x in items]), F.lit("]"))


def json_object(*pairs: Column | str) -> Column:
    """An object of alternating keys (plain strings) and JSON columns, in this order."""
    if len(pairs) % 2:
        raise ValueError("json_object takes keys and values in turn")
    members = [F.concat(F.lit(D.quoted(k) + ":"), json_raw(v)) for k, v in zip(pairs[::2], pairs[1::2])]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
