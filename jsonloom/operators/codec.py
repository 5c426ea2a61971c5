"""Typed decoding and encoding driven by a schema.

A StructType is compiled once on the driver to closures that executors run on each document's tape. Field metadata:

json.name (the member's name), json.ignore, json.string (a quoted scalar), json.number (keep a number's spelling in a string
field), json.raw (keep any value's source in a string field), json.inline (a map that takes members no field matches),
json.embed (a nested struct whose fields count as this one's), json.length (a fixed array), json.omitempty, json.omitzero
(encoding), json.codec (a registered codec).
"""

from __future__ import annotations

import base64
import binascii
import datetime
import decimal
import math
import re
from collections.abc import Callable
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from jsonloom.functions import documents as D
from jsonloom.functions import grammar as G
from jsonloom.functions.columns import FAILFAST, PERMISSIVE, _column, bare, per_document
from jsonloom.functions.numbers import float_text

ERROR = T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("reason", T.StringType())])
_RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_INTEGER = re.compile(r"-?(0|[1-9][0-9]*)\Z")
_NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\Z")
_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)\Z")


class UnsupportedTypeError(TypeError):
    """A schema that has no JSON form; raised when the plan is built."""

    def __init__(self, kind: T.DataType, path: str, reason: str):
        self.kind, self.path, self.reason = kind, path, reason
        super().__init__(f"typed codec does not support {kind.simpleString()} at {path or 'the top'}: {reason}")


class DecodeError(ValueError):
    """A valid document that does not fit the schema; path as in items[3].scores[1]."""

    def __init__(self, offset: int, kind: str, reason: str):
        self.offset, self.kind, self.reason, self.path = offset, kind, reason, ""
        super().__init__(reason)

    def under(self, step: str) -> DecodeError:
        self.path = step + ("" if not self.path or self.path[0] == "[" else ".") + self.path
        return self

    def __str__(self) -> str:
        return f"cannot decode JSON at byte {self.offset} into {self.kind}{f' at {self.path}' if self.path else ''}: {self.reason}"


class EncodeError(ValueError):
    def __init__(self, reason: str):
        self.reason, self.path = reason, ""
        super().__init__(reason)

    under = DecodeError.under

    def __str__(self) -> str:
        return f"cannot encode{f' at {self.path}' if self.path else ''}: {self.reason}"


# The codec registry


class Codec(NamedTuple):
    decode: Callable[[str], Any] | None
    encode: Callable[[Any], str] | None
    text: bool  # values are JSON strings; the hooks see and give their text


CODECS: dict[str, Codec] = {}


def register_codec(name: str, decode: Callable[[str], Any] | None = None, encode: Callable[[Any], str] | None = None, text: bool = False) -> None:
    """Hooks for fields with metadata json.codec = name: decode takes a value's source (or a string's text), encode gives it."""
    CODECS[name] = Codec(decode, encode, text)


# Field resolution


class Member(NamedTuple):
    name: str
    path: tuple[str, ...]  # of fields in the schema
    field: T.StructField
    tagged: bool


def resolve(schema: T.StructType) -> list[Member]:
    """The members of an object by the schema: of equal names the shallowest counts, then the one with an explicit name; what
    stays equal cancels out."""
    out: list[Member] = []
    level: list[tuple[tuple[str, ...], T.StructType]] = [((), schema)]
    taken: set[str] = set()
    while level:
        found: dict[str, list[Member]] = {}
        below = []
        for path, struct in level:
            for f in struct.fields:
                if f.metadata.get("json.ignore"):
                    continue
                if f.metadata.get("json.embed") and isinstance(f.dataType, T.StructType):
                    below.append(((*path, f.name), f.dataType))
                    continue
                name = f.metadata.get("json.name", f.name)
                found.setdefault(name, []).append(Member(name, (*path, f.name), f, "json.name" in f.metadata))
        for name, members in found.items():
            if name in taken:
                continue
            taken.add(name)
            tagged = [m for m in members if m.tagged]
            best = members if len(members) == 1 else tagged
            if len(best) == 1:
                out.append(best[0])
        level = below
    order = _places(schema)
    return sorted(out, key=lambda m: order[m.path])


def _places(schema: T.StructType, path: tuple = (), out: dict | None = None) -> dict:
    out = {} if out is None else out
    for f in schema.fields:
        out[*path, f.name] = len(out)
        if f.metadata.get("json.embed") and isinstance(f.dataType, T.StructType):
            _places(f.dataType, (*path, f.name), out)
    return out


def folded(name: str) -> str:
    """Simple case folding, character by character: the Kelvin sign is k and the long s is s, but sharp s is not ss."""

    def one(c: str) -> str:
        if c in "\u0130\u0131":
            return c
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()
        return low if len(low) == 1 else c

    return "".join(map(one, name))


class FieldSet:
    """Exact lookup, then folded; the first declared wins."""

    def __init__(self, names: list[str]):
        self.exact, self.fold = {}, {}
        for i, n in enumerate(names):
            self.exact.setdefault(n, i)
            self.fold.setdefault(folded(n), i)

    def lookup(self, name: str, case_sensitive: bool = False) -> int | None:
        i = self.exact.get(name)
        return i if i is not None or case_sensitive else self.fold.get(folded(name))


# Decoding


class Options(NamedTuple):
    disallow_unknown: bool = False
    case_sensitive: bool = False
    nulls: str = "null"  # or "zero"
    max_depth: int = G.MAX_DEPTH


def zero(kind: T.DataType) -> Any:
    if isinstance(kind, T.StructType):
        return {f.name: zero(f.dataType) for f in kind.fields}
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(0)
    if isinstance(kind, T.FractionalType):
        return 0.0
    return 0 if isinstance(kind, T.IntegralType) else None


def _decoder(kind: T.DataType, meta: dict, o: Options, path: str) -> Callable[[G.Tape, int, Any], Any]:
    """A function (tape, entry, old value) -> value; the old value matters for structs and maps, which are merged into."""
    name = kind.simpleString() if not isinstance(kind, T.StructType) else "struct"
    empty = (lambda: zero(kind)) if o.nulls == "zero" else lambda: None
    fail = lambda tape, i, reason: DecodeError(tape.start[i], name, reason)

    def nullable(inner):
        return lambda tape, i, old: empty() if tape.kind[i] == G.NULL else inner(tape, i, old)

    if "json.codec" in meta:
        codec = CODECS[meta["json.codec"]]
        if codec.decode is None:
            raise UnsupportedTypeError(kind, path, f"codec {meta['json.codec']} does not decode")

        def custom(tape, i, old):
            if codec.text and tape.kind[i] != G.STRING:
                raise fail(tape, i, "expected string")
            try:
                return codec.decode(tape.text(i) if codec.text else tape.raw(i).decode())
            except DecodeError:
                raise
            except Exception as e:
                raise fail(tape, i, str(e)) from e

        return nullable(custom) if codec.text else custom
    if meta.get("json.string") and isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
        return nullable(_quoted(kind, fail, empty))
    if meta.get("json.raw") and isinstance(kind, T.StringType):
        return lambda tape, i, old: tape.raw(i).decode()

    if isinstance(kind, T.BooleanType):

        def boolean(tape, i, old):
            if tape.kind[i] != G.BOOL:
                raise fail(tape, i, "expected bool")
            return tape.raw(i) == b"true"

        return nullable(boolean)
    if meta.get("json.number") and isinstance(kind, T.StringType):

        def spelling(tape, i, old):
            text = tape.raw(i).decode() if tape.kind[i] == G.NUMBER else tape.text(i) if tape.kind[i] == G.STRING else ""
            if not _NUMBER.match(text):
                raise fail(tape, i, "expected number")
            return text

        return nullable(spelling)
    if isinstance(kind, T.StringType):

        def string(tape, i, old):
            if tape.kind[i] != G.STRING:
                raise fail(tape, i, "expected string")
            return tape.text(i)

        return nullable(string)
    if isinstance(kind, T.NumericType):
        number = _number(kind, fail)

        def numeric(tape, i, old):
            if tape.kind[i] != G.NUMBER:
                raise fail(tape, i, "expected number")
            return number(tape, i, tape.raw(i).decode())

        return nullable(numeric)
    if isinstance(kind, T.BinaryType):
        byte = _number(T.ShortType(), fail)

        def binary(tape, i, old):
            if tape.kind[i] == G.ARRAY:
                out = []
                for j in tape.elements(i):
                    if tape.kind[j] != G.NUMBER:
                        raise fail(tape, j, "expected number")
                    out.append(byte(tape, j, tape.raw(j).decode()))
                    if not 0 <= out[-1] < 256:
                        raise fail(tape, j, "integer overflow")
                return bytes(out)
            if tape.kind[i] != G.STRING:
                raise fail(tape, i, "expected base64 string")
            try:
                return base64.b64decode(tape.text(i).replace("\n", "").replace("\r", ""), validate=True)
            except binascii.Error as e:
                raise fail(tape, i, f"invalid base64: {e}") from e

        return nullable(binary)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):

        def time(tape, i, old):
            m = _TIME.match(tape.text(i)) if tape.kind[i] == G.STRING else None
            if not m:
                raise fail(tape, i, "expected RFC 3339 time")
            try:
                out = datetime.datetime(*map(int, m.groups()[:6]), int((m[7] or "0")[:6].ljust(6, "0")), datetime.timezone.utc)
            except ValueError as e:
                raise fail(tape, i, str(e)) from e
            if m[8] != "Z":
                shift = datetime.timedelta(hours=int(m[8][1:3]), minutes=int(m[8][4:6]))
                out = out - shift if m[8][0] == "+" else out + shift
            return out if isinstance(kind, T.TimestampType) else out.replace(tzinfo=None)

        return nullable(time)
    if isinstance(kind, T.ArrayType):
        item, fixed = _decoder(kind.elementType, {}, o, f"{path}[]"), meta.get("json.length")

        def array(tape, i, old):
            if tape.kind[i] != G.ARRAY:
                raise fail(tape, i, "expected array")
            out = []
            for k, j in enumerate(tape.elements(i)):
                if fixed is None or k < fixed:
                    try:
                        out.append(item(tape, j, None))
                    except DecodeError as e:
                        raise e.under(f"[{k}]")
            return out if fixed is None else out + [zero(kind.elementType) for _ in range(fixed - len(out))]

        return nullable(array)
    if isinstance(kind, T.MapType):
        key, value = _key(kind.keyType, path), _decoder(kind.valueType, {}, o, f"{path}{{}}")

        def mapping(tape, i, old):
            if tape.kind[i] != G.OBJECT:
                raise fail(tape, i, "expected object")
            out = dict(old or {})
            for k, v in tape.members(i):
                text = tape.text(k)
                try:
                    found = key(text)
                except ValueError as e:
                    raise DecodeError(tape.start[k], kind.keyType.simpleString(), f"cannot parse map key as {kind.keyType.simpleString()}") from e
                try:
                    out[found] = value(tape, v, None)
                except DecodeError as e:
                    raise e.under(text)
            return out

        return nullable(mapping)
    if isinstance(kind, T.StructType):
        return _struct(kind, o, path)
    raise UnsupportedTypeError(kind, path, "no JSON form")


def _number(kind: T.DataType, fail: Callable) -> Callable[[G.Tape, int, str], Any]:
    if type(kind) in _RANGES:
        most = 1 << _RANGES[type(kind)] - 1

        def integer(tape, i, text):
            if not _INTEGER.match(text):
                raise fail(tape, i, "expected integer")
            if len(text) > 20 or not -most <= int(text) < most:
                raise fail(tape, i, "integer overflow")
            return int(text)

        return integer
    if isinstance(kind, T.DecimalType):

        def exact(tape, i, text):
            if kind.scale == 0 and not _INTEGER.match(text):
                raise fail(tape, i, "expected integer")
            with decimal.localcontext(prec=kind.precision, traps=[decimal.Inexact, decimal.InvalidOperation, decimal.Overflow]):
                try:
                    out = decimal.Decimal(text).quantize(decimal.Decimal(1).scaleb(-kind.scale))
                except decimal.DecimalException as e:
                    raise fail(tape, i, "number out of range") from e
            if kind.precision == 20 and kind.scale == 0 and (text[0] == "-" or out >= 1 << 64):
                raise fail(tape, i, "integer overflow")
            return out

        return exact

    def real(tape, i, text):
        out = float(text)
        if math.isinf(out) or (isinstance(kind, T.FloatType) and abs(out) > 3.4028235677973366e38):
            raise fail(tape, i, "number out of range")
        return out

    return real


def _quoted(kind: T.DataType, fail: Callable, empty: Callable) -> Callable:
    def each(tape, i, old):
        if tape.kind[i] != G.STRING:
            raise fail(tape, i, "expected quoted value for string-tagged field")
        text = tape.text(i)
        if text == "null":
            return empty()
        if isinstance(kind, T.BooleanType):
            if text not in ("true", "false"):
                raise fail(tape, i, "expected quoted value for string-tagged field")
            return text == "true"
        if isinstance(kind, T.StringType):
            try:
                return D.decoded(G.parse(text.encode()).raw(0))
            except ValueError as e:
                raise fail(tape, i, "expected quoted value for string-tagged field") from e
        whole = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
        bad = f"cannot parse string-tagged {'integer' if whole else 'number'} {text!r}"
        if not text or text[0] not in "-0123456789" or not re.match(r"-?[0-9]+\Z" if whole else r"-?[0-9]*\.?[0-9]*([eE][+-]?[0-9]+)?\Z", text):
            raise fail(tape, i, bad)
        sign, body = ("-", text[1:]) if text[0] == "-" else ("", text)
        body = body.lstrip("0") or "0"
        try:
            return _number(kind, fail)(tape, i, sign + ("0" + body if not body[0].isdigit() else body))
        except (DecodeError, ValueError) as e:
            raise fail(tape, i, bad) from e

    return each


def _key(kind: T.DataType, path: str) -> Callable[[str], Any]:
    if isinstance(kind, T.StringType):
        return str
    if type(kind) in _RANGES or isinstance(kind, T.DecimalType):
        signed = type(kind) in _RANGES
        most = 1 << (_RANGES[type(kind)] - 1 if signed else 64)

        def integer(text: str):
            if not re.match(r"[+-]?[0-9]+\Z" if signed else r"[0-9]+\Z", text):
                raise ValueError(text)
            n = int(text)
            if not (-most if signed else 0) <= n < most:
                raise ValueError(text)
            return n if signed else decimal.Decimal(n)

        return integer
    raise UnsupportedTypeError(kind, path, "map keys are strings or integers")


def _struct(kind: T.StructType, o: Options, path: str) -> Callable:
    members = resolve(kind)
    inline = [m for m in members if m.field.metadata.get("json.inline")]
    if len(inline) > 1 or any(not isinstance(m.field.dataType, T.MapType) or not isinstance(m.field.dataType.keyType, T.StringType) for m in inline):
        raise UnsupportedTypeError(kind, path, "json.inline is for one map with string keys")
    members = [m for m in members if m not in inline]
    names = FieldSet([m.name for m in members])
    decoders = [_decoder(m.field.dataType, m.field.metadata, o, f"{path}.{m.name}".lstrip(".")) for m in members]
    rest = _decoder(inline[0].field.dataType.valueType, {}, o, path) if inline else None

    def fresh():
        return zero(kind) if o.nulls == "zero" else _blank(kind)

    def struct(tape, i, old):
        if tape.kind[i] == G.NULL:
            return old if old is not None or o.nulls != "zero" else fresh()
        if tape.kind[i] != G.OBJECT:
            raise DecodeError(tape.start[i], "struct", "expected object")
        out = fresh() if old is None else _copy(old)
        if inline and old is None:
            _put(out, inline[0].path, {})
        for k, v in tape.members(i):
            text = tape.text(k)
            at = names.lookup(text, o.case_sensitive)
            try:
                if at is not None:
                    m = members[at]
                    _put(out, m.path, decoders[at](tape, v, _at(out, m.path)))
                elif inline:
                    _put(out, inline[0].path, {**dict(_at(out, inline[0].path) or {}), text: rest(tape, v, None)})
                elif o.disallow_unknown:
                    raise DecodeError(tape.start[k], "struct", f'unknown field "{text}"')
            except DecodeError as e:
                if at is None and not inline:
                    raise
                raise e.under(members[at].name if at is not None else text)
        return out

    return struct


def _blank(kind: T.StructType) -> dict:
    return {f.name: _blank(f.dataType) if f.metadata.get("json.embed") and isinstance(f.dataType, T.StructType) else None for f in kind.fields}


def _copy(old: dict) -> dict:
    return {k: _copy(v) if isinstance(v, dict) else v for k, v in old.items()}


def _at(value: dict, path: tuple[str, ...]) -> Any:
    for step in path:
        value = value[step]
    return value


def _put(value: dict, path: tuple[str, ...], new: Any) -> None:
    for step in path[:-1]:
        value = value[step]
    value[path[-1]] = new




def _rows(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _rows(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_rows(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return [(k, _rows(v, kind.valueType)) for k, v in value.items()]
    return value


class _NeedsTape(Exception):
    """What the C parser's values can't tell: places in the source, and the source of what is no number."""


class _Kinds:
    _names = {str: G.STRING, D.Spelling: G.NUMBER, D.Pairs: G.OBJECT, list: G.ARRAY, bool: G.BOOL, type(None): G.NULL}

    def __getitem__(self, value: Any) -> str:
        return self._names[type(value)]


class _Values:
    """Looks like a tape to the decoders, where an entry is the value itself as the C parser gives it."""

    kind = _Kinds()

    @property
    def start(self):
        raise _NeedsTape

    @staticmethod
    def raw(value: Any) -> bytes:
        if type(value) is D.Spelling:
            return value.encode()
        if type(value) is bool:
            return b"true" if value else b"false"
        raise _NeedsTape

    @staticmethod
    def text(value: str) -> str:
        return value

    @staticmethod
    def elements(value: list) -> list:
        return value

    members = elements


class Decoder:
    """A compiled schema; decode(text) gives dicts, lists and scalars or raises JsonSyntaxError or DecodeError."""

    def __init__(self, schema: T.DataType, **options):
        self.schema, self.options = schema, Options(**options)
        self.each = _decoder(schema, {}, self.options, "")

    def decode(self, text: str, old: Any = None) -> Any:
        if self.options.max_depth == G.MAX_DEPTH and G.valid(text):
            try:
                return self.each(_Values(), D.load(text), old)
            except (_NeedsTape, RecursionError):
                pass  # a misfit, whose place the tape tells, or a field that keeps its source
        return self.each(G.parse(text.encode("utf-8", "surrogatepass"), self.options.max_depth), 0, old)

    def decode_prefix(self, text: str) -> tuple[Any, int]:
        """The value at the front and the bytes it takes, blanks before it included."""
        tape = G.scan(text.encode("utf-8", "surrogatepass"), 0, self.options.max_depth)
        return self.each(tape, 0, None), tape.end[0]


def _schema(schema: T.DataType | str) -> T.DataType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def json_decode(c: Column | str, schema: T.DataType | str, mode: str = PERMISSIVE, **options) -> Column:
    """The document decoded by the schema. Options: disallow_unknown, case_sensitive, nulls ("null", "zero"), max_depth.

    PERMISSIVE: NULL for what does not fit (json_decode_result tells why); FAILFAST raises."""
    schema = _schema(schema)
    plan = Decoder(schema, **options)
    return per_document(lambda x: _rows(plan.decode(x), schema), schema, mode)(c)


def json_decode_result(c: Column | str, schema: T.DataType | str, **options) -> Column:
    """A struct of value and error (offset, path, type, reason; NULL if the document fits)."""
    schema = _schema(schema)
    plan = Decoder(schema, **options)

    def each(text: str):
        try:
            return {"value": _rows(plan.decode(text), schema), "error": None}
        except DecodeError as e:
            return {"value": None, "error": {"offset": e.offset, "path": e.path, "type": e.kind, "reason": e.reason}}
        except G.JsonSyntaxError as e:
            return {"value": None, "error": {"offset": e.offset, "path": "", "type": "json", "reason": e.message}}

    return per_document(each, T.StructType([T.StructField("value", schema), T.StructField("error", ERROR)]))(c)


def json_decode_prefix(c: Column | str, schema: T.DataType | str, mode: str = PERMISSIVE, **options) -> Column:
    """value and consumed (bytes): what follows the value at the front is not looked at."""
    schema = _schema(schema)
    plan = Decoder(schema, **options)

    def each(text: str):
        value, consumed = plan.decode_prefix(text)
        return {"value": _rows(value, schema), "consumed": consumed}

    return per_document(each, T.StructType([T.StructField("value", schema), T.StructField("consumed", T.IntegerType())]), mode)(c)


def json_decode_array(c: Column | str, element: T.DataType | str, mode: str = PERMISSIVE, **options) -> Column:
    """A top-level array as ARRAY<element>; null is NULL, [] is empty. F.inline makes it rows."""
    return json_decode(c, T.ArrayType(_schema(element)), mode, **options)


def json_merge_into(old: Column | str, c: Column | str, schema: T.StructType | str, mode: str = PERMISSIVE, **options) -> Column:
    """The struct old with what the document has: absent members keep their value, null leaves scalars NULL and structs as
    they are, maps are merged into."""
    schema = _schema(schema)
    plan = Decoder(schema, **options)

    def batch(olds: pa.Array, docs: pa.Array) -> pa.Array:
        out = []
        for o, d in zip(olds.to_pylist(), docs.to_pylist()):
            try:
                out.append(o if d is None else plan.decode(d, _from_arrow(o, schema)))
            except ValueError:
                if mode == FAILFAST:
                    raise
                out.append(None)
        return pa.array([_rows(_from_arrow(x, schema), schema) for x in out], to_arrow_type(bare(schema)))

    batch.__annotations__ = {"olds": pa.Array, "docs": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, bare(schema))(_column(old), _column(c))


def _from_arrow(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _from_arrow(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_from_arrow(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: _from_arrow(v, kind.valueType) for k, v in (value.items() if isinstance(value, dict) else value)}
    return value


# Encoding


def _encoder(kind: T.DataType, meta: dict, html: bool, path: str) -> Callable[[Any], str]:
    if "json.codec" in meta:
        codec = CODECS[meta["json.codec"]]
        if codec.encode is None:
            raise UnsupportedTypeError(kind, path, f"codec {meta['json.codec']} does not encode")
        custom = (lambda v: D.quoted(codec.encode(v), html)) if codec.text else lambda v: D.compact(codec.encode(v).encode()).decode()
        return lambda v: "null" if v is None else custom(v)
    inner = _plain_encoder(kind, meta, html, path)
    if meta.get("json.string") and isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
        return lambda v: "null" if v is None else D.quoted(inner(v), html)
    return lambda v: "null" if v is None else inner(v)


def _plain_encoder(kind: T.DataType, meta: dict, html: bool, path: str) -> Callable[[Any], str]:
    if isinstance(kind, T.BooleanType):
        return lambda v: "true" if v else "false"
    if isinstance(kind, T.StringType):
        if meta.get("json.raw"):
            return lambda v: D.compact(v.encode()).decode()
        if meta.get("json.number"):

            def spelling(v):
                if v and not _NUMBER.match(v):
                    raise EncodeError(f"invalid number literal {v!r}")
                return v or "0"

            return spelling
        return lambda v: D.quoted(v, html)
    if isinstance(kind, (T.IntegralType, T.NullType)):
        return str  # NullType has no values but NULL
    if isinstance(kind, T.DecimalType):
        return lambda v: format(v, "f")
    if isinstance(kind, T.FractionalType):
        bits = 32 if isinstance(kind, T.FloatType) else 64

        def real(v):
            try:
                return float_text(v, bits)
            except ValueError as e:
                raise EncodeError(str(e)) from e

        return real
    if isinstance(kind, T.BinaryType):
        return lambda v: '"' + base64.b64encode(v).decode() + '"'
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return lambda v: '"' + time_text(v) + '"'
    if isinstance(kind, T.ArrayType):
        item = _encoder(kind.elementType, {}, html, f"{path}[]")

        def array(v):
            out = []
            for i, x in enumerate(v):
                try:
                    out.append(item(x))
                except EncodeError as e:
                    raise e.under(f"[{i}]")
            return "[" + ",".join(out) + "]"

        return array
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, (T.StringType, T.IntegralType, T.DecimalType)):
            raise UnsupportedTypeError(kind, path, "map keys are strings or integers")
        value = _encoder(kind.valueType, {}, html, f"{path}{{}}")
        return lambda v: "{" + ",".join(_members(v, value, html)) + "}"
    if isinstance(kind, T.StructType):
        return _struct_encoder(kind, html, path)
    raise UnsupportedTypeError(kind, path, "no JSON form")


def _members(v: Any, value: Callable, html: bool) -> list[str]:
    pairs = [(k if isinstance(k, str) else format(k, "d") if isinstance(k, int) else format(k, "f"), x) for k, x in (v.items() if isinstance(v, dict) else v)]
    out = []
    for k, x in sorted(pairs, key=lambda p: p[0].encode("utf-8", "surrogatepass")):
        try:
            out.append(D.quoted(k, html) + ":" + value(x))
        except EncodeError as e:
            raise e.under(k)
    return out


def time_text(v: datetime.datetime) -> str:
    """RFC 3339 in UTC, the fraction without zeros at its end."""
    if v.tzinfo is not None:
        v = v.astimezone(datetime.timezone.utc)
    fraction = f".{v.microsecond:06d}".rstrip("0") if v.microsecond else ""
    return f"{v.year:04d}-{v.month:02d}-{v.day:02d}T{v.hour:02d}:{v.minute:02d}:{v.second:02d}{fraction}Z"


def _struct_encoder(kind: T.StructType, html: bool, path: str) -> Callable[[Any], str]:
    members = []
    for m in resolve(kind):
        meta, data = m.field.metadata, m.field.dataType
        if meta.get("json.inline"):
            members.append((m, None, _encoder(data.valueType, {}, html, path), None))
        else:
            members.append((m, D.quoted(m.name, html) + ":", _encoder(data, meta, html, f"{path}.{m.name}".lstrip(".")), zero(data)))

    def struct(v):
        out, last = [], []
        for m, name, encode, nothing in members:
            x = v
            for step in m.path:
                x = None if x is None else x[step]
            if name is None:
                last += _members(x or {}, encode, html)
                continue
            meta = m.field.metadata
            if meta.get("json.omitempty") and (x is None or x is False or (not isinstance(x, dict) and x in (0, "", [], b"", {}))):
                continue
            if meta.get("json.omitzero") and (x is None or x == nothing):
                continue
            try:
                out.append(name + encode(x))
            except EncodeError as e:
                raise e.under(m.name)
        return "{" + ",".join(out + last) + "}"

    return struct


def encoder(schema: T.DataType | str | None = None, escape_html: bool = True, mode: str = FAILFAST):
    """The Arrow function behind json_encode; values of any type, told by their batches where no schema is given."""
    fixed = _encoder(_schema(schema), {}, escape_html, "") if schema is not None else None

    def batch(values: pa.Array) -> pa.Array:
        encode = fixed or _encoder(from_arrow_type(values.type), {}, escape_html, "")
        out = []
        for v in values.to_pylist():
            try:
                out.append(encode(v))
            except ValueError:
                if mode == FAILFAST:
                    raise
                out.append(None)
        return pa.array(out, pa.string())

    batch.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, T.StringType())


def json_encode(c: Column | str, schema: T.DataType | str | None = None, escape_html: bool = True, mode: str = FAILFAST) -> Column:
    """The value as compact JSON: fields in order, NULL as null, map members sorted by their keys' bytes, binary as base64,
    shortest numbers, RFC 3339 times. NaN and the infinities raise, or give NULL in PERMISSIVE mode. The schema is only
    needed for its metadata."""
    return encoder(schema, escape_html, mode)(_column(c))
