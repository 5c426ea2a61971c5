"""Registers the functions for spark.sql: Arrow functions that work once on each distinct row of a batch, with the code of
columns.py, and what Catalyst expresses by itself as SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jsonloom.functions import columns as C
from jsonloom.functions import documents as D
from jsonloom.functions import grammar as G
from jsonloom.functions import numbers as N
from jsonloom.functions import pointer as P
from jsonloom.functions import spans as S
from jsonloom.operators.codec import encoder
from jsonloom.operators.generators import TABLE_FUNCTIONS


@lru_cache(maxsize=1000)
def _pointer(pointer: str) -> P.Pointer:
    return P.compile_pointer(pointer)


def _get_first(text: str, pointer: str) -> str | None:
    try:
        return S.get_first(text, _pointer(pointer))
    except (S.Unsure, RecursionError):
        tape = C._parse(text)
        return C._span(tape, P.get_first(tape, _pointer(pointer)))


def _diagnose(text: str) -> dict:
    if not G.valid(text):
        try:
            C._parse(text)
        except G.JsonSyntaxError as e:
            return {"ok": False, "offset": e.offset, "line": e.line, "column": e.column, "message": e.message}
    return {"ok": True}


def _key(text: str, key: str) -> str | None:
    return dict(C._object(C._valid(text)) or ()).get(key)


def _index(text: str, index: str) -> str | None:
    found = C._array(C._valid(text)) or ()
    return found[int(index)] if index.isdigit() and int(index) < len(found) else None


def _members(text: str):
    found = C._object(C._valid(text))
    return None if found is None else [{"key": k, "value": v} for k, v in found]


def _text(raw: str) -> str | None:
    if not raw.strip(" \n\r\t").startswith('"'):
        return None
    text = json.loads(C._valid(raw))
    text.encode()
    return text


@lru_cache(maxsize=100)
def _short_needle(text: str):
    return D.model(text)


def _contains(haystack: str, needle: str) -> bool:
    return D.contains(D.model(haystack), _short_needle(needle) if len(needle) <= 1000 else D.model(needle))


def _canonical(text: str) -> str | None:
    return N.canonical(text) if G.valid(text) and text.strip(" \n\r\t")[0] in "-0123456789" else None


#: Name: function of one or more strings, and result type. NULL arguments give NULL; invalid documents give NULL.
SCALARS: dict[str, tuple[Callable, T.DataType]] = {
    "json_valid": (G.valid, T.BooleanType()),
    "json_validate": (_diagnose, C.DIAGNOSIS),
    "json_entry_count": (lambda x: len(C._parse(x)), T.IntegerType()),
    "json_get": (lambda x, p: C._got(C._valid(x), _pointer(p)), T.StringType()),
    "json_get_first": (_get_first, T.StringType()),
    "json_get_key": (_key, T.StringType()),
    "json_get_index": (_index, T.StringType()),
    "json_text": (_text, T.StringType()),
    "json_array_len": (lambda x: C._count(C._valid(x), "["), T.IntegerType()),
    "json_object_len": (lambda x: C._count(C._valid(x), "{"), T.IntegerType()),
    "json_contains": (_contains, T.BooleanType()),
    "json_number_canon": (_canonical, T.StringType()),
    "json_compact": (lambda x: D.compact(x.encode()).decode(), T.StringType()),
    "json_indent": (lambda x, prefix, step: D.indent(x.encode(), prefix, step).decode(), T.StringType()),
    "json_canonicalize": (lambda x: D.canonicalize(x.encode()), T.StringType()),
    "json_normalize": (lambda x: D.normalize(x.encode()), T.StringType()),
    "json_quote": (D.quoted, T.StringType()),
    "json_elements": (lambda x: C._array(C._valid(x)), C.SPANS),
    "json_members": (_members, C.MEMBERS),
}
#: How many arguments functions of more than one take.
ARGUMENTS = {"json_get": 2, "json_get_first": 2, "json_get_key": 2, "json_get_index": 2, "json_contains": 2, "json_indent": 3}
_BARE = r"trim(BOTH ' \n\r\t' FROM doc)"
_NUMBER = r"'\\A-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?\\z'"
#: What Catalyst expresses by itself: result type and SQL over the argument doc.
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "json_kind": ("STRING", r"""CASE left(ltrim(' \n\r\t', doc), 1) WHEN 'n' THEN 'null' WHEN 't' THEN 'bool' WHEN 'f' THEN 'bool'
        WHEN '"' THEN 'string' WHEN '[' THEN 'array' WHEN '{' THEN 'object'
        ELSE CASE WHEN left(ltrim(' \n\r\t', doc), 1) RLIKE '^[-0-9]$' THEN 'number' ELSE 'invalid' END END"""),
    "json_int64": ("BIGINT", rf"CASE WHEN {_BARE} RLIKE '\\A-?(0|[1-9][0-9]*)\\z' THEN try_cast({_BARE} AS BIGINT) END"),
    "json_uint64": ("DECIMAL(20,0)", rf"CASE WHEN {_BARE} RLIKE '\\A(0|[1-9][0-9]*)\\z' AND length({_BARE}) <= 20 AND try_cast({_BARE} AS DECIMAL(20,0)) <= 18446744073709551615 THEN try_cast({_BARE} AS DECIMAL(20,0)) END"),
    "json_float64": ("DOUBLE", rf"CASE WHEN {_BARE} RLIKE {_NUMBER} AND abs(try_cast({_BARE} AS DOUBLE)) < double('Infinity') THEN try_cast({_BARE} AS DOUBLE) END"),
    "json_number_text": ("STRING", rf"CASE WHEN {_BARE} RLIKE {_NUMBER} THEN {_BARE} END"),
    "json_is_integer": ("BOOLEAN", rf"coalesce({_BARE} RLIKE '\\A-?(0|[1-9][0-9]*)\\z', false)"),
    "json_is_null": ("BOOLEAN", rf"coalesce({_BARE} = 'null', false)"),
    "json_bool": ("BOOLEAN", rf"CASE {_BARE} WHEN 'true' THEN true WHEN 'false' THEN false END"),
}


def _function(each: Callable, kind: T.DataType, n: int):
    out = to_arrow_type(kind)

    def one(*args: str | None):
        try:
            return None if None in args else each(*args)
        except ValueError:
            return None

    def rows(*columns: pa.Array) -> pa.Array:
        encoded = [c.dictionary_encode() for c in columns]
        if all(len(c.dictionary) == 1 and not c.null_count for c in encoded[1:]):  # the usual case: literals
            rest = [c.dictionary[0].as_py() for c in encoded[1:]]
            return pa.array([one(x, *rest) for x in encoded[0].dictionary.to_pylist()], out).take(encoded[0].indices)
        known: dict[tuple, object] = {}
        found = []
        for args in zip(*[c.to_pylist() for c in columns]):
            if args not in known:
                known[args] = one(*args)
            found.append(known[args])
        return pa.array(found, out)

    batch = {1: lambda a: rows(a), 2: lambda a, b: rows(a, b), 3: lambda a, b, c: rows(a, b, c)}[n]
    batch.__annotations__ = {**dict.fromkeys("abc"[:n], pa.Array), "return": pa.Array}
    return F.arrow_udf(batch, kind)


def register(spark: SparkSession) -> list[str]:
    """Makes the scalar and table functions callable in spark.sql; gives their names."""
    for name, (each, kind) in SCALARS.items():
        spark.udf.register(name, _function(each, kind, ARGUMENTS.get(name, 1)))
    spark.udf.register("json_encode", encoder())
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    for name, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(doc STRING) RETURNS {kind} RETURN {body}")
    return sorted([*SCALARS, "json_encode", *TABLE_FUNCTIONS, *EXPRESSIONS])


def diagnostics(spark: SparkSession) -> dict[str, str]:
    """Versions of what runs the functions."""
    import sys

    import pyarrow

    return {"spark": spark.version, "python": sys.version.split()[0], "pyarrow": pyarrow.__version__, "depth": str(G.MAX_DEPTH)}
