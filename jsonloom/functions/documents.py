"""Whole-document transforms and predicates on tapes: compact, indent, canonicalize, normalize, containment."""

from __future__ import annotations

import json
import re
from json.encoder import encode_basestring

from jsonloom.functions.grammar import NUMBER, STRING, decoded, fold, parse, valid
from jsonloom.functions.numbers import canonical

_TOKENS = re.compile(rb'("(?:[^"\\]|\\.)*+")|[ \t\n\r]+', re.DOTALL)
_PIECES = re.compile(rb'"(?:[^"\\]|\\.)*+"|[][{},:]|[^][{},:" \t\n\r]+', re.DOTALL)
_TRAILING = re.compile(rb"[ \t\n\r]*\Z")
#: The short escapes.
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile('["\\\\\x00-\x1f\u2028\u2029]')
_HTML = re.compile("[<>&]")
_SPECIAL_HTML = re.compile('["\\\\\x00-\x1f\u2028\u2029<>&]')


def quoted(text: str, html: bool = False) -> str:
    """A string token: short escapes, \\u00XX for other control characters, U+2028 and U+2029 escaped; html: <, > and & too.
    Lone surrogates, which UTF-8 can't have, become \\ufffd."""
    if text.isascii() and not (html and _HTML.search(text)):
        return encode_basestring(text)
    out = (_SPECIAL_HTML if html else _SPECIAL).sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", text)
    return '"' + re.sub("[\ud800-\udfff]", r"\\ufffd", out) + '"'


def strip(raw: bytes) -> bytes:
    """A valid document without blanks between tokens, tokens verbatim."""
    return _TOKENS.sub(rb"\1", raw)


def _checked(data: bytes) -> str:
    """The document's text; raises its fault if it has one."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = ""
    if not valid(text):
        parse(data)
    return text


def compact(data: bytes) -> bytes:
    _checked(data)
    return strip(data)


def indent(data: bytes, prefix: str, step: str) -> bytes:
    """One member or element a line, each line with prefix and as many steps as its depth; empty containers stay closed, tokens
    and blanks after the document stay as they are."""
    _checked(data)
    out, depth, fresh = [], 0, False  # fresh: right after an opening bracket
    line = lambda: f"\n{prefix}{step * depth}".encode()
    for m in _PIECES.finditer(data):
        t = m[0]
        if t in (b"]", b"}"):
            depth -= 1
            out.append(t if fresh else line() + t)
            fresh = False
            continue
        if fresh:
            out.append(line())
            fresh = False
        if t in (b"[", b"{"):
            depth += 1
            fresh = True
            out.append(t)
        elif t == b",":
            out += [t, line()]
        else:
            out.append(b": " if t == b":" else t)
    return b"".join(out) + _TRAILING.search(data)[0]


def _scalar(kind: str, raw: bytes) -> str:
    return quoted(decoded(raw)) if kind == STRING else raw.decode()


class Spelling(str):
    """A number as it is spelled."""


class Pairs(list):
    """An object's members."""


load = json.JSONDecoder(parse_int=Spelling, parse_float=Spelling, object_pairs_hook=Pairs).decode
_WORDS = {True: "true", False: "false", None: "null"}


def _written(v, order: bool) -> str:
    kind = type(v)
    if kind is str:
        return quoted(v)
    if kind is Spelling:
        return v
    if kind is Pairs:
        if order:
            v.sort(key=lambda kv: kv[0].encode())
        return "{" + ",".join([quoted(k) + ":" + _written(x, order) for k, x in v]) + "}"
    if kind is list:
        return "[" + ",".join([_written(x, order) for x in v]) + "]"
    return _WORDS[v]


def normalize(data: bytes, order: bool = False) -> str:
    """Compact, with strings written anew and numbers verbatim; order: members sorted by their decoded key's UTF-8, all of a
    repeated key kept in their order."""

    try:
        return _written(load(_checked(data)), order)
    except RecursionError:
        pass  # too deep for both; the tape has no such bound

    def obj(members):
        if order:
            members.sort(key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
        return "{" + ",".join(quoted(k) + ":" + v for k, v in members) + "}"

    return fold(parse(data), _scalar, lambda v: "[" + ",".join(v) + "]", obj)


def canonicalize(data: bytes) -> str:
    return normalize(data, order=True)


def _number(spelling: str) -> tuple[str, str]:
    if spelling[-1] != "0" and spelling.isdigit():
        return NUMBER, spelling + "e0"
    return NUMBER, canonical(spelling)


_load = json.JSONDecoder(parse_int=_number, parse_float=_number).decode
_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def model(text: str):
    """For containment: dicts (the last duplicate counts), lists, strings, booleans, None, and numbers as (number, canonical)."""
    if not valid(text):
        parse(text.encode("utf-8", "surrogatepass"))
    try:
        return _load(text)
    except RecursionError:
        tape = parse(text.encode())
        return fold(tape, lambda kind, raw: decoded(raw) if kind == STRING else _number(raw.decode()) if kind == NUMBER else _CONSTANTS[raw], list, dict)


def contains(haystack, needle) -> bool:
    """Containment of models as PostgreSQL's jsonb defines it: an array at the top also contains an equal scalar.

    Nothing here recurses. An array contains a container if one of its own containers does, so the search below is one of
    alternatives: a frame holds what it still has to show (pairs that all must hold), or the containers of an array to try one
    after the other."""
    if type(haystack) is list and type(needle) not in (dict, list):
        return any(type(x) is type(needle) and x == needle for x in haystack)
    frames, answer = [_all([(haystack, needle)])], None
    while frames:  # each frame takes the answer of the one above it and gives a pair to look into, or its own answer
        step = frames[-1].send(answer)
        if type(step) is bool:
            frames.pop()
            answer = step
        else:
            frames.append(step)
            answer = None
    return answer


def _all(pairs):
    """Whether each needle is in its haystack; pairs of objects are taken apart here, arrays need frames of their own."""
    todo = list(pairs)
    while todo:
        hay, needle = todo.pop()
        if type(hay) is not type(needle):
            yield False
        if type(needle) is dict:
            if not all(k in hay for k in needle):
                yield False
            todo += [(hay[k], v) for k, v in needle.items()]
        elif type(needle) is list:
            scalars = {(type(x), x) for x in hay if type(x) not in (dict, list)}
            if not all((type(x), x) in scalars for x in needle if type(x) not in (dict, list)):
                yield False
            others = [x for x in hay if type(x) in (dict, list)]
            for x in needle:
                if type(x) in (dict, list) and not (yield _any(others, x)):
                    yield False
        elif hay != needle:
            yield False
    yield True


def _any(haystacks, needle):
    for x in haystacks:
        if type(x) is type(needle) and (yield _all([(x, needle)])):
            yield True
    yield False
