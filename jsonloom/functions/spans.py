"""Spans of selected values in valid documents, at the speed of the C scanner: values that are not wanted are skipped by it.

Offsets are in characters of the text. Callers check validity first; documents too deep for the C scanner raise RecursionError,
and the tape does instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

from jsonloom.functions import grammar as G
from jsonloom.functions.pointer import Pointer, PointerError

_blank = re.compile(r"[ \t\n\r]*").match
_STRING = r'"(?:[^"\\]|\\.)*+"'
_CONTAINER = rf'[\[{{](?:[^][{{}}"]++|{_STRING})*+[\]}}]'
for _ in range(2):  # containers with containers in them, three deep in all
    _CONTAINER = rf'[\[{{](?:[^][{{}}"]++|{_STRING}|{_CONTAINER})*+[\]}}]'
_VALUE = rf'({_STRING}|[^][{{}}",: \t\n\r]++|{_CONTAINER})'
#: Sources of all members or elements of a container that ends with the text, by one call; at a deeper value, which is left empty,
#: they end.
_members = re.compile(rf"({_STRING})[ \t\n\r]*+:[ \t\n\r]*+(?:{_VALUE}|.*)", re.DOTALL).findall
_elements = re.compile(rf"{_VALUE}|[\[{{].*", re.DOTALL).findall
_skip = json.JSONDecoder(parse_int=str, parse_float=str, object_pairs_hook=len).scan_once


def _refuse(word: str):
    raise ValueError(word)


_strictly = json.JSONDecoder(parse_constant=_refuse, parse_int=str, parse_float=str, object_pairs_hook=len).scan_once
_surrogate = re.compile(r"\\u[dD][89a-fA-F]").search
_KINDS = {'"': G.STRING, "{": G.OBJECT, "[": G.ARRAY, "t": G.BOOL, "f": G.BOOL, "n": G.NULL}


class Unsure(Exception):
    """There is a fault, or something whose validity the C scanner does not decide."""


def root(text: str) -> tuple[int, int]:
    start = _blank(text, 0).end()
    return start, _skip(text, start)[1]


def members(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """Decoded keys and spans of the object at this place."""
    for key, _, _, start, end in members_with_keys(text, at):
        yield key, start, end


def members_with_keys(text: str, at: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Decoded keys, their own spans, and the values' spans."""
    i = _blank(text, at + 1).end()
    while text[i] != "}":
        first = i
        key, i = scanstring(text, i + 1, True)
        start = _blank(text, _blank(text, i).end() + 1).end()
        end = _skip(text, start)[1]
        yield key, first, i, start, end
        i = _blank(text, end).end()
        if text[i] == ",":
            i = _blank(text, i + 1).end()


def elements(text: str, at: int) -> Iterator[tuple[int, int]]:
    i = _blank(text, at + 1).end()
    while text[i] != "]":
        end = _skip(text, i)[1]
        yield i, end
        i = _blank(text, end).end()
        if text[i] == ",":
            i = _blank(text, i + 1).end()


def key_text(raw: str) -> str:
    """A key's text, of its source."""
    return scanstring(raw, 1, True)[0] if "\\" in raw else raw[1:-1]


def pairs(text: str, at: int = 0) -> list[tuple[str, str]]:
    """Sources of keys and values of the object that starts here and ends with the text."""
    found = _members(text, at + 1)
    if found and not found[-1][1]:
        return [(text[i:j], text[a:b]) for _, i, j, a, b in members_with_keys(text, at)]
    return found


def items(text: str, at: int = 0) -> list[str]:
    """Sources of the elements of the array that starts here and ends with the text."""
    found = _elements(text, at + 1)
    if found and not found[-1]:
        return [text[a:b] for a, b in elements(text, at)]
    return found


def get(text: str, pointer: Pointer) -> str | None:
    """The source of what the pointer selects; of duplicate keys the last counts."""
    text = text.strip(" \t\n\r")
    for token in pointer.tokens:
        found = None
        if text[0] == "{":
            for key, value in pairs(text):
                if key_text(key) == token.text:
                    found = value
        elif text[0] == "[":
            if token.fault:
                raise PointerError(pointer.text, token.fault)
            if token.index is not None:
                found = items(text)
                found = found[token.index] if token.index < len(found) else None
        if found is None:
            return None
        text = found
    return text


def get_many(text: str, pointers: dict[str, Pointer]) -> dict[str, str | None]:
    """As get, for several pointers: each container is gone through once."""
    out: dict[str, str | None] = dict.fromkeys(pointers)
    todo = [(text.strip(" \t\n\r"), 0, list(pointers.items()))]
    while todo:
        text, depth, wanted = todo.pop()
        below: dict = {}
        for name, pointer in wanted:
            if len(pointer.tokens) == depth:
                out[name] = text
            else:
                below.setdefault(pointer.tokens[depth].text, []).append((name, pointer))
        if not below:
            continue
        if text[0] == "{":
            found = {key_text(key): value for key, value in pairs(text)}
            todo += [(found[key], depth + 1, group) for key, group in below.items() if key in found]
        elif text[0] == "[":
            found = items(text)
            for group in below.values():
                token = group[0][1].tokens[depth]
                if token.fault:
                    raise PointerError(group[0][1].text, token.fault)
                if token.index is not None and token.index < len(found):
                    todo.append((found[token.index], depth + 1, group))
    return out


def children(text: str, at: int) -> list[tuple]:
    """Key, key's source, value's source and kind of the children of the container that starts here and ends with the text; None as
    keys of elements."""
    text = text.rstrip(" \t\n\r")
    if text[at] == "[":
        return [(None, None, v, _KINDS.get(v[0], G.NUMBER)) for v in items(text, at)]
    return [(key_text(k), k, v, _KINDS.get(v[0], G.NUMBER)) for k, v in pairs(text, at)]


def _after(text: str, at: int) -> int:
    """The end of the value at this place, which is validated."""
    try:
        end = _strictly(text, at)[1]
    except (ValueError, StopIteration) as e:
        raise Unsure from e
    if _surrogate(text, at, end):
        raise Unsure
    return end


def get_first(text: str, pointer: Pointer) -> str | None:
    """The source of what the pointer selects, each token taking the first member under which the rest selects something. The text
    need not be valid: what stands behind the selected value is not looked at, all before it is validated."""
    found, end = _first(text, pointer.tokens, _blank(text, 0).end())
    if found:
        return text[found[0] : found[1]]
    if _blank(text, end).end() != len(text):
        raise Unsure
    return None


def _first(text: str, tokens: tuple, at: int) -> tuple[tuple[int, int] | None, int]:
    """What the tokens select in the value at this place; if nothing, where the value ends."""
    if not tokens:
        return (at, _after(text, at)), -1
    bracket, token = text[at : at + 1], tokens[0]
    if bracket not in ("{", "["):
        return None, _after(text, at)
    if bracket == "[" and token.fault:
        raise Unsure  # the tape's way raises it, unless a fault comes first
    i, n = _blank(text, at + 1).end(), 0
    if text[i : i + 1] == ("}" if bracket == "{" else "]"):
        return None, i + 1
    while True:
        wanted = n == token.index
        if bracket == "{":
            if text[i : i + 1] != '"':
                raise Unsure
            try:
                key, j = scanstring(text, i + 1, True)
            except ValueError as e:
                raise Unsure from e
            if _surrogate(text, i, j):
                raise Unsure
            wanted, j = key == token.text, _blank(text, j).end()
            if text[j : j + 1] != ":":
                raise Unsure
            i = _blank(text, j + 1).end()
        if wanted:
            found, end = _first(text, tokens[1:], i)
            if found:
                return found, -1
        else:
            end = _after(text, i)
        i, n = _blank(text, end).end(), n + 1
        if text[i : i + 1] == ("}" if bracket == "{" else "]"):
            return None, i + 1
        if text[i : i + 1] != ",":
            raise Unsure
        i = _blank(text, i + 1).end()
