"""JSON Pointer (RFC 6901): compiled on the driver, resolved on a tape under the two rules for duplicate keys."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from jsonloom.functions.grammar import ARRAY, KEY, OBJECT, Tape

#: Indexes beyond this are no indexes (that of a 64-bit machine's int).
MOST = (1 << 63) - 1
_ESCAPES = re.compile("~(.?)", re.DOTALL)


class PointerError(ValueError):
    def __init__(self, pointer: str, message: str):
        self.pointer, self.message = pointer, message
        super().__init__(f"invalid JSON pointer {json.dumps(pointer, ensure_ascii=False)}: {message}")


class Token(NamedTuple):
    text: str
    raw: bytes  # UTF-8 of text, to compare with keys that have no escapes
    index: int | None  # on an array: the element
    fault: str | None  # on an array: why the token is no index


class Pointer(NamedTuple):
    text: str
    tokens: tuple[Token, ...]


def _plain(pointer: str, token: str) -> str:
    def one(m: re.Match) -> str:
        if not m[1]:
            raise PointerError(pointer, "dangling tilde escape")
        if m[1] not in "01":
            raise PointerError(pointer, "unknown tilde escape")
        return "~" if m[1] == "0" else "/"

    return _ESCAPES.sub(one, token)


def _index(token: str) -> tuple[int | None, str | None]:
    if token == "-":  # the place after the last element: always absent
        return None, None
    if not token.isascii() or not token.isdigit():
        return None, "array index is not numeric"
    if len(token) > 1 and token[0] == "0":
        return None, "array index has leading zero"
    return (int(token), None) if len(token) < 20 and int(token) <= MOST else (None, "array index overflows")


def compile_pointer(pointer: str) -> Pointer:
    """Raises PointerError for a pointer that is neither empty nor starts with a slash, or has a bad tilde escape."""
    if not pointer:
        return Pointer(pointer, ())
    if pointer[0] != "/":
        raise PointerError(pointer, "pointer must be empty or start with slash")
    plain = [_plain(pointer, t) for t in pointer[1:].split("/")]
    return Pointer(pointer, tuple(Token(t, t.encode("utf-8", "surrogatepass"), *_index(t)) for t in plain))


def key_is(tape: Tape, i: int, token: Token) -> bool:
    raw = tape.raw(i)
    return tape.text(i) == token.text if b"\\" in raw else raw[1:-1] == token.raw


def get(tape: Tape, pointer: Pointer, root: int = 0) -> int | None:
    """The entry that the pointer selects; of duplicate keys the last one counts. None: absent.

    A token that is no index raises PointerError on an array."""
    at = root
    for token in pointer.tokens:
        found = None
        if tape.kind[at] == OBJECT:
            for k, v in tape.members(at):
                if key_is(tape, k, token):
                    found = v
        elif tape.kind[at] == ARRAY:
            found = element(tape, at, token, pointer)
        if found is None:
            return None
        at = found
    return at


def element(tape: Tape, at: int, token: Token, pointer: Pointer) -> int | None:
    if token.fault:
        raise PointerError(pointer.text, token.fault)
    if token.index is None or token.index >= tape.count[at]:
        return None
    i = at + 1
    for _ in range(token.index):
        i = tape.next[i]
    return i if i < tape.next[at] else None


def get_first(tape: Tape, pointer: Pointer, root: int = 0) -> int | None:
    """As get, but each token takes the first member under which the rest of the pointer selects something."""
    todo = [(root, 0)]
    while todo:
        at, depth = todo.pop()
        if depth == len(pointer.tokens):
            return at
        token = pointer.tokens[depth]
        if tape.kind[at] == OBJECT:
            todo += [(v, depth + 1) for k, v in reversed(tape.members(at)) if key_is(tape, k, token)]
        elif tape.kind[at] == ARRAY:
            found = element(tape, at, token, pointer)
            if found is not None:
                todo.append((found, depth + 1))
    return None


class FieldCursor:
    """Finds members at or after the last hit, wrapping once; a hit moves the cursor behind it, a miss to the front."""

    def __init__(self, tape: Tape, at: int = 0):
        self.tape, self.members = tape, tape.members(at) if tape.kind[at] == OBJECT else []
        self.place = 0

    def find(self, key: str) -> int | None:
        token, n = Token(key, key.encode("utf-8", "surrogatepass"), None, None), len(self.members)
        for step in range(n):
            i = (self.place + step) % n
            if key_is(self.tape, self.members[i][0], token):
                self.place = i + 1
                return self.members[i][1]
        self.place = 0
        return None


__all__ = ["KEY", "FieldCursor", "Pointer", "PointerError", "Token", "compile_pointer", "get", "get_first"]
