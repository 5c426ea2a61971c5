"""The strict grammar: validity, diagnosis, and a tape of spans.

A tape lists a document's values in preorder; an object's member is its key's entry and then its value's. Each entry has a
kind, the byte span of its source, the place where the next sibling starts, and the number of its children. Nothing here
recurses, so depth is bounded by MAX_DEPTH alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

MAX_DEPTH = 10_000
NULL, BOOL, NUMBER, STRING, ARRAY, OBJECT, KEY = "null", "bool", "number", "string", "array", "object", "key"

_BLANK = re.compile(rb"[ \t\n\r]*")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"')
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_LITERAL = {ord("t"): (b"true", BOOL), ord("f"): (b"false", BOOL), ord("n"): (b"null", NULL)}
_SURROGATE = re.compile(rb"\\u[dD][89a-fA-F]")
_SURROGATE_TEXT = re.compile(r"\\u[dD][89a-fA-F]")


class JsonSyntaxError(ValueError):
    """Where (zero-based byte offset; one-based line and byte column) and how a document breaks the grammar."""

    def __init__(self, data: bytes, offset: int, message: str, tape: Tape | None = None):
        self.offset = max(0, min(offset, len(data)))
        before = data[: self.offset]
        self.line = before.count(b"\n") + 1
        self.column = self.offset - (before.rfind(b"\n") + 1) + 1
        self.message, self.tape = message, tape
        super().__init__(f"json syntax error at byte {self.offset}, line {self.line}, column {self.column}: {message}")


class Tape:
    __slots__ = ("count", "data", "end", "kind", "next", "start")

    def __init__(self, data: bytes):
        self.data = data
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []  # -1 while the value is open
        self.next: list[int] = []
        self.count: list[int] = []

    def __len__(self) -> int:
        return len(self.kind)

    def add(self, kind: str, start: int, end: int) -> int:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)
        self.next.append(len(self.kind))
        self.count.append(0)
        return len(self.kind) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def elements(self, i: int) -> list[int]:
        out, at, stop = [], i + 1, self.next[i]
        while at < stop:
            out.append(at)
            at = self.next[at]
        return out

    def members(self, i: int) -> list[tuple[int, int]]:
        """Key and value entries, in order; a key whose value is missing (in the tape of a broken document) is left out."""
        out, at, stop = [], i + 1, self.next[i]
        while at + 1 < stop:
            out.append((at, at + 1))
            at = self.next[at + 1]
        return out

    def text(self, i: int) -> str:
        return decoded(self.raw(i))


def decoded(raw: bytes) -> str:
    """The text of a valid string token."""
    return json.loads(raw) if b"\\" in raw else raw[1:-1].decode()


def _string_fault(data: bytes, start: int) -> tuple[int, str] | None:
    """The first fault of the string that starts here, byte by byte."""
    i, n = start + 1, len(data)
    while i < n:
        c = data[i]
        if c == 0x22:
            return None
        if c < 0x20:
            return i, "unescaped control byte in string"
        if c == 0x5C:
            if i + 1 >= n:
                return n, "unterminated escape sequence"
            e = data[i + 1]
            if e in b'"\\/bfnrt':
                i += 2
                continue
            if e != 0x75:
                return i, "invalid escape sequence"
            unit = _hex(data, i + 2)
            if unit is None:
                return i, "invalid unicode escape"
            if 0xDC00 <= unit < 0xE000:
                return i, "unexpected low surrogate"
            if unit >> 10 == 0x36:
                if i + 12 > n or data[i + 6 : i + 8] != b"\\u":
                    return i, "missing low surrogate"
                low = _hex(data, i + 8)
                if low is None or low >> 10 != 0x37:
                    return i, "invalid low surrogate"
                i += 6
            i += 6
        elif c < 0x80:
            i += 1
        else:
            size = 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            try:
                data[i : i + size].decode()
            except UnicodeDecodeError:
                return i, "invalid UTF-8 in string"
            i += size
    return n, "unterminated string"


def _hex(data: bytes, i: int) -> int | None:
    digits = data[i : i + 4]
    return int(digits, 16) if len(digits) == 4 and all(c in b"0123456789abcdefABCDEF" for c in digits) else None


def _byte_name(c: int) -> str:
    named = {0x07: "\\a", 0x08: "\\b", 0x0C: "\\f", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t", 0x0B: "\\v", 0x27: "\\'", 0x5C: "\\\\"}
    if c in named:
        return f"'{named[c]}'"
    if chr(c).isprintable():
        return f"'{chr(c)}'"
    return f"'\\x{c:02x}'" if c < 0x80 else f"'\\u{c:04x}'"


def scan(data: bytes, start: int = 0, max_depth: int = MAX_DEPTH) -> Tape:
    """The tape of the value at start (blanks before it are skipped). Raises JsonSyntaxError, which has the tape so far."""
    tape, open_, n = Tape(data), [], len(data)
    blank, string, number = _BLANK.match, _STRING.match, _NUMBER.match

    def fault(at: int, message: str) -> JsonSyntaxError:
        for i in open_:
            tape.next[i] = len(tape)
        return JsonSyntaxError(data, at, message, tape)

    def quoted(at: int, kind: str) -> int:
        m = string(data, at)
        token = m[0] if m else b""
        if not m or not token.isascii() or (b"\\u" in token and _SURROGATE.search(token)):
            found = _string_fault(data, at)
            if found:
                raise fault(*found)
        tape.add(kind, at, m.end())
        return m.end()

    i, first = blank(data, start).end(), False  # first: right after an opening bracket
    while True:
        # a value starts at i, or the container that was just opened ends
        c = data[i] if i < n else -1
        done = True
        if first and c == (0x5D if tape.kind[open_[-1]] == ARRAY else 0x7D):
            i += 1
            top = open_.pop()
            tape.end[top], tape.next[top] = i, len(tape)
        else:
            if open_ and tape.kind[open_[-1]] == OBJECT:
                if c != 0x22:
                    raise fault(i, "expected object key string")
                i = blank(data, quoted(i, KEY)).end()
                if i >= n or data[i] != 0x3A:
                    raise fault(i, "expected colon after object key")
                i = blank(data, i + 1).end()
                c = data[i] if i < n else -1
            if open_:
                tape.count[open_[-1]] += 1
            if c == 0x22:
                i = quoted(i, STRING)
            elif c == 0x7B or c == 0x5B:
                if len(open_) >= max_depth:
                    raise fault(i, "maximum nesting depth exceeded")
                open_.append(tape.add(OBJECT if c == 0x7B else ARRAY, i, -1))
                i = blank(data, i + 1).end()
                done = False
            elif c == 0x2D or 0x30 <= c <= 0x39:
                m = number(data, i)
                if not m:
                    raise fault(i, "invalid number")
                after = data[m.end() : m.end() + 1]
                if after == b"." and b"." not in m[0] and b"e" not in m[0].lower():
                    raise fault(i, "invalid number fraction")
                if after in (b"e", b"E") and b"e" not in m[0].lower():
                    raise fault(i, "invalid number exponent")
                tape.add(NUMBER, i, m.end())
                i = m.end()
            elif c in _LITERAL:
                word, kind = _LITERAL[c]
                if not data.startswith(word, i):
                    raise fault(i, "invalid literal")
                tape.add(kind, i, i + len(word))
                i += len(word)
            else:
                raise fault(i, "expected value" if c < 0 else f"unexpected byte {_byte_name(c)} while parsing value")
        first = not done
        while done and open_:
            # a value has ended inside a container: a comma, or the container's end
            i = blank(data, i).end()
            top = open_[-1]
            array = tape.kind[top] == ARRAY
            if i >= n:
                raise fault(i, "unterminated array" if array else "unterminated object")
            c = data[i]
            if c == 0x2C:
                i = blank(data, i + 1).end()
                done = False
            elif c == (0x5D if array else 0x7D):
                i += 1
                open_.pop()
                tape.end[top], tape.next[top] = i, len(tape)
            else:
                raise fault(i, "expected comma or closing bracket in array" if array else "expected comma or closing brace in object")
        if done:
            return tape


def parse(data: bytes, max_depth: int = MAX_DEPTH) -> Tape:
    """The tape of a whole document."""
    tape = scan(data, 0, max_depth)
    end = _BLANK.match(data, tape.end[0]).end()
    if end != len(data):
        raise JsonSyntaxError(data, end, "unexpected data after top-level value", tape)
    return tape


def _refuse(word: str):
    raise ValueError(word)


_loads = json.JSONDecoder(parse_constant=_refuse, parse_int=str, parse_float=str).decode


#: Texts that were found valid not long ago, so that the functions of a row need not check its document each for itself: two
#: generations of so many texts and characters; longer texts are not kept.
_KEPT, _KEPT_CHARACTERS, _LONGEST = 10_000, 4 << 20, 1 << 16
_young: dict[str, None] = {}
_old: dict[str, None] = {}
_characters = 0


def _keep(text: str) -> None:
    global _young, _old, _characters
    if len(_young) >= _KEPT or _characters >= _KEPT_CHARACTERS:
        _young, _old, _characters = {}, _young, 0
    _young[text] = None
    _characters += len(text)


def valid(text: str) -> bool:
    """Whether text is one strict document: the C parser decides, but for surrogates and great depth."""
    if text in _young or text in _old:
        return True
    found = _accepted(text, _loads)
    if found is None:
        found = _valid_slowly(text)
    if found and len(text) <= _LONGEST:
        _keep(text)
    return found


def _accepted(text: str, loads: Callable) -> bool | None:
    """What the C parser finds; None: it can't tell."""
    try:
        loads(text)
    except RecursionError:
        return None
    except ValueError:
        return False
    if _SURROGATE_TEXT.search(text):
        return None
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


def _distinct(members: list[tuple]) -> None:
    if len(members) > 1 and len(dict(members)) < len(members):
        raise ValueError("repeated key")


_loads_distinct = json.JSONDecoder(parse_constant=_refuse, parse_int=str, parse_float=str, object_pairs_hook=_distinct).decode


def surely_distinct(text: str) -> bool:
    """Whether the C parser alone finds the document valid and no object in it with a key twice."""
    return _accepted(text, _loads_distinct) is True


def _valid_slowly(text: str) -> bool:
    try:
        parse(text.encode())
    except ValueError:  # UnicodeEncodeError is one
        return False
    return True


def fold(tape: Tape, scalar: Callable, array: Callable, obj: Callable, root: int = 0):
    """Builds a value from the leaves up: scalar(kind, raw), array(values), obj([(key text, value)])."""
    made: dict[int, object] = {}
    kind = tape.kind
    for i in range(tape.next[root] - 1, root - 1, -1):
        if kind[i] == ARRAY:
            made[i] = array([made.pop(j) for j in tape.elements(i)])
        elif kind[i] == OBJECT:
            made[i] = obj([(tape.text(k), made.pop(v)) for k, v in tape.members(i)])
        elif kind[i] != KEY:
            made[i] = scalar(kind[i], tape.raw(i))
    return made[root]
