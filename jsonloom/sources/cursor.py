"""A forward cursor over one valid JSON value: the caller drives a single pass and builds nothing that it does not ask for."""

from __future__ import annotations

import re
from json.decoder import scanstring

from jsonloom.functions import grammar as G

_blank = re.compile(r"[ \t\n\r]*").match
_number = re.compile(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?").match
_string = re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL).match
_structure = re.compile(r'"(?:[^"\\]|\\.)*+"|[][{}]', re.DOTALL).finditer
_KINDS = {'"': G.STRING, "{": G.OBJECT, "[": G.ARRAY, "t": G.BOOL, "f": G.BOOL, "n": G.NULL}
_WORDS = {"true": True, "false": False}


class CursorError(ValueError):
    """Another kind of value than asked for, or a walk that left something over; offset in characters."""

    def __init__(self, offset: int, message: str):
        self.offset, self.message = offset, message
        super().__init__(f"{message} at offset {offset}")


class ValueCursor:
    """Stands at a value: read it, enter it (begin_array, begin_object) or skip it. Inside an array, next_element goes to the next
    element; inside an object, next_field gives the next key and goes to its value. Both tell when the container ends, and the
    cursor then stands behind it. Containers may be as deep as the grammar allows: nothing recurses."""

    def __init__(self, text: str):
        self.text = text
        self.at = _blank(text, 0).end()
        self.open: list[list] = []  # closing bracket, whether a child has come

    def _expected(self, what: str) -> CursorError:
        return CursorError(self.at, f"expected {what}")

    def kind(self) -> str | None:
        """The kind of the value here; None: there is none."""
        c = self.text[self.at : self.at + 1]
        return _KINDS.get(c) or (G.NUMBER if c and c in "-0123456789" else None)

    def null(self) -> bool:
        """Whether a null stood here, which is then read; another value stays."""
        if not self.text.startswith("null", self.at):
            return False
        self.at += 4
        return True

    def bool(self) -> bool:
        for word, value in _WORDS.items():
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return value
        raise self._expected("bool")

    def number_text(self) -> str:
        m = _number(self.text, self.at)
        if not m:
            raise self._expected("number")
        self.at = m.end()
        return m[0]

    def _integer(self, low: int, high: int) -> int:
        start, spelled = self.at, self.number_text()
        if spelled.lstrip("-").isdigit() and len(spelled) <= 20 and low <= int(spelled) <= high and not (low == 0 and spelled[0] == "-"):
            return int(spelled)
        self.at = start
        raise self._expected("integer in range")

    def int64(self) -> int:
        return self._integer(-(1 << 63), (1 << 63) - 1)

    def uint64(self) -> int:
        """Any minus, even of -0, is out of range."""
        return self._integer(0, (1 << 64) - 1)

    def float64(self) -> float:
        start = self.at
        value = float(self.number_text())
        if value in (float("inf"), float("-inf")):
            self.at = start
            raise self._expected("number in range")
        return value

    def string(self) -> str:
        """The decoded text of a string."""
        if self.kind() != G.STRING:
            raise self._expected("string")
        value, self.at = scanstring(self.text, self.at + 1, True)
        return value

    def raw(self) -> str:
        """The source of any value, which is skipped."""
        start = self.at
        self.skip()
        return self.text[start : self.at]

    def begin_array(self) -> None:
        self._begin("[", "]", "array")

    def begin_object(self) -> None:
        self._begin("{", "}", "object")

    def _begin(self, bracket: str, end: str, name: str) -> None:
        if self.text[self.at : self.at + 1] != bracket:
            raise self._expected(name)
        self.at = _blank(self.text, self.at + 1).end()
        self.open.append([end, False])

    def _next(self, bracket: str, name: str) -> bool:
        if not self.open or self.open[-1][0] != bracket:
            raise CursorError(self.at, f"not in {name}")
        top = self.open[-1]
        self.at = _blank(self.text, self.at).end()
        c = self.text[self.at : self.at + 1]
        if c == bracket:
            self.open.pop()
            self.at += 1
            return False
        if top[1]:
            if c != ",":
                raise self._expected("comma: the value before it has not been read")
            self.at = _blank(self.text, self.at + 1).end()
        elif c == ",":
            raise self._expected(name)
        top[1] = True
        return True

    def next_element(self) -> bool:
        return self._next("]", "an array")

    def next_field(self) -> str | None:
        """The next member's decoded key; None: the object has ended."""
        if not self._next("}", "an object"):
            return None
        key = self.string()
        self.at = _blank(self.text, _blank(self.text, self.at).end() + 1).end()
        return key

    def skip(self) -> None:
        """Goes behind the value here, counting brackets only."""
        kind = self.kind()
        if kind is None:
            raise self._expected("value")
        if kind == G.STRING:
            self.at = _string(self.text, self.at).end()
        elif kind == G.NUMBER:
            self.number_text()
        elif kind in (G.ARRAY, G.OBJECT):
            depth = 0
            for m in _structure(self.text, self.at):
                depth += (m[0] in "[{") - (m[0] in "]}")
                if not depth:
                    self.at = m.end()
                    return
        else:
            self.at += 5 if self.text[self.at] == "f" else 4

    def finish(self) -> None:
        """Raises unless the value has been gone through to its end."""
        if self.open or _blank(self.text, self.at).end() != len(self.text) or not self.text.strip(" \t\n\r"):
            raise CursorError(self.at, "the value has not been read to its end")
