"""Frames values in a stream of bytes: newline-separated, blank-separated or directly concatenated."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from jsonloom.functions import grammar as G

_BLANK = re.compile(rb"[ \t\n\r]*+")
#: A container without others inside, which ends in these bytes.
_FLAT = re.compile(rb'[\[{](?:[^][{}"]++|"(?:[^"\\]|\\.)*+")*+[\]}]', re.DOTALL)
#: What can change the state outside and inside of strings.
_OUTSIDE, _INSIDE = re.compile(rb'["\[\]{}]'), re.compile(rb'["\\]')
_NUMBER_END = re.compile(rb"[^0-9.eE+-]|(?<![eE])[+-]")


class ValueFrame:
    """Finds the end of one value without reading any byte twice, however the value is split over reads.

    State between reads: depth, whether in a string, whether after a backslash. A literal ends with its last byte, so another value
    may follow at once; a number ends before a byte that no number has, or before a sign that no exponent stands before, or
    at the end of the input."""

    def __init__(self, first: int):
        self.depth, self.string, self.escaped = 0, first == 0x22, False
        self.literal = {0x74: 4, 0x6E: 4, 0x66: 5}.get(first, 0)  # bytes that are still to come
        self.number = not self.literal and first not in b'"[{'
        self.exponent = self.started = False

    def scan(self, data: bytes, at: int) -> int:
        """The end of the value in data, or -1: go on with the next bytes. at is the value's first byte on the first call."""
        n = len(data)
        if self.literal:
            take = min(self.literal, n - at)
            self.literal -= take
            self.number = False
            return -1 if self.literal else at + take
        if self.number:
            if not self.started:
                self.started = True
                at += 1
            elif self.exponent and data[at] in b"+-":
                at += 1
            m = _NUMBER_END.search(data, at)
            self.exponent = data[-1] in b"eE"
            return m.start() if m else -1
        if not self.started:
            self.started = True
            self.depth = 0 if self.string else 1
            at += 1
        while at < n:
            if self.escaped:
                self.escaped = False
                at += 1
                continue
            m = (_INSIDE if self.string else _OUTSIDE).search(data, at)
            if not m:
                return -1
            c, at = data[m.start()], m.end()
            if self.string:
                if c == 0x5C:
                    self.escaped = True
                else:
                    self.string = False
                    if not self.depth:
                        return at
            elif c == 0x22:
                self.string = True
            else:
                self.depth += 1 if c in b"[{" else -1
                if self.depth <= 0:
                    return at
        return -1


class StreamError(ValueError):
    def __init__(self, offset: int, message: str):
        self.offset, self.message = offset, message
        super().__init__(f"value at input offset {offset}: {message}")


def _checked(value: bytes, offset: int) -> bytes:
    """The value, if it is one; the C parser decides, and the tape tells what is wrong."""
    try:
        if G.valid(value.decode()):
            return value
    except UnicodeDecodeError:
        pass
    try:
        tape = G.scan(value)
    except G.JsonSyntaxError as e:
        raise StreamError(offset, e.message) from e
    if tape.end[0] != len(value):  # a number with something stuck to it, as 01
        raise StreamError(offset, "invalid character after value")
    return value


def values(chunks: Iterable[bytes], most: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offsets and sources of the stream's values, each validated. At the first fault StreamError is raised and nothing follows.
    What is left of a chunk is copied only when a value goes on in the next one, so the work is linear in the bytes.

    most: bytes that a value may have (0: any). Blank or empty input is a clean end."""
    held, base, source = b"", 0, iter(chunks)  # base: the stream's offset of held
    at = 0
    while True:
        at = _BLANK.match(held, at).end()
        if at == len(held):
            base, at = base + len(held), 0
            held = next((c for c in source if c), None)
            if held is None:
                return
            continue
        m = _FLAT.match(held, at)
        end = m.end() if m else -1
        if end < 0:
            frame = ValueFrame(held[at])
            end = frame.scan(held, at)
        if end < 0:
            held, base, at = held[at:], base + at, 0
            parts, size = [held], len(held)
            while end < 0:
                if most and size > most:
                    raise StreamError(base, f"value exceeds the limit of {most} bytes")
                more = next((c for c in source if c), None)
                if more is None:
                    end = size
                    break
                found = frame.scan(more, 0)
                parts.append(more)
                if found >= 0:
                    end = size + found
                size += len(more)
            held = b"".join(parts)
        if most and end - at > most:
            raise StreamError(base + at, f"value exceeds the limit of {most} bytes")
        yield base + at, _checked(held[at:end], base + at)
        at = end
