"""Table functions over a document: elements, members, and the tape as a relation. Use them with LATERAL or lateralJoin; in the
DataFrame API F.inline over json_each_array and json_each_object (columns.py) gives the same rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from jsonloom.functions import grammar as G
from jsonloom.functions.columns import FAILFAST, PERMISSIVE
from jsonloom.functions.columns import _children as children


def _delivered(doc: str | None, bracket: str, mode: str | None) -> Iterator[tuple]:
    """The root's children. What stands before a fault is delivered; then FAILFAST (the default) raises and PERMISSIVE ends."""
    if doc is None:
        return
    fault = None
    try:
        found = children(doc, bracket, (mode or FAILFAST).upper())
    except G.JsonSyntaxError as e:
        found, fault = children(doc, bracket, PERMISSIVE), e
    yield from found
    if fault:
        raise fault


@F.udtf(returnType="pos: int, raw: string, kind: string")
class JsonEachArray:
    """json_each_array(doc[, mode]): an array's elements in order."""

    def eval(self, doc: str, mode: str = "FAILFAST"):
        for pos, (_, _, raw, kind) in enumerate(_delivered(doc, "[", mode)):
            yield pos, raw, kind


@F.udtf(returnType="pos: int, key: string, raw_key: string, raw: string, kind: string")
class JsonEachObject:
    """json_each_object(doc[, mode]): an object's members in order, duplicates kept."""

    def eval(self, doc: str, mode: str = "FAILFAST"):
        for pos, child in enumerate(_delivered(doc, "{", mode)):
            yield pos, *child


@F.udtf(returnType="entry_id: int, parent_id: int, depth: int, key: string, ordinal: int, kind: string, start: int, end: int, next: int, count: int, is_key: boolean, escaped: boolean")
class JsonTape:
    """json_tape(doc): the structural index in preorder. Keys are entries; next is the entry behind the subtree; start and end
    are byte offsets; count is the number of children. An invalid document raises."""

    def eval(self, doc: str):
        if doc is None:
            return
        tape = G.parse(doc.encode("utf-8", "surrogatepass"))
        open_: list[list[int]] = []  # entry, next, children so far
        key = None
        for i in range(len(tape)):
            while open_ and i >= open_[-1][1]:
                open_.pop()
            parent = open_[-1] if open_ else None
            is_key = tape.kind[i] == G.KEY
            raw = tape.raw(i) if tape.kind[i] in (G.KEY, G.STRING) else b""
            kind = G.STRING if is_key else tape.kind[i]
            if is_key:
                key = tape.text(i)
            in_object = parent is not None and tape.kind[parent[0]] == G.OBJECT
            yield i, parent[0] if parent else None, len(open_), key if in_object else None, parent[2] if parent else None, kind, tape.start[i], tape.end[i], tape.next[i], tape.count[i], is_key, b"\\" in raw
            if parent and not is_key:
                parent[2] += 1
            if tape.kind[i] in (G.ARRAY, G.OBJECT):
                open_.append([i, tape.next[i], 0])


TABLE_FUNCTIONS = {"json_each_array": JsonEachArray, "json_each_object": JsonEachObject, "json_tape": JsonTape}
