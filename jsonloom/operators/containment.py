"""Containment joins by an inverted index, instead of comparing all pairs.

A document's terms are hashes of (path, kind, canonical scalar) for all its values; a path is the keys on the way, with one mark for
any array element. If a document contains a needle, it has all the needle's terms. Each needle goes by one of its terms, a
long one and a scalar if there is any: an equi-join on it finds the candidates, and containment itself decides.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonloom.functions import documents as D
from jsonloom.functions.columns import json_contains, per_document
from jsonloom.plans.rewrite import once

#: Needles are broadcast up to so many bytes, shuffled beyond.
BROADCAST_BYTES = 10_000_000


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _walk(model) -> list[tuple[int, int, str]]:
    """Path (a hash), its length, and kind with scalar of all values; an array at the top has its scalars at its own place too.

    A step hashes the path before it and its key, so the time is linear in the document however deep it is."""
    out, todo = [], [(0, 0, model)]
    if type(model) is list:
        todo += [(0, 0, x) for x in model if type(x) not in (dict, list)]
    while todo:
        path, size, value = todo.pop()
        if type(value) is dict:
            out.append((path, size, "{"))
            todo += [(_hash(str(path), k), size + len(k) + 1, v) for k, v in value.items()]
        elif type(value) is list:
            out.append((path, size, "["))
            inside = _hash(str(path))
            todo += [(inside, size + 1, v) for v in value]
        else:
            out.append((path, size, f"={type(value).__name__}{value!r}"))
    return out


def terms(text: str) -> list[int]:
    return sorted({_hash(str(path), "", kind) for path, _, kind in _walk(D.model(text))})


def probe(text: str) -> int:
    """The term that a needle goes by: strings and numbers before other scalars, these before containers; then the longest."""
    rank = lambda t: ((t[2][0] == "=") + t[2].startswith(("=str", "=tuple")), t[1] + len(t[2]), t[2], t[0])
    path, _, kind = max(_walk(D.model(text)), key=rank)
    return _hash(str(path), "", kind)


def contains_join(docs: DataFrame, doc: str, needles: DataFrame, needle: str) -> DataFrame:
    """The columns of docs and of needles for each pair where the document contains the needle. NULL and invalid documents and
    needles join nothing. A needle whose term many documents have meets them all, as any index would have it; adaptive
    execution splits its rows. Column names must differ."""
    found = docs.withColumn("_term", F.explode(per_document(terms, T.ArrayType(T.LongType()), "PERMISSIVE")(doc)))
    wanted = needles.withColumn("_term", once(per_document(probe, T.LongType(), "PERMISSIVE")(needle)))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length(F.col(needle)) + 64), F.lit(0))).first()[0]
    pairs = found.join(F.broadcast(wanted) if size <= BROADCAST_BYTES and len(needles.columns) <= 4 else wanted, "_term").drop("_term")
    return pairs.where(json_contains(F.col(doc), F.col(needle)))


__all__ = ["contains_join", "probe", "terms"]
