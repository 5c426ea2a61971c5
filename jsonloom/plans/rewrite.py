"""Plan rewrites on the driver: sibling selections on one column become one pass over it; keys are computed once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.columns import PERMISSIVE, json_extract_many


class Get(NamedTuple):
    """A selection that with_gets may share: pointer, then an accessor over the selected value (json_int64, ...)."""

    column: str
    pointer: str
    accessor: object = None
    mode: str = PERMISSIVE


def with_gets(df: DataFrame, gets: dict[str, Get]) -> DataFrame:
    """df with a column for each selection: one Python pass for each source column and mode, whatever their number."""
    groups: dict[tuple[str, str], dict[str, str]] = {}
    for g in gets.values():
        pointers = groups.setdefault((g.column, g.mode), {})
        pointers.setdefault(g.pointer, f"p{len(pointers)}")
    places: dict[tuple[str, str, str], Column] = {}
    staged, hidden = df, []
    for n, ((column, mode), pointers) in enumerate(groups.items()):
        name = f"__gets_{n}"
        hidden.append(name)
        staged = staged.withColumn(name, json_extract_many(column, {v: k for k, v in pointers.items()}, mode))
        for pointer, field in pointers.items():
            places[column, mode, pointer] = F.col(name)[field]
    for name, g in gets.items():
        raw = places[g.column, g.mode, g.pointer]
        staged = staged.withColumn(name, g.accessor(raw) if g.accessor else raw)
    return staged.drop(*hidden)


def once(column: Column) -> Column:
    """The column, computed once a row wherever it is used.

    Spark copies what a join or a filter knows of a column (that it is not null, or its comparison) below the projection that
    makes it, and so runs its Python a second time. A row number that decides nothing forbids that. Filters on other columns
    are not pushed below such a projection either, so put them before it."""
    return F.when(F.monotonically_increasing_id() >= 0, column)
