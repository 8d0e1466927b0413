"""Joins of many rows to one row a key that hold whatever part of the rows a key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many marks are broadcast whole; beyond, only keys with more than 1 / HOT_KEYS of the rows, of which there are fewer than HOT_KEYS.
SMALL_ROWS, HOT_KEYS = 200_000, 1_000


def attach(rows: DataFrame, marks: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", small_rows: int = SMALL_ROWS) -> DataFrame:
    """``rows`` with the further columns of ``marks``; keys match null-safely, as ``how`` says (inner or left).

    ``marks`` has each key once, and in ``weight`` the number of rows that have it; it is read several times, so
    give it materialized. Its size is counted: a small one is broadcast, so that no row moves. Beyond that the
    hot keys are broadcast, a number that their share bounds, and only rows of other keys are shuffled: no task
    gets more than a thousandth of the rows for one key. Empty sides give what the join gives; columns of marks
    must not be among those of rows.
    """
    others = [c for c in marks.columns if c not in (*keys, weight)]

    def join(part: DataFrame, side: DataFrame, kind: str) -> DataFrame:
        side = side.select(*[F.col(f"`{k}`").alias(f"__k_{k}") for k in keys], *others)
        same = [part[f"`{k}`"].eqNullSafe(side[f"__k_{k}"]) for k in keys]
        return part.join(side, same, kind).select(*rows.columns, *(others if kind != "left_anti" else []))

    n, total = marks.agg(F.count("*"), F.sum(weight)).first()
    if n <= small_rows:
        return join(rows, F.broadcast(marks), how)
    hot, cold = marks.where(F.col(weight) * HOT_KEYS > total), marks.where(F.col(weight) * HOT_KEYS <= total)
    return join(rows, F.broadcast(hot), "inner").unionByName(join(join(rows, F.broadcast(hot), "left_anti"), cold, how))
