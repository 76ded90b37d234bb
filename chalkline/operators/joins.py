"""Joins that keep rows without a key out of the shuffle, and large sides out of the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_known(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join in which rows with a null key pass by: they cannot match, and would all meet in one task.

    The right side holds each key once at most or repeats rows as any join does; columns come in the order of a left join.
    """
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    more = [c for c in right.columns if c not in keys]
    order = [*keys, *[c for c in left.columns if c not in keys], *more]
    known = left.where(~missing).join(right, list(keys), "left").select(*order)
    kinds = dict(right.dtypes)
    absent = left.where(missing).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in more]).select(*order)
    return known.unionByName(absent)


def join_large(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join with a side of a row per student-year, which is never broadcast: its stored files look small but
    hold many times their size in rows, and a broadcast passes all of them through the driver."""
    return left.join(right.hint("merge"), list(keys), how)
