"""Order-free checksums of rows: what changed between two states of a table, without moving the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Count, exclusive-or and sum of row hashes; two states with equal values count as equal.
SUMS = ("n", "mix", "total")


def row_hash(columns: Sequence[str]) -> Column:
    """64 bits over all columns, nulls told apart from values."""
    marks = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return F.xxhash64(marks, *[F.col(c) for c in columns])


def checksums(df: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """One row per group with the checksum of its rows; partial sums combine before the shuffle.

    The sum takes the upper 32 bits of each hash, so it stays in 64 bits for up to 2^31 rows a group.
    """
    hashed = df.withColumn("__h", row_hash(sorted(df.columns)))
    return hashed.groupBy(*by).agg(
        F.count("*").alias("n"), F.bit_xor("__h").alias("mix"), F.sum(F.shiftrightunsigned("__h", 32)).alias("total")
    )


def differing(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose checksums differ or that one side lacks, with both row counts (NULL where absent).

    Each side's rows are added to one grouped sum, so null group values need no special join.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        cells = {f"{c}_{s}": F.col(c) if s == name else F.lit(None).cast("bigint") for c in SUMS for s in ("left", "right")}
        return df.select(*by, *[v.alias(k) for k, v in cells.items()])

    both = side(left, "left").unionByName(side(right, "right")).groupBy(*by)
    both = both.agg(*[F.max(f"{c}_{s}").alias(f"{c}_{s}") for c in SUMS for s in ("left", "right")])
    same = F.lit(True)
    for c in SUMS:
        same = same & F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right"))
    return both.where(~same).select(*by, F.col("n_left"), F.col("n_right"))


def differing_rows(left: DataFrame, right: DataFrame, by: Sequence[str], key: Sequence[str], buckets: int = 64) -> DataFrame:
    """Rows that one side has more often than the other: ``by``, ``key``, ``side`` ('left' or 'right') and ``copies``.

    Both sides are summed up by group and key bucket, one pass each; only the rows of buckets whose checksums differ are
    compared themselves. Equal tables move no row at all.
    """
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        raise ValueError("both sides need the same columns")
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    sides = [df.select(*columns).withColumn("__bucket", place) for df in (left, right)]
    groups = differing(*[checksums(df, [*by, "__bucket"]) for df in sides], [*by, "__bucket"])
    only = groups.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__at"))
    there = F.col("__bucket") == F.col("__at")
    for c in by:
        there = there & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # As long as there are groups and buckets; known at once, so that no side is shuffled to find its rows.
    signed = [df.join(F.broadcast(only), there, "left_semi").withColumn("__sign", F.lit(sign)) for df, sign in zip(sides, (1, -1))]
    rows = signed[0].unionByName(signed[1]).groupBy(*columns).agg(F.sum("__sign").alias("__sign")).where("__sign <> 0")
    side = F.when(F.col("__sign") > 0, "left").otherwise("right")
    return rows.select(*by, *[c for c in key if c not in by], side.alias("side"), F.abs("__sign").alias("copies"))
