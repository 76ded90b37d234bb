"""Averages kept up to date by signed deltas instead of ranking and summing all history again.

``held`` has one row per revision key: the revision that counts, with its sums. A batch of marks is ranked by itself and
joined to the held rows of its keys; where it brings a newer revision, the old one's sums are subtracted and the new
one's added. Sums are whole hundredths, so adding and subtracting is exact. ``totals`` has one row per student, year and
exam; only totals that a delta belongs to change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.columns import KEY, percent
from chalkline.operators.marks import REVISION_KEY, heading_rows_of_all, latest_marks, measures
from chalkline.operators.writes import missing_rows, upsert

MEASURES = ("m", "top", "written_m", "written_top", "internal_m", "internal_top")
TOTAL_KEY = [*KEY, "exam_id"]
#: How many revisions have a readable mark; a sum of none is NULL and not 0.
_READABLE = ("m", "written_m", "internal_m")


def held_revisions(marks: DataFrame) -> DataFrame:
    """The newest revision per key with its sums; ``counted`` is 0 where it is unpublished, has no present heading or
    lacks a part of its key.

    There is one newest revision per key, so its headings are summed where they lie: no join, and one ranking.
    """
    rows = heading_rows_of_all(latest_marks(marks))
    counts = F.coalesce(F.col("is_present") == "Y", F.lit(False))
    for c in REVISION_KEY:
        counts = counts & F.col(c).isNotNull()
    sums = rows.groupBy(*REVISION_KEY, "marks_id").agg(*measures(counts), F.max(counts.cast("int")).alias("counted"))
    return sums.select(*REVISION_KEY, "marks_id", *MEASURES, "counted")


def revision_deltas(batch: DataFrame | None, held: DataFrame | None, fresh: DataFrame | None = None) -> DataFrame:
    """What a batch changes: its rows that replace the held revision or are the first of their key.

    Beside the new values stand the differences to the held ones (``d_…``). Older revisions and repeated marks give no row.
    ``fresh`` is ``held_revisions`` of the batch where that is at hand.
    """
    fresh = held_revisions(batch) if fresh is None else fresh
    names = ["marks_id", *MEASURES, "counted"]
    if held is None:
        both = fresh.select("*", *[F.lit(None).cast("bigint").alias(f"old_{c}") for c in names])
    else:
        old = held.select(*REVISION_KEY, *[F.col(c).alias(f"old_{c}") for c in names])
        both = fresh.join(old, REVISION_KEY, "left")

    def moved(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"old_{c}"), F.lit(0))

    def readable(c: str) -> Column:
        return F.col(c).isNotNull().cast("bigint") - F.col(f"old_{c}").isNotNull().cast("bigint")

    newer = F.col("old_marks_id").isNull() | (F.col("marks_id") > F.col("old_marks_id"))
    return both.where(newer).select(
        *REVISION_KEY, *names, *[moved(c).alias(f"d_{c}") for c in (*MEASURES, "counted")], *[readable(c).alias(f"d_n_{c}") for c in _READABLE]
    )


def held_after(held: DataFrame | None, deltas: DataFrame) -> DataFrame:
    return upsert(deltas.select(*REVISION_KEY, "marks_id", *MEASURES, "counted"), held, REVISION_KEY)


def totals_after(totals: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """All totals after the deltas; those of other students, years and exams pass unchanged."""
    names = [*MEASURES, "counted", *[f"n_{c}" for c in _READABLE]]
    moved = deltas.groupBy(*TOTAL_KEY).agg(*[F.sum(f"d_{c}").alias(c) for c in names])
    if totals is None:
        return moved
    old = totals.join(moved.select(*TOTAL_KEY), TOTAL_KEY, "left_semi")
    changed = old.unionByName(moved).groupBy(*TOTAL_KEY).agg(*[F.sum(c).alias(c) for c in names])
    return missing_rows(totals, moved, TOTAL_KEY).unionByName(changed)


def academics_from_totals(totals: DataFrame) -> DataFrame:
    """The averages per student and year."""

    def total(c: str) -> Column:
        return F.when(F.sum(f"n_{c}") > 0, F.sum(c))

    rows = totals.groupBy(*KEY).agg(
        percent(total("m"), F.sum("top")).alias("avg_percent"),
        percent(total("written_m"), F.sum("written_top")).alias("written_avg"),
        percent(total("internal_m"), F.sum("internal_top")).alias("oral_avg"),
        F.count_if(F.col("counted") > 0).alias("exams_taken"),
    )
    # A student whose last counted revision was withdrawn has no row.
    return rows.where("exams_taken > 0")


def counted_sums(held: DataFrame) -> DataFrame:
    """The held revisions in the form of ``exam_sums``."""
    return held.where("counted = 1").select(*REVISION_KEY, *MEASURES)
