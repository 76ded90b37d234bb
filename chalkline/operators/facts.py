"""Attendance, achievement and homework facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import KEY, percent


def attendance(days: DataFrame, mode: str = "present") -> DataFrame:
    """Days per student-year.

    ``present`` counts only 'P' as present; ``absent`` counts only 'A' as absent.
    """
    total = F.count("*")
    status = F.col("attendance_status")
    if mode == "present":
        present = F.count_if(status == "P")
        absent = total - present
    elif mode == "absent":
        absent = F.count_if(status == "A")
        present = total - absent
    else:
        raise ValueError(mode)
    return days.groupBy(*KEY).agg(
        total.alias("total_school_days"),
        absent.alias("absent_days"),
        present.alias("present_days"),
        percent(present, total).alias("attendance_percentage"),
    )


def _ordered_text(text: Column, *order: Column) -> Column:
    """Aggregate: texts joined by comma in the given order; null texts are skipped."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("text")))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), ", ")


def achievements_by_year(achievements: DataFrame) -> DataFrame:
    """Count and list per student-year, oldest first."""
    title = F.coalesce(F.col("achievement"), F.col("event"))
    return achievements.groupBy(*KEY).agg(
        F.count("*").alias("achievement_count"),
        _ordered_text(title, F.col("date"), F.col("achievement_id")).alias("achievement_list"),
    )


def achievements_lifetime(by_year: DataFrame) -> DataFrame:
    """One 'ALL' row per student from the yearly rows."""
    years = by_year.filter(F.col("academic_yr") != fv.LIFETIME)
    return years.groupBy("school_id", "student_id").agg(
        F.sum("achievement_count").alias("achievement_count"),
        _ordered_text(F.col("achievement_list"), F.col("academic_yr")).alias("achievement_list"),
    ).select("school_id", "student_id", F.lit(fv.LIFETIME).alias("academic_yr"), "achievement_count", "achievement_list")


def achievements_lifetime_text(achievements: DataFrame) -> DataFrame:
    """One 'ALL' row per student from the source, each distinct 'year: event - position' once.

    Equal entries are merged before the shuffle; the count covers every row.
    """
    place = F.when(F.col("position") != "", F.concat(F.lit(" - "), F.col("position"))).otherwise("")
    entry = F.struct("academic_yr", "event", F.concat(F.col("academic_yr"), F.lit(": "), F.col("event"), place).alias("text"))
    merged = achievements.groupBy("school_id", "student_id", entry.alias("entry")).agg(F.count("*").alias("n"))
    return merged.groupBy("school_id", "student_id").agg(
        F.sum("n").alias("achievement_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["text"]), ", ").alias("achievement_list"),
    ).select("school_id", "student_id", F.lit(fv.LIFETIME).alias("academic_yr"), "achievement_count", "achievement_list")


def lifetime_totals(all_rows: DataFrame) -> DataFrame:
    """Totals over yearly rows, 'ALL' rows left out so that nothing counts twice.

    A list that recurs in several years is shown once, at its first year.
    """
    lists = all_rows.filter(F.col("academic_yr") != fv.LIFETIME).groupBy("school_id", "student_id", "achievement_list").agg(
        F.sum("achievement_count").alias("n"), F.min("academic_yr").alias("first_yr")
    )
    return lists.groupBy("school_id", "student_id").agg(
        F.sum("n").alias("total_achievements"),
        _ordered_text(F.col("achievement_list"), F.col("first_yr")).alias("total_achievement_list"),
    )


def homework_engagement(homework: DataFrame, comments: DataFrame) -> DataFrame:
    """Distinct homeworks a student commented on, per year.

    Comments are reduced to distinct pairs first, so repeated comments never reach the join.
    """
    pairs = comments.select("school_id", "homework_id", "student_id").distinct()
    return (
        pairs.join(homework.select("school_id", "homework_id", "academic_yr").distinct(), ["school_id", "homework_id"])
        .groupBy(*KEY)
        .agg(F.count("*").alias("homework_assigned_count"))
    )
