"""Master profile, behaviour signals and the views on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import (
    KEY, attendance_band, display_name, engagement, first_word, has_name, has_real_name, learning_style,
    strength_axis, trend_label,
)
from chalkline.operators.joins import join_known, join_large
from chalkline.operators.writes import first_rows


def master_profile(
    students: DataFrame, academics: DataFrame, attendance: DataFrame, achievements: DataFrame, homework: DataFrame,
    lifetime: bool = False,
) -> DataFrame:
    """One row per student-year.

    All sides are grouped by the same key, so the joins reuse one partitioning.  ``lifetime``
    takes a student's 'ALL' achievements, with the list, in place of the year's.
    """
    if lifetime:
        side = achievements.filter(F.col("academic_yr") == fv.LIFETIME).drop("academic_yr")
        joined = join_large(students, side, ["school_id", "student_id"])
        extra = [F.coalesce("achievement_list", F.lit("")).alias("achievement_list")]
    else:
        side = achievements.filter(F.col("academic_yr") != fv.LIFETIME).select(*KEY, "achievement_count")
        joined, extra = join_large(students, side, KEY), []
    for more in (academics, attendance.select(*KEY, "attendance_percentage"), homework):
        joined = join_large(joined, more, KEY)
    return (
        joined.select(
            *KEY, "reg_no", "class_id", "section_id", "avg_percent", "written_avg", "oral_avg", "exams_taken",
            "attendance_percentage",
            F.coalesce("achievement_count", F.lit(0)).alias("achievements"),
            *extra,
            F.coalesce("homework_assigned_count", F.lit(0)).alias("homework_assigned_count"),
        )
    )


def behavior_signals(profile: DataFrame) -> DataFrame:
    return profile.select(
        *KEY,
        attendance_band(F.col("attendance_percentage")).alias("attendance_band"),
        learning_style(F.col("written_avg"), F.col("oral_avg")).alias("learning_style"),
        engagement(F.col("homework_assigned_count")).alias("engagement_pattern"),
        strength_axis(F.col("avg_percent"), F.col("achievements")).alias("primary_strength_axis"),
    )


def science_text(components: DataFrame) -> DataFrame:
    """'Physics, Chemistry, Biology (not assessed)' per student-year: entered first, then best first."""
    name = F.when(F.col("is_entered") == 0, F.concat("component", F.lit(fv.NOT_ASSESSED))).otherwise(F.col("component"))
    order = F.struct((-F.col("is_entered")).alias("e"), (-F.coalesce("avg_percent", F.lit(-1))).alias("p"), name.alias("name"))
    # At most three components exist per student-year.
    return components.groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["name"]), ", ").alias("science_components")
    )


def _best_first(text: Column) -> Column:
    """Aggregate over distinct names: best average first, then by name."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("b"), text.alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), ", ")


def subject_strengths(performance: DataFrame, subjects: DataFrame, components: DataFrame) -> DataFrame:
    """Subjects at 75 or more, best first; the second list spells out the Science components.

    Equal names are merged first, so a list holds at most the school's subject names.
    """
    named = performance.filter(F.col("avg_percent") >= 75).join(
        subjects.select("school_id", "subject_id", "subject_name"), ["school_id", "subject_id"]
    )
    names = named.groupBy(*KEY, "subject_name").agg(F.max("avg_percent").alias("best"))
    science = F.concat(F.lit("Science ("), F.coalesce("science_components", F.lit("combined")), F.lit(")"))
    spelled = F.when(F.col("subject_name") == fv.SCIENCE_NAME, science).otherwise(F.col("subject_name"))
    return (
        join_large(names, science_text(components), KEY)
        .groupBy(*KEY)
        .agg(
            _best_first(F.col("subject_name")).alias("strong_subjects"),
            _best_first(spelled).alias("strong_subjects_ai"),
        )
    )


def _parents(parents: DataFrame) -> DataFrame:
    return parents.select(
        "school_id", "parent_id", "father_name", "mother_name", "father_contact", "mother_contact"
    )


def with_parents(demographics: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Demographics with their parents' columns; those of students without a parent are NULL. ``None``: they are there already."""
    return demographics if parents is None else join_known(demographics, _parents(parents), ["school_id", "parent_id"])


def ai_profile(
    demographics: DataFrame, classes: DataFrame, sections: DataFrame, parents: DataFrame | None, profile: DataFrame,
    strengths: DataFrame, signals: DataFrame,
) -> DataFrame:
    rows = with_parents(demographics, parents)
    for side in (profile.drop("class_id", "section_id", "reg_no"), strengths, signals):
        rows = join_large(rows, side, KEY)
    return (
        rows.join(classes, ["school_id", "class_id"], "left")
        .join(sections, ["school_id", "section_id"], "left")
        .select(
            "school_id", "student_id",
            display_name(F.col("student_name"), F.col("father_name")).alias("student_name"),
            "gender", "dob", "academic_yr", "parent_id", "class_name", "section_name", "father_name", "mother_name",
            "avg_percent", "written_avg", "oral_avg", "exams_taken", "attendance_percentage", "achievements",
            "homework_assigned_count", "strong_subjects", "strong_subjects_ai", "attendance_band", "learning_style",
            "engagement_pattern", "primary_strength_axis",
        )
    )


def confidence_profile(
    demographics: DataFrame, parents: DataFrame | None, profile: DataFrame, strengths: DataFrame, totals: DataFrame,
    confidence: DataFrame,
) -> DataFrame:
    """The earlier profile view: lifetime achievements and the career confidence index."""
    return (
        with_parents(demographics, parents).join(profile.drop("class_id", "section_id", "reg_no", "achievements"), KEY, "left")
        .join(strengths.select(*KEY, "strong_subjects"), KEY, "left")
        .join(confidence, KEY, "left")
        .join(totals, ["school_id", "student_id"], "left")
        .withColumns({
            "achievements": F.coalesce("total_achievements", F.lit(0)),
            "achievement_list": F.coalesce("total_achievement_list", F.lit("")),
        })
        .drop("total_achievements", "total_achievement_list")
    )


def child_selector(demographics: DataFrame, parents: DataFrame | None, aliases: DataFrame) -> DataFrame:
    """The latest year of each child of a parent; children are told apart by (aliased) first name."""
    named = with_parents(demographics, parents).withColumn("raw_name", first_word(F.col("student_name")))
    joined = (
        join_known(named, aliases.select("school_id", "parent_id", "raw_name", "canonical"), ["school_id", "parent_id", "raw_name"])
        .select(
            "school_id", "parent_id",
            display_name(F.col("student_name"), F.col("father_name")).alias("display_name"),
            F.col("student_id").alias("latest_student_id"),
            F.col("academic_yr").alias("latest_academic_yr"),
            F.coalesce("canonical", "raw_name").alias("child"),
        )
    )
    order = [F.desc("latest_academic_yr"), F.desc("latest_student_id")]
    return first_rows(joined, ["school_id", "parent_id", "child"], order).drop("child")


def academic_trend(profile: DataFrame) -> DataFrame:
    before = F.lag("avg_percent").over(Window.partitionBy("school_id", "student_id").orderBy("academic_yr"))
    return profile.select(*KEY, "avg_percent", before.alias("prev_year_percent")).select(
        "*",
        F.round(F.col("avg_percent") - F.col("prev_year_percent"), 2).alias("year_growth"),
        trend_label(F.col("avg_percent"), F.col("prev_year_percent")).alias("performance_trend"),
    )


def career_confidence(profile: DataFrame, trend: DataFrame, strengths: DataFrame) -> DataFrame:
    def part(column: str, weight: str) -> Column:
        return F.coalesce(column, F.lit(0)) * F.lit(weight).cast("decimal(3,2)")

    def points(value: Column, weight: str) -> Column:
        return value.cast("decimal(3,0)") * F.lit(weight).cast("decimal(3,2)")

    trend_points = (
        F.when(F.col("performance_trend") == fv.TREND_UP, 20).when(F.col("performance_trend") == fv.TREND_SAME, 10).otherwise(0)
    )
    has_strength = F.coalesce(F.col("strong_subjects") != "", F.lit(False))
    index = (
        part("avg_percent", "0.30") + part("attendance_percentage", "0.20") + points(trend_points, "0.20")
        + points(F.when(has_strength, 100).otherwise(0), "0.15")
        + points(F.when(F.col("achievements") > 0, 100).otherwise(0), "0.15")
    )
    return (
        profile.select(*KEY, "avg_percent", "attendance_percentage", "achievements")
        .join(trend.select(*KEY, "performance_trend", "year_growth"), KEY, "left")
        .join(strengths.select(*KEY, "strong_subjects"), KEY, "left")
        .select(*KEY, index.cast("decimal(15,6)").alias("career_confidence_index"), "performance_trend", "year_growth")
    )


def student_profile(
    demographics: DataFrame, classes: DataFrame, sections: DataFrame, parents: DataFrame | None, profile: DataFrame,
    strengths: DataFrame, signals: DataFrame, achievements: DataFrame,
) -> DataFrame:
    """The student page's profile: every student-year with a real name.

    Carries class, section and registration ids, which row-level visibility needs.
    """
    year = achievements.filter(F.col("academic_yr") != fv.LIFETIME).select(
        *KEY, F.col("achievement_count").alias("year_achievement_count"), F.col("achievement_list").alias("year_achievement_list")
    )
    ever = achievements.filter(F.col("academic_yr") == fv.LIFETIME).select(
        "school_id", "student_id", "achievement_count", "achievement_list"
    )
    # Lifetime rows are met by the bare keys, so that the wide rows stay where they lie.
    ever = join_large(demographics.select(*KEY), ever, ["school_id", "student_id"], "inner")
    zero, blank = F.lit(0), F.lit("")
    rows = with_parents(demographics, parents).filter(has_real_name(F.col("student_name")))
    for side in (profile.drop("class_id", "section_id", "achievements"), strengths, signals, year, ever):
        rows = join_large(rows, side, KEY)
    return (
        rows.join(classes, ["school_id", "class_id"], "left")
        .join(sections, ["school_id", "section_id"], "left")
        .select(
            "school_id", "student_id",
            display_name(F.col("student_name"), F.col("father_name")).alias("student_name"),
            "reg_no", "gender", "dob", "parent_id", "guardian_name", "guardian_mobile", "academic_yr", "class_id",
            "section_id", "class_name", "section_name", "father_name", "mother_name", "father_contact",
            "mother_contact", "avg_percent", "written_avg", "oral_avg", "exams_taken", "attendance_percentage",
            "homework_assigned_count", "strong_subjects", "strong_subjects_ai", "attendance_band", "learning_style",
            "engagement_pattern", "primary_strength_axis",
            F.coalesce("year_achievement_count", zero).alias("year_achievement_count"),
            F.coalesce("year_achievement_list", blank).alias("year_achievement_list"),
            F.coalesce("achievement_count", zero).alias("achievement_count"),
            F.coalesce("achievement_list", blank).alias("achievement_list"),
        )
    )


def class_roster(
    demographics: DataFrame, classes: DataFrame, sections: DataFrame, parents: DataFrame | None, profile: DataFrame,
    signals: DataFrame, strengths: DataFrame,
) -> DataFrame:
    """Roster rows of every class and year."""
    return (
        with_parents(demographics, parents).filter(has_name(F.col("student_name")))
        .join(profile.select(*KEY, "avg_percent", "attendance_percentage", "achievements", "homework_assigned_count"), KEY, "left")
        .join(signals.select(*KEY, "attendance_band", "learning_style", "primary_strength_axis"), KEY, "left")
        .join(strengths.select(*KEY, "strong_subjects"), KEY, "left")
        .join(classes, ["school_id", "class_id"])
        .join(sections, ["school_id", "section_id"], "left")
        .select(
            *KEY, "class_name", "section_name",
            display_name(F.col("student_name"), F.col("father_name")).alias("student_name"),
            "avg_percent", "attendance_percentage", "achievements", "homework_assigned_count", "attendance_band",
            "learning_style", "primary_strength_axis", "strong_subjects",
        )
    )
