"""Reconciliation, schema checks and the run log."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import KEY, role_label
from chalkline.operators.dims import in_range

SCHOOL_YEAR = ["school_id", "academic_yr"]


YEAR_RANGE = (fv.FIRST_YEAR, fv.LAST_YEAR)


def verify_by_year(
    students: DataFrame, profile: DataFrame, attendance: DataFrame, performance: DataFrame, years: tuple = YEAR_RANGE
) -> DataFrame:
    """Distinct students per school and year in the source and in each target, with a status."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*SCHOOL_YEAR).agg(F.count_distinct("student_id").alias(name))

    source = counted(in_range(students, *years).filter(F.col("is_delete") == "N"), "source_students")
    joined = reduce(
        lambda left, right: left.join(right, SCHOOL_YEAR, "left"),
        [counted(profile, "in_master"), counted(attendance, "have_attendance"), counted(performance, "have_marks")],
        source,
    ).fillna(0, ["in_master", "have_attendance", "have_marks"])
    total, master = F.col("source_students"), F.col("in_master")
    status = (
        F.when((total == master) & (total == F.col("have_attendance")), fv.STATUS_COMPLETE)
        .when(master == 0, fv.STATUS_NOT_RUN)
        .otherwise(fv.STATUS_PARTIAL)
    )
    return joined.withColumn("missing_from_master", total - master).withColumn("etl_status", status)


def missing_from_master(students: DataFrame, profile: DataFrame, years: tuple = YEAR_RANGE) -> DataFrame:
    current = in_range(students, *years).filter(F.col("is_delete") == "N").select(*KEY, "student_name", "parent_id")
    return current.join(profile.select(*KEY), KEY, "left_anti")


def ghost_students(profile: DataFrame, demographics: DataFrame, students: DataFrame, years: tuple = YEAR_RANGE) -> DataFrame:
    """Profile rows whose source row is gone or deleted."""
    source = students.select(*KEY, "is_delete")
    return (
        in_range(profile, *years).select(*KEY)
        .join(source, KEY, "left")
        .filter(F.col("is_delete").isNull() | (F.col("is_delete") == "Y"))
        .join(demographics.select(*KEY, "student_name"), KEY, "left")
        .select(*KEY, "student_name")
    )


def without_parent(demographics: DataFrame, years: tuple = YEAR_RANGE) -> DataFrame:
    return in_range(demographics, *years).filter(F.col("parent_id").isNull()).select(*KEY, "student_name")


def rows_per_year(profile: DataFrame, years: tuple = YEAR_RANGE) -> DataFrame:
    return in_range(profile, *years).groupBy(*SCHOOL_YEAR).agg(F.count("*").alias("student_count"))


def staff_counts(teachers: DataFrame) -> DataFrame:
    def holds(word: str) -> Column:
        return F.count_if(F.col("designation").contains(word))

    return teachers.groupBy("school_id").agg(
        F.count("*").alias("total_teachers_loaded"),
        holds("Principal").alias("principals"), holds("TGT").alias("tgt_teachers"),
        holds("PGT").alias("pgt_teachers"), holds("PRT").alias("prt_teachers"),
    )


def users_per_role(users: DataFrame) -> DataFrame:
    return users.groupBy("school_id", "role_id").agg(F.count("*").alias("accounts")).withColumn(
        "role_label", role_label(F.col("role_id"))
    )


def placeholder_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.filter(F.col("subject_name").isin(fv.PLACEHOLDER_SUBJECTS)).select("school_id", "subject_id", "subject_name")


def science_completeness(components: DataFrame) -> DataFrame:
    per_student = components.groupBy(*KEY).agg(F.count("*").alias("component_count"))
    return per_student.groupBy(*SCHOOL_YEAR).agg(
        F.count_distinct("student_id").alias("students"),
        F.count_if(F.col("component_count") != 3).alias("incomplete"),
    )


# --- schema and content checks -----------------------------------------------------------


def _message(df: DataFrame, level: Column, check: str, subject: Column, value: Column) -> DataFrame:
    return df.select(
        "school_id", level.alias("level"), F.lit(check).alias("check"), subject.cast("string").alias("subject"),
        value.cast("bigint").alias("value"),
    )


def structure_checks(spark: SparkSession, tables: Mapping[str, DataFrame], views: Mapping[str, DataFrame]) -> DataFrame:
    """Missing tables, views and columns.  Only schemas are looked at; no data is read."""
    found = [("Missing table", t) for t, _ in fv.REQUIRED_COLUMNS if t not in tables]
    found += [("Missing view", v) for v in fv.REQUIRED_VIEWS if v not in views]
    found += [
        ("Missing column", f"{t}.{c}")
        for t, columns in fv.REQUIRED_COLUMNS if t in tables
        for c in columns if c not in tables[t].columns
    ]
    rows = [(None, "error", check, subject, None) for check, subject in found]
    return spark.createDataFrame(rows, "school_id int, level string, check string, subject string, value bigint")


def content_checks(schools: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Counts per school as (level, check, subject, value).

    Every check is a left join from the school list, so a school with no rows still reports.
    """
    ids = schools.select("school_id")

    def per_school(counts: DataFrame) -> DataFrame:
        return ids.join(counts, "school_id", "left").fillna(0, ["n"])

    subjects = tables["dim_subject"].groupBy("school_id").agg(
        F.count_if(F.col("subject_name").isin(fv.PLACEHOLDER_SUBJECTS)).alias("placeholder"),
        F.count_if(F.col("subject_id") == fv.SCIENCE_ID).alias("science"),
    )
    n = F.col("n")
    checks = [
        _message(
            per_school(subjects.select("school_id", F.col("placeholder").alias("n"))),
            F.when(n > 0, "error").otherwise("info"), "placeholder subjects", F.lit("dim_subject"), n,
        ),
        _message(
            per_school(subjects.select("school_id", F.col("science").alias("n"))),
            F.when(n != 1, "error").otherwise("info"), "science rows", F.lit("dim_subject"), n,
        ),
        _message(
            per_school(tables["dim_teachers"].groupBy("school_id").agg(F.count("*").alias("n"))),
            F.when(n == 0, "warning").otherwise("info"), "teacher records", F.lit("dim_teachers"), n,
        ),
        _message(
            per_school(tables["student_master_profile"].groupBy("school_id").agg(F.count_distinct("student_id").alias("n"))),
            F.when(n == 0, "error").otherwise("info"), "unique students", F.lit("student_master_profile"), n,
        ),
        _message(
            tables["student_master_profile"].filter(F.col("academic_yr") != fv.LIFETIME)
            .groupBy(*SCHOOL_YEAR).agg(F.count_distinct("student_id").alias("n")),
            F.lit("info"), "students in year", F.col("academic_yr"), n,
        ),
        _message(
            users_per_role(tables["dim_users"]), F.lit("info"), "accounts", F.col("role_label"), F.col("accounts"),
        ),
    ]
    return reduce(DataFrame.unionByName, checks)


def log_checks(log: DataFrame, tie_break: str = "notes") -> DataFrame:
    """The last successful run of each school in the log, an error row where none succeeded; ``tie_break`` orders runs that ended together."""
    return log.groupBy("school_id").agg(
        F.max_by("notes", F.when(F.col("status") == "SUCCESS", F.struct("run_end", tie_break))).alias("subject"),
        F.count_if(F.col("status") == "SUCCESS").alias("value"),
    ).select(
        "school_id", F.when(F.col("value") == 0, "error").otherwise("info").alias("level"),
        F.lit("last successful run").alias("check"), "subject", "value",
    )


# --- run log ----------------------------------------------------------------------------------

RUN_LOG = (
    "run_id string, school_id int, school_name string, run_start timestamp, run_end timestamp, status string, "
    "error_msg string, rows_raw bigint, rows_components bigint, rows_facts bigint, new_years bigint, notes string"
)


def years_note(years: DataFrame, first: str | None = fv.FIRST_YEAR, last: str | None = fv.LAST_YEAR) -> DataFrame:
    """Years processed per school, as the log's count and note; an open end of the range is left blank."""
    listed = F.array_join(F.array_sort(F.collect_set("academic_yr")), ", ")
    return years.groupBy("school_id").agg(
        F.count_distinct("academic_yr").alias("new_years"),
        F.concat(
            F.lit(f"Backfill range {first or ''} to {last or ''}. Years processed: " if first or last else "New years only. Years processed: "), listed
        ).alias("notes"),
    )


def row_counts(raw: DataFrame, components: DataFrame, performance: DataFrame) -> DataFrame:
    """Rows per school of the three tables the log reports."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("school_id").agg(F.count("*").alias(name))

    return (
        counted(raw, "rows_raw")
        .join(counted(components, "rows_components"), "school_id", "full")
        .join(counted(performance, "rows_facts"), "school_id", "full")
        .fillna(0)
    )


def run_report(log: DataFrame, today: Column | None = None) -> DataFrame:
    """Runs that started today, newest first, with their length in seconds."""
    day = F.current_date() if today is None else today
    return (
        log.filter(F.to_date("run_start") == day)
        .withColumn("duration_sec", F.unix_timestamp("run_end") - F.unix_timestamp("run_start"))
        .orderBy(F.desc("run_start"), "school_id")
    )


def school_of_user(users: DataFrame, schools: DataFrame) -> DataFrame:
    """The first active school that knows each user id, upper and lower case alike."""
    active = schools.filter("is_active").select("school_id")
    return (
        users.join(active, "school_id", "left_semi")
        .groupBy(F.lower("user_id").alias("user_key"))
        .agg(F.min("school_id").alias("school_id"))
    )
