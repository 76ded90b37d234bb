"""Years, people, classes and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import KEY, effective_subject
from chalkline.operators.writes import first_rows, insert_first, missing_rows, pin_row


def in_range(df: DataFrame, first: str | None = fv.FIRST_YEAR, last: str | None = fv.LAST_YEAR) -> DataFrame:
    """Rows of the years from first to last; None leaves that end open. Text order is time order, and the filter reaches the scan."""
    kept = df if first is None else df.filter(F.col("academic_yr") >= first)
    return kept if last is None else kept.filter(F.col("academic_yr") <= last)


def years_in_range(students: DataFrame, first: str | None = fv.FIRST_YEAR, last: str | None = fv.LAST_YEAR) -> DataFrame:
    """Years of each school inside the range."""
    return in_range(students, first, last).select("school_id", "academic_yr").distinct()


def years_after_target(students: DataFrame, target: DataFrame) -> DataFrame:
    """Years of each school later than the newest one its target holds."""
    newest = target.groupBy("school_id").agg(F.max("academic_yr").alias("newest"))
    return (
        students.select("school_id", "academic_yr").distinct()
        .join(newest, "school_id", "left")
        .filter(F.col("academic_yr") > F.coalesce("newest", F.lit("0000-0000")))
        .select("school_id", "academic_yr")
    )


def in_years(df: DataFrame, years: DataFrame) -> DataFrame:
    return df.join(years, ["school_id", "academic_yr"], "left_semi")


def current_students(students: DataFrame, need_active: bool = False) -> DataFrame:
    kept = students.filter(F.col("is_delete") == "N")
    return kept.filter(F.col("is_active") == "Y") if need_active else kept


def student_clean(students: DataFrame, need_active: bool = False) -> DataFrame:
    return current_students(students, need_active).select(*KEY, "reg_no", "class_id", "section_id")


def demographics(students: DataFrame) -> DataFrame:
    """A zero date of birth becomes NULL."""
    return current_students(students).select(
        *KEY, F.trim("student_name").alias("student_name"), "gender", F.col("dob").try_cast("date").alias("dob"),
        "class_id", "section_id", "nationality", "category", "parent_id", "guardian_name", "guardian_mobile",
    )


def teachers(source: DataFrame) -> DataFrame:
    return source.filter(F.col("is_delete") == "N").select(
        "school_id", "teacher_id", "name", "designation", "class_id", "section_id"
    )


def users(source: DataFrame) -> DataFrame:
    """Parents, teachers and principals; passwords are never carried."""
    return source.filter(F.col("role_id").isin(list(fv.ROLE_LABELS)) & (F.col("is_delete") == "N")).select(
        "school_id", "user_id", "name", "reg_id", "role_id"
    )


def new_parents(source: DataFrame, loaded: DataFrame | None, drop_deleted: bool = False) -> DataFrame:
    """Parents not loaded yet, one row each; ``drop_deleted`` is the older load's filter."""
    rows = source.filter(F.col("is_delete") == "N") if drop_deleted else source
    rows = rows.select(
        "school_id", "parent_id", "father_name", "mother_name",
        F.col("f_mobile").alias("father_contact"), F.col("m_mobile").alias("mother_contact"),
    )
    order = [F.asc_nulls_last(c) for c in ("father_name", "mother_name", "father_contact")]
    return insert_first(rows, loaded, ["school_id", "parent_id"], order)


def new_classes(classes: DataFrame, students: DataFrame, loaded: DataFrame | None, years: DataFrame) -> DataFrame:
    """Classes with current students; a class id recurs every year, the latest name wins."""
    used = in_years(current_students(students), years)
    used = used.select("school_id", "class_id").distinct()
    named = first_rows(classes, ["school_id", "class_id"], [F.desc("academic_yr"), F.asc("name")]).select(
        "school_id", "class_id", F.col("name").alias("class_name")
    )
    return missing_rows(named.join(used, ["school_id", "class_id"], "left_semi"), loaded, ["school_id", "class_id"])


def new_sections(sections: DataFrame, students: DataFrame, loaded: DataFrame | None, years: DataFrame) -> DataFrame:
    used = in_years(current_students(students), years)
    used = used.select("school_id", "section_id").distinct()
    named = first_rows(sections, ["school_id", "section_id"], [F.asc("name")]).select(
        "school_id", "section_id", F.col("name").alias("section_name")
    )
    return missing_rows(named.join(used, ["school_id", "section_id"], "left_semi"), loaded, ["school_id", "section_id"])


def real_subjects(master: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Subject master rows without placeholder subjects."""
    name, unwanted = F.col("name"), fv.PLACEHOLDER_SUBJECTS
    if ignore_case:
        name, unwanted = F.lower(name), [s.lower() for s in unwanted]
    return master.filter(~name.isin(unwanted))


def science_row(schools: DataFrame) -> DataFrame:
    return schools.select(
        "school_id", F.lit(fv.SCIENCE_ID).alias("subject_id"), F.lit(fv.SCIENCE_NAME).alias("subject_name"),
        F.lit(fv.SCIENCE_TYPE).alias("subject_type"),
    )


def dim_subject(master: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Loaded and new subjects, with the combined Science row pinned in each school."""
    fresh = real_subjects(master).select(
        "school_id", F.col("sm_id").alias("subject_id"), F.col("name").alias("subject_name"), "subject_type"
    )
    if loaded is not None:
        fresh = loaded.unionByName(missing_rows(fresh, loaded, ["school_id", "subject_id"]))
    schools = master.select("school_id").distinct()
    return pin_row(fresh, F.col("subject_id") == fv.SCIENCE_ID, science_row(schools))


def class_subject_map(subjects: DataFrame, classes: DataFrame, master: DataFrame, years: DataFrame) -> DataFrame:
    """Subjects of a class name by year; the three sciences count as Science in the science classes."""
    named = classes.select("school_id", "class_id", "academic_yr", F.col("name").alias("class_name"))
    return (
        in_years(subjects, years)
        .join(named, ["school_id", "class_id", "academic_yr"])
        .join(real_subjects(master).select("school_id", "sm_id"), ["school_id", "sm_id"], "left_semi")
        .select(
            "school_id", "class_name",
            effective_subject(F.col("class_name"), F.col("sm_id")).alias("subject_id"), "academic_yr",
        )
        .distinct()
    )
