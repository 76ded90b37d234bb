"""Marks: latest revision, heading rows, averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import KEY, effective_subject, hundredths, in_science, lookup, percent
from chalkline.operators.writes import missing_rows

REVISION_KEY = ["school_id", "student_id", "subject_id", "exam_id", "academic_yr"]
_MAP = "map<string,string>"
_TEXTS = ("present", "mark_obtained", "highest_marks")


def unseen_marks(source: DataFrame, loaded: DataFrame | None) -> DataFrame:
    """Source marks whose id was not loaded before."""
    return missing_rows(source, loaded, ["school_id", "marks_id"])


def latest_marks(raw: DataFrame) -> DataFrame:
    """The newest revision per student, subject, exam and year.

    Spark limits each group to one row before the shuffle (window group limit), so a group
    with very many revisions reaches its task as one row per input partition. The student's number tells most rows
    apart and comes first in the sort; with the school first every comparison would read whole keys.
    """
    keys = sorted(REVISION_KEY, key=lambda c: c != "student_id")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("marks_id")))
    return raw.withColumn("rn", newest).filter(F.col("rn") == 1).drop("rn")


def _heading_values(maps: DataFrame, heading: Column, keys: Sequence[str]) -> DataFrame:
    h = F.col("heading")
    # The headings are rows before their values are read, so that no array lambda is interpreted.
    return maps.select("*", heading.alias("heading")).select(
        *keys,
        h.try_cast("bigint").alias("marks_headings_id"),
        F.try_element_at("present", h).alias("is_present"),
        F.try_element_at("mark_obtained", h).try_cast("decimal(5,2)").alias("marks_obtained"),
        F.try_element_at("highest_marks", h).try_cast("decimal(5,2)").alias("max_marks"),
    )


def heading_rows(latest: DataFrame) -> DataFrame:
    """One row per heading of each published mark; unreadable numbers become NULL."""
    maps = latest.filter(F.col("publish") == "Y").select(*REVISION_KEY, *[F.from_json(c, _MAP).alias(c) for c in _TEXTS])
    return _heading_values(maps, F.explode(F.map_keys("mark_obtained")), REVISION_KEY)


def heading_rows_of_all(latest: DataFrame) -> DataFrame:
    """The same with ``marks_id``; an unpublished mark, or one without headings, is a row of its own without values."""
    published = [F.from_json(F.when(F.col("publish") == "Y", F.col(c)), _MAP).alias(c) for c in _TEXTS]
    maps = latest.select(*REVISION_KEY, "marks_id", *published)
    return _heading_values(maps, F.explode_outer(F.map_keys("mark_obtained")), [*REVISION_KEY, "marks_id"])


def with_headings(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """Heading rows with the heading's name and exam flag; unknown headings stay, unnamed."""
    named = headings.select(
        "school_id",
        F.col("marks_headings_id").cast("bigint").alias("marks_headings_id"),
        F.col("name").alias("component_name"),
        "written_exam",
    )
    return rows.join(named, ["school_id", "marks_headings_id"], "left")


def exam_sums(rows: DataFrame) -> DataFrame:
    """Sums in hundredths per revision key over present headings.

    The key equals the one ``latest_marks`` shuffles by, so this adds no shuffle, and everything
    after it works on one row per exam instead of one per heading.
    """
    return rows.filter(F.col("is_present") == "Y").groupBy(*REVISION_KEY).agg(*measures(F.lit(True)))


def measures(counts: Column) -> list[Column]:
    """Aggregates: sums in hundredths over the heading rows that count."""
    written = F.col("marks_headings_id").isin(fv.WRITTEN_HEADINGS)
    internal = F.col("marks_headings_id").isin(fv.INTERNAL_HEADINGS)
    m, top = hundredths(F.col("marks_obtained")), hundredths(F.col("max_marks"))
    return [
        F.sum(F.when(counts, m)).alias("m"), F.sum(F.when(counts, top)).alias("top"),
        F.sum(F.when(counts & written, m)).alias("written_m"), F.sum(F.when(counts & written, top)).alias("written_top"),
        F.sum(F.when(counts & internal, m)).alias("internal_m"), F.sum(F.when(counts & internal, top)).alias("internal_top"),
    ]


def ratio_of_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = {c: F.sum(c) for c in ("m", "top", "written_m", "written_top", "internal_m", "internal_top")}
    return sums.groupBy(*keys).agg(
        percent(total["m"], total["top"]).alias("avg_percent"),
        percent(total["written_m"], total["written_top"]).alias("written_avg"),
        percent(total["internal_m"], total["internal_top"]).alias("oral_avg"),
        F.count_distinct("exam_id").alias("exams_taken"),
    )


def in_class(sums: DataFrame, students: DataFrame, classes: DataFrame, subjects: DataFrame) -> DataFrame:
    """Exam sums of current students in subjects their class takes, with the class name.

    Subjects only decide membership, so a repeated subject row cannot multiply marks.
    """
    enrolled = students.filter(F.col("is_delete") == "N").select(*KEY, "class_id")
    named = classes.select("school_id", "class_id", "academic_yr", F.col("name").alias("class_name"))
    taught = subjects.select("school_id", F.col("sm_id").alias("subject_id"), "class_id", "academic_yr")
    return (
        sums.withColumn("subject_id", F.col("subject_id").try_cast("int"))
        .join(enrolled, KEY)
        .join(named, ["school_id", "class_id", "academic_yr"])
        .join(taught, ["school_id", "subject_id", "class_id", "academic_yr"], "left_semi")
    )


def subject_performance(class_sums: DataFrame) -> DataFrame:
    folded = class_sums.withColumn("subject_id", effective_subject(F.col("class_name"), F.col("subject_id")))
    return ratio_of_sums(folded, [*KEY, "subject_id"])


def science_components(class_sums: DataFrame) -> DataFrame:
    science = class_sums.filter(in_science(F.col("class_name"), F.col("subject_id")))
    return (
        science.groupBy(*KEY, "subject_id")
        .agg(percent(F.sum("m"), F.sum("top")).alias("avg_percent"))
        .select(
            *KEY,
            lookup(fv.SCIENCE_COMPONENTS, F.col("subject_id")).alias("component"),
            "avg_percent",
            F.lit(1).alias("is_entered"),
        )
    )


def missing_components(components: DataFrame) -> DataFrame:
    """Placeholder rows for components a student-year with science lacks.

    The set of present names is at most three per student-year, so it is carried as an array
    and no cross or anti join is needed.
    """
    every = F.array(*[F.lit(c) for c in fv.SCIENCE_COMPONENTS.values()])
    return (
        components.groupBy(*KEY)
        .agg(F.collect_set("component").alias("have"), F.max("is_entered").alias("entered"))
        .filter(F.col("entered") == 1)
        .select(*KEY, F.explode(F.array_except(every, "have")).alias("component"))
        .withColumns({"avg_percent": F.lit(None).cast("decimal(11,2)"), "is_entered": F.lit(0)})
    )


def with_missing_components(components: DataFrame) -> DataFrame:
    return components.unionByName(missing_components(components))


# --- other averages the older loads use ------------------------------------------------------


def ratio_of_sums_by_name(master: DataFrame, detail: DataFrame, headings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratio of sums where the heading called 'Written' is written and every other one internal."""
    rows = (
        detail.filter(F.col("present") == "Y")
        .join(master, ["school_id", "mark_id"])
        .join(headings.select("school_id", "marks_headings_id", F.col("name").alias("heading")), ["school_id", "marks_headings_id"])
    )
    m, top = hundredths(F.col("marks_obtained")), hundredths(F.col("highest_marks"))
    written, other = F.col("heading") == "Written", F.col("heading") != "Written"
    return rows.groupBy(*keys).agg(
        percent(F.sum(m), F.sum(top)).alias("avg_percent"),
        percent(F.sum(F.when(written, m)), F.sum(F.when(written, top))).alias("written_avg"),
        percent(F.sum(F.when(other, m)), F.sum(F.when(other, top))).alias("oral_avg"),
        F.count_distinct("exam_id").alias("exams_taken"),
    )


def average_of_ratios(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average of each heading's own percentage, split by the heading's written-exam flag."""
    ratio = F.col("marks_obtained") / F.nullif(F.col("max_marks"), F.lit(0).cast("decimal(5,2)")) * 100
    flag = F.col("written_exam")

    def average(value: Column) -> Column:
        return F.round(F.avg(value), 2).cast("decimal(11,2)")

    return rows.filter(F.col("is_present") == "Y").groupBy(*keys).agg(
        average(ratio).alias("avg_percent"),
        average(F.when(flag == "Y", ratio)).alias("written_avg"),
        average(F.when(flag == "N", ratio)).alias("oral_avg"),
        F.count_distinct("exam_id").alias("exams_taken"),
    )


def heading_audit(rows: DataFrame, headings: DataFrame, classify) -> DataFrame:
    """Distinct headings in use with the group they count in."""
    used = rows.select("school_id", "marks_headings_id").distinct()
    named = headings.select("school_id", F.col("marks_headings_id").cast("bigint").alias("marks_headings_id"), "name")
    return used.join(named, ["school_id", "marks_headings_id"]).withColumn(
        "classification", classify(F.col("marks_headings_id"))
    )


def unreadable_marks(latest: DataFrame) -> DataFrame:
    """Published marks whose text is no JSON object, and headings whose number cannot be read, per school and year."""
    bad_text = F.from_json("mark_obtained", _MAP).isNull()
    texts = latest.filter(F.col("publish") == "Y").groupBy("school_id", "academic_yr").agg(
        F.count_if(bad_text).alias("unreadable_texts")
    )
    numbers = heading_rows(latest).groupBy("school_id", "academic_yr").agg(
        F.count_if(F.col("marks_obtained").isNull()).alias("unreadable_numbers")
    )
    return texts.join(numbers, ["school_id", "academic_yr"], "left").fillna(0, ["unreadable_numbers"])
