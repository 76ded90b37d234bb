"""Tables behind the class page, keyed by school, year, class and section or 'all'."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import has_name, display_name, mean_double, tenth, tenth_text, whole
from chalkline.operators.profile import with_parents

GROUP = ["school_id", "academic_yr", "class_name", "section"]


def class_rows(profile: DataFrame) -> DataFrame:
    """Profile rows with a class, once under their section and once under 'all'.

    Two narrow rows per student replace a second pass; sums are pre-aggregated in each task.
    """
    sections = F.array_distinct(F.array_compact(F.array(F.col("section_name"), F.lit("all"))))
    return profile.filter(F.col("class_name").isNotNull()).select(
        "school_id", "academic_yr", "class_name", F.explode(sections).alias("section"),
        "student_id", "student_name", "reg_no", "avg_percent", "attendance_percentage",
        "attendance_band", "learning_style", "engagement_pattern",
    )


def risk_group() -> Column:
    """Both, attendance or academic; a missing value puts a student in none."""
    avg, att = F.col("avg_percent"), F.col("attendance_percentage")
    return (
        F.when((att < 75) & (avg < 40), "both").when((att < 75) & (avg >= 40), "attendance").when((avg < 40) & (att >= 75), "academic")
    )


def kpis(rows: DataFrame) -> DataFrame:
    avg, att = F.col("avg_percent"), F.col("attendance_percentage")
    risk = risk_group()
    return rows.groupBy(*GROUP).agg(
        F.count("*").alias("n_students"),
        mean_double(avg).alias("avg_academic"),
        mean_double(att).alias("avg_attendance"),
        F.count_if(avg >= 75).alias("count_top"),
        F.count_if(risk == "both").alias("count_at_risk_both"),
        F.count_if(risk == "attendance").alias("count_at_risk_att"),
        F.count_if(risk == "academic").alias("count_at_risk_acad"),
        F.count_if(att >= 85).alias("count_good_attendance"),
    )


def at_risk(rows: DataFrame) -> DataFrame:
    """Students at risk, lowest average first within a class when ordered by ``avg_percent``."""
    return rows.withColumn("risk", risk_group()).filter(F.col("risk").isNotNull()).select(
        *GROUP, "risk", "student_id", "student_name", F.coalesce("reg_no", F.lit("")).alias("reg_no"),
        tenth(F.col("avg_percent")).alias("avg_percent"),
        tenth(F.col("attendance_percentage")).alias("attendance_percentage"),
    )


def attendance_histogram(rows: DataFrame) -> DataFrame:
    """Students per attendance bin, empty bins included."""
    att = F.col("attendance_percentage")
    bins = [att < 60, (att >= 60) & (att < 75), (att >= 75) & (att < 85), (att >= 85) & (att < 90), att >= 90]
    return _unpivot_counts(rows, bins, fv.ATTENDANCE_BINS)


def academic_histogram(rows: DataFrame, include_upper: bool = False) -> DataFrame:
    """Students per ten-point bin, empty bins included; exactly 100 counts only with ``include_upper``."""
    avg = F.col("avg_percent")
    bins = [(avg >= b) & (avg < b + 10) for b in range(0, 100, 10)]
    if include_upper:
        bins[-1] = (avg >= 90) & (avg <= 100)
    return _unpivot_counts(rows, bins, [f"{b}–{b + 10}" for b in range(0, 100, 10)])


def _unpivot_counts(rows: DataFrame, bins: Sequence[Column], labels: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(*GROUP).agg(*[F.count_if(b).alias(f"b{i}") for i, b in enumerate(bins)])
    cells = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(label).alias("label"), F.col(f"b{i}").alias("students"))
        for i, label in enumerate(labels)
    ])
    return counts.select(*GROUP, F.inline(cells))


def signal_distribution(rows: DataFrame) -> DataFrame:
    """Count and share of each value of the three signals; missing values are left out.

    The three signals have at most eight values, so shares come from one small window.
    """
    cells = F.array(*[
        F.struct(F.lit(name).alias("signal"), F.col(name).alias("label"))
        for name in ("attendance_band", "learning_style", "engagement_pattern")
    ])
    counts = (
        rows.select(*GROUP, F.inline(cells)).filter(F.col("label").isNotNull())
        .groupBy(*GROUP, "signal", "label").agg(F.count("*").alias("students"))
    )
    total = F.sum("students").over(Window.partitionBy(*GROUP, "signal"))
    return counts.withColumn("pct", whole(F.col("students").cast("double") / total * 100).cast("bigint"))


def _median(value: str) -> Column:
    """Aggregate: exact median; Spark keeps value counts, so equal values cost one entry."""
    return F.median(F.col(value).cast("double"))


def medians(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(
        F.count("*").alias("n_students"),
        _median("avg_percent").alias("avg_median"),
        _median("attendance_percentage").alias("att_median"),
    )


def zone_points(rows: DataFrame) -> DataFrame:
    """Scatter points with their zone; both values are needed."""
    high = F.col("avg_percent").cast("double") >= F.col("avg_median")
    there = F.col("attendance_percentage").cast("double") >= F.col("att_median")
    zone = (
        F.when(high & there, fv.ZONE_BOTH).when(high, fv.ZONE_ACADEMIC).when(there, fv.ZONE_PRESENT).otherwise(fv.ZONE_NEITHER)
    )
    both = rows.filter(F.col("avg_percent").isNotNull() & F.col("attendance_percentage").isNotNull())
    return both.join(medians(rows), GROUP).select(
        *GROUP, "student_id", "student_name", "n_students",
        tenth(F.col("attendance_percentage")).alias("x"), tenth(F.col("avg_percent")).alias("y"), zone.alias("zone"),
    )


def zones(rows: DataFrame) -> DataFrame:
    """Students and share of the class per zone, empty zones included."""
    names = [fv.ZONE_BOTH, fv.ZONE_ACADEMIC, fv.ZONE_PRESENT, fv.ZONE_NEITHER]
    counts = zone_points(rows).groupBy(*GROUP).agg(
        *[F.count_if(F.col("zone") == z).alias(f"z{i}") for i, z in enumerate(names)]
    )
    sized = rows.groupBy(*GROUP).agg(F.count("*").alias("n_students")).join(counts, GROUP, "left").fillna(0)
    cells = F.array(*[F.struct(F.lit(z).alias("zone"), F.col(f"z{i}").alias("students")) for i, z in enumerate(names)])
    return sized.select(*GROUP, "n_students", F.inline(cells)).withColumn(
        "pct", whole(F.col("students").cast("double") / F.col("n_students") * 100).cast("bigint")
    )


def insight(rows: DataFrame) -> DataFrame:
    """The one-sentence class insight: risk, then thriving, then attendance, then the averages."""
    thriving = zone_points(rows).filter(F.col("zone") == fv.ZONE_BOTH).groupBy(*GROUP).agg(F.count("*").alias("thriving"))
    n = F.col("n_students")

    def share(count: str) -> Column:
        return F.coalesce(F.col(count), F.lit(0)).cast("double") / n * 100

    risk, good, well = share("count_at_risk_both"), share("count_good_attendance"), share("thriving")
    code = F.when(risk > 20, "risk").when(well >= 70, "thriving").when(good < 50, "attendance").otherwise("average")

    def number(value: Column) -> Column:
        return F.format_string("%d", whole(value).cast("bigint"))

    def shown(value: str) -> Column:
        return F.coalesce(tenth_text(F.col(value)), F.lit("nan"))

    text = (
        F.when(F.col("insight") == "risk", F.concat(
            number(risk), F.lit("% of students are showing both low attendance and low academic scores — early intervention is recommended.")))
        .when(F.col("insight") == "thriving", F.concat(
            number(well), F.lit("% of students are academically on track with good attendance. The class is performing well overall.")))
        .when(F.col("insight") == "attendance", F.concat(
            F.lit("Only "), number(good),
            F.lit("% of students have attendance above 85%. Improving attendance could boost academic outcomes.")))
        .otherwise(F.concat(
            F.lit("Class average is "), shown("avg_academic"), F.lit("% academic, "), shown("avg_attendance"),
            F.lit("% attendance. "), F.col("count_at_risk_both").cast("string"), F.lit(" student(s) need priority support.")))
    )
    return (
        kpis(rows).join(thriving, GROUP, "left").withColumn("insight", code)
        .select(*GROUP, "insight", text.alias("insight_text"))
    )


def top_performers(rows: DataFrame, most: int = 5) -> DataFrame:
    """The best five above 80 of each class, with their place label.

    The rank limit is applied in each task before the shuffle (window group limit).
    """
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("avg_percent"), "student_name", "student_id"))
    top = rows.filter(F.col("avg_percent") > 80).withColumn("place", place).filter(F.col("place") <= most)
    medal = F.coalesce(F.get(F.array(*[F.lit(m) for m in fv.MEDALS]), F.col("place") - 1), F.col("place").cast("string"))
    return top.select(
        *GROUP, "place", "student_id", "student_name", F.coalesce("reg_no", F.lit("")).alias("reg_no"),
        tenth(F.col("avg_percent")).alias("avg_percent"), medal.alias("medal"),
    )


def needs_support(rows: DataFrame, most: int = 10) -> DataFrame:
    """The lowest ten below 35 of each class."""
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("avg_percent", "student_name", "student_id"))
    low = rows.filter(F.col("avg_percent") < 35).withColumn("place", place).filter(F.col("place") <= most)
    return low.select(
        *GROUP, "place", "student_id", "student_name", F.coalesce("reg_no", F.lit("")).alias("reg_no"),
        tenth(F.col("avg_percent")).alias("avg_percent"),
    )


def class_summary(rows: DataFrame) -> DataFrame:
    """Head count and mean values to one decimal."""
    return rows.groupBy(*GROUP).agg(
        F.count("*").alias("students"),
        tenth(mean_double(F.col("avg_percent"))).alias("avg_percent"),
        tenth(mean_double(F.col("attendance_percentage"))).alias("attendance_percentage"),
    )


def class_subjects(subject_map: DataFrame, subjects: DataFrame, marks: DataFrame) -> DataFrame:
    """Subjects of each class and year, and whether any student has marks in them."""
    named = subject_map.join(subjects.select("school_id", "subject_id", "subject_name"), ["school_id", "subject_id"])
    with_marks = marks.select("school_id", "academic_yr", "class_name", "subject_id").distinct().withColumn("has_marks", F.lit(1))
    return named.join(with_marks, ["school_id", "academic_yr", "class_name", "subject_id"], "left").select(
        "school_id", "academic_yr", "class_name", "subject_id", "subject_name",
        F.coalesce("has_marks", F.lit(0)).alias("has_marks"),
    )


def class_subject_marks(
    subject_map: DataFrame, performance: DataFrame, demographics: DataFrame, parents: DataFrame | None, classes: DataFrame,
    reference_scope: bool = False,
) -> DataFrame:
    """Marks of each class's subjects, one row per student and subject.

    By default a class shows its own students.  With ``reference_scope`` it shows every student of
    the school and year who has the subject, whichever class they are in.
    """
    people = with_parents(demographics, parents).filter(has_name(F.col("student_name"))).select(
        "school_id", "student_id", "academic_yr", "class_id",
        display_name(F.col("student_name"), F.col("father_name")).alias("student_name"),
    )
    marks = performance.select(
        "school_id", "student_id", "academic_yr", "subject_id", F.col("avg_percent").alias("subject_avg"), "written_avg", "oral_avg"
    ).join(people, ["school_id", "student_id", "academic_yr"])
    keys = ["school_id", "academic_yr", "subject_id"]
    if not reference_scope:
        marks = marks.join(classes.select("school_id", "class_id", "class_name"), ["school_id", "class_id"])
        keys = [*keys, "class_name"]
    return marks.join(subject_map, keys).select(
        "school_id", "academic_yr", "class_name", "subject_id", "student_id", "student_name",
        "subject_avg", "written_avg", "oral_avg",
    )


def staff_access(users: DataFrame, teachers: DataFrame, is_principal) -> DataFrame:
    """Teacher and principal accounts with their place and whether the designation makes them principal."""
    staff = users.filter(F.col("role_id").isin("T", "M")).select("school_id", "user_id", F.col("reg_id").alias("teacher_id"), "role_id")
    return staff.join(teachers, ["school_id", "teacher_id"]).select(
        "school_id", "user_id", "teacher_id", "designation", "class_id", "section_id",
        is_principal(F.col("designation")).cast("int").alias("is_principal"),
    )
