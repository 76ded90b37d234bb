"""Tables behind the student page, for all students at once.

A page is a filter on one of these tables.  Lists are kept as rows, so no group is gathered
into one value unless its size is bounded by the subject list of a school.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import (
    KEY, bar_value, category_rank, class_rank, clean_subjects, component_rank, effective_subject, exam_title,
    in_science, initials, is_listed_scholastic, is_senior_class, lookup, mean2, norm, percent_text,
    performance_tier, remedial_priority, subject_category, tenth, text_items,
)
from chalkline.operators.profile import science_text
from chalkline.session import first_partitions

CLASS_KEY = ["school_id", "academic_yr", "class_id", "section_id"]
_MAP = "map<string,string>"
#: Over how many tasks one class's pairs of students and teachers may spread.
SHARES = 32
#: How many teacher accounts of a class a list holds at most.
LISTED = 1024


def _named(performance: DataFrame, subjects: DataFrame) -> DataFrame:
    return performance.join(subjects.select("school_id", "subject_id", "subject_name"), ["school_id", "subject_id"])


def student_subjects(performance: DataFrame, subjects: DataFrame, components: DataFrame) -> DataFrame:
    """Subjects with an average; the Science row also names its components."""
    science = science_text(components).withColumn("subject_name", F.lit(fv.SCIENCE_NAME))
    rows = _named(performance, subjects).filter(F.col("avg_percent").isNotNull())
    return rows.join(science, [*KEY, "subject_name"], "left").select(
        *KEY, "subject_id", "subject_name", "avg_percent", "written_avg", "oral_avg", "science_components",
        is_listed_scholastic(F.col("subject_name")).alias("is_scholastic"),
    )


def subject_performance_all(performance: DataFrame, subjects: DataFrame) -> DataFrame:
    return _named(performance, subjects).select(
        *KEY, "subject_name", "avg_percent", "written_avg", "oral_avg", "exams_taken"
    )


def subject_vs_class(performance: DataFrame, subjects: DataFrame, profile: DataFrame) -> DataFrame:
    """Own average beside the average of the same class, section and year.

    Averages are grouped (partial sums first) and joined back, so a very large class does not
    have to pass through one window task.
    """
    place = profile.select(*KEY, "class_id", "section_id")
    placed = performance.select(*KEY, "subject_id", "avg_percent", "written_avg", "oral_avg").join(place, KEY, "left")
    by_class = placed.filter(F.col("class_id").isNotNull() & F.col("section_id").isNotNull())
    by_class = by_class.groupBy(*CLASS_KEY, "subject_id").agg(mean2(F.col("avg_percent")).alias("class_avg_percent"))
    joined = placed.join(by_class, [*CLASS_KEY, "subject_id"], "left")
    return _named(joined, subjects).select(
        *KEY, "subject_name", "avg_percent", "written_avg", "oral_avg", "class_avg_percent"
    )


def present_in_exam(is_present: Column) -> Column:
    """'Y', or a JSON object with entries; text that is no JSON counts as absent."""
    # Text without a brace holds no object and is not parsed: a plain 'N' would fail in the parser, row by row.
    entries = F.when(is_present.contains("{"), F.size(F.from_json(is_present, _MAP)))
    return (is_present == "Y") | (F.coalesce(entries, F.lit(0)) > 0)


def exam_breakdown(
    rows: DataFrame, headings: DataFrame, exams: DataFrame, students: DataFrame, classes: DataFrame,
    master: DataFrame, subjects: DataFrame,
) -> DataFrame:
    """Marks per heading, exam and subject.  The three sciences keep their own names.

    Heading rows are summed before the joins; they are the largest input.
    """
    sums = (
        rows.filter(present_in_exam(F.col("is_present")))
        .groupBy(*KEY, "subject_id", "exam_id", "marks_headings_id")
        .agg(F.sum("marks_obtained").alias("marks_obtained"), F.sum("max_marks").alias("max_marks"))
        .withColumn("subject_id", F.col("subject_id").try_cast("int"))
    )
    headings = headings.select(
        "school_id", F.col("marks_headings_id").cast("bigint").alias("marks_headings_id"), F.col("name").alias("exam_type")
    )
    exams = exams.select("school_id", "exam_id", "academic_yr", F.col("name").alias("exam_name"))
    enrolled = students.filter(F.col("is_delete") == "N").select(*KEY, "class_id")
    classes = classes.select("school_id", "class_id", "academic_yr", F.col("name").alias("class_name"))
    known = master.select("school_id", F.col("sm_id").alias("subject_id"))
    joined = (
        sums.join(headings, ["school_id", "marks_headings_id"])
        .join(exams, ["school_id", "exam_id", "academic_yr"])
        .join(enrolled, KEY)
        .join(classes, ["school_id", "class_id", "academic_yr"])
        .join(known, ["school_id", "subject_id"], "left_semi")
    )
    own_name = F.when(in_science(F.col("class_name"), F.col("subject_id")), lookup(fv.SCIENCE_COMPONENTS, F.col("subject_id")))
    counted_as = effective_subject(F.col("class_name"), F.col("subject_id"))
    named = joined.select(
        *KEY, "exam_type", "exam_id", "exam_name", "class_name", F.col("subject_id").alias("source_id"),
        own_name.alias("own_name"), counted_as.alias("subject_id"), "marks_obtained", "max_marks",
    ).join(subjects.select("school_id", "subject_id", "subject_name"), ["school_id", "subject_id"])
    return (
        named.groupBy(*KEY, "exam_type", "exam_id", "exam_name", "class_name", "source_id", "own_name", "subject_name")
        .agg(F.sum("marks_obtained").alias("marks_obtained"), F.sum("max_marks").alias("max_marks"))
        .select(
            *KEY, "exam_type", "exam_id", "exam_name",
            F.coalesce("own_name", "subject_name").alias("subject_name"), "marks_obtained", "max_marks",
        )
    )


def exam_report(breakdown: DataFrame) -> DataFrame:
    """One row per shown exam and subject with totals, percent and order columns.

    Exams whose shown names agree are merged.  An exam's place is that of its first row in (heading,
    exam, subject) order; it comes with the totals, so the breakdown is evaluated once.
    """
    own = breakdown.withColumn("exam", exam_title(F.col("exam_name")))
    total, top = F.sum("marks_obtained").cast("double"), F.sum("max_marks").cast("double")
    category = subject_category(F.col("subject_name"))
    totals = own.groupBy(*KEY, "exam", "subject_name").agg(
        F.coalesce(total, F.lit(0.0)).alias("o"), F.coalesce(top, F.lit(0.0)).alias("m"),
        F.count("*").alias("component_count"),
        F.min(F.struct("exam_type", "exam_name", "subject_name", "exam_id")).alias("first"),
    )
    # A student-year has few exams and subjects, so both windows are over a handful of rows. Staged heading rows lie by
    # student-year and so do the totals: they are not dealt again.
    placed = totals.withColumn("exam_first", F.min("first").over(Window.partitionBy(*KEY, "exam")))
    placed = placed.withColumn("exam_place", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("exam_first", "exam")))
    return placed.select(
        *KEY, "exam", "exam_place", "subject_name",
        category.alias("category"),
        lookup(fv.CATEGORY_ABBREVIATIONS, category).alias("category_abbr"),
        category_rank(category).alias("category_rank"),
        is_listed_scholastic(F.col("subject_name")).alias("is_scholastic"),
        "component_count", tenth(F.col("o")).alias("total"), tenth(F.col("m")).alias("max_marks"),
        F.when(F.col("m") > 0, tenth(F.try_divide("o", "m") * 100)).otherwise(0.0).alias("avg"),
    )


def exam_components(breakdown: DataFrame) -> DataFrame:
    """The components inside each line of the exam report, with their order."""
    label = F.trim("exam_type")
    return breakdown.select(
        *KEY, exam_title(F.col("exam_name")).alias("exam"), "exam_id", "subject_name", label.alias("label"),
        tenth(F.col("marks_obtained")).alias("obtained"), tenth(F.col("max_marks")).alias("highest"),
        component_rank(label).alias("sort_order"),
    )


def remedial(subjects: DataFrame) -> DataFrame:
    """Scholastic subjects below 50, worst first, with advice."""
    advice = {r[0]: r[1:] for r in fv.REMEDIAL}
    name = norm(F.col("subject_name"))

    def advised(place: int) -> Column:
        return F.coalesce(lookup({k: v[place] for k, v in advice.items()}, name), F.lit(fv.REMEDIAL_ELSE[place]))

    low = subjects.filter((F.col("avg_percent") < 50) & (subject_category(F.col("subject_name")) == fv.SCHOLASTIC))
    # At most one row per subject of the school, so the window stays small.
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("avg_percent", "subject_name", "subject_id"))
    return low.select(
        *KEY, "subject_name", "avg_percent", place.alias("place"),
        remedial_priority(F.col("avg_percent")).alias("priority"),
        F.concat_ws("; ", advised(0), advised(1), advised(2)).alias("focus"),
        advised(3).alias("action"),
    )


def strong_subject_list(profile: DataFrame, subjects: DataFrame) -> DataFrame:
    """The cleaned strong subjects; without any, the subjects at 75 or more, else the first five."""
    best = Window.partitionBy(*KEY).orderBy(F.desc("avg_percent"), "subject_name", "subject_id")
    ranked = subjects.select(
        *KEY, "subject_name", "avg_percent", F.row_number().over(best).alias("r"),
        F.max("avg_percent").over(Window.partitionBy(*KEY)).alias("top"),
    )
    picked = ranked.filter(F.when(F.col("top") >= 75, F.col("avg_percent") >= 75).otherwise(F.col("r") <= 5))
    in_order = F.array_sort(F.collect_list(F.struct("r", "subject_name")))
    fallback = picked.groupBy(*KEY).agg(F.array_join(F.transform(in_order, lambda x: x["subject_name"]), ", ").alias("picked"))
    own = clean_subjects(F.col("strong_subjects"))
    return profile.select(*KEY, "strong_subjects", "strong_subjects_ai").join(fallback, KEY, "left").select(
        *KEY,
        F.when(F.size(own) > 0, own).otherwise(clean_subjects(F.col("picked"))).alias("subjects"),
        F.when(F.size(own) > 0, F.coalesce("strong_subjects_ai", F.lit("")))
        .otherwise(F.coalesce("picked", "strong_subjects_ai", F.lit(""))).alias("subjects_ai"),
    )


def subject_groups(lists: DataFrame) -> DataFrame:
    """Strong subjects by category, in list order, one row per subject."""
    rows = lists.select(*KEY, F.posexplode("subjects").alias("place", "subject_name"))
    return rows.withColumn("category", subject_category(F.col("subject_name")))


def classmates(profile: DataFrame) -> DataFrame:
    """Scatter points keyed by class.  A student's classmates are the rows with that class key."""
    zero = F.lit(0.0)
    return profile.select(
        "school_id", "academic_yr", "class_name", "section_name", "student_id", "student_name",
        F.coalesce(tenth(F.col("avg_percent")), zero).alias("score"),
        F.coalesce(tenth(F.col("attendance_percentage")), zero).alias("attendance"),
    )


def classmates_of(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points of the classes the wanted (school, student, year) rows belong to, with ``is_me``.

    Sized by what is asked for: one class per wanted student.
    """
    class_of = ["school_id", "academic_yr", "class_name", "section_name"]
    mine = points.join(wanted.select(*KEY), KEY, "left_semi").select(*class_of, F.col("student_id").alias("me"))
    return points.join(mine, class_of).withColumn("is_me", F.col("student_id") == F.col("me"))


PERSON = ["school_id", "parent_id", "student_name"]


def progress(profile: DataFrame) -> DataFrame:
    """Points of the multi-year chart, keyed by person (same name and parent)."""
    return profile.select(
        *PERSON, "academic_yr", "student_id",
        F.coalesce(tenth(F.col("avg_percent")), F.lit(0.0)).alias("score"),
    )


def history_trend(profile: DataFrame) -> DataFrame:
    """First and last average of each person, oldest year first, with the direction."""
    scored = profile.filter(F.col("avg_percent").isNotNull())
    order = F.struct("academic_yr", "student_id")
    ends = scored.groupBy(*PERSON).agg(
        F.count("*").alias("points"),
        F.min_by("avg_percent", order).alias("first_score"),
        F.max_by("avg_percent", order).alias("last_score"),
    )
    first, last = F.col("first_score"), F.col("last_score")
    direction = F.when(last > first, "improving").when(last < first, "declining").otherwise("steady")
    return ends.withColumn("direction", F.when(F.col("points") >= 2, direction))


def page_header(profile: DataFrame) -> DataFrame:
    """The plain values at the top of the page."""
    name = F.upper(F.coalesce(F.when(~norm(F.col("student_name")).isin("none", "nan", ""), F.trim("student_name")), F.lit("Student")))
    avg, att = F.col("avg_percent"), F.col("attendance_percentage")
    return profile.select(
        *KEY, name.alias("name"), initials(name).alias("avatar"), "class_name", "section_name",
        percent_text(avg).alias("overall_disp"), bar_value(avg).alias("overall_pct"),
        percent_text(att).alias("att_disp"), bar_value(att).alias("att_pct"),
        performance_tier(avg).alias("tier"), is_senior_class(F.col("class_name")).alias("is_senior"),
        "achievement_count", F.coalesce("homework_assigned_count", F.lit(0)).alias("hw_count"),
        F.size(text_items(F.col("achievement_list"))).alias("achievement_items"),
    )


# --- selectors and visibility -----------------------------------------------------------------


def selectors(profile: DataFrame) -> DataFrame:
    """Distinct year, class, section and student choices with the class order."""
    return (
        profile.select("school_id", "academic_yr", "class_name", "section_name", "student_name").distinct()
        .withColumn("class_rank", class_rank(F.col("class_name")))
    )


def years_and_classes(profile: DataFrame, demographics: DataFrame, classes: DataFrame) -> DataFrame:
    """Years with a profile, and per year the classes with students: rows of (kind, year, class)."""
    years = profile.filter(F.col("academic_yr") != fv.LIFETIME).select(
        "school_id", F.lit("year").alias("kind"), "academic_yr", F.lit(None).cast("string").alias("class_name")
    )
    named = demographics.select("school_id", "academic_yr", "class_id").distinct().join(classes, ["school_id", "class_id"])
    return years.distinct().unionByName(
        named.select("school_id", F.lit("class").alias("kind"), "academic_yr", "class_name").distinct()
    )


def selection(profile: DataFrame, school_id: int, year: str | None = None, class_name: str | None = None,
              section_name: str | None = None, student_name: str | None = None) -> DataFrame:
    """Rows of one cascading choice; an unknown student falls back to the first name in order.

    Each step looks at one school's rows only and keeps one value, so nothing large moves.
    """
    rows = profile.filter(F.col("school_id") == school_id)
    if year is None:
        latest = rows.agg(F.max("academic_yr").alias("academic_yr"))
        rows = rows.join(F.broadcast(latest), "academic_yr", "left_semi")
    else:
        rows = rows.filter(F.col("academic_yr") == year)
    for column, wanted in (("class_name", class_name), ("section_name", section_name)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    named = F.max(F.when(F.col("student_name") == student_name, F.col("student_name"))) if student_name else F.lit(None)
    chosen = rows.agg(F.coalesce(named, F.min("student_name")).alias("student_name"))
    return rows.join(F.broadcast(chosen), "student_name", "left_semi")


def visible_to_parents(profile: DataFrame, parents: DataFrame) -> DataFrame:
    """(user, student-year) rows a parent account may see."""
    access = parents.filter(F.col("role_id") == "P").select("school_id", "user_id", F.col("reg_id").alias("parent_id"))
    return profile.select(*KEY, "parent_id").join(access, ["school_id", "parent_id"]).select(*KEY, "user_id")


def visible_classes(users: DataFrame, teachers: DataFrame) -> DataFrame:
    """(user, class, section) rows a teacher account may see.

    Visibility is kept per class: a teacher's students are the profile rows with that key.
    """
    access = users.filter(F.col("role_id") == "T").select("school_id", "user_id", F.col("reg_id").alias("teacher_id"))
    return access.join(teachers.select("school_id", "teacher_id", "class_id", "section_id"), ["school_id", "teacher_id"]).select(
        "school_id", "user_id", "class_id", "section_id"
    )


def visible_to_teachers(profile: DataFrame, access: DataFrame) -> DataFrame:
    """(user, student-year) rows of the classes and sections each teacher account may see.

    There are few classes and many rows of each on both sides, so the pairs far outgrow what is joined and writing them
    is nearly all of the work. Each class's students are dealt to ``SHARES`` shares, its teachers go to every share in
    lists of ``LISTED`` accounts at most, and the shares are not joined again. The merge streams the students: a student
    side small enough to be broadcast would be met whole by each list.
    """
    place = ["school_id", "class_id", "section_id"]
    # One column to deal by: classes that are the same value in all rows would be folded away, and the shares be joined again.
    dealt = F.xxhash64(*place, "share").alias("dealt")
    parts = first_partitions(profile.sparkSession)
    share = F.pmod(F.xxhash64("student_id"), F.lit(SHARES)).cast("int").alias("share")
    rows = profile.select(*KEY, "class_id", "section_id", share).select("*", dealt).repartition(parts, "dealt")
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("user_id"))
    lists = access.select(*place, "user_id", F.floor((nth - 1) / LISTED).alias("list")).groupBy(*place, "list").agg(
        F.collect_list(F.struct("user_id"))["user_id"].alias("user_ids")  # in structs, as a list of plain values drops nulls
    )
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    mine = lists.select(*place, "user_ids", shares).select("*", dealt).repartition(parts, "dealt").hint("merge")
    return rows.join(mine, [*place, "share", "dealt"]).select(*KEY, F.explode("user_ids").alias("user_id"))


def default_selection(profile: DataFrame) -> DataFrame:
    """What each choice of year, class and section falls back to: its first student in name order; the latest year is marked."""
    place = ["school_id", "academic_yr", "class_name", "section_name"]
    first = profile.groupBy(*place).agg(F.min("student_name").alias("student_name"))
    latest = profile.groupBy("school_id").agg(F.max("academic_yr").alias("latest"))
    return first.join(latest, "school_id").select(*place, "student_name", (F.col("academic_yr") == F.col("latest")).alias("is_latest_year"))


def achievement_items(profile: DataFrame) -> DataFrame:
    """The lifetime achievement text as rows, one per item in order."""
    rows = profile.select(*KEY, F.posexplode(text_items(F.col("achievement_list"))).alias("i", "item"))
    return rows.select(*KEY, (F.col("i") + 1).alias("place"), "item")


def rows_for_teacher(profile: DataFrame, access: DataFrame, user_id: str) -> DataFrame:
    """Profile rows of one teacher's class and section."""
    mine = access.filter(F.col("user_id") == user_id).select("school_id", "class_id", "section_id")
    return profile.join(mine, ["school_id", "class_id", "section_id"], "left_semi")


def child_years(children: DataFrame, profile: DataFrame) -> DataFrame:
    """Years of each child: profile rows of the parent whose name starts with the child's first name.

    A first name has no space, so only beginnings of the row's first word can equal it.  Joining on
    those keeps an equality join: a parent with very many rows costs rows times word length, not
    rows times children.
    """
    names = children.select(
        "school_id", "parent_id", "latest_student_id",
        F.upper(F.substring_index("display_name", " ", 1)).alias("first_name"),
    )
    word = F.substring_index(F.upper("student_name"), " ", 1)
    starts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: word.substr(F.lit(1), n))
    rows = profile.filter(F.length(word) > 0).select(
        "school_id", "parent_id", "student_id", "academic_yr", F.explode(starts).alias("first_name")
    )
    return rows.join(names, ["school_id", "parent_id", "first_name"]).select(
        "school_id", "parent_id", "latest_student_id", "academic_yr", "student_id"
    )


def request_checks(requests: DataFrame) -> DataFrame:
    """Requests (student_id, academic_yr, user_id) with the first reason to refuse them."""
    return requests.withColumn(
        "refused",
        F.when(F.coalesce(F.col("student_id").try_cast("bigint"), F.lit(0)) <= 0, "student_id")
        .when(~F.coalesce(F.col("academic_yr").isin(fv.VALID_YEARS), F.lit(False)), "academic_yr")
        .when(F.coalesce(F.trim("user_id"), F.lit("")) == "", "user_id"),
    )
