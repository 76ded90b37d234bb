"""Operators on small frames with hand-computed answers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions import matching as mt
from chalkline.operators import careers, class_view, dims, facts, marks, profile, quality, student_view, writes
from chalkline.schemas import INPUT_TABLES
from chalkline.session import shared_folder
from chalkline.sources.readers import bad_values, conform

MARKS = (
    "school_id int, student_id bigint, subject_id string, exam_id int, academic_yr string, marks_id bigint, publish string, "
    "present string, mark_obtained string, highest_marks string"
)


def mark(marks_id, obtained, present='{"1":"Y"}', highest='{"1":"20"}', publish="Y", student=1, subject="5", exam=1):
    return (1, student, subject, exam, "2023-2024", marks_id, publish, present, obtained, highest)


def test_heading_rows_and_bad_text(spark):
    rows = [
        mark(1, '{"1":"12","2":"8"}', '{"1":"Y","2":"Y"}', '{"1":"20","2":"10"}', student=1),
        mark(2, "", student=2), mark(3, "Y", student=3), mark(4, '{"1":null}', student=4),
        mark(5, '{"1":"AB"}', student=5), mark(6, '{"9":"10"}', '{"9":"Y"}', '{"9":"20"}', student=6),
        mark(7, '{"1":"5"}', publish="N", student=7), mark(8, None, student=8),
    ]
    raw = spark.createDataFrame(rows, MARKS)
    got = {(r.student_id, r.marks_headings_id): r.marks_obtained for r in marks.heading_rows(raw).collect()}
    assert got == {
        (1, 1): Decimal("12.00"), (1, 2): Decimal("8.00"), (4, 1): None, (5, 1): None, (6, 9): Decimal("10.00"),
    }
    quality_row = marks.unreadable_marks(raw).first()
    assert (quality_row.unreadable_texts, quality_row.unreadable_numbers) == (3, 2)


def test_latest_revision_over_all_rows(spark):
    raw = spark.createDataFrame([mark(1, '{"1":"1"}'), mark(3, '{"1":"3"}'), mark(2, '{"1":"2"}')], MARKS)
    assert [r.marks_id for r in marks.latest_marks(raw).collect()] == [3]


def test_ratio_of_sums_zero_maximum_and_unclassified(spark):
    raw = spark.createDataFrame(
        [
            mark(1, '{"1":"5"}', highest='{"1":"0"}', student=1),
            mark(2, '{"1":"15","2":"4","8":"6"}', '{"1":"Y","2":"Y","8":"Y"}', '{"1":"20","2":"10","8":"10"}', student=2),
        ],
        MARKS,
    )
    key = ["school_id", "student_id", "academic_yr"]
    got = {r.student_id: r for r in marks.ratio_of_sums(marks.exam_sums(marks.heading_rows(raw)), key).collect()}
    assert got[1].avg_percent is None
    assert (got[2].avg_percent, got[2].written_avg, got[2].oral_avg) == (Decimal("62.50"), Decimal("75.00"), Decimal("40.00"))


def test_missing_components(spark):
    entered = spark.createDataFrame(
        [(1, 1, "2023-2024", "Physics", Decimal("80.00"), 1)],
        "school_id int, student_id bigint, academic_yr string, component string, avg_percent decimal(11,2), is_entered int",
    )
    full = marks.with_missing_components(entered)
    assert full.count() == 3 and marks.missing_components(full).count() == 0
    assert profile.science_text(full).first().science_components == "Physics, Biology (not assessed), Chemistry (not assessed)"


def test_attendance_modes(spark):
    days = spark.createDataFrame([(1, 1, "y", s) for s in "PPLA"], "school_id int, student_id bigint, academic_yr string, attendance_status string")
    p, a = facts.attendance(days).first(), facts.attendance(days, "absent").first()
    assert (p.absent_days, p.present_days, p.attendance_percentage) == (2, 2, Decimal("50.00"))
    assert (a.absent_days, a.present_days, a.attendance_percentage) == (1, 3, Decimal("75.00"))
    with pytest.raises(ValueError):
        facts.attendance(days, "other")


def test_trend_labels(spark):
    rows = [(1, 1, y, v) for y, v in [("1", 50), ("2", 60), ("3", 55), ("4", 55), ("5", None), ("6", 70)]]
    df = spark.createDataFrame([(a, b, y, None if v is None else Decimal(v)) for a, b, y, v in rows], "school_id int, student_id bigint, academic_yr string, avg_percent decimal(11,2)")
    got = [r.performance_trend for r in profile.academic_trend(df).orderBy("academic_yr").collect()]
    assert got == ["Baseline Year", "Improving", "Declining", "Stable", "Stable", "Baseline Year"]


def test_writes_are_idempotent(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    source = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")

    def rows(df):
        return sorted(map(tuple, df.collect()))

    keep = writes.write_rows(source, target, ["k"], "keep")
    assert rows(keep) == [(1, "old"), (2, "old"), (3, "new")]
    assert rows(writes.write_rows(source, keep, ["k"], "keep")) == rows(keep)
    replace = writes.write_rows(source, target, ["k"], "replace")
    assert rows(replace) == [(1, "old"), (2, "new"), (3, "new")]
    assert rows(writes.upsert(source, replace, ["k"])) == rows(replace)
    first = writes.insert_first(source.unionByName(source), target, ["k"], [F.asc("v")])
    assert rows(first) == [(3, "new")]
    with_owner, orphans = writes.split_orphans(target, source, ["k"])
    assert (rows(with_owner), rows(orphans)) == ([(2, "old")], [(1, "old")])


def test_absent_column_is_an_error_and_bad_values_are_counted(spark):
    whole = spark.createDataFrame([("1", "School A", "A", "true"), ("x", "School B", "B", "perhaps")], "school_id string, name string, code string, is_active string")
    names = T.StructType.fromDDL(INPUT_TABLES["school"]).fieldNames()
    given = whole.toDF(*names)
    assert conform(given, "school").count() == 2
    assert {r.column_name: r.bad for r in bad_values(given, "school").collect()} == {names[0]: 1, names[1]: 0, names[2]: 0, names[3]: 1}
    with pytest.raises(ValueError, match=names[3]):
        conform(given.drop(names[3]), "school")
    assert conform(given.drop(names[3]), "school", optional=[names[3]]).filter(F.col(names[3]).isNull()).count() == 2


def test_year_range_is_open_where_asked(spark):
    rows = spark.createDataFrame([(1, y) for y in ("2018-2019", "2019-2020", "2025-2026", "2026-2027")], "school_id int, academic_yr string")
    years = lambda df: {r.academic_yr for r in df.collect()}
    assert years(dims.years_in_range(rows)) == {"2019-2020", "2025-2026"}
    assert years(dims.in_range(rows, "2025-2026", None)) == {"2025-2026", "2026-2027"}
    assert years(dims.in_range(rows, None, None)) == years(rows)


def test_own_folder_only_for_a_local_master(spark):
    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Remote)


RECORD = (
    "school_id int, id bigint, student_id bigint, title string, category string, achievement_date date, level string, position string, "
    "description string, certificate_filename string, certificate_data string, certificate_mime string, submitted_by_parent_id bigint"
)


def test_change_batch(spark):
    day = dt.date(2024, 1, 1)
    base = spark.createDataFrame([(1, i, 7, f"t{i}", "c", day, "l", None, None, "f", "DATA", "m", 1) for i in (1, 2, 3)], RECORD)

    def change(seq, op, i, title, cert=None):
        return (1, seq, op, i, 7, title, "c", day, "l", None, None, cert and "g", cert, cert and "n", 1)

    fields = RECORD.replace("school_id int, ", "school_id int, seq int, op string, ", 1)
    changes = spark.createDataFrame(
        [
            change(1, "update", 1, "keeps"), change(1, "update", 2, "first", "X"), change(2, "update", 2, "last", "NEW"),
            change(1, "delete", 3, None), change(1, "insert", 10, "new"), change(1, "insert", 11, " "), change(1, "update", 99, "t"),
            change(1, "delete", 0, None),
        ],
        fields,
    )
    judged = writes.judge_changes(changes, base)
    got = {r.id: (r.title, r.certificate_data, r.certificate_filename) for r in writes.apply_changes(base, judged).collect()}
    assert got == {1: ("keeps", "DATA", "f"), 2: ("last", "NEW", "g"), 10: ("new", None, None)}
    refused = {r.id: r.reject_reason for r in judged.filter("reject_reason is not null").collect()}
    assert refused == {11: "missing fields: title", 99: "not found", 0: "invalid id"}


CLASS_ROW = (
    "school_id int, academic_yr string, class_name string, section_name string, student_id bigint, student_name string, reg_no string, "
    "avg_percent decimal(11,2), attendance_percentage decimal(11,2), attendance_band string, learning_style string, engagement_pattern string"
)


def class_rows(spark, pairs):
    rows = [
        (1, "y", "9", "A", i, f"S{i}", None, None if a is None else Decimal(str(a)), None if t is None else Decimal(str(t)), "b", None, "e")
        for i, (a, t) in enumerate(pairs)
    ]
    return class_view.class_rows(spark.createDataFrame(rows, CLASS_ROW))


def test_histogram_edges(spark):
    rows = class_rows(spark, [(0, 59.99), (9.99, 60), (10, 75), (99.99, 85), (100, 90), (None, None)])

    def counts(df):
        return [r.students for r in df.filter("section = 'all'").orderBy("bin").collect()]

    assert counts(class_view.attendance_histogram(rows)) == [1, 1, 1, 1, 1]
    assert counts(class_view.academic_histogram(rows)) == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert counts(class_view.academic_histogram(rows, include_upper=True))[-1] == 2


def test_risk_zone_and_insight(spark):
    rows = class_rows(spark, [(39.99, 74.99), (40, 74.99), (39.99, 75), (None, 10), (90, 95)])
    kpi = class_view.kpis(rows).filter("section = 'all'").first()
    assert (kpi.n_students, kpi.count_at_risk_both, kpi.count_at_risk_att, kpi.count_at_risk_acad) == (5, 1, 1, 1)
    zones = {r.zone: (r.students, r.pct) for r in class_view.zones(rows).filter("section = 'all'").collect()}
    assert zones == {"Thriving": (2, 40), "Academically Strong": (0, 0), "Present & Growing": (2, 40), "Needs Support": (0, 0)}
    assert class_view.insight(rows).filter("section = 'all'").first().insight == "attendance"


def test_top_five_only(spark):
    rows = class_rows(spark, [(80.01 + i, 90) for i in range(8)] + [(80, 90)])
    top = class_view.top_performers(rows).filter("section = 'all'").orderBy("place").collect()
    assert [r.medal for r in top] == ["🥇", "🥈", "🥉", "4th", "5th"] and top[0].avg_percent == 87.0


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "x string").select(expr(F.col("x")).alias("v")).first().v


def test_career_words(spark):
    assert [r.career for r in one(spark, mt.analysis_careers, "Computer Science")][0] == "Medicine & Healthcare"
    assert [r.career for r in one(spark, lambda x: mt.analysis_careers(x, "longest"), "Computer Science")][0].startswith("Software")
    assert one(spark, mt.required_subjects, "Software Engineer") == "Physics, Mathematics, Chemistry"
    assert one(spark, lambda x: mt.required_subjects(x, "longest"), "Software Engineer") == "Computer Science, Mathematics"
    assert one(spark, mt.required_subjects, "xyz") == ""


def test_achievement_signals_fall_through_to_unseen_categories(spark):
    got = one(spark, mt.achievement_signals, "2023-2024: Cricket - First, 2024-2025: Quiz, Football, Sports art, Unknown")
    assert [(r.title, r.category) for r in got] == [
        ("Cricket - First", "Sports & Athletics"), ("Quiz", "Academic Excellence"), ("Sports art", "Visual Arts & Design"),
    ]
    assert one(spark, mt.achievement_signals, "") == [] and one(spark, mt.achievement_signals, None) == []


def test_list_rows_core_first(spark):
    df = spark.createDataFrame(
        [(1, 1, "y", "Art & Drawing, Sanskrit", "Art & Drawing, Science (Biology, Chemistry (not assessed))")],
        "school_id int, student_id bigint, academic_yr string, strong_subjects string, strong_subjects_ai string",
    )
    got = [(r.subject_name, r.is_core) for r in careers.subject_list_rows(df).orderBy("list_place").collect()]
    assert got == [("Science (Biology, Chemistry (not assessed))", 1), ("Art & Drawing", 0)]


def test_exam_presence(spark):
    assert [bool(one(spark, student_view.present_in_exam, t)) for t in ("Y", "N", '{"1":"Y"}', "{}", None)] == [True, False, True, False, False]


def test_request_checks(spark):
    df = spark.createDataFrame([("5", "2023-2024", "u"), ("0", "2023-2024", "u"), ("x", "2023-2024", "u"), ("5", "2030", "u"), ("5", "2023-2024", " ")], "student_id string, academic_yr string, user_id string")
    assert [r.refused for r in student_view.request_checks(df).collect()] == [None, "student_id", "student_id", "academic_yr", "user_id"]


def test_structure_checks(spark):
    tables = {"dim_class": spark.range(1).select(F.col("id").alias("class_id"))}
    got = {(r.check, r.subject) for r in quality.structure_checks(spark, tables, {}).collect()}
    assert ("Missing column", "dim_class.class_name") in got and ("Missing table", "dim_subject") in got
    assert ("Missing view", "child_selector") in got


def test_child_years_match_by_prefix(spark):
    children = spark.createDataFrame([(1, 5, 10, "Asha Rao"), (1, 5, 11, "Ravi Rao"), (1, 6, 12, "Asha X")], "school_id int, parent_id bigint, latest_student_id bigint, display_name string")
    rows = spark.createDataFrame(
        [(1, 5, 10, "ASHA Rao", "y1"), (1, 5, 9, "Ashalata R", "y0"), (1, 5, 11, "Ravi", "y1"), (1, 5, 8, "As", "y0"), (2, 5, 7, "Asha", "y0")],
        "school_id int, parent_id bigint, student_id bigint, student_name string, academic_yr string",
    )
    got = {(r.latest_student_id, r.student_id) for r in student_view.child_years(children, rows).collect()}
    assert got == {(10, 10), (10, 9), (11, 11)}


def test_one_hot_key_keeps_all_its_rows(spark):
    hot = spark.range(20000).select(
        F.lit(1).alias("school_id"), F.lit(1).cast("bigint").alias("student_id"), F.lit("5").alias("subject_id"), F.lit(1).alias("exam_id"),
        F.lit("2023-2024").alias("academic_yr"), F.col("id").alias("marks_id"), F.lit("Y").alias("publish"), F.lit('{"1":"Y"}').alias("present"),
        F.concat(F.lit('{"1":"'), (F.col("id") % 20).cast("string"), F.lit('"}')).alias("mark_obtained"), F.lit('{"1":"20"}').alias("highest_marks"),
    )
    assert [r.marks_id for r in marks.latest_marks(hot).collect()] == [19999]
    every = marks.ratio_of_sums(marks.exam_sums(marks.heading_rows(hot)), ["school_id", "student_id", "academic_yr"]).first()
    assert every.avg_percent == Decimal("47.50")
