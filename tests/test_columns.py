"""Boundaries of the scalar rules, with hand-computed answers."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chalkline.functions import columns as c
from chalkline.functions import fixed_values as fv


def values(spark, expr, rows, kind):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_attendance_band(spark):
    got = values(spark, c.attendance_band, [Decimal("89.99"), Decimal("90.00"), Decimal("74.99"), Decimal("75.00"), None], "decimal(5,2)")
    assert got == ["Moderately Consistent", "Highly Consistent", "Irregular", "Moderately Consistent", "Irregular"]


def test_performance_tier(spark):
    got = values(spark, c.performance_tier, [85.0, 84.99, 65.0, 50.0, 49.99, None], "double")
    labels = dict(fv.TIERS)
    assert got == [labels[85], labels[65], labels[65], labels[50], fv.TIER_ELSE, None]


def test_percent_rounds_half_up_and_guards_zero(spark):
    df = spark.createDataFrame([(97, 800), (1, 0), (1, 3), (None, 5), (0, 5)], "a bigint, b bigint")
    got = [r.p for r in df.select(c.percent(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [Decimal("12.13"), None, Decimal("33.33"), None, Decimal("0.00")]


def test_mean2_is_exact(spark):
    df = spark.createDataFrame([(Decimal("1.00"),), (Decimal("1.01"),), (None,)], "x decimal(5,2)")
    assert df.agg(c.mean2(F.col("x"))).first()[0] == Decimal("1.01")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1000), min_size=200, max_size=400))
def test_tenth_matches_exact_rounding(spark, numbers):
    numbers = numbers + [x / 20 for x in range(0, 400)] + [x / 100 for x in range(0, 300)]
    got = values(spark, c.tenth, numbers, "double")
    assert got == [round(x, 1) for x in numbers]


def test_class_rank_and_senior(spark):
    names = ["Nursery", "LKG", "Class 9", "Std X", "10th", "Grade 12", "Other", "standard 8", None]
    assert values(spark, c.class_rank, names, "string")[:8] == [0, 1, 11, 15, 15, 14, 15, 10]
    assert values(spark, c.is_senior_class, names, "string") == [False, False, True, True, True, True, False, False, False]


def test_upper_school(spark):
    assert values(spark, c.is_upper_school, ["Class 10", "Class 6", "7A", "LKG"], "string") == [True, False, True, False]


def test_names(spark):
    df = spark.createDataFrame(
        [(" Asha ", "Ravi Rao"), ("Asha Rao", "X"), ("Asha", ""), ("Asha", None)], "n string, f string"
    )
    got = [r.v for r in df.select(c.display_name(F.col("n"), F.col("f")).alias("v")).collect()]
    assert got == ["Asha Ravi", "Asha Rao", "Asha", "Asha"]
    assert values(spark, c.has_real_name, ["12345", "A1", " ", None], "string") == [False, True, False, False]
    assert values(spark, c.initials, ["asha rao", "Asha", "a b c"], "string") == ["AR", "A", "AC"]


def test_title_case(spark):
    texts = ["pre-board 3", "ix n x", "it's", "UNIT test", "a(b)c"]
    assert values(spark, c.title_case, texts, "string") == [t.title() for t in texts]


def test_exam_title(spark):
    assert values(spark, c.exam_title, ["Periodic Test 2 (IX n X)", " term 1 ", "mock exam"], "string") == [
        "Periodic Test 2", "Term 1", "Mock Exam",
    ]


def test_clean_subjects(spark):
    texts = ["Mathematics, maths, Art , , Social Science", "None", None, "—"]
    assert values(spark, c.clean_subjects, texts, "string") == [["Maths", "Art", "SST"], [], [], []]


def test_parentheses(spark):
    text = "Science (Biology, Chemistry (not assessed)), English, Maths/Art"
    assert values(spark, lambda x: F.transform(c.split_outside_parentheses(x), lambda s: F.trim(s)), [text], "string")[0] == [
        "Science (Biology, Chemistry (not assessed))", "English", "Maths", "Art",
    ]
    assert values(spark, c.without_parentheses, ["Science (Biology, Chemistry (not assessed))", "Psychology (Opt)"], "string") == [
        "Science", "Psychology",
    ]


@pytest.mark.parametrize("written, oral, want", [(50, 60.5, fv.COMM_ORAL), (61, 50, fv.COMM_WRITTEN), (60, 50, fv.COMM_BALANCED), (0, 50, "unknown"), (None, 50, "unknown")])
def test_communication_style(spark, written, oral, want):
    df = spark.createDataFrame([(float(written) if written is not None else None, float(oral))], "w double, o double")
    assert df.select(c.communication_style(F.col("w"), F.col("o"))).first()[0] == want


def test_display_percent(spark):
    assert values(spark, c.percent_text, [82.25, 100.0, None], "double") == ["82.2%", "100.0%", "N/A"]
    assert values(spark, c.bar_value, [82.9, 120.0, None], "double") == [82, 100, 0]


def test_two_subject_rules_differ(spark):
    assert values(spark, c.subject_category, ["Robotics", "Music"], "string") == ["Scholastic", "Co-Scholastic"]
    assert values(spark, c.is_listed_scholastic, ["Robotics", "Physics"], "string") == [False, True]


def test_principal(spark):
    assert values(spark, c.is_principal, ["Vice-Principal", "Head Master", "TGT", None], "string") == [True, True, False, False]
