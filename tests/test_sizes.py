"""How many tasks the tables are dealt to, and what is derived or moved once."""

import shutil
from pathlib import Path

import pytest

from chalkline.functions.columns import DEALT
from chalkline.operators import marks
from chalkline.plans import registry
from chalkline.plans.star import StagedStar
from chalkline.sources import readers
from chalkline.sources.order_school import OrderSchool

MARKS = (
    "school_id int, student_id bigint, subject_id string, exam_id int, academic_yr string, marks_id bigint, publish string, "
    "present string, mark_obtained string, highest_marks string"
)


@pytest.fixture
def folder(small, tmp_path):
    into = tmp_path / "data"
    into.mkdir()
    for file in Path(small).iterdir():
        shutil.copyfile(file, into / file.name)
    return str(into)


def test_larger_tables_are_dealt_to_more_tasks(spark, small, folder, monkeypatch):
    monkeypatch.setattr(readers, "PART_BYTES", 10_000)
    bytes_of = sum((Path(folder) / f"{t}.parquet").stat().st_size for t in ("customer", "orders", "lineitem"))
    parts = -(-bytes_of // 10_000)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        star = registry._star(spark, folder)
        assert star.buckets == parts and spark.conf.get(readers.START) == str(parts)
        rows = star.marks_raw
        assert rows.count() == registry._star(spark, folder).source["student_marks"].count()
        grouped = rows.groupBy("school_id", "student_id", "academic_yr").count()._jdf.queryExecution().executedPlan().toString()
        assert f"out of {parts}" in grouped and "Exchange" not in grouped
        star.drop()
    finally:
        monkeypatch.undo()
        registry._star(spark, small)
    assert spark.conf.get(readers.START, None) is None  # a small folder leaves the session as it was


def test_a_start_of_the_users_own_is_kept(spark, monkeypatch):
    monkeypatch.setattr(readers, "_own_start", {})
    spark.conf.set(readers.START, "50")
    try:
        for parts, want in ((20, "50"), (70, "70"), (20, "50")):
            readers.start_shuffles_with(spark, parts)
            assert spark.conf.get(readers.START) == want
    finally:
        spark.conf.unset(readers.START)


def test_student_years_are_derived_once(spark, small):
    star = StagedStar(spark, OrderSchool(spark, small))
    for name in ("years", "dim_class", "student_clean", "dim_student_demographics"):
        getattr(star, name)
    plan = star.dim_student_demographics._jdf.queryExecution().executedPlan().toString()
    assert "students" in star.__dict__ and "o_custkey" not in plan
    star.drop()


def test_marks_texts_are_objects_of_the_headings_present(spark, small):
    from pyspark.sql import functions as F

    rows = OrderSchool(spark, small)["student_marks"]
    for c in ("present", "mark_obtained", "highest_marks"):
        again = F.to_json(F.from_json(c, "map<string,string>"))
        assert rows.where(F.col(c).isNull() | (again != F.col(c)) | again.isNull() | ~F.col(c).contains('":"')).isEmpty()


def test_heading_rows_read_no_lambda(spark):
    """Repeated, missing and null headings as before, but read by plain expressions."""
    rows = [
        (1, 1, "5", 1, "2023-2024", 1, "Y", '{"1":"Y"}', '{"1":"7","1":"9","x":"3","2":null}', '{"1":"20","2":"10"}'),
        (1, 2, "5", 1, "2023-2024", 2, "Y", None, '{"1":"7"}', None),
        (1, 3, "5", 1, "2023-2024", 3, "Y", '{"1":"Y"}', None, '{"1":"20"}'),
        (1, 4, "5", 1, "2023-2024", 4, "Y", '{"1":"Y"}', "{}", '{"1":"20"}'),
    ]
    found = marks.heading_rows(spark.createDataFrame(rows, MARKS))
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    text = lambda v: None if v is None else str(v)
    got = sorted(((r.student_id, r.marks_headings_id, r.is_present, text(r.marks_obtained), text(r.max_marks)) for r in found.collect()), key=str)
    assert got == sorted([
        (1, 1, "Y", "7.00", "20.00"), (1, 1, "Y", "7.00", "20.00"), (1, None, None, "3.00", None), (1, 2, None, None, "10.00"),
        (2, 1, None, "7.00", None),
    ], key=str)


def test_no_student_side_is_broadcast(spark, small):
    """Files of student-years look small; their rows must not pass through the driver."""
    star = registry._star(spark, small)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for table in ("people", "student_master_profile", "fact_science_components", "dim_class", "dim_section", "dim_subject"):
        getattr(star, table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        from chalkline.plans.star import Star

        for name in ("student_profile", "student_ai_profile", "student_master_profile"):
            plan = Star.__dict__[name].func(star)._jdf.queryExecution().executedPlan().toString()
            built = [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "academic_yr" in x.split("LeftOuter")[0] and "LeftOuter" in x]
            assert not built and "SortMergeJoin" in plan, (name, built)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_differing_rows_are_found_without_a_shuffle_of_both_sides(spark):
    from pyspark.sql import functions as F

    from chalkline.operators.reconcile import differing_rows

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(1000).select((F.col("id") % 2).alias("school"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = differing_rows(rows, rows.unionByName(rows.where("id = 7")), ["school"], ["id"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and [tuple(r) for r in found.collect()] == [(1, 7, "right", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_pairs_of_one_class_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from chalkline.operators.student_view import visible_to_teachers

    one = [F.lit(1).alias(c) for c in ("school_id", "class_id", "section_id")]
    pupils = spark.range(2000).select(*one, F.when(F.col("id") > 0, F.col("id")).alias("student_id"), F.lit("2023-2024").alias("academic_yr"))
    staff = spark.range(20).select(*one, F.concat(F.lit("t"), "id").alias("user_id"))
    seen = visible_to_teachers(pupils, staff)
    tasks = [r[1] for r in seen.groupBy(F.spark_partition_id()).count().collect()]
    assert seen.count() == seen.distinct().count() == 40_000 == sum(tasks) and max(tasks) < 20_000


def test_pairs_are_met_in_lists_and_dealt_as_the_sizes_ask(spark, monkeypatch):
    """Lists of a bounded length bring every pair: accounts that are null or come twice, and none for a missing class."""
    from collections import Counter

    from chalkline.operators import student_view

    monkeypatch.setattr(student_view, "LISTED", 4)
    places = [(1, 3, 2), (1, 3, 4), (7, 3, 2), (1, None, 2)]
    pupils = [(s, k, "2023-2024", c, d) for s, c, d in places for k in (1, 2, 2, None)]
    staff = [(s, u, c, d) for s, c, d in places[:2] + places[3:] for u in [None, None, "t1", "t1", *(f"u{i}" for i in range(7))]]
    profile = spark.createDataFrame(pupils, "school_id int, student_id long, academic_yr string, class_id int, section_id int")
    access = spark.createDataFrame(staff, "school_id int, user_id string, class_id int, section_id int")
    spark.conf.set(readers.START, "40")
    try:
        seen = student_view.visible_to_teachers(profile, access)
        plan = seen._jdf.queryExecution().executedPlan().toString()
        found = Counter(tuple(r) for r in seen.collect())
    finally:
        spark.conf.unset(readers.START)
    pairs = [(s, k, y, u) for s, k, y, c, d in pupils for t, u, e, f in staff if c is not None and (s, c, d) == (t, e, f)]
    assert found == Counter(pairs) and len(pairs) == 2 * 4 * 11
    assert plan.index("Generate explode(user_ids") < plan.index("SortMergeJoin") < plan.index("collect_list(struct(user_id")
    assert plan.count(", 40), REPARTITION_BY_NUM") == 2 == plan.count("Exchange") - 1


def test_marks_are_dealt_once(spark, small):
    """Lines move to the tasks of their student-year and are grouped and stored there; the wide rows do not move."""
    star = StagedStar(spark, OrderSchool(spark, small, 24), 24, all_schools=True)
    dealt = star.source["student_marks"].repartition(24, *DEALT)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "24)" in x]
    above, below = plan.split("Exchange hashpartitioning(student_id")
    assert len(moved) == 1 and "HashAggregate" in above and "HashAggregate" not in below
    star.drop()


def test_absent_and_repeated_lines_of_a_group(spark, tmp_path):
    """Headings without a line, with several, absent in one of them, and line numbers and marks that are missing."""
    from datetime import date

    day = date(1996, 3, 1)
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5, 1, day)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 10.0, "N"), (1, 12.0, "R"), (3, None, "R"), (7, 4.0, None), (None, 9.0, "R"), (9, 9.0, "R")]
    spark.createDataFrame(
        [(5, 40, 30, n, q, f, "F", day) for n, q, f in lines],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate date",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    row = OrderSchool(spark, str(tmp_path))["student_marks"].collect()
    assert len(row) == 1
    assert (row[0].present, row[0].mark_obtained, row[0].highest_marks) == (
        '{"1":"N","3":"N","7":"Y"}', '{"1":"12","7":"4"}', '{"1":"50","7":"50"}')


def test_both_states_of_a_load_come_from_one_pass(spark, small):
    plan = registry.queries()["load_touched_partitions"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan  # the large sources are stored once, not derived for each state
