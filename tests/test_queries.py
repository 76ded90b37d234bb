"""Every registered query against its SQL, and the shape of the plans."""

import re
from pathlib import Path

import pytest

from chalkline.plans.registry import queries
from oracles.compare import compare, connect
from oracles.sql import oracle_sql


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_sql(spark, con, small, name):
    assert compare(spark, con, small, name) is None


@pytest.mark.parametrize("name", list(queries()))
def test_plan_has_no_pairwise_join(spark, small, name):
    plan = queries()[name](spark, small)._jdf.queryExecution().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|BatchEvalPython|ArrowEvalPython", plan)


def test_entry(spark):
    import __spark_entry__ as entry

    assert {"school_id", "student_id", "academic_yr", "avg_percent"} <= set(entry.entry(spark).columns)


def test_latest_revision_is_limited_before_the_shuffle(spark, small):
    plan = queries()["marks_latest"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange hashpartitioning[\s\S]*WindowGroupLimit.*Partial", plan)


def test_scans_read_only_what_they_need(spark, small):
    plan = queries()["attendance_present"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in plan


def test_shared_tables_go_to_the_named_folder(spark, small, tmp_path):
    from chalkline.plans.star import StagedStar
    from chalkline.sources.order_school import OrderSchool

    star = StagedStar(spark, OrderSchool(spark, small))
    star.folder = str(tmp_path)
    assert star.exam_sums.count() > 0
    assert {p.name for p in tmp_path.iterdir()} == {"marks_raw", "heading_rows", "exam_sums"}
    assert len([p for p in (tmp_path / "marks_raw").iterdir() if p.name.endswith(".parquet")]) <= 8  # a file a bucket at most
    star.drop()
    assert not tmp_path.exists()


def stored_sides(plan):
    """For each bucketed scan of a plan, the nodes from it up to the first join."""
    lines = [x for x in plan.split("\n") if x.strip()]
    depth = [len(re.match(r"[\s:|+-]*", x)[0]) for x in lines]
    for i, line in enumerate(lines):
        if "Bucketed: true" in line:
            above, at = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < at:
                    at = depth[j]
                    if "Join" in lines[j]:
                        break
                    above.append(lines[j])
            yield line, above


@pytest.mark.parametrize("name", ["student_master_profile", "student_profile", "student_ai_profile", "marks_unseen"])
def test_stored_tables_are_joined_as_they_lie(spark, small, name):
    from chalkline.plans import registry
    from chalkline.plans.star import STAGED, Star

    star = registry._star(spark, small)
    for table in STAGED:
        getattr(star, table)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # class and section names only
    try:
        df = queries()[name](spark, small) if name == "marks_unseen" else Star.__dict__[name].func(star)
        plan = df._jdf.queryExecution().executedPlan().toString()
        sides = list(stored_sides(plan))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sides and (name == "marks_unseen" or any("SortMergeJoin" in x or "HashJoin" in x for x in plan.split("\n")))
    for scan, above in sides:
        bare = len(re.search(r"FileScan parquet \S*?\[([^\]]*)\]", scan)[1].split(",")) <= 3  # bare keys may move
        if not bare and name != "marks_unseen" or "mark_ids" in scan:
            assert not any(re.search("(?<!Broadcast)Exchange", x) for x in above), (scan[:120], above)


def test_null_keys_pass_by(spark):
    from pyspark.sql import functions as F

    from chalkline.operators.joins import join_known

    rows = spark.range(10_000).select(F.lit(1).alias("s"), F.when(F.col("id") % 5 > 2, F.col("id")).alias("p"), F.col("id").alias("k"))
    names = spark.range(0, 10_000, 2).select(F.lit(1).alias("s"), F.col("id").alias("p"), F.concat(F.lit("n"), "id").alias("name"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = join_known(rows, names, ["s", "p"]), rows.join(names, ["s", "p"], "left")
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        # 60 % of the keys are null: the plain join deals them to one task, here no task has more than its share.
        share = lambda df: max(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()) / 10_000
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert share(got) < 0.2 < share(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_changed_folder_is_read_anew(spark, small, tmp_path):
    import shutil

    from chalkline.plans import registry

    # The given folder is read-only, and copies would keep its mode.
    folder = tmp_path / "data"
    folder.mkdir()
    for file in Path(small).iterdir():
        shutil.copyfile(file, folder / file.name)
    first = registry._star(spark, str(folder))
    assert registry._star(spark, str(folder)) is first
    shutil.copyfile(f"{small}/nation.parquet", folder / "more.parquet")
    assert registry._star(spark, str(folder)) is not first


def test_exam_report_evaluates_the_breakdown_once(spark, small):
    plan = queries()["exam_report"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/heading_rows") == 1  # scans of that folder


def test_exam_report_deals_no_totals_again(spark, small):
    plan = queries()["exam_report"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan
