"""The load into a warehouse folder: repeatable, incremental, whole."""

import random
from collections import Counter
from collections.abc import Mapping
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chalkline.operators import quality
from chalkline.operators.reconcile import checksums, differing, differing_rows
from chalkline.plans.load import Warehouse, finished_runs, last_load, loaded_marks, read_log, run_load
from chalkline.plans.manifest import RAW, Manifest, drop_unnamed
from chalkline.sources.order_school import OrderSchool
from chalkline.sources.readers import TableFolder, read_query, write_table
from chalkline.streaming.marks_feed import stored_marks, take_in


class Changed(Mapping):
    """A source with some tables replaced."""

    def __init__(self, base, **tables):
        self.base, self.tables = base, tables

    def __getitem__(self, name):
        return self.tables.get(name, None) if name in self.tables else self.base[name]

    def __iter__(self):
        return iter(self.base)

    def __len__(self):
        return len(self.base)


def same(a, b):
    columns = sorted(a.columns)
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


@pytest.fixture(scope="module")
def source(spark, small):
    return OrderSchool(spark, small)


@pytest.fixture(scope="module")
def whole(spark, source, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("whole"))
    return root, run_load(spark, source, root, "r1")


def test_second_load_changes_nothing(spark, source, whole):
    root, first = whole
    second = run_load(spark, source, root, "r2")
    assert finished_runs(spark, root) == ["r1", "r2"]
    assert loaded_marks(spark, root, ["r1", "r2"]).count() == source["student_marks"].count()
    for table in first:
        assert same(first[table], second[table]), table
    with pytest.raises(ValueError):
        run_load(spark, source, root, "r2")


def test_log_rows(spark, whole):
    log = read_log(spark, whole[0]).filter("run_id = 'r1'").collect()
    assert {r.school_id for r in log} == {1, 7} and all(r.status == "SUCCESS" and r.rows_raw > 0 for r in log)
    assert quality.run_report(read_log(spark, whole[0])).first().duration_sec >= 0


def test_two_part_load_with_replace_equals_one_load(spark, source, whole, tmp_path):
    half = Changed(source, student_marks=source["student_marks"].filter(F.col("exam_id") != 2))
    run_load(spark, half, str(tmp_path), "a", on_existing="replace")
    done = run_load(spark, source, str(tmp_path), "b", on_existing="replace")
    for table in ("fact_academics", "fact_student_subject_performance", "fact_science_components", "student_master_profile"):
        assert same(done[table], whole[1][table]), table


def files_of(root, run):
    return sorted(str(p.relative_to(root)) for p in Path(root).glob(f"data/*/load_run={run}/**/*.parquet"))


def test_a_small_batch_writes_only_what_it_touches(spark, source, whole, tmp_path):
    """New marks of one school-year and new teachers of one school."""
    marks, teachers = source["student_marks"], source["teacher"]
    late = (F.col("school_id") == 7) & (F.col("academic_yr") == "2024-2025") & (F.col("exam_id") == 2)
    half = Changed(source, student_marks=marks.where(~late), teacher=teachers.where("NOT (school_id = 1 AND teacher_id % 2 = 0)"))
    run_load(spark, half, str(tmp_path), "a", on_existing="replace")
    first = Manifest.read(spark, str(tmp_path), "a")
    done = run_load(spark, source, str(tmp_path), "b", on_existing="replace")
    with_marks = {RAW, "student_marks_components", "marks_held", "exam_totals", "fact_academics", "fact_science_components", "fact_student_subject_performance", "student_master_profile", "student_behavior_signals"}
    folders = {f.rsplit("/", 1)[0] for f in files_of(tmp_path, "b")}
    assert folders == {f"data/{t}/load_run=b/school_id=7/academic_yr=2024-2025" for t in with_marks} | {"data/dim_teachers/load_run=b/school_id=1"}
    assert len(files_of(tmp_path, "b")) <= 2 * len(folders) < len(files_of(tmp_path, "a")) / 3
    # Readers follow the manifest, and the state is that of one whole load.
    for table in done:
        assert same(done[table], whole[1][table]), table
    assert loaded_marks(spark, str(tmp_path), ["a", "b"]).count() == marks.count() and loaded_marks(spark, str(tmp_path), ["a"]).where(late).isEmpty()
    # Earlier states stay readable until retention drops what the kept runs do not name.
    assert same(Warehouse(spark, str(tmp_path), "a")["fact_academics"], first.table("fact_academics", done.schemas["fact_academics"]))
    assert drop_unnamed(spark, str(tmp_path), ["a", "b"], keep=2) == 0
    assert drop_unnamed(spark, str(tmp_path), ["a", "b"], keep=1) == len(with_marks)  # the other tables and the teachers; raw marks stay
    for table in with_marks - {RAW}:
        assert same(done[table], whole[1][table]), table


def test_readers_list_only_named_folders(spark, source, whole):
    warehouse = last_load(spark, whole[0])
    plan = warehouse.part("fact_attendance", {(1, "2020-2021")})
    assert all("school_id=1/academic_yr=2020-2021" in f for f in plan.inputFiles()) and plan.inputFiles()


def test_checksums_see_every_change(spark):
    rows = [(1, "a", 1), (1, "a", 1), (1, None, 2), (2, "b", None), (None, "", 3)]
    sums = lambda r: checksums(spark.createDataFrame(r, "k int, t string, v int"), ["k"])
    gone = lambda r: {x.k for x in differing(sums(rows), sums(r), ["k"]).collect()}
    assert gone(rows[::-1]) == set()
    assert gone(rows[1:]) == {1} and gone(rows + [(1, "a", 1)]) == {1} and gone([*rows[:2], (1, "", 2), *rows[3:]]) == {1}
    assert gone([*rows[:4], (None, None, 3)]) == {None} and gone(rows[:4]) == {None} and gone([*rows, (3, "c", 1)]) == {3}


@pytest.mark.parametrize("buckets", [1, 64])
def test_differing_rows_equal_a_full_comparison(spark, buckets):
    rnd = random.Random(buckets)
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["a", None]), rnd.randint(1, 40), rnd.choice([None, "x", "y", ""])) for _ in range(400)]
    other = [r if rnd.random() > 0.05 else (*r[:3], "z") for r in rows[7:]] + rows[20:23]
    make = lambda r: spark.createDataFrame(r, "s int, y string, k int, v string")
    got = Counter((r.s, r.y, r.k, r.side) for r in differing_rows(make(rows), make(other), ["s", "y"], ["k"], buckets).collect() for _ in range(r.copies))
    left, right = Counter(rows), Counter(other)
    want = Counter((*r[:3], "left") for r in (left - right).elements()) + Counter((*r[:3], "right") for r in (right - left).elements())
    assert got == want and differing_rows(make(rows), make(rows[::-1]), ["s", "y"], ["k"], buckets).isEmpty()


def test_new_years_are_loaded_and_logged(spark, source, tmp_path):
    run_load(spark, source, str(tmp_path), "a")
    late = F.when(F.col("academic_yr") == "2025-2026", "2026-2027").otherwise(F.col("academic_yr"))
    tables = {t: source[t].withColumn("academic_yr", late) for t in ("student", "attendance_clean", "class", "subject", "exam", "homework", "achievements_clean")}
    done = run_load(spark, Changed(source, **tables), str(tmp_path), "b", only_new_years=True)
    expected = tables["student"].filter("academic_yr = '2026-2027' AND is_delete = 'N'").count()
    assert expected and done["student_clean"].filter("academic_yr = '2026-2027'").count() == expected
    assert done["fact_attendance"].filter("academic_yr = '2026-2027'").count() > 0
    notes = {r.notes for r in read_log(spark, str(tmp_path)).filter("run_id = 'b'").collect()}
    assert notes == {"New years only. Years processed: 2026-2027"}


def test_duplicate_keys_fail_a_run(spark, source, tmp_path):
    twice = Changed(source, teacher=source["teacher"].unionByName(source["teacher"]))
    with pytest.raises(ValueError, match="dim_teachers"):
        run_load(spark, twice, str(tmp_path), "a")
    assert finished_runs(spark, str(tmp_path)) == []


def test_keep_leaves_old_facts(spark, source, tmp_path):
    half = Changed(source, student_marks=source["student_marks"].filter(F.col("exam_id") == 1))
    first = run_load(spark, half, str(tmp_path), "a")
    second = run_load(spark, source, str(tmp_path), "b")
    key = ["school_id", "student_id", "academic_yr"]
    old = second["fact_academics"].join(first["fact_academics"].select(key), key, "left_semi")
    assert same(old, first["fact_academics"])
    assert second["fact_academics"].count() > first["fact_academics"].count()


def test_failed_run_keeps_the_last_tables(spark, source, tmp_path):
    run_load(spark, source, str(tmp_path), "good")
    broken = Changed(source, teacher=source["teacher"].drop("designation"), student_marks=source["student_marks"].where("exam_id <> 2"))
    with pytest.raises(Exception):
        run_load(spark, broken, str(tmp_path), "bad")
    assert last_load(spark, str(tmp_path)).run_id == "good"
    # What the failed run left is in no manifest, and retention drops it.
    good = len(files_of(tmp_path, "good"))
    assert files_of(tmp_path, "bad") and drop_unnamed(spark, str(tmp_path), ["good"]) > 0
    assert not files_of(tmp_path, "bad") and len(files_of(tmp_path, "good")) == good
    assert {r.status for r in read_log(spark, str(tmp_path)).collect()} == {"SUCCESS", "ERROR"}


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_table_folder_formats(spark, source, tmp_path, fmt):
    marks = source["student_marks"].filter("school_id = 1")
    options = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    marks.write.format(fmt).options(**options).save(f"{tmp_path}/student_marks")
    assert same(TableFolder(spark, str(tmp_path), fmt, **options)["student_marks"], marks)


def test_partitioned_write_and_bound_query(spark, source, tmp_path):
    write_table(source["student"], f"{tmp_path}/student")
    df = read_query(
        spark, "SELECT count(*) AS n FROM {s} WHERE academic_yr = :y AND school_id = 1", {"y": "2020-2021"},
        s=spark.read.parquet(f"{tmp_path}/student"),
    )
    assert df.first().n == source["student"].filter("academic_yr = '2020-2021' AND school_id = 1").count()
    assert "PartitionFilters: [isnotnull(academic_yr" in df._jdf.queryExecution().executedPlan().toString()


def test_marks_feed_takes_each_mark_once(spark, source, tmp_path):
    marks = source["student_marks"]
    files, target, progress = (f"{tmp_path}/{x}" for x in ("files", "target", "progress"))
    marks.filter("marks_id % 2 = 0").write.mode("append").parquet(files)
    take_in(spark, files, target, progress)
    marks.write.mode("append").parquet(files)
    take_in(spark, files, target, progress)
    take_in(spark, files, target, progress)
    assert same(stored_marks(spark, target), marks)
