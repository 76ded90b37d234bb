"""Averages by signed deltas equal averages over all marks."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.functions.columns import KEY
from chalkline.operators import deltas, marks

SCHEMA = "school_id int, marks_id bigint, exam_id int, subject_id string, student_id bigint, present string, mark_obtained string, highest_marks string, publish string, academic_yr string"


def row(marks_id, student, subject, exam, cells, publish="Y"):
    """cells: heading -> (present, mark, maximum)."""
    text = ["{" + ", ".join(f'"{h}": "{c[i]}"' for h, c in cells.items()) + "}" for i in range(3)]
    return (1, marks_id, exam, str(subject), student, *text, publish, "2020-2021")


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for marks_id in rnd.sample(range(1000), 120):
        cells = {rnd.randint(1, 9): (rnd.choice("YYYN"), rnd.choice(["7", "12.5", "AB", "0", "50"]), rnd.choice(["50", "20", "0", "x"])) for _ in range(rnd.randint(0, 3))}
        rows.append(row(marks_id, rnd.randint(1, 4), rnd.randint(1, 3), rnd.randint(1, 2), cells, rnd.choice("YYYN")))
    return rows


def whole(df):
    return sorted(map(tuple, marks.ratio_of_sums(marks.exam_sums(marks.heading_rows(marks.latest_marks(df))), KEY).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_in_any_order(spark, seed):
    rows, rnd = made(seed), random.Random(seed)
    rnd.shuffle(rows)
    held = totals = None
    seen = []
    for batch in (rows[:60], rows[60:61], rows[61:], rows[:5]):
        seen += batch
        df = spark.createDataFrame(batch, SCHEMA)
        moved = spark.createDataFrame(deltas.revision_deltas(df, held).collect(), deltas.revision_deltas(df, held).schema)
        held = spark.createDataFrame(deltas.held_after(held, moved).collect(), deltas.held_after(held, moved).schema)
        totals = spark.createDataFrame(deltas.totals_after(totals, moved).collect(), deltas.totals_after(totals, moved).schema)
        everything = spark.createDataFrame(seen, SCHEMA)
        assert sorted(map(tuple, deltas.academics_from_totals(totals).collect())) == whole(everything)
        assert sorted(map(str, deltas.counted_sums(held).collect())) == sorted(map(str, marks.exam_sums(marks.heading_rows(marks.latest_marks(everything))).collect()))


def test_superseded_unpublished_and_repeated(spark):
    good = {1: ("Y", "40", "50")}
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    held = deltas.held_revisions(df(row(10, 1, 1, 1, good)))
    first = deltas.totals_after(None, deltas.revision_deltas(df(row(10, 1, 1, 1, good)), None))
    assert deltas.revision_deltas(df(row(10, 1, 1, 1, good), row(9, 1, 1, 1, {1: ("Y", "1", "50")})), held).isEmpty()
    # The successor is unpublished: the old revision goes, and with it the student's row.
    gone = deltas.totals_after(first, deltas.revision_deltas(df(row(11, 1, 1, 1, good, "N")), held))
    assert deltas.academics_from_totals(gone).isEmpty() and gone.first().m == 0
    better = deltas.academics_from_totals(deltas.totals_after(first, deltas.revision_deltas(df(row(12, 1, 1, 1, {1: ("Y", "50", "50")})), held))).first()
    assert float(better.avg_percent) == 100.0 and better.exams_taken == 1


def test_only_keys_of_the_batch_are_read(spark, tmp_path):
    """Held revisions lie in school-year folders; a batch of one school-year opens one of them."""
    from chalkline.plans.manifest import Manifest, written_partitions
    from chalkline.sources.readers import write_table

    rows = [row(i, i % 50, i % 5, i % 2, {1: ("Y", "40", "50")}) for i in range(500)]
    held = deltas.held_revisions(spark.createDataFrame(rows, SCHEMA))
    years = held.withColumn("academic_yr", F.concat((F.col("student_id") % 7 + 2019).cast("string"), F.lit("-x")))
    path = f"{tmp_path}/data/marks_held/load_run=a"
    write_table(years, path)
    stored = Manifest(spark, str(tmp_path), written_partitions(spark.read.schema(years.schema).parquet(path), "marks_held", "a"))
    part = stored.table("marks_held", years.schema, {(1, "2020-x")})
    moved = deltas.revision_deltas(spark.createDataFrame([(*rows[0][:-1], "2020-x")], SCHEMA), part)
    files = {f.rsplit("/", 2)[1] for f in part.inputFiles()}
    assert files == {"academic_yr=2020-x"} and moved.count() == 1
    assert len(stored.of("marks_held")) == 7


def test_held_revisions_are_ranked_once_and_not_joined(spark):
    """A revision that is unpublished, has no present heading or lacks a part of its key is held with no sums."""
    schema = ("school_id int, student_id bigint, subject_id string, exam_id int, academic_yr string, marks_id bigint, publish string, "
              "present string, mark_obtained string, highest_marks string")
    one, twenty = '{"1":"7","2":"5"}', '{"1":"20","2":"20"}'
    rows = [
        (1, 1, "5", 1, "2023-2024", 1, "Y", '{"1":"Y","2":"Y"}', one, twenty),
        (1, 1, "5", 1, "2023-2024", 2, "Y", '{"1":"Y","2":"N"}', one, twenty),
        (1, 2, "5", 1, "2023-2024", 3, "N", '{"1":"Y"}', one, twenty),
        (1, 3, "5", 1, "2023-2024", 4, "Y", '{"1":"N"}', one, twenty),
        (1, 4, "5", 1, "2023-2024", 5, "Y", '{"1":"Y"}', None, twenty),
        (1, 5, None, 1, "2023-2024", 6, "Y", '{"1":"Y"}', one, twenty),
        (1, 6, "5", 1, "2023-2024", 7, None, '{"1":"Y"}', one, twenty),
        (1, 7, "5", 1, "2023-2024", None, "Y", '{"1":"Y"}', '{"1":"x"}', twenty),
    ]
    held = deltas.held_revisions(spark.createDataFrame(rows, schema))
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len([x for x in plan.split("\n") if "Window [" in x]) == 1
    got = {r.student_id: (r.marks_id, r.m, r.top, r.written_m, r.counted) for r in held.collect()}
    none = {k: (n, None, None, None, 0) for k, n in ((2, 3), (3, 4), (4, 5), (5, 6), (6, 7))}
    assert {k: v for k, v in got.items() if k in none} == none and len(got) == 7
    assert got[1][:3] == (2, 700, 2000) and got[1][4] == 1 and got[7][:3] == (None, None, 2000) and got[7][4] == 1
