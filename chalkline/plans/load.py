"""One load of all active schools into a warehouse folder.

A run writes only the school-years that its sources' changes touch, under its own name, and a manifest of all
partitions of the new state (see `manifest`); everything else stays where earlier runs wrote it. Only runs that the log
calls successful are read, so a run that dies leaves the old tables whole and can be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import KEY
from chalkline.operators import deltas, quality
from chalkline.operators.marks import REVISION_KEY
from chalkline.operators.writes import duplicate_keys
from chalkline.plans.manifest import RAW, SOURCE_STATE, YEARLESS, Manifest, touched_partitions, write_source_state, written_partitions
from chalkline.plans.star import Star
from chalkline.schemas import INPUT_TABLES
from chalkline.sources.readers import write_table

# Written in this order; each later table is built from the written earlier ones.
STAGES = [
    "student_marks_components", "exam_totals", "marks_held", "student_clean", "dim_student_demographics", "dim_teachers", "dim_users", "dim_parent",
    "fact_attendance", "dim_subject", "dim_class_subject_map", "dim_class", "dim_section",
    "fact_academics", "fact_science_components", "fact_student_subject_performance", "fact_achievements",
    "fact_homework_engagement", "student_master_profile", "student_behavior_signals",
]
LOG = "run_log"
# Unique keys of the written tables; a run with a repeated key does not count as successful.
YEAR_KEY = ("school_id", "student_id", "academic_yr")
UNIQUE = {
    "marks_held": tuple(REVISION_KEY), "exam_totals": tuple(deltas.TOTAL_KEY),
    "student_clean": YEAR_KEY, "dim_student_demographics": YEAR_KEY, "dim_teachers": ("school_id", "teacher_id"),
    "dim_parent": ("school_id", "parent_id"), "dim_subject": ("school_id", "subject_id"),
    "dim_class_subject_map": ("school_id", "class_name", "subject_id", "academic_yr"),
    "dim_class": ("school_id", "class_id"), "dim_section": ("school_id", "section_id"),
    "fact_attendance": YEAR_KEY, "fact_academics": YEAR_KEY, "fact_science_components": (*YEAR_KEY, "component"),
    "fact_student_subject_performance": (*YEAR_KEY, "subject_id"), "fact_achievements": YEAR_KEY,
    "fact_homework_engagement": YEAR_KEY, "student_master_profile": YEAR_KEY, "student_behavior_signals": YEAR_KEY,
}
RAW_SCHEMA = INPUT_TABLES["student_marks"]


class Warehouse(Mapping[str, DataFrame]):
    """The tables as one finished run left them, read from the partitions that its manifest names."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    @cached_property
    def schemas(self) -> dict[str, T.StructType]:
        """A table without rows has no file to take a schema from."""
        rows = self.spark.read.parquet(f"{self.root}/_runs/{self.run_id}/schemas").collect()
        return {r.table: T.StructType.fromJson(json.loads(r.schema)) for r in rows}

    @cached_property
    def manifest(self) -> Manifest:
        return Manifest.read(self.spark, self.root, self.run_id)

    def part(self, table: str, pairs: set | None = None, schools: set | None = None) -> DataFrame:
        """Rows of some (school, year) pairs or schools; no other folder is listed or read."""
        return self.manifest.table(table, self.schemas[table], pairs, schools)

    @property
    def source_state(self) -> DataFrame:
        return self.spark.read.schema(SOURCE_STATE).parquet(f"{self.root}/_runs/{self.run_id}/sources")

    def __getitem__(self, table: str) -> DataFrame:
        if table not in STAGES:
            raise KeyError(table)
        return self.part(table)

    def __iter__(self):
        return iter(STAGES)

    def __len__(self) -> int:
        return len(STAGES)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(quality.RUN_LOG).parquet(f"{root.rstrip('/')}/{LOG}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], quality.RUN_LOG)


def finished_runs(spark: SparkSession, root: str) -> list[str]:
    """Ids of successful runs, oldest first; one id per run ever made, a short list."""
    rows = read_log(spark, root).filter("status = 'SUCCESS'").groupBy("run_id").agg(F.min("run_start").alias("s")).orderBy("s")
    return [r.run_id for r in rows.collect()]


def last_load(spark: SparkSession, root: str) -> Warehouse | None:
    runs = finished_runs(spark, root)
    return Warehouse(spark, root, runs[-1]) if runs else None


def loaded_marks(spark: SparkSession, root: str, runs: list[str]) -> DataFrame | None:
    """Raw marks that the given finished runs took in; leftovers of a failed run are in no manifest."""
    if not runs:
        return None
    whole = Manifest.read(spark, root, runs[-1])
    return Manifest(spark, root, [e for e in whole.entries if e[3] in set(runs)]).table(RAW, RAW_SCHEMA)


class _Scoped(Mapping[str, DataFrame]):
    """A source cut to the schools and school-years that a load touches; class names are needed of all years."""

    def __init__(self, source: Mapping[str, DataFrame], pairs: DataFrame, schools: DataFrame):
        self.source, self.pairs, self.schools = source, pairs, schools

    def __getitem__(self, table: str) -> DataFrame:
        rows = self.source[table]
        if table == "school":
            return rows
        if "academic_yr" in rows.columns and table != "class":
            return rows.join(self.pairs, ["school_id", "academic_yr"], "left_semi")
        return rows.join(self.schools, "school_id", "left_semi")

    def __iter__(self):
        return iter(self.source)

    def __len__(self) -> int:
        return len(self.source)


class _Written(Star):
    """A star whose written tables are read back instead of being computed again.

    Marks come as the batch of this run: averages follow from the held revisions and totals by signed deltas, so the
    history of marks is neither ranked nor summed again.
    """

    @cached_property
    def mark_deltas(self) -> DataFrame:
        return deltas.revision_deltas(self.marks_fresh, self.loaded.get("marks_held"))

    @cached_property
    def marks_held(self) -> DataFrame:
        return deltas.held_after(self.loaded.get("marks_held"), self.mark_deltas)

    @cached_property
    def exam_totals(self) -> DataFrame:
        return deltas.totals_after(self.loaded.get("exam_totals"), self.mark_deltas)

    @cached_property
    def exam_sums(self) -> DataFrame:
        return deltas.counted_sums(self.marks_held)

    @cached_property
    def fact_academics(self) -> DataFrame:
        return self._after_load("fact_academics", self.in_years(deltas.academics_from_totals(self.exam_totals)), KEY)

    def use(self, table: str, df: DataFrame) -> None:
        self.__dict__[table] = df
        if table == "student_marks_components":
            self.__dict__["heading_rows"] = df
        if table == "fact_achievements":
            self.__dict__["fact_achievements_by_year"] = df.filter(F.col("academic_yr") != "ALL")


def run_load(
    spark: SparkSession, source: Mapping[str, DataFrame], root: str, run_id: str, on_existing: str = "keep",
    attendance_mode: str = "present", only_new_years: bool = False,
    first_year: str | None = fv.FIRST_YEAR, last_year: str | None = fv.LAST_YEAR,
) -> Warehouse:
    root = root.rstrip("/")
    runs = finished_runs(spark, root)
    if run_id in runs:
        raise ValueError(f"run {run_id} has finished before")
    started = spark.range(1).select(F.current_timestamp().alias("t")).first().t
    options = dict(on_existing=on_existing, attendance_mode=attendance_mode, only_new_years=only_new_years, first_year=first_year, last_year=last_year)
    try:
        load = _Load(spark, source, root, run_id, Warehouse(spark, root, runs[-1]) if runs else None, options)
        counts = load.run()
    except Exception as error:
        _log(spark, source, root, run_id, started, "ERROR", str(error), None)
        raise
    _log(spark, source, root, run_id, started, "SUCCESS", None, counts)
    return Warehouse(spark, root, run_id)


class _Load:
    """One run: what the sources changed, the tables of these school-years, the next manifest."""

    def __init__(self, spark: SparkSession, source: Mapping[str, DataFrame], root: str, run_id: str, before: Warehouse | None, options: dict):
        self.spark, self.root, self.run_id, self.before = spark, root, run_id, before
        self.folder = f"{root}/_runs/{run_id}"
        self.touched = self._compare(source, options)
        self.pairs = {(s, y) for _, s, y in self.touched if y is not None}
        self.schools = {s for _, s, _ in self.touched}
        if before is not None:
            # As long as there are touched school-years.
            at = spark.createDataFrame(sorted(self.pairs), "school_id int, academic_yr string")
            source = _Scoped(source, at, spark.createDataFrame([(s,) for s in sorted(self.schools)], "school_id int"))
        self.manifest = before.manifest if before else Manifest(spark, root)
        self.schemas = dict(before.schemas) if before else {}
        self.star = _Written(source, {t: self._stored(t, before=True) for t in STAGES if before and t != "student_marks_components"}, **options)

    def _compare(self, source: Mapping[str, DataFrame], options: dict) -> set[tuple]:
        """The partitions to write. A change of the options touches everything."""
        active = source["school"].filter("is_active").select("school_id")

        class Active(dict):
            def __missing__(self, table):
                return source[table].join(active, "school_id", "left_semi")

        write_source_state(Active(), f"{self.folder}/sources")
        chosen = active.select("school_id", F.lit(None).cast("string").alias("academic_yr"), F.lit(1).cast("bigint").alias("n"), F.xxhash64(F.lit(str(sorted(options.items())))).alias("mix"), F.lit(0).cast("bigint").alias("total"))
        chosen.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sources/source_table=options")
        now = self.spark.read.schema(SOURCE_STATE).parquet(f"{self.folder}/sources")
        then = self.before.source_state if self.before else self.spark.createDataFrame([], SOURCE_STATE)
        return {tuple(r) for r in touched_partitions(then, now).collect()}

    def _stored(self, table: str, before: bool = False) -> DataFrame:
        """What is stored of a table for the touched schools and years.

        Lifetime achievements and the newest loaded year need all years of a school.
        """
        manifest, schemas = (self.before.manifest, self.before.schemas) if before else (self.manifest, self.schemas)
        whole = table in YEARLESS or before and (table == "fact_achievements" or table == "student_master_profile")
        return manifest.table(table, schemas[table], None if whole else self.pairs, self.schools)

    def _take_in_marks(self) -> None:
        """Store marks whose id the school does not hold yet, and show the star all marks of the touched school-years."""
        touched = {t for t in self.touched if t[0] == RAW}
        path = f"{self.root}/data/{RAW}/load_run={self.run_id}"
        if touched:
            fresh = self.star.of_schools("student_marks")
            if self.before:
                held = self.manifest.table(RAW, RAW_SCHEMA, schools={s for _, s, _ in touched}).select("school_id", "marks_id")
                fresh = fresh.join(held, ["school_id", "marks_id"], "left_anti")
            write_table(fresh, path)
            written = self.spark.read.schema(RAW_SCHEMA).parquet(path)
            self.manifest = self.manifest.replaced(touched, written_partitions(written, RAW, self.run_id))
            self.star.__dict__["marks_fresh"] = written
        self.star.__dict__["marks_raw"] = self.manifest.table(RAW, RAW_SCHEMA, self.pairs)

    def _write(self, table: str) -> None:
        """Write the touched partitions of a table and let the star read them from there."""
        touched = {t for t in self.touched if t[0] == table}
        if touched:
            df = getattr(self.star, table)
            keys = ["school_id"] if table in YEARLESS else ["school_id", "academic_yr"]
            if self.before:
                at = self.spark.createDataFrame(sorted(t[1:] for t in touched), "school_id int, academic_yr string")
                df = df.join(at.select(*keys), keys, "left_semi").select(*df.columns)
            path = f"{self.root}/data/{table}/load_run={self.run_id}"
            write_table(df, path)
            self.schemas[table] = df.schema
            written = self.spark.read.schema(df.schema).parquet(path)
            if table in UNIQUE and not duplicate_keys(written, UNIQUE[table]).isEmpty():
                raise ValueError(f"{table} holds a key twice: {', '.join(UNIQUE[table])}")
            self.manifest = self.manifest.replaced(touched, written_partitions(written, table, self.run_id))
        self.star.use(table, self._stored(table))

    def run(self) -> DataFrame:
        self._take_in_marks()
        for table in STAGES:
            self._write(table)
        self.manifest.write(self.run_id)
        rows = [(t, s.json()) for t, s in self.schemas.items()]
        self.spark.createDataFrame(rows, "table string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/schemas")
        # Rows are counted by the manifest; no table is read again.
        held = self.manifest.frame().groupBy("school_id")
        of = lambda name: F.sum(F.when(F.col("table_name") == name, F.col("n_rows")).otherwise(0))
        counts = held.agg(of(RAW).alias("rows_raw"), of("student_marks_components").alias("rows_components"), of("fact_student_subject_performance").alias("rows_facts"))
        return counts.join(quality.years_note(self.star.years, self.star.first_year, self.star.last_year), "school_id", "full")


def _log(spark, source, root, run_id, started, status, error, counts) -> None:
    """One log row per active school."""
    schools = source["school"].filter("is_active").select("school_id", F.col("name").alias("school_name"))
    names = ["rows_raw", "rows_components", "rows_facts", "new_years", "notes"]
    if counts is None:
        rows = schools.select("*", *[F.lit(None).alias(n) for n in names])
    else:
        rows = schools.join(counts, "school_id", "left")
    rows = rows.select(
        F.lit(run_id).alias("run_id"), "school_id", "school_name", F.lit(started).alias("run_start"),
        F.current_timestamp().alias("run_end"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error_msg"),
        *[F.col(n).cast("string" if n == "notes" else "bigint").alias(n) for n in names],
    )
    rows.coalesce(1).write.mode("append").parquet(f"{root}/{LOG}")
