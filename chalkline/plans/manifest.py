"""Which run holds which school and year of which table.

Tables are kept as ``<root>/data/<table>/load_run=<run>/school_id=…/academic_yr=…``. A load compares the checksums of
its sources, per school and year, with those of the last run, follows the changes to the tables that depend on them, and
writes just these partitions under its own run. Its manifest is the last one with these entries replaced, so every
finished run has a whole, unchanging list of its partitions; readers open the folders it names and no others.

Raw marks are only ever added to: their entries stay and new ones join them.
A manifest is as long as there are tables, schools and years; it is read by the driver, rows of tables never are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions import fixed_values as fv
from chalkline.operators.reconcile import SUMS, checksums, differing
from chalkline.schemas import PARTITION_COLUMNS

RAW = "student_marks_raw"
MANIFEST = "table_name string, school_id int, academic_yr string, load_run string, n_rows bigint"
SOURCE_STATE = "source_table string, school_id int, academic_yr string, n bigint, mix bigint, total bigint"

_STUDENT_MARKS = ("student_marks", "student_years")
_CLASS_MARKS = (*_STUDENT_MARKS, "student", "class", "subject")
_FACTS = ("student", *_STUDENT_MARKS, "attendance_clean", "achievements_clean", "homework", "homework_comments")
#: Sources of each stored table. ``student_years`` stands for the schools' list of years alone.
DEPENDS: dict[str, tuple[str, ...]] = {
    RAW: ("student_marks",),
    "student_marks_components": ("student_marks", "marks_headings"),
    "exam_totals": ("student_marks",), "marks_held": ("student_marks",),
    "student_clean": ("student",), "dim_student_demographics": ("student",),
    "dim_teachers": ("teacher",), "dim_users": ("user_master",), "dim_parent": ("parent",),
    "fact_attendance": ("attendance_clean", "student_years"),
    "dim_subject": ("subject_master",),
    "dim_class_subject_map": ("subject", "class", "subject_master", "student_years"),
    "dim_class": ("class", "student"), "dim_section": ("section", "student"),
    "fact_academics": _STUDENT_MARKS, "fact_science_components": _CLASS_MARKS, "fact_student_subject_performance": _CLASS_MARKS,
    "fact_achievements": ("achievements_clean", "student_years"),
    "fact_homework_engagement": ("homework", "homework_comments", "student_years"),
    "student_master_profile": _FACTS, "student_behavior_signals": _FACTS,
}
#: Stored tables without a year.
YEARLESS = ("dim_teachers", "dim_users", "dim_parent", "dim_subject", "dim_class", "dim_section")
#: Sources that a load reads; `options` stands for the parameters of the load.
SOURCES = sorted({s for names in DEPENDS.values() for s in names} - {"student_years"})


def _with_year(source: Mapping[str, DataFrame], table: str) -> DataFrame:
    """Comments have no year of their own; they belong to the year of their homework."""
    rows = source[table]
    if table != "homework_comments":
        return rows
    year = source["homework"].select("school_id", "homework_id", "academic_yr").distinct()
    return rows.join(year, ["school_id", "homework_id"], "left")


def _state(source: Mapping[str, DataFrame], table: str) -> DataFrame:
    rows = _with_year(source, table)
    year = F.col("academic_yr") if "academic_yr" in rows.columns else F.lit(None).cast("string")
    return checksums(rows, ["school_id", year.alias("__year")]).select(F.lit(table).alias("source_table"), "school_id", F.col("__year").alias("academic_yr"), *SUMS)


def source_state(source: Mapping[str, DataFrame], tables: Iterable[str] = SOURCES) -> DataFrame:
    """Checksums of every source per school and year, one aggregate a table."""
    return reduce(DataFrame.unionByName, [_state(source, t) for t in tables])


def write_source_state(source: Mapping[str, DataFrame], folder: str, tables: Iterable[str] = SOURCES) -> None:
    """The same as a table below ``folder``, a folder a source. The aggregates are independent, so several run at once."""

    def write(table: str) -> None:
        _state(source, table).drop("source_table").coalesce(1).write.mode("overwrite").parquet(f"{folder}/source_table={table}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, tables))


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_table, school_id, academic_yr) of the partitions that differ; a year that a school gains or loses also counts as ``student_years``."""
    moved = differing(before, after, ["source_table", "school_id", "academic_yr"])
    years = moved.where((F.col("source_table") == "student") & (F.col("n_left").isNull() | F.col("n_right").isNull()))
    return moved.select("source_table", "school_id", "academic_yr").unionByName(
        years.select(F.lit("student_years").alias("source_table"), "school_id", "academic_yr"))


def touched_partitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, school_id, academic_yr) that a load from state ``before`` to ``after`` has to write.

    A source without years touches all years of its school; a table without years is touched by any year.
    """
    moved = changed_sources(before, after)
    # Both states are as long as there are sources, schools and years.
    years = before.unionByName(after).where("academic_yr IS NOT NULL").select("school_id", F.col("academic_yr").alias("every")).distinct()
    pairs = [(t, s) for t, sources in DEPENDS.items() for s in (*sources, "options")]
    rules = moved.sparkSession.createDataFrame(pairs, "table_name string, source_table string")
    hit = moved.join(F.broadcast(rules), "source_table").select("table_name", "school_id", "academic_yr").distinct()
    yearless = F.col("table_name").isin(*YEARLESS)
    plain = hit.where(yearless).select("table_name", "school_id", F.lit(None).cast("string").alias("academic_yr")).distinct()
    dated = hit.where(~yearless & F.col("academic_yr").isNotNull())
    whole = hit.where(~yearless & F.col("academic_yr").isNull()).join(years, "school_id").select("table_name", "school_id", F.col("every").alias("academic_yr"))
    dated = dated.unionByName(whole).distinct()
    lifetime = dated.where("table_name = 'fact_achievements'").select("table_name", "school_id", F.lit(fv.LIFETIME).alias("academic_yr")).distinct()
    return plain.unionByName(dated).unionByName(lifetime)


def _escaped(value: object) -> str:
    """A partition value as part of a folder name, in the way Spark writes it."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", str(value))


class Manifest:
    """The partitions of one state of the warehouse."""

    def __init__(self, spark: SparkSession, root: str, entries: Iterable[tuple] = ()):
        self.spark, self.root, self.entries = spark, root.rstrip("/"), list(entries)

    @classmethod
    def read(cls, spark: SparkSession, root: str, run: str) -> Manifest:
        rows = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/_runs/{run}/manifest")
        return cls(spark, root, [tuple(r) for r in rows.collect()])

    def write(self, run: str) -> None:
        rows = self.spark.createDataFrame(self.entries, MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_runs/{run}/manifest")

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.entries, MANIFEST)

    def of(self, table: str, pairs: set | None = None, schools: set | None = None) -> list[tuple]:
        """Entries of a table that hold rows, of the given (school, year) pairs or schools alone."""
        mine = (e for e in self.entries if e[0] == table and e[4])
        return [e for e in mine if (pairs is None or (e[1], e[2]) in pairs) and (schools is None or e[1] in schools)]

    def folders(self, entries: Iterable[tuple], keys: list[str]) -> list[str]:
        at = {"school_id": 1, "academic_yr": 2}
        return [
            "/".join([f"{self.root}/data/{e[0]}/load_run={_escaped(e[3])}", *(f"{k}={_escaped(e[at[k]])}" for k in keys)]) for e in entries
        ]

    def table(self, table: str, schema, pairs: set | None = None, schools: set | None = None) -> DataFrame:
        """Rows of a table, read from the folders that the manifest names."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        keys = [c for c in PARTITION_COLUMNS if c in schema.fieldNames()]
        paths = self.folders(self.of(table, pairs, schools), keys)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{table}").parquet(*paths)
        return rows.select(*schema.fieldNames())

    def replaced(self, touched: Iterable[tuple], written: Iterable[tuple]) -> Manifest:
        """The next manifest: touched partitions give way to what was written for them; raw marks are added."""
        gone = {t for t in touched if t[0] != RAW}
        return Manifest(self.spark, self.root, [e for e in self.entries if e[:3] not in gone] + list(written))


def written_partitions(written: DataFrame, table: str, run: str) -> list[tuple]:
    """Manifest entries of a written table; only file footers and folder names are read."""
    keys = [c for c in PARTITION_COLUMNS if c in written.columns]
    rows = written.groupBy(*keys).count().collect()
    return [(table, r["school_id"], r["academic_yr"] if "academic_yr" in keys else None, run, r["count"]) for r in rows]


def drop_unnamed(spark: SparkSession, root: str, runs: list[str], keep: int = 1) -> int:
    """Delete partition folders that none of the last ``keep`` finished runs names (also those of failed runs); gives their number."""
    root = root.rstrip("/")
    named = set()
    for run in runs[-keep:]:
        m = Manifest.read(spark, root, run)
        for e in m.entries:
            named.update(m.folders([e], ["school_id"] if e[2] is None else list(PARTITION_COLUMNS)))
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    plain = lambda p: re.sub(r"^[a-z0-9]+:/+", "/", p)
    named, dropped = {plain(p) for p in named}, 0
    for depth in ("school_id=*", "school_id=*/academic_yr=*"):
        for status in fs.globStatus(jvm.Path(f"{root}/data/*/load_run=*/{depth}")) or []:
            path = status.getPath()
            inner = fs.globStatus(jvm.Path(path, "academic_yr=*")) if depth == "school_id=*" else None
            if not inner and plain(path.toString()) not in named:
                fs.delete(path, True)
                dropped += 1
    return dropped
