"""The star schema as lazy frames over the operational tables.

Each property is one table.  Nothing runs until a table is written or read; Spark sees one plan
from the source scan to the asked table and prunes what is not needed.  ``loaded`` holds tables
of an earlier load; without it every table is built from scratch.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import DEALT, KEY
from chalkline.operators import careers, class_view, dims, facts, marks, profile, student_view
from chalkline.operators.writes import upsert, write_rows
from chalkline.session import shared_folder
from chalkline.sources.readers import write_bucketed


class Star:
    def __init__(
        self,
        source: Mapping[str, DataFrame],
        loaded: Mapping[str, DataFrame] | None = None,
        on_existing: str = "keep",
        attendance_mode: str = "present",
        need_active: bool = False,
        all_schools: bool = False,
        only_new_years: bool = False,
        first_year: str | None = fv.FIRST_YEAR,
        last_year: str | None = fv.LAST_YEAR,
    ):
        self.source, self.loaded = source, loaded or {}
        self.on_existing, self.attendance_mode, self.need_active = on_existing, attendance_mode, need_active
        self.all_schools, self.only_new_years = all_schools, only_new_years
        # Years later than a school's loaded ones have no upper end; the range is for full loads.
        newer = only_new_years and "student_master_profile" in self.loaded
        self.first_year, self.last_year = (None, None) if newer else (first_year, last_year)

    # --- input scope --------------------------------------------------------------------------

    @cached_property
    def active_schools(self) -> DataFrame:
        return self.source["school"].filter("is_active").select("school_id")

    def of_schools(self, table: str) -> DataFrame:
        """Source rows of active schools; adaptive execution broadcasts the registry from its measured size."""
        rows = self.students if table == "student" else self.source[table]
        return rows if self.all_schools else rows.join(self.active_schools, "school_id", "left_semi")

    @cached_property
    def students(self) -> DataFrame:
        """The student-years as the source has them; years, classes, people and marks all need them."""
        return self.source["student"]

    @cached_property
    def years(self) -> DataFrame:
        if self.only_new_years and "student_master_profile" in self.loaded:
            return dims.years_after_target(self.of_schools("student"), self.loaded["student_master_profile"])
        return dims.years_in_range(self.of_schools("student"), self.first_year, self.last_year)

    def in_years(self, df: DataFrame) -> DataFrame:
        """The plain range reaches the scan; the year list decides.

        Used on grouped rows: the filter is on a grouping column, so it selects the same groups.
        """
        return dims.in_years(dims.in_range(df, self.first_year, self.last_year), self.years)

    def _after_load(self, table: str, rows: DataFrame, keys: list[str], on_existing: str | None = None) -> DataFrame:
        return write_rows(rows, self.loaded.get(table), keys, on_existing or self.on_existing)

    # --- marks -----------------------------------------------------------------------------------

    @cached_property
    def marks_raw(self) -> DataFrame:
        loaded = self.loaded.get("student_marks_raw")
        fresh = marks.unseen_marks(self.of_schools("student_marks"), loaded)
        return fresh if loaded is None else loaded.unionByName(fresh, allowMissingColumns=True)

    @cached_property
    def mark_ids(self) -> DataFrame:
        """What the check for unseen marks needs of the stored ones."""
        return self.marks_raw.select("school_id", "marks_id", "student_id")

    @cached_property
    def heading_rows(self) -> DataFrame:
        return marks.heading_rows(marks.latest_marks(self.marks_raw))

    @cached_property
    def student_marks_components(self) -> DataFrame:
        return marks.with_headings(self.heading_rows, self.source["marks_headings"])

    @cached_property
    def exam_sums(self) -> DataFrame:
        return marks.exam_sums(self.heading_rows)

    @cached_property
    def class_sums(self) -> DataFrame:
        return marks.in_class(self.exam_sums, self.students, self.source["class"], self.source["subject"])

    # --- dimensions ---------------------------------------------------------------------------------

    @cached_property
    def student_clean(self) -> DataFrame:
        rows = self.in_years(dims.student_clean(self.of_schools("student"), self.need_active))
        return self._after_load("student_clean", rows, KEY, "keep")

    @cached_property
    def dim_student_demographics(self) -> DataFrame:
        rows = self.in_years(dims.demographics(self.of_schools("student")))
        return self._after_load("dim_student_demographics", rows, KEY, "keep")

    @cached_property
    def dim_parent(self) -> DataFrame:
        loaded = self.loaded.get("dim_parent")
        fresh = dims.new_parents(self.of_schools("parent"), loaded)
        return fresh if loaded is None else loaded.unionByName(fresh)

    @cached_property
    def people(self) -> DataFrame:
        """Demographics with the parents' columns; the parents are met once and not by every view."""
        return profile.with_parents(self.dim_student_demographics, self.dim_parent)

    @cached_property
    def dim_teachers(self) -> DataFrame:
        return dims.teachers(self.of_schools("teacher"))

    @cached_property
    def dim_users(self) -> DataFrame:
        return dims.users(self.of_schools("user_master"))

    @cached_property
    def dim_subject(self) -> DataFrame:
        return dims.dim_subject(self.of_schools("subject_master"), self.loaded.get("dim_subject"))

    @cached_property
    def dim_class_subject_map(self) -> DataFrame:
        rows = dims.class_subject_map(self.of_schools("subject"), self.source["class"], self.source["subject_master"], self.years)
        return upsert(rows, self.loaded.get("dim_class_subject_map"), ["school_id", "class_name", "subject_id", "academic_yr"])

    @cached_property
    def dim_class(self) -> DataFrame:
        loaded = self.loaded.get("dim_class")
        fresh = dims.new_classes(self.of_schools("class"), self.students, loaded, self.years)
        return fresh if loaded is None else loaded.unionByName(fresh)

    @cached_property
    def dim_section(self) -> DataFrame:
        loaded = self.loaded.get("dim_section")
        fresh = dims.new_sections(self.of_schools("section"), self.students, loaded, self.years)
        return fresh if loaded is None else loaded.unionByName(fresh)

    # --- facts -----------------------------------------------------------------------------------------

    @cached_property
    def fact_attendance(self) -> DataFrame:
        rows = self.in_years(facts.attendance(self.of_schools("attendance_clean"), self.attendance_mode))
        return self._after_load("fact_attendance", rows, KEY)

    @cached_property
    def fact_academics(self) -> DataFrame:
        return self._after_load("fact_academics", self.in_years(marks.ratio_of_sums(self.exam_sums, KEY)), KEY)

    @cached_property
    def fact_student_subject_performance(self) -> DataFrame:
        rows = self.in_years(marks.subject_performance(self.class_sums))
        return self._after_load("fact_student_subject_performance", rows, [*KEY, "subject_id"])

    @cached_property
    def fact_science_components(self) -> DataFrame:
        rows = self.in_years(marks.science_components(self.class_sums))
        entered = upsert(rows, self.loaded.get("fact_science_components"), [*KEY, "component"])
        return marks.with_missing_components(entered)

    @cached_property
    def fact_achievements_by_year(self) -> DataFrame:
        rows = self.in_years(facts.achievements_by_year(self.of_schools("achievements_clean")))
        loaded = self.loaded.get("fact_achievements")
        return write_rows(rows, None if loaded is None else loaded.filter(F.col("academic_yr") != fv.LIFETIME), KEY, self.on_existing)

    @cached_property
    def fact_achievements(self) -> DataFrame:
        return self.fact_achievements_by_year.unionByName(facts.achievements_lifetime(self.fact_achievements_by_year))

    @cached_property
    def fact_homework_engagement(self) -> DataFrame:
        rows = self.in_years(facts.homework_engagement(self.of_schools("homework"), self.source["homework_comments"]))
        return self._after_load("fact_homework_engagement", rows, KEY)

    # --- profile and views ----------------------------------------------------------------------------------

    @cached_property
    def student_master_profile(self) -> DataFrame:
        rows = profile.master_profile(
            self.student_clean, self.fact_academics, self.fact_attendance, self.fact_achievements_by_year,
            self.fact_homework_engagement,
        )
        return self._after_load("student_master_profile", rows, KEY)

    @cached_property
    def student_behavior_signals(self) -> DataFrame:
        return self._after_load("student_behavior_signals", profile.behavior_signals(self.student_master_profile), KEY)

    @cached_property
    def student_subject_strengths(self) -> DataFrame:
        return profile.subject_strengths(self.fact_student_subject_performance, self.dim_subject, self.fact_science_components)

    @cached_property
    def student_ai_profile(self) -> DataFrame:
        return profile.ai_profile(
            self.people, self.dim_class, self.dim_section, None, self.student_master_profile,
            self.student_subject_strengths, self.student_behavior_signals,
        )

    @cached_property
    def child_selector(self) -> DataFrame:
        return profile.child_selector(self.people, None, self.source["name_aliases"])

    @cached_property
    def student_academic_trend(self) -> DataFrame:
        return profile.academic_trend(self.student_master_profile)

    @cached_property
    def student_career_profile(self) -> DataFrame:
        return profile.career_confidence(self.student_master_profile, self.student_academic_trend, self.student_subject_strengths)

    # --- read models -------------------------------------------------------------------------------------------

    @cached_property
    def student_profile(self) -> DataFrame:
        return profile.student_profile(
            self.people, self.dim_class, self.dim_section, None, self.student_master_profile,
            self.student_subject_strengths, self.student_behavior_signals, self.fact_achievements,
        )

    @cached_property
    def student_subjects(self) -> DataFrame:
        return student_view.student_subjects(self.fact_student_subject_performance, self.dim_subject, self.fact_science_components)

    @cached_property
    def exam_breakdown(self) -> DataFrame:
        s = self.source
        return student_view.exam_breakdown(
            self.heading_rows, s["marks_headings"], s["exam"], self.students, s["class"], s["subject_master"], self.dim_subject
        )

    @cached_property
    def class_rows(self) -> DataFrame:
        return class_view.class_rows(self.student_profile)

    @cached_property
    def subject_levels(self) -> DataFrame:
        return careers.subject_levels(self.student_subjects)

    @cached_property
    def grounded_careers(self) -> DataFrame:
        return careers.grounded_careers(self.subject_levels, self.dim_subject)

    @cached_property
    def subject_list_rows(self) -> DataFrame:
        return careers.subject_list_rows(self.student_profile)


# Tables many others are built from, in the order they depend on each other.
# Years, classes, sections and subjects are small: once written, their size is known, and joins with them are
# planned as broadcasts at once.
STAGED = (
    "students", "years", "dim_class", "dim_section", "dim_subject",
    "marks_raw", "mark_ids", "heading_rows", "exam_sums", "fact_student_subject_performance", "fact_science_components",
    "student_clean", "people", "student_master_profile", "student_profile",
)
# What they are bucketed by, where that is not the student-year: joins and groupings on these columns move only the other side.
BUCKETS = {"mark_ids": ["school_id", "marks_id"]}


class StagedStar(Star):
    """A star that writes its shared tables once to the shared folder and reads them back.

    Lazy branches push different filters below the latest-revision shuffle, so Spark could not
    share it and would read all marks once per branch.  A written table is read by every branch
    and outlives a lost executor.  The tables are bucketed by student-year, so the views' joins and
    groupings on it read them as they lie.
    """

    def __init__(self, spark: SparkSession, source: Mapping[str, DataFrame], buckets: int | None = None, **options):
        super().__init__(source, **options)
        self.spark, self.buckets = spark, buckets
        self.folder = f"{shared_folder(spark)}/star-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def _stage(self, table: str, df: DataFrame) -> DataFrame:
        keys = BUCKETS.get(table, DEALT)
        if not set(keys) <= set(df.columns):
            df.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{table}")
            return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{table}")
        name = f"{self.folder.rsplit('/', 1)[-1].replace('-', '_')}_{table}"
        stored = write_bucketed(df, name, f"{self.folder}/{table}", keys, self.buckets)
        self.tables.append(name)
        return stored.select(*df.columns)

    def stage_once(self, table: str, build) -> DataFrame:
        """A table of one query that the query reads more than once."""
        if table not in self.__dict__:
            self.__dict__[table] = self._stage(table, build())
        return self.__dict__[table]

    def drop(self) -> None:
        """Remove the staged tables; the star is of no use afterwards."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _staged(table: str) -> cached_property:
    build = Star.__dict__[table].func
    prop = cached_property(lambda self: self._stage(table, build(self)))
    prop.__set_name__(StagedStar, table)
    return prop


for _table in STAGED:
    setattr(StagedStar, _table, _staged(_table))
