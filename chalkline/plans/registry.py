"""Named queries over the derived school tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import KEY, heading_group, is_principal, subject_category
from chalkline.operators import careers, class_view, deltas, dims, facts, marks, profile, quality, reconcile, student_view, writes
from chalkline.plans import manifest
from chalkline.plans.star import Star, StagedStar
from chalkline.sources import readers
from chalkline.sources.order_school import OrderSchool

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Wide whole numbers, doubles and date texts, so that results compare across engines."""

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*[cell(f) for f in df.schema.fields])


_stars: dict[tuple, Star] = {}


def _star(spark: SparkSession, folder: str) -> Star:
    """One star per session and state of the folder; its shared tables are written when first needed.

    The state is the folder's file list with sizes and times, so a changed folder is read anew. The size of the school's
    files decides how many tasks their rows are dealt to.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    school = F.col("path").rlike(r"/(customer|orders|lineitem)\.parquet(/|$)")
    *state, size = files.agg(
        F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.sum(F.when(school, F.col("length"))),
    ).first()
    parts = readers.parts_for(spark, size or 0)
    readers.start_shuffles_with(spark, parts)
    key = (spark.sparkContext.applicationId, folder, *state)
    if key not in _stars:
        _stars[key] = StagedStar(spark, OrderSchool(spark, folder, parts), parts)
    return _stars[key]


def query(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    _QUERIES[build.__name__] = lambda spark, folder: plain(build(_star(spark, folder)))
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _fifth(df: DataFrame) -> DataFrame:
    """The part of a built table that counts as loaded before."""
    return df.filter(F.col("student_id") % 5 == 0)


# --- marks ----------------------------------------------------------------------------------


@query
def marks_latest(s: Star) -> DataFrame:
    return marks.latest_marks(s.marks_raw).select(
        "school_id", "student_id", F.col("subject_id").cast("int").alias("subject_id"), "exam_id", "academic_yr", "marks_id",
        "class_id", "section_id", "exam_date", "publish",
    )


@query
def marks_unseen(s: Star) -> DataFrame:
    return marks.unseen_marks(s.marks_raw, _fifth(s.mark_ids)).select("school_id", "marks_id", "student_id", "academic_yr", "exam_id")


@query
def marks_components(s: Star) -> DataFrame:
    return s.student_marks_components.withColumn("subject_id", F.col("subject_id").cast("int"))


@query
def unreadable_marks(s: Star) -> DataFrame:
    return marks.unreadable_marks(marks.latest_marks(s.marks_raw))


@query
def academics_by_year(s: Star) -> DataFrame:
    return s.fact_academics


@query
def academics_by_deltas(s: Star) -> DataFrame:
    """Two batches: newer revisions come before and after the ones they supersede."""
    first, second = s.marks_raw.where("marks_id % 3 <> 0"), s.marks_raw.where("marks_id % 3 = 0")
    held = s.stage_once("held_of_first_batch", lambda: deltas.held_revisions(first))
    totals = s.stage_once("totals_of_first_batch", lambda: deltas.totals_after(None, deltas.revision_deltas(first, None, held)))
    moved = s.stage_once("deltas_of_second_batch", lambda: deltas.revision_deltas(second, held))
    return s.in_years(deltas.academics_from_totals(deltas.totals_after(totals, moved)))


@query
def academics_by_heading_name(s: Star) -> DataFrame:
    src = s.source
    return s.in_years(marks.ratio_of_sums_by_name(src["mark_master"], src["mark_detail"], src["marks_headings"], KEY))


@query
def academics_avg_of_ratios(s: Star) -> DataFrame:
    return s.in_years(marks.average_of_ratios(s.student_marks_components, KEY))


@query
def subject_avg_of_ratios(s: Star) -> DataFrame:
    rows = s.student_marks_components.withColumn("subject_id", F.col("subject_id").cast("int"))
    return s.in_years(marks.average_of_ratios(rows, [*KEY, "subject_id"]))


@query
def academics_keep_existing(s: Star) -> DataFrame:
    old = _fifth(s.student_clean).select(
        *KEY, *[F.lit(1).cast("decimal(11,2)").alias(c) for c in ("avg_percent", "written_avg", "oral_avg")],
        F.lit(0).cast("bigint").alias("exams_taken"),
    )
    return writes.write_rows(s.fact_academics, old, KEY, "keep")


@query
def academics_replace_existing(s: Star) -> DataFrame:
    old = _fifth(s.student_clean).select(
        *KEY, *[F.lit(1).cast("decimal(11,2)").alias(c) for c in ("avg_percent", "written_avg", "oral_avg")],
        F.lit(0).cast("bigint").alias("exams_taken"),
    )
    return writes.write_rows(s.fact_academics, old, KEY, "replace")


# --- incremental writes and dimensions ---------------------------------------------------------


@query
def students_missing_append(s: Star) -> DataFrame:
    return writes.missing_rows(s.student_clean, _fifth(s.student_clean), KEY)


@query
def students_active_only(s: Star) -> DataFrame:
    return s.in_years(dims.student_clean(s.source["student"], need_active=True))


@query
def insert_ignore_first(s: Star) -> DataFrame:
    pupils = s.source["student"].filter(F.col("parent_id").isNotNull()).select(
        "school_id", "parent_id", F.col("guardian_name"), F.col("student_id"), F.col("reg_no")
    )
    loaded = pupils.filter(F.col("parent_id") % 5 == 0)
    return writes.insert_first(pupils, loaded, ["school_id", "parent_id"], [F.desc("student_id"), F.asc("reg_no")])


@query
def upsert_science(s: Star) -> DataFrame:
    old = s.student_clean.filter(F.col("student_id") % 5 < 2).select(
        *KEY, F.lit("Physics").alias("component"), F.lit(1).cast("decimal(11,2)").alias("avg_percent"), F.lit(1).alias("is_entered")
    )
    return writes.upsert(s.in_years(marks.science_components(s.class_sums)), old, [*KEY, "component"])


@query
def upsert_class_subject_map(s: Star) -> DataFrame:
    ids = F.explode(F.array(F.lit(5), F.lit(99)))
    old = _fifth(s.student_clean).select("school_id", F.col("class_id").cast("string").alias("class_name"), ids.alias("subject_id"), "academic_yr")
    return writes.upsert(s.dim_class_subject_map, old.distinct(), ["school_id", "class_name", "subject_id", "academic_yr"])


@query
def pin_science_row(s: Star) -> DataFrame:
    part = s.source.given("part")
    used = part.select((F.col("p_partkey") % 7 * 4).cast("int").alias("subject_id")).distinct()
    loaded = used.select(F.explode(F.array(F.lit(1), F.lit(7))).alias("school_id"), "subject_id").select(
        "school_id", "subject_id", F.concat(F.lit("Loaded "), F.col("subject_id").cast("string")).alias("subject_name"),
        F.lit("Scholastic").alias("subject_type"),
    )
    return dims.dim_subject(s.of_schools("subject_master"), loaded)


@query
def target_years_range(s: Star) -> DataFrame:
    return s.years


@query
def target_years_highwater(s: Star) -> DataFrame:
    held = s.source["student"].filter((F.col("school_id") == 1) & (F.col("academic_yr") <= "2021-2022"))
    return dims.years_after_target(s.source["student"], held)


@query
def demographics(s: Star) -> DataFrame:
    return s.dim_student_demographics


@query
def teachers_refresh(s: Star) -> DataFrame:
    return s.dim_teachers


@query
def users_refresh(s: Star) -> DataFrame:
    return s.dim_users


@query
def parents_first(s: Star) -> DataFrame:
    loaded = s.source["parent"].filter(F.col("parent_id") % 5 == 1)
    return dims.new_parents(s.of_schools("parent"), loaded, drop_deleted=True)


@query
def class_section_dims(s: Star) -> DataFrame:
    classes = s.dim_class.select("school_id", F.lit("class").alias("kind"), F.col("class_id").alias("id"), F.col("class_name").alias("name"))
    return classes.unionByName(
        s.dim_section.select("school_id", F.lit("section").alias("kind"), F.col("section_id").alias("id"), F.col("section_name").alias("name"))
    )


# --- facts ------------------------------------------------------------------------------------------


@query
def attendance_present(s: Star) -> DataFrame:
    return s.fact_attendance


@query
def attendance_absent(s: Star) -> DataFrame:
    return s.in_years(facts.attendance(s.of_schools("attendance_clean"), "absent"))


@query
def subject_performance(s: Star) -> DataFrame:
    return s.fact_student_subject_performance


@query
def subject_performance_by_heading_name(s: Star) -> DataFrame:
    src = s.source
    keys = [*KEY, "subject_id"]
    return s.in_years(marks.ratio_of_sums_by_name(src["mark_master"], src["mark_detail"], src["marks_headings"], keys))


@query
def science_components(s: Star) -> DataFrame:
    return s.in_years(marks.science_components(s.class_sums))


@query
def science_backfill(s: Star) -> DataFrame:
    return s.fact_science_components


@query
def achievements_year(s: Star) -> DataFrame:
    return s.fact_achievements_by_year


@query
def achievements_lifetime(s: Star) -> DataFrame:
    return facts.achievements_lifetime(s.fact_achievements_by_year)


@query
def achievements_lifetime_formatted(s: Star) -> DataFrame:
    return facts.achievements_lifetime_text(s.source["achievements_clean"])


@query
def achievements_totals(s: Star) -> DataFrame:
    return facts.lifetime_totals(s.fact_achievements)


@query
def homework_engagement(s: Star) -> DataFrame:
    return s.fact_homework_engagement


# --- profile and views --------------------------------------------------------------------------------


@query
def master_profile(s: Star) -> DataFrame:
    return s.student_master_profile


@query
def master_profile_lifetime(s: Star) -> DataFrame:
    lifetime = facts.achievements_lifetime_text(s.source["achievements_clean"])
    return profile.master_profile(
        s.student_clean, s.fact_academics, s.fact_attendance, lifetime, s.fact_homework_engagement, lifetime=True
    )


@query
def behavior_signals(s: Star) -> DataFrame:
    return s.student_behavior_signals


@query
def subject_strengths(s: Star) -> DataFrame:
    return s.student_subject_strengths


@query
def ai_profile(s: Star) -> DataFrame:
    return s.student_ai_profile


@query
def child_selector(s: Star) -> DataFrame:
    return s.child_selector


@query
def academic_trend(s: Star) -> DataFrame:
    return s.student_academic_trend


@query
def career_confidence(s: Star) -> DataFrame:
    return s.student_career_profile


@query
def confidence_profile(s: Star) -> DataFrame:
    return profile.confidence_profile(
        s.people, None, s.student_master_profile, s.student_subject_strengths,
        facts.lifetime_totals(s.fact_achievements), s.student_career_profile,
    )


# --- reconciliation and quality ---------------------------------------------------------------------------


@query
def verify_by_year(s: Star) -> DataFrame:
    return quality.verify_by_year(
        s.source["student"], s.student_master_profile, s.fact_attendance, s.fact_student_subject_performance
    )


@query
def missing_from_master(s: Star) -> DataFrame:
    partly = s.student_clean.filter(F.col("student_id") % 5 != 0)
    return quality.missing_from_master(s.source["student"], partly)


@query
def reconcile_rows(s: Star) -> DataFrame:
    """Planted differences between two states of master, attendance and marks: changed, absent and repeated rows."""
    k = F.col("student_id")
    by = ["school_id", "academic_yr"]
    master = s.student_master_profile.select(*KEY, "avg_percent")
    other_master = master.where(k % 89 != 0).withColumn("avg_percent", F.when(k % 97 != 0, F.col("avg_percent")))
    days = s.fact_attendance.select(*KEY, "present_days")
    other_days = days.withColumn("present_days", F.when(k % 83 == 0, F.col("present_days") + 1).otherwise(F.col("present_days")))
    ids = s.marks_raw.select(*KEY, "marks_id", "exam_id")
    other_ids = ids.unionByName(ids.where("marks_id % 4001 = 0"))

    def found(name: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        rows = reconcile.differing_rows(left, right, by, [key])
        return rows.select(F.lit(name).alias("table_name"), *by, F.col(key).cast("string").alias("row_key"), "side", "copies")

    return (
        found("student_master_profile", master, other_master, "student_id")
        .unionByName(found("fact_attendance", days, other_days, "student_id"))
        .unionByName(found("student_marks", ids, other_ids, "marks_id"))
    )


@query
def ghost_students(s: Star) -> DataFrame:
    everyone = s.source["student"].select(*KEY, "is_delete")
    gone = everyone.filter(F.col("student_id") % 37 != 0)
    return quality.ghost_students(everyone.select(*KEY), s.dim_student_demographics, gone)


@query
def duplicate_keys(s: Star) -> DataFrame:
    twice = s.student_clean.unionByName(_fifth(s.student_clean))
    return writes.duplicate_keys(twice, KEY)


@query
def heading_audit(s: Star) -> DataFrame:
    return marks.heading_audit(s.heading_rows, s.source["marks_headings"], heading_group)


@query
def science_completeness(s: Star) -> DataFrame:
    return quality.science_completeness(s.fact_science_components)


@query
def science_incomplete(s: Star) -> DataFrame:
    return quality.science_completeness(s.in_years(marks.science_components(s.class_sums)))


@query
def staff_counts(s: Star) -> DataFrame:
    return quality.staff_counts(s.dim_teachers)


@query
def rows_per_year(s: Star) -> DataFrame:
    return quality.rows_per_year(s.student_master_profile)


@query
def without_parent(s: Star) -> DataFrame:
    return quality.without_parent(s.dim_student_demographics)


@query
def users_per_role(s: Star) -> DataFrame:
    return quality.users_per_role(s.dim_users)


@query
def schema_checks(s: Star) -> DataFrame:
    tables = {t: getattr(s, t) for t in ("dim_subject", "dim_teachers", "dim_users", "student_master_profile")}
    return quality.content_checks(s.active_schools, tables)


@query
def run_log(s: Star) -> DataFrame:
    counts = quality.row_counts(s.marks_raw, s.heading_rows, s.fact_student_subject_performance)
    return counts.join(quality.years_note(s.years), "school_id", "full")


class _Earlier(dict):
    """The source as it was before some rows came in."""

    def __init__(self, source, **tables: DataFrame):
        super().__init__(tables)
        self.source = source

    def __missing__(self, table: str) -> DataFrame:
        return self.source[table]


@query
def load_touched_partitions(s: Star) -> DataFrame:
    """What a load has to write after new marks, attendance, parents, a subject and a school's first year came in.

    Both states are summed up from the same rows; the large ones are derived once and stored.
    """
    large = {t: s.stage_once(f"{t}_of_both_states", lambda t=t: s.source[t]) for t in ("student_marks", "attendance_clean")}
    src = _Earlier(s.source, **large)
    year = F.col("academic_yr")
    before = _Earlier(
        src,
        student_marks=src["student_marks"].where(~((F.col("school_id") == 7) & (year == "2024-2025") & (F.col("exam_id") == 2))),
        attendance_clean=src["attendance_clean"].where(~((F.col("school_id") == 1) & (year == "2021-2022") & (F.col("student_id") % 3 == 0))),
        parent=src["parent"].where(~((F.col("school_id") == 7) & (F.col("parent_id") % 10 == 0))),
        subject_master=src["subject_master"].where(~((F.col("school_id") == 1) & (F.col("sm_id") == 20))),
        student=src["student"].where(~((F.col("school_id") == 1) & (year == "2019-2020"))),
    )
    changed = list(before)
    then, now = (manifest.source_state(t, [*changed, "class"]) for t in (before, src))
    return manifest.touched_partitions(then, now)


def _event_log(s: Star) -> DataFrame:
    """Events read as finished or failed runs, one per event."""
    e = s.source.given("events")
    return e.select(
        F.col("event_id").cast("string").alias("run_id"),
        F.when(F.col("user_id") % 2 == 0, 1).otherwise(7).alias("school_id"),
        F.col("ts").cast("timestamp").alias("run_start"),
        F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + F.col("event_id") % 500).alias("run_end"),
        F.when(F.col("event_id") % 3 == 0, "ERROR").otherwise("SUCCESS").alias("status"),
        F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("notes"),
    )


@query
def run_report(s: Star) -> DataFrame:
    """Each run as its own day's report shows it."""
    report = quality.run_report(_event_log(s), today=F.to_date("run_start"))
    return report.select("run_id", "school_id", "status", "duration_sec", "notes")


@query
def run_log_checks(s: Star) -> DataFrame:
    log = _event_log(s).withColumn("run_end", F.struct("run_end", F.col("run_id").cast("bigint")))
    return quality.log_checks(log)


@query
def tenant_lookup(s: Star) -> DataFrame:
    return quality.school_of_user(s.dim_users, s.source["school"])


# --- student page -------------------------------------------------------------------------------------------


@query
def student_profile(s: Star) -> DataFrame:
    return s.student_profile


@query
def student_subjects(s: Star) -> DataFrame:
    return s.student_subjects


@query
def subject_vs_class(s: Star) -> DataFrame:
    return student_view.subject_vs_class(s.fact_student_subject_performance, s.dim_subject, s.student_master_profile)


@query
def subject_performance_all(s: Star) -> DataFrame:
    return student_view.subject_performance_all(s.fact_student_subject_performance, s.dim_subject)


@query
def exam_breakdown(s: Star) -> DataFrame:
    return s.exam_breakdown


@query
def exam_report(s: Star) -> DataFrame:
    return student_view.exam_report(s.exam_breakdown)


@query
def exam_components(s: Star) -> DataFrame:
    return student_view.exam_components(s.exam_breakdown)


@query
def remedial(s: Star) -> DataFrame:
    return student_view.remedial(s.student_subjects)


@query
def subject_groups(s: Star) -> DataFrame:
    lists = student_view.strong_subject_list(s.student_profile, s.student_subjects)
    return student_view.subject_groups(lists).withColumn("place", F.col("place") + 1)


@query
def classmates(s: Star) -> DataFrame:
    return student_view.classmates(s.student_profile)


@query
def progress(s: Star) -> DataFrame:
    return student_view.progress(s.student_profile)


@query
def trend_first_last(s: Star) -> DataFrame:
    return student_view.history_trend(s.student_profile)


@query
def performance_tier(s: Star) -> DataFrame:
    return student_view.page_header(s.student_profile)


@query
def selectors(s: Star) -> DataFrame:
    return student_view.selectors(s.student_profile)


@query
def years_classes_lists(s: Star) -> DataFrame:
    return student_view.years_and_classes(s.student_master_profile, s.dim_student_demographics, s.dim_class)


@query
def visible_students(s: Star) -> DataFrame:
    return student_view.visible_to_parents(s.student_profile, s.dim_users)


@query
def visible_classes(s: Star) -> DataFrame:
    return student_view.visible_classes(s.dim_users, s.dim_teachers)


@query
def teacher_students(s: Star) -> DataFrame:
    return student_view.visible_to_teachers(s.student_profile, student_view.visible_classes(s.dim_users, s.dim_teachers))


@query
def student_selection(s: Star) -> DataFrame:
    return student_view.default_selection(s.student_profile)


@query
def classmates_of(s: Star) -> DataFrame:
    """Asked for the student with the smallest id of every class and section."""
    points = student_view.classmates(s.student_profile)
    asked = points.groupBy("school_id", "academic_yr", "class_name", "section_name").agg(F.min("student_id").alias("student_id"))
    return student_view.classmates_of(points, asked)


@query
def orphans(s: Star) -> DataFrame:
    """Demographics rows that are left when only active students are kept."""
    active = s.in_years(dims.student_clean(s.of_schools("student"), need_active=True))
    return writes.split_orphans(s.dim_student_demographics, active, KEY)[1].select(*KEY, "student_name")


@query
def achievement_items(s: Star) -> DataFrame:
    return student_view.achievement_items(s.student_profile)


@query
def child_years(s: Star) -> DataFrame:
    return student_view.child_years(s.child_selector, s.student_profile)


@query
def request_checks(s: Star) -> DataFrame:
    e = s.source.given("events")
    return student_view.request_checks(e.select(
        "event_id", (F.col("user_id") % 100).cast("string").alias("student_id"),
        F.concat((F.lit(2017) + F.col("event_id") % 10).cast("string"), F.lit("-"), (F.lit(2018) + F.col("event_id") % 10).cast("string")).alias("academic_yr"),
        F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type")).alias("user_id"),
    ))


@query
def eca_records(s: Star) -> DataFrame:
    return writes.record_list(s.source["extracurricular_achievements"])


# --- class page ------------------------------------------------------------------------------------------------


@query
def class_roster(s: Star) -> DataFrame:
    return profile.class_roster(
        s.people, s.dim_class, s.dim_section, None, s.student_master_profile,
        s.student_behavior_signals, s.student_subject_strengths,
    )


@query
def class_summary(s: Star) -> DataFrame:
    return class_view.class_summary(s.class_rows)


@query
def class_kpis(s: Star) -> DataFrame:
    return class_view.kpis(s.class_rows)


@query
def at_risk(s: Star) -> DataFrame:
    return class_view.at_risk(s.class_rows)


@query
def attendance_histogram(s: Star) -> DataFrame:
    return class_view.attendance_histogram(s.class_rows)


@query
def academic_histogram(s: Star) -> DataFrame:
    return class_view.academic_histogram(s.class_rows)


@query
def academic_histogram_upper(s: Star) -> DataFrame:
    return class_view.academic_histogram(s.class_rows, include_upper=True)


@query
def signal_distribution(s: Star) -> DataFrame:
    return class_view.signal_distribution(s.class_rows)


@query
def class_zones(s: Star) -> DataFrame:
    return class_view.zones(s.class_rows)


@query
def zone_points(s: Star) -> DataFrame:
    return class_view.zone_points(s.class_rows)


@query
def class_insight(s: Star) -> DataFrame:
    return class_view.insight(s.class_rows)


@query
def top_performers(s: Star) -> DataFrame:
    return class_view.top_performers(s.class_rows)


@query
def needs_support(s: Star) -> DataFrame:
    return class_view.needs_support(s.class_rows)


def _class_marks(s: Star, reference_scope: bool) -> DataFrame:
    return class_view.class_subject_marks(
        s.dim_class_subject_map, s.fact_student_subject_performance, s.people, None, s.dim_class,
        reference_scope,
    )


@query
def class_subject_marks(s: Star) -> DataFrame:
    return _class_marks(s, False)


@query
def class_subject_marks_wide(s: Star) -> DataFrame:
    return _class_marks(s, True)


@query
def class_subjects(s: Star) -> DataFrame:
    return class_view.class_subjects(s.dim_class_subject_map, s.dim_subject, _class_marks(s, False))


@query
def staff_access(s: Star) -> DataFrame:
    return class_view.staff_access(s.dim_users, s.dim_teachers, is_principal)


# --- careers and insight -------------------------------------------------------------------------------------------


@query
def subject_levels(s: Star) -> DataFrame:
    return s.subject_levels


@query
def careers_first_match(s: Star) -> DataFrame:
    return s.grounded_careers


@query
def careers_longest_match(s: Star) -> DataFrame:
    return careers.grounded_careers(s.subject_levels, s.dim_subject, match="longest")


@query
def careers_shown(s: Star) -> DataFrame:
    return careers.one_career_per_subject(s.grounded_careers).drop("place")


@query
def careers_all_match(s: Star) -> DataFrame:
    return careers.insight_subject_careers(s.subject_list_rows)


@query
def achievement_categories(s: Star) -> DataFrame:
    return careers.achievement_category_rows(s.student_profile)


@query
def achievement_careers(s: Star) -> DataFrame:
    return careers.achievement_career_rows(s.student_profile)


def _student_goals(s: Star) -> DataFrame:
    return s.student_profile.select(*KEY).join(s.source.goals(), ["school_id", "student_id"])


@query
def goal_required_subjects(s: Star) -> DataFrame:
    return careers.with_required_subjects(careers.with_required_subjects(s.source.goals(), "first", "required_first"), "longest", "required_longest")


@query
def goal_supported(s: Star) -> DataFrame:
    return careers.goal_status(_student_goals(s), s.grounded_careers)


@query
def career_report(s: Star) -> DataFrame:
    return careers.career_report(
        careers.goal_status(_student_goals(s), s.grounded_careers), s.student_profile,
        careers.level_lists(s.subject_levels), careers.one_career_per_subject(s.grounded_careers),
    )


@query
def core_supporting(s: Star) -> DataFrame:
    return careers.core_supporting(s.subject_list_rows)


@query
def science_note(s: Star) -> DataFrame:
    return careers.science_note(s.fact_science_components, s.student_subjects)


@query
def career_options(s: Star) -> DataFrame:
    return careers.career_options(s.subject_list_rows, s.student_profile)


@query
def insight_context(s: Star) -> DataFrame:
    return careers.insight_context(
        s.student_profile, s.subject_list_rows, careers.career_options(s.subject_list_rows, s.student_profile),
        careers.science_note(s.fact_science_components, s.student_subjects),
    )


@query
def insight_fallback(s: Star) -> DataFrame:
    return careers.insight_fallback(s.student_profile, s.subject_list_rows)


@query
def profile_fingerprint(s: Star) -> DataFrame:
    return careers.profile_fingerprints(s.student_profile)


# --- change batches ----------------------------------------------------------------------------------------------------


@query
def eca_apply_changes(s: Star) -> DataFrame:
    records = s.source["extracurricular_achievements"]
    return writes.apply_changes(records, writes.judge_changes(s.source["eca_changes"], records))


@query
def eca_rejected(s: Star) -> DataFrame:
    judged = writes.judge_changes(s.source["eca_changes"], s.source["extracurricular_achievements"])
    return judged.filter(F.col("reject_reason").isNotNull()).select("school_id", "id", "op", "seq", "reject_reason")
