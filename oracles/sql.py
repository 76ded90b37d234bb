"""The final SELECT of every oracle."""

from __future__ import annotations

from chalkline.functions import fixed_values as fv
from oracles.base import (
    K, SCIENCE_CLASSES, YEARS, I, W, avgs, big, display, in_list, mean_c, mean_of_ratios, num, quoted, ratio, tenth, values,
    with_ctes,
)

G = "school_id, academic_yr, class_name, section"
PLACE = f"row_number() OVER (PARTITION BY {G} ORDER BY avg_c {{}}, student_name, student_id)"
SELECTS: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    SELECTS[name] = sql


def percent_text(c: str) -> str:
    return f"coalesce(printf('%.1f', {num(c)}) || '%', 'N/A')"


# --- marks ------------------------------------------------------------------------------------
add("marks_latest", (
    f"SELECT school_id, student_id, subject_id, exam_id, academic_yr, marks_id, {big('(student_id + y) % 12 + 1')} AS class_id, "
    f"{big('c_nationkey % 4 + 1')} AS section_id, CAST(CAST(last_day AS DATE) AS VARCHAR) AS exam_date, "
    "CASE WHEN subject_id % 10 = 9 THEN 'N' ELSE 'Y' END AS publish FROM t_latest"))
add("marks_unseen", "SELECT school_id, marks_id, student_id, academic_yr, exam_id FROM t_marks WHERE student_id % 5 <> 0")
add("marks_components", (
    "SELECT school_id, student_id, subject_id, exam_id, academic_yr, heading AS marks_headings_id, present AS is_present, "
    "CAST(mark AS DOUBLE) AS marks_obtained, 50.0::DOUBLE AS max_marks, heading_name AS component_name, written_exam FROM t_comp"))
add("unreadable_marks", (
    "SELECT school_id, academic_yr, 0::BIGINT AS unreadable_texts, 0::BIGINT AS unreadable_numbers FROM t_latest "
    "WHERE subject_id % 10 <> 9 GROUP BY ALL"))
_on_year = "('fact_attendance'), ('fact_academics'), ('fact_achievements'), ('fact_homework_engagement'), ('fact_student_subject_performance'), ('fact_science_components'), ('dim_class_subject_map'), ('student_master_profile'), ('student_behavior_signals')"
_on_student = "('student_clean'), ('dim_student_demographics'), ('dim_class'), ('dim_section')"
_on_marks = "('student_marks_raw'), ('marks_held'), ('exam_totals'), ('student_marks_components'), ('fact_academics'), ('fact_student_subject_performance'), ('fact_science_components'), ('student_master_profile'), ('student_behavior_signals')"
_hit = (
    f"SELECT t, 7 AS school_id, '2024-2025' AS y FROM (VALUES {_on_marks}) v(t) WHERE EXISTS (SELECT 1 FROM t_marks WHERE school_id = 7 AND academic_yr = '2024-2025' AND exam_id = 2) UNION ALL "
    "SELECT t, 1, '2021-2022' FROM (VALUES ('fact_attendance'), ('student_master_profile'), ('student_behavior_signals')) v(t) "
    "WHERE EXISTS (SELECT 1 FROM t_line WHERE school_id = 1 AND academic_yr = '2021-2022' AND student_id % 3 = 0) UNION ALL "
    "SELECT 'dim_parent', 7, NULL WHERE EXISTS (SELECT 1 FROM t_parent WHERE school_id = 7 AND parent_id % 10 = 0) UNION ALL "
    "SELECT 'dim_subject', 1, NULL UNION ALL SELECT 'dim_class_subject_map', 1, (1995 + i + 24) || '-' || (1995 + i + 25) FROM range(7) r(i) UNION ALL "
    f"SELECT t, 1, CASE WHEN t IN ('dim_class', 'dim_section') THEN NULL ELSE '2019-2020' END FROM (VALUES {_on_year}, {_on_student}) v(t) "
    "WHERE EXISTS (SELECT 1 FROM t_student WHERE school_id = 1 AND academic_yr = '2019-2020') UNION ALL "
    "SELECT 'fact_achievements', 1, 'ALL' WHERE EXISTS (SELECT 1 FROM t_student WHERE school_id = 1 AND academic_yr = '2019-2020')"
)
add("load_touched_partitions", f"SELECT DISTINCT t AS table_name, CAST(school_id AS BIGINT) AS school_id, y AS academic_yr FROM ({_hit})")
add("academics_by_year", f"SELECT {K}, {avgs()} FROM t_acad")
add("academics_by_deltas", f"SELECT {K}, {avgs()} FROM t_acad")
_by_name = ratio("mark", "50", "heading_name = 'Written'", "heading_name <> 'Written'")
_all_rows = f"(SELECT r.*, h.heading_name FROM t_rev r JOIN t_heading h USING (heading) WHERE present = 'Y' AND {YEARS})"
add("academics_by_heading_name", f"SELECT {K}, {avgs()} FROM (SELECT {K}, {_by_name} FROM {_all_rows} GROUP BY {K})")
add("academics_avg_of_ratios", f"SELECT {K}, {avgs()} FROM (SELECT {K}, {mean_of_ratios()} FROM t_comp WHERE present = 'Y' AND {YEARS} GROUP BY {K})")
add("subject_avg_of_ratios", (
    f"SELECT {K}, subject_id, {avgs()} FROM (SELECT {K}, subject_id, {mean_of_ratios()} FROM t_comp WHERE present = 'Y' AND {YEARS} GROUP BY {K}, subject_id)"))
_ones = f"SELECT {K}, 1.0::DOUBLE AS avg_percent, 1.0::DOUBLE AS written_avg, 1.0::DOUBLE AS oral_avg, 0::BIGINT AS exams_taken FROM t_clean WHERE student_id % 5 = 0"
add("academics_keep_existing", (
    f"{_ones} UNION ALL SELECT {K}, {avgs()} FROM t_acad ANTI JOIN (SELECT {K} FROM t_clean WHERE student_id % 5 = 0) USING ({K})"))
add("academics_replace_existing", (
    f"SELECT * FROM ({_ones}) o ANTI JOIN t_acad USING ({K}) UNION ALL SELECT {K}, {avgs()} FROM t_acad"))

# --- incremental writes and dimensions --------------------------------------------------------------
_clean = f"SELECT {K}, reg_no, {big('class_id')} AS class_id, {big('section_id')} AS section_id FROM"
add("students_missing_append", f"{_clean} t_clean WHERE student_id % 5 <> 0")
add("students_active_only", f"{_clean} t_student WHERE is_delete = 'N' AND is_active = 'Y' AND {YEARS}")
add("insert_ignore_first", (
    "SELECT school_id, parent_id, guardian_name, student_id, reg_no FROM (SELECT DISTINCT school_id, parent_id, guardian_name, student_id, reg_no FROM t_student WHERE parent_id IS NOT NULL AND parent_id % 5 <> 0) "
    "QUALIFY row_number() OVER (PARTITION BY school_id, parent_id ORDER BY student_id DESC) = 1"))
_sci = f"SELECT {K}, component, {num('avg_c')} AS avg_percent, {big('is_entered')} AS is_entered FROM"
add("upsert_science", (
    f"{_sci} t_sci UNION ALL SELECT {K}, 'Physics', 1.0::DOUBLE, 1::BIGINT FROM t_clean ANTI JOIN (SELECT {K} FROM t_sci WHERE component = 'Physics') USING ({K}) WHERE student_id % 5 < 2"))
add("upsert_class_subject_map", (
    "SELECT school_id, class_name, CAST(subject_id AS BIGINT) AS subject_id, academic_yr FROM t_map UNION "
    "SELECT school_id, CAST(class_id AS VARCHAR), unnest([5, 99])::BIGINT, academic_yr FROM t_clean WHERE student_id % 5 = 0"))
add("pin_science_row", (
    "SELECT school_id, subject_id, subject_name, subject_type FROM ("
    "SELECT school_id, subject_id::BIGINT AS subject_id, 'Loaded ' || CAST(subject_id AS VARCHAR) AS subject_name, 'Scholastic' AS subject_type FROM "
    "(SELECT DISTINCT p_partkey % 7 * 4 AS subject_id FROM part) CROSS JOIN t_school WHERE subject_id <> 24 "
    "UNION ALL SELECT school_id, subject_id::BIGINT, subject_name, subject_type FROM t_dimsub WHERE subject_id = 24 OR subject_id NOT IN "
    "(SELECT p_partkey % 7 * 4 FROM part))"))
add("target_years_range", "SELECT school_id, academic_yr FROM t_years")
add("target_years_highwater", (
    "SELECT DISTINCT s.school_id, s.academic_yr FROM t_student s LEFT JOIN (SELECT school_id, max(academic_yr) AS newest FROM t_student "
    "WHERE school_id = 1 AND academic_yr <= '2021-2022' GROUP BY school_id) h USING (school_id) WHERE s.academic_yr > coalesce(h.newest, '0000-0000')"))
add("demographics", (
    f"SELECT {K}, student_name, gender, dob, {big('class_id')} AS class_id, {big('section_id')} AS section_id, nationality, category, parent_id, guardian_name, guardian_mobile FROM t_demo"))
_teacher = f"school_id, teacher_id, name, designation, {big('class_id')} AS class_id, {big('section_id')} AS section_id"
add("teachers_refresh", f"SELECT {_teacher} FROM t_teacher")
add("users_refresh", "SELECT school_id, user_id, name, reg_id, role_id FROM t_users")
add("parents_first", (
    "SELECT school_id, parent_id, father_name, mother_name, father_contact, mother_contact FROM t_parent WHERE is_delete = 'N' AND parent_id % 5 <> 1"))
add("class_section_dims", (
    f"SELECT DISTINCT school_id, 'class' AS kind, {big('class_id')} AS id, CAST(class_id AS VARCHAR) AS name FROM t_clean "
    f"UNION ALL SELECT DISTINCT school_id, 'section', {big('section_id')}, section_name FROM t_clean JOIN t_section USING (section_id)"))

# --- facts -------------------------------------------------------------------------------------------
add("attendance_present", f"SELECT {K}, total AS total_school_days, total - p AS absent_days, p AS present_days, {num('att_c')} AS attendance_percentage FROM t_att")
add("attendance_absent", (
    f"SELECT {K}, total AS total_school_days, a AS absent_days, total - a AS present_days, {num('(20000 * (total - a) + total) // (2 * total)')} AS attendance_percentage FROM t_day"))
add("subject_performance", f"SELECT {K}, {big('subject_id')} AS subject_id, {avgs()} FROM t_perf")
add("subject_performance_by_heading_name", f"SELECT {K}, subject_id, {avgs()} FROM (SELECT {K}, subject_id, {_by_name} FROM {_all_rows} GROUP BY {K}, subject_id)")
add("science_components", f"{_sci} t_sci")
add("science_backfill", f"{_sci} t_sciall")
add("achievements_year", f"SELECT {K}, n AS achievement_count, list AS achievement_list FROM t_ach")
_ever = f"SELECT school_id, student_id, 'ALL' AS academic_yr, {big('n')} AS achievement_count, list AS achievement_list FROM"
add("achievements_lifetime", f"{_ever} t_achall")
add("achievements_lifetime_formatted", f"{_ever} t_achtext")
add("achievements_totals", f"SELECT school_id, student_id, {big('n')} AS total_achievements, list AS total_achievement_list FROM t_achtotal")
add("homework_engagement", f"SELECT {K}, hw AS homework_assigned_count FROM t_hw")

# --- profile and views ---------------------------------------------------------------------------------
_place = f"reg_no, {big('class_id')} AS class_id, {big('section_id')} AS section_id"
add("master_profile", (
    f"SELECT {K}, {_place}, {avgs()}, {num('att_c')} AS attendance_percentage, {big('achievements')} AS achievements, {big('hw')} AS homework_assigned_count FROM t_profile"))
add("master_profile_lifetime", (
    f"SELECT p.school_id, p.student_id, p.academic_yr, reg_no, {big('class_id')} AS class_id, {big('section_id')} AS section_id, {avgs()}, {num('att_c')} AS attendance_percentage, "
    f"{big('coalesce(a.n, 0)')} AS achievements, coalesce(a.list, '') AS achievement_list, {big('hw')} AS homework_assigned_count FROM t_profile p LEFT JOIN t_achtext a USING (school_id, student_id)"))
add("behavior_signals", f"SELECT {K}, attendance_band, learning_style, engagement_pattern, primary_strength_axis FROM t_sig")
add("subject_strengths", f"SELECT {K}, strong_subjects, strong_subjects_ai FROM t_strength")
add("ai_profile", (
    "SELECT d.school_id, d.student_id, " + display("d.student_name", "p.father_name") + f" AS student_name, d.gender, d.dob, d.academic_yr, d.parent_id, "
    f"CAST(d.class_id AS VARCHAR) AS class_name, x.section_name, p.father_name, p.mother_name, {avgs('m')}, {num('m.att_c')} AS attendance_percentage, "
    f"{big('m.achievements')} AS achievements, {big('m.hw')} AS homework_assigned_count, s.strong_subjects, s.strong_subjects_ai, g.attendance_band, g.learning_style, g.engagement_pattern, g.primary_strength_axis "
    f"FROM t_demo d LEFT JOIN t_section x USING (section_id) LEFT JOIN t_parent p USING (school_id, parent_id) LEFT JOIN t_profile m USING ({K}) LEFT JOIN t_strength s USING ({K}) LEFT JOIN t_sig g USING ({K})"))
add("child_selector", "SELECT school_id, parent_id, display_name, latest_student_id, latest_academic_yr FROM t_child")
_trend = f"{num('growth_c')} AS year_growth, performance_trend"
add("academic_trend", f"SELECT {K}, {num('avg_c')} AS avg_percent, {num('prev_c')} AS prev_year_percent, {_trend} FROM t_trendlabel")
add("career_confidence", f"SELECT {K}, CAST(cci AS DOUBLE) / 10000 AS career_confidence_index, {_trend} FROM t_confidence")
add("confidence_profile", (
    f"SELECT d.school_id, d.student_id, d.academic_yr, d.student_name, d.gender, d.dob, {big('d.class_id')} AS class_id, {big('d.section_id')} AS section_id, d.nationality, d.category, d.parent_id, d.guardian_name, d.guardian_mobile, "
    f"p.father_name, p.mother_name, p.father_contact, p.mother_contact, {avgs('m')}, {num('m.att_c')} AS attendance_percentage, {big('m.hw')} AS homework_assigned_count, "
    f"{big('coalesce(a.n, 0)')} AS achievements, coalesce(a.list, '') AS achievement_list, s.strong_subjects, CAST(c.cci AS DOUBLE) / 10000 AS career_confidence_index, c.performance_trend, {num('c.growth_c')} AS year_growth "
    f"FROM t_demo d LEFT JOIN t_parent p USING (school_id, parent_id) LEFT JOIN t_profile m USING ({K}) LEFT JOIN t_strength s USING ({K}) LEFT JOIN t_confidence c USING ({K}) LEFT JOIN t_achtotal a USING (school_id, student_id)"))

# --- reconciliation and quality ---------------------------------------------------------------------------
add("verify_by_year", (
    "SELECT school_id, academic_yr, source_students, coalesce(in_master, 0) AS in_master, coalesce(have_attendance, 0) AS have_attendance, coalesce(have_marks, 0) AS have_marks, "
    "source_students - coalesce(in_master, 0) AS missing_from_master, CASE WHEN source_students = coalesce(in_master, 0) AND source_students = coalesce(have_attendance, 0) "
    f"THEN {quoted(fv.STATUS_COMPLETE)} WHEN coalesce(in_master, 0) = 0 THEN {quoted(fv.STATUS_NOT_RUN)} ELSE {quoted(fv.STATUS_PARTIAL)} END AS etl_status "
    f"FROM (SELECT school_id, academic_yr, count(DISTINCT student_id) AS source_students FROM t_student WHERE is_delete = 'N' AND {YEARS} GROUP BY ALL) "
    "LEFT JOIN (SELECT school_id, academic_yr, count(DISTINCT student_id) AS in_master FROM t_profile GROUP BY ALL) USING (school_id, academic_yr) "
    "LEFT JOIN (SELECT school_id, academic_yr, count(DISTINCT student_id) AS have_attendance FROM t_att GROUP BY ALL) USING (school_id, academic_yr) "
    "LEFT JOIN (SELECT school_id, academic_yr, count(DISTINCT student_id) AS have_marks FROM t_perf GROUP BY ALL) USING (school_id, academic_yr)"))
add("missing_from_master", f"SELECT {K}, student_name, parent_id FROM t_student WHERE is_delete = 'N' AND student_id % 5 = 0 AND {YEARS}")
_rows = (
    "SELECT 'student_master_profile' AS t, school_id, academic_yr, CAST(student_id AS VARCHAR) AS row_key, 'left' AS side, 1 AS n FROM t_profile "
    "WHERE student_id % 89 = 0 OR (student_id % 97 = 0 AND avg_c IS NOT NULL) UNION ALL "
    "SELECT 'student_master_profile', school_id, academic_yr, CAST(student_id AS VARCHAR), 'right', 1 FROM t_profile "
    "WHERE student_id % 89 <> 0 AND student_id % 97 = 0 AND avg_c IS NOT NULL UNION ALL "
    "SELECT 'fact_attendance', school_id, academic_yr, CAST(student_id AS VARCHAR), unnest(['left', 'right']), 1 FROM t_att WHERE student_id % 83 = 0 UNION ALL "
    "SELECT 'student_marks', school_id, academic_yr, CAST(marks_id AS VARCHAR), 'right', 1 FROM t_marks WHERE marks_id % 4001 = 0"
)
add("reconcile_rows", f"SELECT t AS table_name, CAST(school_id AS BIGINT) AS school_id, academic_yr, row_key, side, CAST(n AS BIGINT) AS copies FROM ({_rows})")
add("ghost_students", (
    f"SELECT s.school_id, s.student_id, s.academic_yr, d.student_name FROM t_student s LEFT JOIN t_demo d USING ({K}) WHERE (s.student_id % 37 = 0 OR s.is_delete = 'Y') AND s.{YEARS}"))
add("duplicate_keys", f"SELECT {K}, 2::BIGINT AS cnt FROM t_clean WHERE student_id % 5 = 0")
add("heading_audit", (
    f"SELECT DISTINCT school_id, {big('heading')} AS marks_headings_id, heading_name AS name, CASE WHEN heading IN {W} THEN 'Written' WHEN heading IN {I} THEN 'Internal' ELSE {quoted(fv.UNCLASSIFIED)} END AS classification FROM t_comp"))
_complete = "SELECT school_id, academic_yr, count(DISTINCT student_id) AS students, count(CASE WHEN n <> 3 THEN 1 END) AS incomplete FROM (SELECT {k}, count(*) AS n FROM {t} GROUP BY {k}) GROUP BY ALL"
add("science_completeness", _complete.format(k=K, t="t_sciall"))
add("science_incomplete", _complete.format(k=K, t="t_sci"))
add("staff_counts", (
    "SELECT school_id, count(*) AS total_teachers_loaded, count(CASE WHEN designation LIKE '%Principal%' THEN 1 END) AS principals, count(CASE WHEN designation LIKE '%TGT%' THEN 1 END) AS tgt_teachers, "
    "count(CASE WHEN designation LIKE '%PGT%' THEN 1 END) AS pgt_teachers, count(CASE WHEN designation LIKE '%PRT%' THEN 1 END) AS prt_teachers FROM t_teacher GROUP BY school_id"))
add("rows_per_year", "SELECT school_id, academic_yr, count(*) AS student_count FROM t_profile GROUP BY ALL")
add("without_parent", f"SELECT {K}, student_name FROM t_demo WHERE parent_id IS NULL")
_role = "CASE role_id WHEN 'P' THEN 'Parent' WHEN 'T' THEN 'Teacher' ELSE 'Principal' END"
add("users_per_role", f"SELECT school_id, role_id, count(*) AS accounts, {_role} AS role_label FROM t_users GROUP BY ALL")
add("schema_checks", (
    "SELECT school_id, 'info' AS level, 'placeholder subjects' AS check, 'dim_subject' AS subject, 0::BIGINT AS value FROM t_school "
    "UNION ALL SELECT school_id, 'info', 'science rows', 'dim_subject', 1 FROM t_school "
    "UNION ALL SELECT s.school_id, CASE WHEN count(teacher_id) = 0 THEN 'warning' ELSE 'info' END, 'teacher records', 'dim_teachers', count(teacher_id) FROM t_school s LEFT JOIN t_teacher t USING (school_id) GROUP BY s.school_id "
    "UNION ALL SELECT s.school_id, CASE WHEN count(student_id) = 0 THEN 'error' ELSE 'info' END, 'unique students', 'student_master_profile', count(DISTINCT student_id) FROM t_school s LEFT JOIN t_clean c USING (school_id) GROUP BY s.school_id "
    "UNION ALL SELECT school_id, 'info', 'students in year', academic_yr, count(DISTINCT student_id) FROM t_clean GROUP BY ALL "
    f"UNION ALL SELECT school_id, 'info', 'accounts', {_role}, count(*) FROM t_users GROUP BY ALL"))
add("run_log", (
    "SELECT s.school_id, coalesce(r.n, 0) AS rows_raw, coalesce(c.n, 0) AS rows_components, coalesce(f.n, 0) AS rows_facts, y.n AS new_years, "
    f"'Backfill range {fv.FIRST_YEAR} to {fv.LAST_YEAR}. Years processed: ' || y.list AS notes FROM t_school s "
    "LEFT JOIN (SELECT school_id, count(*) AS n FROM t_marks GROUP BY 1) r USING (school_id) LEFT JOIN (SELECT school_id, count(*) AS n FROM t_comp GROUP BY 1) c USING (school_id) "
    "LEFT JOIN (SELECT school_id, count(*) AS n FROM t_perf GROUP BY 1) f USING (school_id) LEFT JOIN (SELECT school_id, count(*) AS n, string_agg(academic_yr, ', ' ORDER BY academic_yr) AS list FROM t_years GROUP BY 1) y USING (school_id)"))
_tenant = "CASE WHEN user_id % 2 = 0 THEN 1 ELSE 7 END"
add("run_report", (
    f"SELECT CAST(event_id AS VARCHAR) AS run_id, {big(_tenant)} AS school_id, CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status, "
    "event_id % 500 AS duration_sec, 'run ' || CAST(event_id AS VARCHAR) AS notes FROM events"))
add("run_log_checks", (
    f"SELECT {big(_tenant)} AS school_id, CASE WHEN count(CASE WHEN event_id % 3 <> 0 THEN 1 END) = 0 THEN 'error' ELSE 'info' END AS level, 'last successful run' AS check, "
    "max_by('run ' || CAST(event_id AS VARCHAR), (floor(epoch(ts))::BIGINT + event_id % 500) * 1000000000 + event_id) FILTER (event_id % 3 <> 0) AS subject, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS value FROM events GROUP BY 1"))
add("tenant_lookup", f"SELECT lower(user_id) AS user_key, {big('min(school_id)')} AS school_id FROM t_users GROUP BY 1")

# --- student page --------------------------------------------------------------------------------------------
add("student_profile", (
    f"SELECT {K}, student_name, {_place}, gender, dob, parent_id, guardian_name, guardian_mobile, class_name, section_name, father_name, mother_name, father_contact, mother_contact, {avgs()}, "
    f"{num('att_c')} AS attendance_percentage, {big('hw')} AS homework_assigned_count, strong_subjects, strong_subjects_ai, attendance_band, learning_style, engagement_pattern, primary_strength_axis, "
    f"{big('year_n')} AS year_achievement_count, year_list AS year_achievement_list, {big('ever_n')} AS achievement_count, ever_list AS achievement_list FROM t_sp"))
_three = f"{num('avg_c')} AS avg_percent, {num('written_c')} AS written_avg, {num('oral_c')} AS oral_avg"
add("student_subjects", f"SELECT {K}, {big('subject_id')} AS subject_id, subject_name, {_three}, science_components, CAST(listed AS BIGINT) AS is_scholastic FROM t_cat")
add("subject_performance_all", f"SELECT {K}, subject_name, {avgs()} FROM t_named")
add("subject_vs_class", (
    f"SELECT n.school_id, n.student_id, n.academic_yr, n.subject_name, {_three}, {num('class_c')} AS class_avg_percent FROM t_named n LEFT JOIN t_clean p USING ({K}) LEFT JOIN ("
    f"SELECT f.school_id, f.academic_yr, c.class_id, c.section_id, f.subject_id, {mean_c('sum(f.avg_c)', 'count(f.avg_c)')} AS class_c FROM t_perf f JOIN t_clean c USING ({K}) GROUP BY ALL) a "
    "ON a.school_id = n.school_id AND a.academic_yr = n.academic_yr AND a.class_id = p.class_id AND a.section_id = p.section_id AND a.subject_id = n.subject_id"))
add("exam_breakdown", f"SELECT {K}, exam_type, exam_id, exam_name, subject_name, CAST(o AS DOUBLE) AS marks_obtained, CAST(m AS DOUBLE) AS max_marks FROM t_exambr")
_exam = "CASE WHEN exam_id = 1 THEN 'Term 1' ELSE 'Periodic Test 2' END"
_cat = "coalesce(c.category, 'Scholastic')"
add("exam_report", (
    f"SELECT r.school_id, r.student_id, r.academic_yr, r.exam, x.exam_place, r.subject_name, {_cat} AS category, CASE {_cat} WHEN 'Scholastic' THEN 'SC' WHEN 'Co-Scholastic' THEN 'CS' WHEN 'Social' THEN 'SO' ELSE 'OP' END AS category_abbr, "
    f"CASE {_cat} WHEN 'Scholastic' THEN 0 WHEN 'Co-Scholastic' THEN 1 WHEN 'Social' THEN 2 ELSE 3 END::BIGINT AS category_rank, CASE WHEN c.category = 'Scholastic' THEN 1 ELSE 0 END::BIGINT AS is_scholastic, r.n AS component_count, "
    f"{tenth('r.o')} AS total, {tenth('r.m')} AS max_marks, {tenth('r.o / r.m * 100')} AS avg FROM ("
    f"SELECT {K}, {_exam} AS exam, subject_name, CAST(sum(o) AS DOUBLE) AS o, CAST(sum(m) AS DOUBLE) AS m, count(*) AS n FROM t_exambr GROUP BY ALL) r JOIN ("
    f"SELECT {K}, exam, row_number() OVER (PARTITION BY {K} ORDER BY f, exam) AS exam_place FROM (SELECT {K}, {_exam} AS exam, min(exam_type || '|' || exam_name || '|' || subject_name || '|' || exam_id) AS f FROM t_exambr GROUP BY ALL)) x USING ({K}, exam) "
    "LEFT JOIN t_category c ON c.word = lower(r.subject_name)"))
_ranks = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in fv.COMPONENT_RANKS.items())
add("exam_components", (
    f"SELECT {K}, {_exam} AS exam, exam_id, subject_name, exam_type AS label, {tenth('o::DOUBLE')} AS obtained, {tenth('m::DOUBLE')} AS highest, CASE lower(exam_type) {_ranks} ELSE 99 END::BIGINT AS sort_order FROM t_exambr"))
_advice = values([(r[0], "; ".join(r[1:4]), r[4]) for r in fv.REMEDIAL], "word, focus, action")
add("remedial", (
    f"SELECT {K}, subject_name, {num('avg_c')} AS avg_percent, row_number() OVER (PARTITION BY {K} ORDER BY avg_c, subject_name, subject_id) AS place, "
    f"CASE WHEN avg_c < 3500 THEN {quoted(fv.PRIORITY_URGENT)} ELSE {quoted(fv.PRIORITY_SOME)} END AS priority, coalesce(focus, {quoted('; '.join(fv.REMEDIAL_ELSE[:3]))}) AS focus, coalesce(action, {quoted(fv.REMEDIAL_ELSE[3])}) AS action "
    f"FROM t_cat LEFT JOIN ({_advice}) a ON a.word = lower(subject_name) WHERE avg_c < 5000 AND category = 'Scholastic'"))
_alias = values(list(fv.SUBJECT_ALIASES.items()), "word, shown")
add("subject_groups", (
    f"WITH picked AS (SELECT {K}, subject_name, row_number() OVER (PARTITION BY {K} ORDER BY avg_c DESC, subject_name, subject_id) AS r, max(avg_c) OVER (PARTITION BY {K}) AS top, avg_c FROM t_subj SEMI JOIN t_sp USING ({K})), "
    f"kept AS (SELECT {K}, coalesce(a.shown, subject_name) AS subject_name, r FROM picked LEFT JOIN ({_alias}) a ON a.word = lower(subject_name) WHERE CASE WHEN top >= 7500 THEN avg_c >= 7500 ELSE r <= 5 END) "
    f"SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY r) AS place, subject_name, coalesce(c.category, 'Scholastic') AS category FROM kept LEFT JOIN t_category c ON c.word = lower(subject_name)"))
add("classmates", (
    f"SELECT school_id, academic_yr, class_name, section_name, student_id, student_name, coalesce({tenth(num('avg_c'))}, 0) AS score, coalesce({tenth(num('att_c'))}, 0) AS attendance FROM t_sp"))
add("progress", f"SELECT school_id, parent_id, student_name, academic_yr, student_id, coalesce({tenth(num('avg_c'))}, 0) AS score FROM t_sp")
_direction = "CASE WHEN points >= 2 THEN CASE WHEN last_c > first_c THEN 'improving' WHEN last_c < first_c THEN 'declining' ELSE 'steady' END END"
add("trend_first_last", f"SELECT school_id, parent_id, student_name, points, {num('first_c')} AS first_score, {num('last_c')} AS last_score, {_direction} AS direction FROM t_history")
_tier = "CASE WHEN avg_c IS NULL THEN NULL " + " ".join(f"WHEN avg_c >= {t * 100} THEN {quoted(label)}" for t, label in fv.TIERS) + f" ELSE {quoted(fv.TIER_ELSE)} END"
add("performance_tier", (
    f"SELECT {K}, upper(student_name) AS name, upper(substr(student_name, 1, 1) || CASE WHEN contains(student_name, ' ') THEN substr(list_extract(string_split(student_name, ' '), -1), 1, 1) ELSE '' END) AS avatar, class_name, section_name, "
    f"{percent_text('avg_c')} AS overall_disp, {big('least(coalesce(avg_c, 0) // 100, 100)')} AS overall_pct, {percent_text('att_c')} AS att_disp, {big('least(coalesce(att_c, 0) // 100, 100)')} AS att_pct, {_tier} AS tier, "
    f"CASE WHEN class_name IN {in_list(fv.SENIOR_CLASSES)} THEN 1 ELSE 0 END::BIGINT AS is_senior, {big('ever_n')} AS achievement_count, {big('coalesce(hw, 0)')} AS hw_count, CASE WHEN ever_list = '' THEN 0 ELSE len(string_split(ever_list, ',')) END::BIGINT AS achievement_items FROM t_sp"))
add("selectors", f"SELECT DISTINCT school_id, academic_yr, class_name, section_name, student_name, {big('class_id + 2')} AS class_rank FROM t_sp")
add("years_classes_lists", (
    "SELECT DISTINCT school_id, 'year' AS kind, academic_yr, CAST(NULL AS VARCHAR) AS class_name FROM t_clean UNION ALL SELECT DISTINCT school_id, 'class', academic_yr, CAST(class_id AS VARCHAR) FROM t_clean"))
add("visible_students", f"SELECT p.school_id, p.student_id, p.academic_yr, u.user_id FROM t_sp p JOIN t_users u ON u.school_id = p.school_id AND u.reg_id = p.parent_id AND u.role_id = 'P'")
_staff = "FROM t_users u JOIN t_teacher t ON t.school_id = u.school_id AND t.teacher_id = u.reg_id"
add("visible_classes", f"SELECT u.school_id, u.user_id, {big('t.class_id')} AS class_id, {big('t.section_id')} AS section_id {_staff} WHERE u.role_id = 'T'")
add("teacher_students", f"SELECT p.school_id, p.student_id, p.academic_yr, u.user_id FROM t_sp p JOIN (SELECT u.school_id, u.user_id, t.class_id, t.section_id {_staff} WHERE u.role_id = 'T') u USING (school_id, class_id, section_id)")
add("student_selection", (
    "SELECT school_id, academic_yr, class_name, section_name, min(student_name) AS student_name, "
    "CASE WHEN academic_yr = max(academic_yr) OVER (PARTITION BY school_id) THEN 1 ELSE 0 END::BIGINT AS is_latest_year FROM t_sp GROUP BY school_id, academic_yr, class_name, section_name"))
_class_of = "school_id, academic_yr, class_name, section_name"
add("classmates_of", (
    f"WITH me AS (SELECT {_class_of}, min(student_id) AS me FROM t_sp GROUP BY ALL) SELECT {_class_of}, p.student_id, p.student_name, "
    f"coalesce({tenth(num('avg_c'))}, 0) AS score, coalesce({tenth(num('att_c'))}, 0) AS attendance, me.me, CASE WHEN p.student_id = me.me THEN 1 ELSE 0 END::BIGINT AS is_me FROM t_sp p JOIN me USING ({_class_of})"))
add("orphans", f"SELECT {K}, student_name FROM t_demo WHERE is_active <> 'Y'")
add("achievement_items", (
    f"SELECT {K}, i AS place, trim(list_extract(items, i)) AS item FROM (SELECT {K}, string_split(ever_list, ',') AS items FROM t_sp WHERE ever_list <> ''), LATERAL (SELECT unnest(generate_series(1, len(items))) AS i)"))
add("staff_access", (
    f"SELECT u.school_id, u.user_id, t.teacher_id, t.designation, {big('t.class_id')} AS class_id, {big('t.section_id')} AS section_id, CASE WHEN lower(t.designation) LIKE '%principal%' THEN 1 ELSE 0 END::BIGINT AS is_principal {_staff} WHERE u.role_id IN ('T', 'M')"))
add("child_years", (
    "SELECT p.school_id, p.parent_id, c.latest_student_id, p.academic_yr, p.student_id FROM t_sp p JOIN t_child c USING (school_id, parent_id) WHERE starts_with(upper(p.student_name), upper(split_part(c.display_name, ' ', 1)))"))
_asked = "CAST(2017 + event_id % 10 AS VARCHAR) || '-' || CAST(2018 + event_id % 10 AS VARCHAR)"
add("request_checks", (
    f"SELECT event_id, CAST(user_id % 100 AS VARCHAR) AS student_id, {_asked} AS academic_yr, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS user_id, "
    f"CASE WHEN user_id % 100 = 0 THEN 'student_id' WHEN {_asked} NOT IN {in_list(fv.VALID_YEARS)} THEN 'academic_yr' WHEN event_id % 11 = 0 THEN 'user_id' END AS refused FROM events"))
add("eca_records", (
    "SELECT school_id, id, student_id, title, category, achievement_date, level, coalesce(position, '') AS position, '' AS description, coalesce(certificate_filename, '') AS certificate_filename, "
    "coalesce(certificate_mime, '') AS certificate_mime, CASE WHEN certificate_data IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS has_cert FROM t_eca WHERE known"))

# --- class page -------------------------------------------------------------------------------------------------
add("class_roster", (
    f"SELECT d.school_id, d.student_id, d.academic_yr, CAST(d.class_id AS VARCHAR) AS class_name, x.section_name, " + display("d.student_name", "p.father_name") + f" AS student_name, {num('m.avg_c')} AS avg_percent, {num('m.att_c')} AS attendance_percentage, "
    f"{big('m.achievements')} AS achievements, {big('m.hw')} AS homework_assigned_count, g.attendance_band, g.learning_style, g.primary_strength_axis, s.strong_subjects FROM t_demo d LEFT JOIN t_section x USING (section_id) "
    f"LEFT JOIN t_parent p USING (school_id, parent_id) LEFT JOIN t_profile m USING ({K}) LEFT JOIN t_sig g USING ({K}) LEFT JOIN t_strength s USING ({K}) WHERE d.student_name <> ''"))
add("class_summary", f"SELECT {G}, n_students AS students, {tenth('avg_academic')} AS avg_percent, {tenth('avg_attendance')} AS attendance_percentage FROM t_kpi")
add("class_kpis", "SELECT * FROM t_kpi")
add("at_risk", f"SELECT {G}, risk, student_id, student_name, reg_no, {tenth(num('avg_c'))} AS avg_percent, {tenth(num('att_c'))} AS attendance_percentage FROM t_risk WHERE risk IS NOT NULL")


def histogram(column: str, bins: list[tuple[str, str]]) -> str:
    counts = ", ".join(f"count(CASE WHEN {cond} THEN 1 END) AS b{i}" for i, (_, cond) in enumerate(bins))
    return " UNION ALL ".join(
        f"SELECT {G}, {i}::BIGINT AS bin, {quoted(label)} AS label, b{i} AS students FROM (SELECT {G}, {counts} FROM t_crow GROUP BY ALL)"
        for i, (label, _) in enumerate(bins)
    )


_att = ["att_c < 6000", "att_c >= 6000 AND att_c < 7500", "att_c >= 7500 AND att_c < 8500", "att_c >= 8500 AND att_c < 9000", "att_c >= 9000"]
add("attendance_histogram", histogram("att_c", list(zip(fv.ATTENDANCE_BINS, _att))))
_tens = [(f"{b}–{b + 10}", f"avg_c >= {b * 100} AND avg_c < {b * 100 + 1000}") for b in range(0, 100, 10)]
add("academic_histogram", histogram("avg_c", _tens))
add("academic_histogram_upper", histogram("avg_c", [*_tens[:-1], (_tens[-1][0], "avg_c >= 9000 AND avg_c <= 10000")]))
_signals = " UNION ALL ".join(f"SELECT {G}, '{c}' AS signal, {c} AS label FROM t_crow WHERE {c} IS NOT NULL" for c in ("attendance_band", "learning_style", "engagement_pattern"))
add("signal_distribution", (
    f"SELECT *, {big('round_even(CAST(students AS DOUBLE) / sum(students) OVER (PARTITION BY ' + G + ', signal) * 100, 0)')} AS pct FROM (SELECT {G}, signal, label, count(*) AS students FROM ({_signals}) GROUP BY ALL)"))
_zone_names = values([(fv.ZONE_BOTH,), (fv.ZONE_ACADEMIC,), (fv.ZONE_PRESENT,), (fv.ZONE_NEITHER,)], "zone")
add("class_zones", (
    f"SELECT {G}, n_students, zone, students, {big('round_even(CAST(students AS DOUBLE) / n_students * 100, 0)')} AS pct FROM (SELECT k.school_id, k.academic_yr, k.class_name, k.section, k.n_students, z.zone, count(p.student_id) AS students "
    f"FROM t_kpi k CROSS JOIN ({_zone_names}) z LEFT JOIN t_point p ON p.school_id = k.school_id AND p.academic_yr = k.academic_yr AND p.class_name = k.class_name AND p.section = k.section AND p.zone = z.zone GROUP BY ALL)"))
add("zone_points", f"SELECT {G}, student_id, student_name, n_students, {tenth(num('att_c'))} AS x, {tenth(num('avg_c'))} AS y, zone FROM t_point")
_share = "round_even({}, 0)::BIGINT::VARCHAR"
add("class_insight", (
    f"SELECT {G}, insight, CASE insight WHEN 'risk' THEN {_share.format('risk')} || '% of students are showing both low attendance and low academic scores — early intervention is recommended.' "
    f"WHEN 'thriving' THEN {_share.format('well')} || '% of students are academically on track with good attendance. The class is performing well overall.' "
    f"WHEN 'attendance' THEN 'Only ' || {_share.format('good')} || '% of students have attendance above 85%. Improving attendance could boost academic outcomes.' "
    "ELSE 'Class average is ' || coalesce(printf('%.1f', avg_academic), 'nan') || '% academic, ' || coalesce(printf('%.1f', avg_attendance), 'nan') || '% attendance. ' || CAST(count_at_risk_both AS VARCHAR) || ' student(s) need priority support.' END AS insight_text FROM ("
    "SELECT *, CASE WHEN risk > 20 THEN 'risk' WHEN well >= 70 THEN 'thriving' WHEN good < 50 THEN 'attendance' ELSE 'average' END AS insight FROM ("
    "SELECT k.*, CAST(count_at_risk_both AS DOUBLE) / n_students * 100 AS risk, CAST(count_good_attendance AS DOUBLE) / n_students * 100 AS good, CAST(coalesce(t.n, 0) AS DOUBLE) / n_students * 100 AS well "
    f"FROM t_kpi k LEFT JOIN (SELECT {G}, count(*) AS n FROM t_point WHERE zone = 'Thriving' GROUP BY ALL) t USING ({G})))"))
_medal = "CASE place " + " ".join(f"WHEN {i + 1} THEN {quoted(m)}" for i, m in enumerate(fv.MEDALS)) + " END"
add("top_performers", f"SELECT {G}, place, student_id, student_name, reg_no, {tenth(num('avg_c'))} AS avg_percent, {_medal} AS medal FROM (SELECT *, {PLACE.format('DESC')} AS place FROM t_crow WHERE avg_c > 8000) WHERE place <= 5")
add("needs_support", f"SELECT {G}, place, student_id, student_name, reg_no, {tenth(num('avg_c'))} AS avg_percent FROM (SELECT *, {PLACE.format('')} AS place FROM t_crow WHERE avg_c < 3500) WHERE place <= 10")
_marks = (
    f"SELECT f.school_id, f.academic_yr, m.class_name, {big('f.subject_id')} AS subject_id, f.student_id, " + display("d.student_name", "p.father_name") + f" AS student_name, {num('f.avg_c')} AS subject_avg, {num('f.written_c')} AS written_avg, {num('f.oral_c')} AS oral_avg "
    f"FROM t_perf f JOIN t_demo d USING ({K}) LEFT JOIN t_parent p USING (school_id, parent_id) JOIN t_map m ON m.school_id = f.school_id AND m.academic_yr = f.academic_yr AND m.subject_id = f.subject_id")
add("class_subject_marks", f"{_marks} AND m.class_name = CAST(d.class_id AS VARCHAR) WHERE d.student_name <> ''")
add("class_subject_marks_wide", f"{_marks} WHERE d.student_name <> ''")
add("class_subjects", (
    f"SELECT m.school_id, m.academic_yr, m.class_name, {big('m.subject_id')} AS subject_id, s.subject_name, CASE WHEN EXISTS (SELECT 1 FROM t_perf f JOIN t_demo d USING ({K}) WHERE f.school_id = m.school_id AND f.academic_yr = m.academic_yr "
    "AND f.subject_id = m.subject_id AND CAST(d.class_id AS VARCHAR) = m.class_name AND d.student_name <> '') THEN 1 ELSE 0 END::BIGINT AS has_marks FROM t_map m JOIN t_dimsub s USING (school_id, subject_id)"))

# --- careers and insight --------------------------------------------------------------------------------------------
add("subject_levels", f"SELECT {K}, {big('subject_id')} AS subject_id, subject_name, {num('avg_c')} AS avg_percent, level FROM t_level")
add("careers_first_match", f"SELECT {K}, place, career, reason, subject_name AS subject FROM t_career")
add("careers_longest_match", (
    f"SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY subject_place, ord) AS place, career, reason, subject_name AS subject FROM (SELECT s.school_id, s.student_id, s.academic_yr, s.subject_place, s.subject_name, r.ord, r.career, r.reason FROM t_strongrow s "
    f"JOIN t_firstword f USING (school_id, subject_id) JOIN t_acareer r ON r.word = f.longest_word QUALIFY row_number() OVER (PARTITION BY {K}, career ORDER BY subject_place, r.ord) = 1)"))
add("careers_shown", f"SELECT {K}, career, reason, subject_name AS subject, shown_place FROM t_shown")
add("careers_all_match", f"SELECT {K}, place, career, reason, subject_name AS subject FROM t_listcareer")
add("achievement_careers", f"SELECT {K}, place, career, reason, skill FROM t_achcareer")
add("achievement_categories", (
    "WITH RECURSIVE texts AS MATERIALIZED (SELECT list, regexp_split_to_array(list, ', ?') AS items FROM (SELECT DISTINCT ever_list AS list FROM t_sp WHERE ever_list <> '')), "
    "steps AS (SELECT list, items, 0 AS i, []::VARCHAR[] AS seen, NULL::VARCHAR AS title, NULL::VARCHAR AS category, NULL::VARCHAR AS signal FROM texts UNION ALL "
    "SELECT list, items, i + 1, CASE WHEN hit IS NULL THEN seen ELSE list_append(seen, hit.category) END, items[i + 1], hit.category, hit.signal FROM ("
    "SELECT s.list, s.items, s.i, s.seen, (SELECT min_by({'category': r.category, 'signal': r.signal}, r.ord) FROM t_achrule r WHERE contains(lower(s.items[s.i + 1]), r.word) AND NOT list_contains(s.seen, r.category)) AS hit FROM steps s WHERE s.i < len(s.items))) "
    f"SELECT p.school_id, p.student_id, p.academic_yr, row_number() OVER (PARTITION BY {K} ORDER BY i) AS place, title, category, signal AS career_signal FROM t_sp p JOIN steps s ON s.list = p.ever_list WHERE category IS NOT NULL"))
add("goal_required_subjects", "SELECT school_id, student_id, career_goal, coalesce(first_needed, '') AS required_first, coalesce(longest_needed, '') AS required_longest FROM t_goalword")
add("goal_supported", f"SELECT {K}, career_goal, needed AS required_subjects, status, career AS goal_career, reason AS goal_reason, subject AS goal_subject FROM t_goalstatus")
_title = "CASE career_goal WHEN 'Unknown goal' THEN 'Unknown Goal' WHEN 'law & governance' THEN 'Law & Governance' ELSE career_goal END"
_nl = "chr(10)"
add("career_report", (
    f"WITH strong AS (SELECT {K}, string_agg(subject_name, ', ' ORDER BY subject_place) AS names FROM t_strongrow GROUP BY {K}), "
    f"paths AS (SELECT {K}, string_agg('* ' || career || ' — ' || subject_name || ' — ' || reason || '.', {_nl} ORDER BY shown_place) AS body, min_by(career, shown_place) AS career1, min_by(subject_name, shown_place) AS subject1 FROM t_shown GROUP BY {K}), "
    "base AS (SELECT g.*, split_part(p.student_name, ' ', 1) AS who, coalesce(CAST(p.avg_c AS DOUBLE) / 100, 0) AS overall, p.class_name, "
    f"coalesce(s.names, 'multiple subjects') AS names, h.body, h.career1, h.subject1, 'Goal: ' || {_title} || ':' AS heading FROM t_goalstatus g JOIN t_sp p USING ({K}) LEFT JOIN strong s USING ({K}) LEFT JOIN paths h USING ({K})) "
    f"SELECT {K}, career_goal, status, who || ' demonstrates ' || CASE WHEN overall >= 85 THEN 'an exceptional' WHEN overall >= 70 THEN 'a strong' ELSE 'a developing' END || ' academic profile with an overall average of ' || printf('%.1f', overall) || '%, showing particular strength in ' || names || '.' || {_nl} || "
    f"CASE status WHEN 'supported' THEN 'The goal of becoming a ' || career_goal || ' is well-supported — ' || who || ' already scores strongly in ' || subject || ', which is a key subject for this path.' || {_nl} || {_nl} || heading || {_nl} || '* Key supporting subject: ' || subject || {_nl} || '* Why it fits: ' || reason || '.' || {_nl} || '* Next step: Build on ' || subject || ' and explore related entrance exams and college options early.' "
    f"WHEN 'not yet supported' THEN 'To reach the goal of ' || career_goal || ', ' || who || ' will need to build strong scores in ' || needed || ' — these are the core subjects for this career.' || {_nl} || {_nl} || heading || {_nl} || '* Subjects needed: ' || needed || {_nl} || '* Next step: Focus on these subjects in upcoming terms to keep this goal within reach.' "
    f"ELSE {_nl} || heading || {_nl} || '* This goal could not be directly matched to current subject scores.' || {_nl} || '* Next step: Speak with a school counsellor to explore which subjects align with this career.' END || {_nl} || {_nl} || 'Potential Career Paths:' || {_nl} || "
    f"coalesce(body, '* Focus on building subject scores to unlock more career path recommendations.') || CASE WHEN body IS NOT NULL AND class_name IN {in_list(fv.SENIOR_CLASSES)} THEN {_nl} || {_nl} || 'Suggested Colleges & Entrance Exams:' || {_nl} || '* Research entrance exams aligned with ' || career1 || '.' || {_nl} || '* Look into universities offering programmes in ' || subject1 || '-related fields.' || {_nl} || '* Speak with your school counsellor for institution-specific guidance.' ELSE '' END AS report FROM base"))
_core = f"SELECT {K}, coalesce(string_agg(CASE WHEN is_core = 1 THEN spelled END, ', ' ORDER BY list_place), '') AS core, coalesce(string_agg(CASE WHEN is_core = 0 THEN spelled END, ', ' ORDER BY list_place), '') AS supporting FROM t_list GROUP BY {K}"
add("core_supporting", _core)
add("science_note", f"SELECT {K}, science_note FROM t_notetext")
add("career_options", f"SELECT {K}, option_place, career, reason, subject FROM t_option")
_shown = "CASE WHEN coalesce({c}, 0) <> 0 THEN printf('%.2f', " + num("{c}") + ") ELSE 'not available' END"
add("insight_context", (
    f"SELECT p.school_id, p.student_id, p.academic_yr, p.student_name, p.class_name, {_shown.format(c='avg_c')} AS overall, {_shown.format(c='written_c')} AS written, {_shown.format(c='oral_c')} AS internal, "
    "CASE WHEN coalesce(core, '') <> '' THEN core ELSE 'not identified' END AS core_subjects, CASE WHEN coalesce(supporting, '') <> '' THEN supporting ELSE 'none' END AS supporting_subjects, CASE WHEN ever_list <> '' THEN ever_list ELSE 'none recorded' END AS achievements, "
    f"CASE WHEN coalesce(written_c, 0) = 0 OR coalesce(oral_c, 0) = 0 THEN 'unknown' WHEN oral_c > written_c + 1000 THEN {quoted(fv.COMM_ORAL)} WHEN written_c > oral_c + 1000 THEN {quoted(fv.COMM_WRITTEN)} ELSE {quoted(fv.COMM_BALANCED)} END AS communication_style, "
    f"coalesce(science_note, '') AS science_note, CASE WHEN points >= 2 THEN 'Historical trend: ' || {_direction} || ' (from ' || printf('%.1f', {num('first_c')}) || '% to ' || printf('%.1f', {num('last_c')}) || '%)' ELSE '' END AS trend_note, "
    "coalesce(block, 'No strongly mapped careers identified from current subjects.') AS career_block, CASE WHEN CAST(p.class_name AS INT) >= 7 THEN 1 ELSE 0 END::BIGINT AS is_senior, "
    "CASE WHEN coalesce(avg_c, 0) <> 0 OR coalesce(written_c, 0) <> 0 OR coalesce(oral_c, 0) <> 0 OR coalesce(strong_subjects, '') <> '' THEN 1 ELSE 0 END::BIGINT AS has_data "
    f"FROM t_sp p LEFT JOIN ({_core}) c USING ({K}) LEFT JOIN t_notetext USING ({K}) LEFT JOIN (SELECT {K}, string_agg('- ' || career || ' (because of ' || subject || ': ' || reason || ')', {_nl} ORDER BY option_place) AS block FROM t_option GROUP BY {K}) o USING ({K}) "
    "LEFT JOIN t_history h USING (school_id, parent_id, student_name)"))
add("insight_fallback", (
    f"WITH fields AS (SELECT {K}, string_agg(career, ', ' ORDER BY place) AS fields FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY list_place, ord) AS n FROM t_listcareer WHERE is_core = 1) WHERE n <= 2 GROUP BY {K}), "
    f"names AS (SELECT {K}, string_agg(subject_name, ', ' ORDER BY list_place) AS names FROM t_list WHERE is_core = 1 AND list_place <= 2 GROUP BY {K}), "
    "t AS (SELECT p.*, f.fields, n.names, printf('%.2f', CAST(avg_c AS DOUBLE) / 100) AS o FROM t_sp p "
    f"LEFT JOIN fields f USING ({K}) LEFT JOIN names n USING ({K})) "
    f"SELECT {K}, CASE WHEN coalesce(avg_c, 0) = 0 AND coalesce(written_c, 0) = 0 AND coalesce(oral_c, 0) = 0 AND coalesce(strong_subjects, '') = '' THEN {quoted(fv.NO_DATA_MESSAGE)} "
    "WHEN coalesce(avg_c, 0) <> 0 AND coalesce(strong_subjects, '') <> '' AND fields IS NOT NULL THEN 'Strong performance across core subjects (overall ' || o || '%). Based on subject profile, potential directions include: ' || fields || '.' "
    "WHEN coalesce(avg_c, 0) <> 0 AND coalesce(strong_subjects, '') <> '' THEN 'Strong performance in ' || coalesce(names, substr(strong_subjects, 1, 40)) || ' (overall ' || o || '%). Detailed career mapping will appear once more assessment data is available.' "
    f"ELSE {quoted(fv.WAITING_MESSAGE)} END AS insight_text, "
    f"student_name || ' has an overall average of ' || {percent_text('avg_c')} || ' and attends ' || {percent_text('att_c')} || ' of school days. Once more data is recorded, a personalised AI summary will appear here.' AS page_text FROM t"))
_two = "coalesce(printf('%.2f', " + num("{}") + "), '')"
add("profile_fingerprint", (
    f"SELECT {K}, md5(student_name || '|' || coalesce(class_name, '') || '|' || {_two.format('avg_c')} || '|' || {_two.format('written_c')} || '|' || {_two.format('oral_c')} || '|' || coalesce(strong_subjects, '') || '|' || coalesce(strong_subjects_ai, '') || '|' || ever_list) AS fingerprint FROM t_sp"))

# --- change batches -----------------------------------------------------------------------------------------------------
_record = "school_id, id, student_id, {title} AS title, category, achievement_date, level, position, CAST(NULL AS VARCHAR) AS description, {f} AS certificate_filename, {d} AS certificate_data, {m} AS certificate_mime, submitted_by_parent_id"
_new_title = "CASE WHEN id % 7 <> 0 THEN 'New ' || title END"
_old = _record.format(title="title", f="certificate_filename", d="certificate_data", m="certificate_mime")
_fresh = _record.format(title=_new_title, f="CASE WHEN id % 3 <> 0 THEN 'b.png' END", d="CASE WHEN id % 3 <> 0 THEN 'REVG' END", m="CASE WHEN id % 3 <> 0 THEN 'image/png' END")
_touched = _record.format(
    title=_new_title, f="CASE WHEN id % 3 <> 0 THEN 'b.png' ELSE certificate_filename END",
    d="CASE WHEN id % 3 <> 0 THEN 'REVG' ELSE certificate_data END", m="CASE WHEN id % 3 <> 0 THEN 'image/png' ELSE certificate_mime END")
add("eca_apply_changes", (
    f"SELECT {_old} FROM t_eca WHERE known AND (title = '4-NOT SPECIFIED' OR id <= 0) UNION ALL SELECT {_touched} FROM t_judged WHERE op = 'update' AND reject_reason IS NULL "
    f"UNION ALL SELECT {_fresh} FROM t_judged WHERE op = 'insert' AND reject_reason IS NULL"))
add("eca_rejected", f"SELECT school_id, id, op, {big('seq')} AS seq, reject_reason FROM t_judged WHERE reject_reason IS NOT NULL")


def _merge(select: str) -> str:
    """Put the shared expressions before a SELECT that has its own WITH."""
    for head in ("WITH RECURSIVE ", "WITH "):
        if select.startswith(head):
            shared = with_ctes(select)
            return shared.replace(f") {select}", f"), {select[len(head):]}", 1).replace("WITH ", head, 1)
    return with_ctes(select)


def oracle_sql() -> dict[str, str]:
    return {name: _merge(select) for name, select in SELECTS.items()}
