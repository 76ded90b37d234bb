"""Common table expressions over the given tables, in exact whole-number arithmetic.

Averages are kept as hundredths (``*_c`` columns, BIGINT) and become doubles in the final SELECT.
"""

from __future__ import annotations

import re

from chalkline.functions import fixed_values as fv
from chalkline.sources import order_school as src


def quoted(value) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def numbered(rows):
    return [(i, *r) for i, r in enumerate(rows)]


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def pct_c(part: str, whole: str) -> str:
    """Hundredths of part / whole * 100, half up."""
    w = f"CAST({whole} AS BIGINT)"
    return f"((20000 * CAST({part} AS BIGINT) + {w}) // nullif(2 * {w}, 0))"


def mean_c(total: str, n: str) -> str:
    """Hundredths of the mean of hundredths, half up."""
    return f"((2 * CAST({total} AS BIGINT) + {n}) // nullif(2 * {n}, 0))"


def num(hundredths: str) -> str:
    return f"(CAST({hundredths} AS DOUBLE) / 100)"


def tenth(x: str) -> str:
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def avgs(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (
        f"{num(a + 'avg_c')} AS avg_percent, {num(a + 'written_c')} AS written_avg, {num(a + 'oral_c')} AS oral_avg, "
        f"{big(a + 'exams_taken')} AS exams_taken"
    )


K = "school_id, student_id, academic_yr"
SID = "CASE WHEN {} < 13 THEN 1 ELSE 7 END"
YEARS = f"academic_yr BETWEEN '{fv.FIRST_YEAR}' AND '{fv.LAST_YEAR}'"
W, I = in_list(fv.WRITTEN_HEADINGS), in_list(fv.INTERNAL_HEADINGS)
SCIENCE_CLASSES = in_list(fv.SCIENCE_CLASSES)


def display(name: str, father: str) -> str:
    return (
        f"CASE WHEN trim({name}) LIKE '% %' THEN trim({name}) "
        f"WHEN {father} IS NOT NULL AND trim({father}) <> '' THEN trim({name}) || ' ' || split_part(trim({father}), ' ', 1) "
        f"ELSE trim({name}) END"
    )


def ratio(m: str, top: str, written: str, internal: str, exam: str = "exam_id") -> str:
    return (
        f"{pct_c(f'sum({m})', f'sum({top})')} AS avg_c, "
        f"{pct_c(f'sum(CASE WHEN {written} THEN {m} END)', f'sum(CASE WHEN {written} THEN {top} END)')} AS written_c, "
        f"{pct_c(f'sum(CASE WHEN {internal} THEN {m} END)', f'sum(CASE WHEN {internal} THEN {top} END)')} AS oral_c, "
        f"count(DISTINCT {exam}) AS exams_taken"
    )


def mean_of_ratios() -> str:
    def one(cond: str) -> str:
        return f"{mean_c(f'sum(CASE WHEN {cond} THEN 200 * mark END)', f'count(CASE WHEN {cond} THEN mark END)')}"

    return (
        f"{one('true')} AS avg_c, {one(flag('Y'))} AS written_c, {one(flag('N'))} AS oral_c, count(DISTINCT exam_id) AS exams_taken"
    )


def flag(value: str) -> str:
    return f"written_exam = '{value}'"


_headings = [(i + 1, n, "Y" if n in ("Written", "Term") else "N") for i, n in enumerate(src.HEADINGS)]
_kinds = {11: "Co-Scholastic", 12: "Co-Scholastic", 13: "Co-Scholastic", 14: "Co-Scholastic", 18: "Social"}
_master = [(i + 1, n, _kinds.get(i + 1, "Scholastic")) for i, n in enumerate(src.SUBJECT_NAMES)]
_categories = [(s, c) for c, names in fv.SUBJECTS_BY_CATEGORY.items() for s in names]

CTES: dict[str, str] = {
    "t_school": values([(1,), (7,)], "school_id"),
    "t_ord": (
        f"SELECT o.*, c.c_nationkey, {SID.format('c.c_nationkey')} AS school_id, year(o.o_orderdate) AS y, "
        "CAST(year(o.o_orderdate) + 24 AS VARCHAR) || '-' || CAST(year(o.o_orderdate) + 25 AS VARCHAR) AS academic_yr "
        "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
    ),
    "t_line": "SELECT l.*, t.o_custkey AS student_id, t.school_id, t.y, t.academic_yr, t.c_nationkey FROM lineitem l JOIN t_ord t ON l.l_orderkey = t.o_orderkey",
    "t_student": (
        "SELECT DISTINCT school_id, o_custkey AS student_id, academic_yr, "
        "CASE WHEN o_custkey % 50 = 1 THEN '12345' WHEN o_custkey % 3 = 0 THEN ' Stu' || CAST(o_custkey % 2 AS VARCHAR) || ' ' "
        "ELSE 'Stu' || CAST(o_custkey % 2 AS VARCHAR) || ' Fam' || CAST(o_custkey AS VARCHAR) END AS student_name, "
        "'R' || CAST(o_custkey AS VARCHAR) AS reg_no, CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, "
        "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE '2010-06-15' END AS dob, "
        "CAST((o_custkey + y) % 12 + 1 AS INT) AS class_id, c_nationkey % 4 + 1 AS section_id, "
        "'Indian' AS nationality, CASE o_custkey % 3 WHEN 0 THEN 'GEN' WHEN 1 THEN 'OBC' ELSE 'SC' END AS category, "
        "CASE WHEN o_custkey % 97 <> 0 THEN o_custkey - o_custkey % 2 END AS parent_id, "
        "'Guardian' || CAST(o_custkey - o_custkey % 2 AS VARCHAR) AS guardian_name, "
        "CASE WHEN o_custkey % 4 <> 0 THEN '9' || CAST(o_custkey AS VARCHAR) END AS guardian_mobile, "
        "CASE WHEN o_custkey % 29 = 0 THEN 'Y' ELSE 'N' END AS is_delete, "
        "CASE WHEN o_custkey % 7 = 0 THEN 'N' ELSE 'Y' END AS is_active FROM t_ord"
    ),
    "t_parentkey": f"SELECT DISTINCT {SID.format('c_nationkey')} AS school_id, c_custkey - c_custkey % 2 AS parent_id FROM customer",
    "t_parent": (
        "SELECT school_id, parent_id, CASE WHEN parent_id % 5 = 0 THEN NULL WHEN parent_id % 7 = 0 THEN '' "
        "ELSE 'Father' || CAST(parent_id AS VARCHAR) || ' Fam' END AS father_name, "
        "'Mother' || CAST(parent_id AS VARCHAR) AS mother_name, '7' || CAST(parent_id AS VARCHAR) AS father_contact, "
        "'8' || CAST(parent_id AS VARCHAR) AS mother_contact, CASE WHEN parent_id % 31 = 0 THEN 'Y' ELSE 'N' END AS is_delete FROM t_parentkey"
    ),
    "t_section": values([(i + 1, n) for i, n in enumerate(src.SECTIONS)], "section_id, section_name"),
    "t_heading": values(_headings, "heading, heading_name, written_exam"),
    "t_exam": values([(i + 1, n) for i, n in enumerate(src.EXAMS)], "exam_id, exam_name"),
    "t_master": values(_master, "sm_id, name, subject_type"),
    "t_dimsub": (
        f"SELECT school_id, sm_id AS subject_id, name AS subject_name, subject_type FROM t_master CROSS JOIN t_school WHERE name NOT IN {in_list(fv.PLACEHOLDER_SUBJECTS)} "
        "UNION ALL SELECT school_id, 24, 'Science', 'Scholastic' FROM t_school"
    ),
    "t_teacher": (
        f"SELECT {SID.format('s_nationkey')} AS school_id, s_suppkey AS teacher_id, s_name AS name, "
        "CASE s_suppkey % 5 WHEN 0 THEN 'Vice Principal' WHEN 1 THEN 'TGT Maths' WHEN 2 THEN 'PGT Physics' WHEN 3 THEN 'PRT' ELSE 'Clerk' END AS designation, "
        "s_suppkey % 12 + 1 AS class_id, s_nationkey % 4 + 1 AS section_id FROM supplier WHERE s_suppkey % 13 <> 0"
    ),
    "t_users": (
        f"SELECT {SID.format('c_nationkey')} AS school_id, 'P' || CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, "
        "c_custkey - c_custkey % 2 AS reg_id, 'P' AS role_id FROM customer WHERE c_custkey % 17 <> 0 "
        f"UNION ALL SELECT {SID.format('s_nationkey')}, 't' || CAST(s_suppkey AS VARCHAR), s_name, s_suppkey, "
        "CASE WHEN s_suppkey % 5 = 0 THEN 'M' ELSE 'T' END FROM supplier"
    ),
    "t_years": f"SELECT DISTINCT school_id, academic_yr FROM t_student WHERE {YEARS}",
    "t_rev": (
        "SELECT school_id, student_id, academic_yr, y, c_nationkey, l_partkey % 20 + 1 AS subject_id, l_suppkey % 3 + 1 AS exam_id, "
        "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS rev, l_linenumber AS heading, "
        "CAST(trunc(max(l_quantity)) AS BIGINT) AS mark, CASE WHEN max(l_returnflag) = 'R' THEN 'N' ELSE 'Y' END AS present, "
        "max(l_shipdate) AS last_day FROM t_line GROUP BY ALL"
    ),
    "t_marks": (
        "SELECT school_id, student_id, academic_yr, y, c_nationkey, subject_id, exam_id, rev, max(last_day) AS last_day, "
        "(((student_id * 8 + y - 1995) * 32 + subject_id) * 8 + exam_id) * 2 + rev AS marks_id FROM t_rev GROUP BY ALL"
    ),
    "t_latest": "SELECT * FROM t_marks QUALIFY row_number() OVER (PARTITION BY school_id, student_id, subject_id, exam_id, academic_yr ORDER BY marks_id DESC) = 1",
    "t_comp": (
        "SELECT r.school_id, r.student_id, r.academic_yr, r.subject_id, r.exam_id, r.heading, r.mark, r.present, h.heading_name, h.written_exam "
        "FROM t_rev r JOIN t_latest t USING (school_id, student_id, academic_yr, subject_id, exam_id, rev) JOIN t_heading h USING (heading) "
        "WHERE r.subject_id % 10 <> 9"
    ),
    "t_acad": f"SELECT {K}, {ratio('mark', '50', f'heading IN {W}', f'heading IN {I}')} FROM t_comp SEMI JOIN t_years USING (school_id, academic_yr) WHERE present = 'Y' GROUP BY {K}",
    "t_classcomp": (
        "SELECT c.school_id, c.student_id, c.academic_yr, c.subject_id, c.exam_id, c.heading, c.mark, c.heading_name, s.class_id, "
        f"CAST(s.class_id AS VARCHAR) IN {SCIENCE_CLASSES} AND c.subject_id IN (15, 16, 17) AS is_science "
        "FROM t_comp c JOIN t_student s USING (school_id, student_id, academic_yr) "
        f"WHERE c.present = 'Y' AND s.is_delete = 'N' AND (c.subject_id + s.class_id) % 7 <> 0 AND {YEARS}"
    ),
    "t_perf": (
        f"SELECT {K}, CASE WHEN is_science THEN 24 ELSE subject_id END AS subject_id, {ratio('mark', '50', f'heading IN {W}', f'heading IN {I}')} "
        "FROM t_classcomp GROUP BY school_id, student_id, academic_yr, CASE WHEN is_science THEN 24 ELSE subject_id END"
    ),
    "t_sci": (
        f"SELECT {K}, CASE subject_id WHEN 15 THEN 'Physics' WHEN 16 THEN 'Chemistry' ELSE 'Biology' END AS component, "
        f"{pct_c('sum(mark)', 'sum(50)')} AS avg_c, 1 AS is_entered FROM t_classcomp WHERE is_science GROUP BY {K}, subject_id"
    ),
    "t_sciall": (
        f"SELECT * FROM t_sci UNION ALL SELECT e.*, n.component, NULL, 0 FROM (SELECT DISTINCT {K} FROM t_sci) e "
        "CROSS JOIN (VALUES ('Physics'), ('Chemistry'), ('Biology')) n(component) "
        "WHERE NOT EXISTS (SELECT 1 FROM t_sci s WHERE s.school_id = e.school_id AND s.student_id = e.student_id AND s.academic_yr = e.academic_yr AND s.component = n.component)"
    ),
    "t_scitext": (
        f"SELECT {K}, string_agg(CASE WHEN is_entered = 0 THEN component || ' (not assessed)' ELSE component END, ', ' "
        f"ORDER BY is_entered DESC, avg_c DESC NULLS LAST, component) AS science_components FROM t_sciall GROUP BY {K}"
    ),
    "t_day": (
        f"SELECT {K}, count(*) AS total, count(CASE WHEN l_discount < 0.09 THEN 1 END) AS p, count(CASE WHEN l_discount >= 0.10 THEN 1 END) AS a "
        f"FROM t_line WHERE {YEARS} GROUP BY {K}"
    ),
    "t_att": f"SELECT {K}, total, p, {pct_c('p', 'total')} AS att_c FROM t_day",
    "t_achsrc": (
        "SELECT school_id, o_custkey AS student_id, academic_yr, o_orderkey, o_orderdate AS d, "
        "list_extract([" + ", ".join(quoted(e) for e in src.EVENTS) + f"], CAST(o_orderkey % {len(src.EVENTS)} + 1 AS BIGINT)) AS event, "
        "CASE WHEN o_orderkey % 3 = 2 THEN 'First' END AS place FROM t_ord"
    ),
    "t_ach": (
        f"SELECT {K}, count(*) AS n, string_agg(CASE WHEN o_orderkey % 2 = 0 THEN event ELSE event || ' Cup' END, ', ' ORDER BY d, o_orderkey) AS list "
        f"FROM t_achsrc WHERE {YEARS} GROUP BY {K}"
    ),
    "t_achall": "SELECT school_id, student_id, sum(n) AS n, string_agg(list, ', ' ORDER BY academic_yr) AS list FROM t_ach GROUP BY school_id, student_id",
    "t_achtext": (
        "SELECT school_id, student_id, sum(n) AS n, string_agg(entry, ', ' ORDER BY academic_yr, event, entry) AS list FROM ("
        "SELECT school_id, student_id, academic_yr, event, academic_yr || ': ' || event || CASE WHEN place IS NULL THEN '' ELSE ' - ' || place END AS entry, count(*) AS n "
        "FROM t_achsrc GROUP BY ALL) GROUP BY school_id, student_id"
    ),
    "t_achtotal": (
        "SELECT school_id, student_id, sum(n) AS n, string_agg(list, ', ' ORDER BY first_yr, list) AS list FROM ("
        "SELECT school_id, student_id, list, sum(n) AS n, min(academic_yr) AS first_yr FROM t_ach GROUP BY school_id, student_id, list) GROUP BY school_id, student_id"
    ),
    "t_hw": f"SELECT {K}, count(DISTINCT l_orderkey) AS hw FROM t_line WHERE {YEARS} GROUP BY {K}",
    "t_clean": f"SELECT {K}, reg_no, class_id, section_id FROM t_student WHERE is_delete = 'N' AND {YEARS}",
    "t_demo": f"SELECT * REPLACE (trim(student_name) AS student_name) FROM t_student WHERE is_delete = 'N' AND {YEARS}",
    "t_profile": (
        "SELECT c.*, a.avg_c, a.written_c, a.oral_c, a.exams_taken, t.att_c, coalesce(h.n, 0) AS achievements, coalesce(w.hw, 0) AS hw FROM t_clean c "
        f"LEFT JOIN t_acad a USING ({K}) LEFT JOIN t_att t USING ({K}) LEFT JOIN t_ach h USING ({K}) LEFT JOIN t_hw w USING ({K})"
    ),
    "t_sig": (
        f"SELECT {K}, CASE WHEN att_c >= 9000 THEN 'Highly Consistent' WHEN att_c >= 7500 THEN 'Moderately Consistent' ELSE 'Irregular' END AS attendance_band, "
        "CASE WHEN written_c > oral_c THEN 'Conceptual / Written-Oriented' WHEN oral_c > written_c THEN 'Experiential / Oral-Oriented' ELSE 'Balanced' END AS learning_style, "
        "CASE WHEN hw > 0 THEN 'Academically Engaged' ELSE 'Low Visible Engagement' END AS engagement_pattern, "
        "CASE WHEN avg_c >= 8500 THEN 'Academic Excellence' WHEN achievements > 0 THEN 'Co-Curricular Strength' ELSE 'Developing Potential' END AS primary_strength_axis FROM t_profile"
    ),
    "t_named": "SELECT p.*, d.subject_name FROM t_perf p JOIN t_dimsub d USING (school_id, subject_id)",
    "t_strongname": (
        "SELECT n.school_id, n.student_id, n.academic_yr, subject_name, max(avg_c) AS best, "
        "any_value(CASE WHEN subject_name = 'Science' THEN 'Science (' || coalesce(science_components, 'combined') || ')' ELSE subject_name END) AS spelled "
        f"FROM t_named n LEFT JOIN t_scitext s USING ({K}) WHERE avg_c >= 7500 GROUP BY ALL"
    ),
    "t_strength": (
        f"SELECT {K}, string_agg(subject_name, ', ' ORDER BY best DESC, subject_name) AS strong_subjects, "
        f"string_agg(spelled, ', ' ORDER BY best DESC, spelled) AS strong_subjects_ai FROM t_strongname GROUP BY {K}"
    ),
    "t_trend": (
        f"SELECT {K}, avg_c, lag(avg_c) OVER (PARTITION BY school_id, student_id ORDER BY academic_yr) AS prev_c FROM t_profile"
    ),
    "t_trendlabel": (
        f"SELECT {K}, avg_c, prev_c, avg_c - prev_c AS growth_c, CASE WHEN prev_c IS NULL THEN 'Baseline Year' WHEN avg_c > prev_c THEN 'Improving' "
        "WHEN avg_c < prev_c THEN 'Declining' ELSE 'Stable' END AS performance_trend FROM t_trend"
    ),
    "t_confidence": (
        "SELECT p.school_id, p.student_id, p.academic_yr, coalesce(p.avg_c, 0) * 30 + coalesce(p.att_c, 0) * 20 "
        "+ CASE t.performance_trend WHEN 'Improving' THEN 40000 WHEN 'Stable' THEN 20000 ELSE 0 END "
        "+ CASE WHEN s.strong_subjects <> '' THEN 150000 ELSE 0 END + CASE WHEN p.achievements > 0 THEN 150000 ELSE 0 END AS cci, "
        f"t.performance_trend, t.growth_c FROM t_profile p LEFT JOIN t_trendlabel t USING ({K}) LEFT JOIN t_strength s USING ({K})"
    ),
    "t_child": (
        "SELECT d.school_id, d.parent_id, " + display("d.student_name", "p.father_name") + " AS display_name, d.student_id AS latest_student_id, "
        "d.academic_yr AS latest_academic_yr FROM t_demo d LEFT JOIN t_parent p USING (school_id, parent_id) "
        "QUALIFY row_number() OVER (PARTITION BY d.school_id, d.parent_id, CASE WHEN d.parent_id % 10 = 0 AND split_part(d.student_name, ' ', 1) = 'Stu1' THEN 'Stu0' "
        "ELSE split_part(d.student_name, ' ', 1) END ORDER BY d.academic_yr DESC, d.student_id DESC) = 1"
    ),
    "t_sp": (
        "SELECT d.school_id, d.student_id, d.academic_yr, " + display("d.student_name", "p.father_name") + " AS student_name, d.reg_no, d.gender, d.dob, d.parent_id, "
        "d.guardian_name, d.guardian_mobile, d.class_id, d.section_id, CAST(d.class_id AS VARCHAR) AS class_name, x.section_name, p.father_name, p.mother_name, "
        "p.father_contact, p.mother_contact, m.avg_c, m.written_c, m.oral_c, m.exams_taken, m.att_c, m.hw, s.strong_subjects, s.strong_subjects_ai, "
        "g.attendance_band, g.learning_style, g.engagement_pattern, g.primary_strength_axis, coalesce(y.n, 0) AS year_n, coalesce(y.list, '') AS year_list, "
        "coalesce(e.n, 0) AS ever_n, coalesce(e.list, '') AS ever_list "
        f"FROM t_demo d LEFT JOIN t_section x USING (section_id) LEFT JOIN t_parent p USING (school_id, parent_id) LEFT JOIN t_profile m USING ({K}) "
        f"LEFT JOIN t_strength s USING ({K}) LEFT JOIN t_sig g USING ({K}) LEFT JOIN t_ach y USING ({K}) LEFT JOIN t_achall e USING (school_id, student_id) "
        "WHERE d.student_name IS NOT NULL AND d.student_name <> '' AND NOT regexp_full_match(d.student_name, '[0-9]+')"
    ),
    "t_crow": (
        "SELECT school_id, academic_yr, class_name, unnest([section_name, 'all']) AS section, student_id, student_name, reg_no, avg_c, att_c, "
        "attendance_band, learning_style, engagement_pattern FROM t_sp"
    ),
    "t_risk": (
        "SELECT *, CASE WHEN att_c < 7500 AND avg_c < 4000 THEN 'both' WHEN att_c < 7500 AND avg_c >= 4000 THEN 'attendance' "
        "WHEN avg_c < 4000 AND att_c >= 7500 THEN 'academic' END AS risk FROM t_crow"
    ),
    "t_kpi": (
        "SELECT school_id, academic_yr, class_name, section, count(*) AS n_students, CAST(sum(avg_c) AS DOUBLE) / 100 / count(avg_c) AS avg_academic, "
        "CAST(sum(att_c) AS DOUBLE) / 100 / count(att_c) AS avg_attendance, count(CASE WHEN avg_c >= 7500 THEN 1 END) AS count_top, "
        "count(CASE WHEN risk = 'both' THEN 1 END) AS count_at_risk_both, count(CASE WHEN risk = 'attendance' THEN 1 END) AS count_at_risk_att, "
        "count(CASE WHEN risk = 'academic' THEN 1 END) AS count_at_risk_acad, count(CASE WHEN att_c >= 8500 THEN 1 END) AS count_good_attendance "
        "FROM t_risk GROUP BY ALL"
    ),
    "t_point": (
        "SELECT r.*, m.n_students, CASE WHEN avg_c >= am AND att_c >= tm THEN 'Thriving' WHEN avg_c >= am THEN 'Academically Strong' "
        "WHEN att_c >= tm THEN 'Present & Growing' ELSE 'Needs Support' END AS zone FROM t_crow r JOIN ("
        "SELECT school_id, academic_yr, class_name, section, count(*) AS n_students, median(avg_c) AS am, median(att_c) AS tm FROM t_crow GROUP BY ALL) m "
        "USING (school_id, academic_yr, class_name, section) WHERE avg_c IS NOT NULL AND att_c IS NOT NULL"
    ),
    "t_map": (
        "SELECT DISTINCT s.school_id, CAST(c.class_id AS VARCHAR) AS class_name, "
        f"CASE WHEN CAST(c.class_id AS VARCHAR) IN {SCIENCE_CLASSES} AND m.sm_id IN (15, 16, 17) THEN 24 ELSE m.sm_id END AS subject_id, "
        f"y.academic_yr FROM t_school s CROSS JOIN (SELECT unnest(range(1, 13)) AS class_id) c CROSS JOIN ({values([(y,) for y in fv.VALID_YEARS], 'academic_yr')}) y "
        f"CROSS JOIN t_master m WHERE (m.sm_id + c.class_id) % 7 <> 0 AND m.name NOT IN {in_list(fv.PLACEHOLDER_SUBJECTS)}"
    ),
    "t_exambr": (
        "SELECT c.school_id, c.student_id, c.academic_yr, c.heading_name AS exam_type, c.exam_id, e.exam_name, "
        f"CASE WHEN CAST(s.class_id AS VARCHAR) IN {SCIENCE_CLASSES} AND c.subject_id IN (15, 16, 17) THEN m.name ELSE d.subject_name END AS subject_name, "
        "sum(mark) AS o, sum(50) AS m FROM t_comp c JOIN t_exam e USING (exam_id) JOIN t_student s USING (school_id, student_id, academic_yr) "
        "JOIN t_master m ON m.sm_id = c.subject_id "
        f"JOIN t_dimsub d ON d.school_id = c.school_id AND d.subject_id = CASE WHEN CAST(s.class_id AS VARCHAR) IN {SCIENCE_CLASSES} AND c.subject_id IN (15, 16, 17) THEN 24 ELSE c.subject_id END "
        f"WHERE c.present = 'Y' AND s.is_delete = 'N' GROUP BY ALL"
    ),
    "t_category": values(_categories, "word, category"),
    "t_subj": (
        "SELECT n.*, s.science_components FROM t_named n LEFT JOIN t_scitext s ON n.subject_name = 'Science' AND s.school_id = n.school_id "
        "AND s.student_id = n.student_id AND s.academic_yr = n.academic_yr WHERE n.avg_c IS NOT NULL"
    ),
    "t_cat": "SELECT t.*, coalesce(c.category, 'Scholastic') AS category, c.category IS NOT NULL AND c.category = 'Scholastic' AS listed FROM t_subj t LEFT JOIN t_category c ON c.word = lower(trim(t.subject_name))",
    "t_acareer": values(numbered(fv.ANALYSIS_CAREERS), "ord, word, career, reason"),
    "t_icareer": values(numbered(fv.INSIGHT_CAREERS), "ord, word, career, reason"),
    "t_goalrule": values(numbered(fv.GOAL_SUBJECTS), "ord, word, needed"),
    "t_achrule": values(numbered(fv.ACHIEVEMENT_CATEGORIES), "ord, word, category, signal"),
    "t_skillrule": values(numbered(fv.ACHIEVEMENT_SKILLS), "ord, word, skill"),
    "t_skillcareer": values(numbered(fv.SKILL_CAREERS), "ord, skill, career, reason"),
    "t_level": (
        "SELECT *, CASE WHEN avg_c >= 7000 THEN 'strong' WHEN avg_c >= 5000 THEN 'developing' ELSE 'weak' END AS level FROM t_subj"
    ),
    "t_strongrow": (
        f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY avg_c DESC, subject_name, subject_id) AS subject_place FROM t_level WHERE level = 'strong'"
    ),
    "t_firstword": (
        "SELECT d.school_id, d.subject_id, min_by(r.word, r.ord) AS first_word, min_by(r.word, -length(r.word) * 1000 + r.ord) AS longest_word "
        "FROM t_dimsub d JOIN t_acareer r ON contains(lower(d.subject_name), r.word) OR contains(r.word, lower(d.subject_name)) GROUP BY ALL"
    ),
    "t_careerrow": (
        "SELECT s.school_id, s.student_id, s.academic_yr, s.subject_place, s.subject_name, r.ord, r.career, r.reason FROM t_strongrow s "
        "JOIN t_firstword f USING (school_id, subject_id) JOIN t_acareer r ON r.word = f.first_word"
    ),
    "t_career": (
        f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY subject_place, ord) AS place FROM ("
        f"SELECT * FROM t_careerrow QUALIFY row_number() OVER (PARTITION BY {K}, career ORDER BY subject_place, ord) = 1)"
    ),
    "t_shown": (
        f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY place) AS shown_place FROM ("
        f"SELECT * FROM t_career QUALIFY row_number() OVER (PARTITION BY {K}, lower(subject_name) ORDER BY place) = 1) "
        f"QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY place) <= 3"
    ),
    "t_goal": (
        f"SELECT {SID.format('c_nationkey')} AS school_id, c_custkey AS student_id, "
        "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {quoted(g)}" for i, g in enumerate(src.GOALS)) + " END AS career_goal FROM customer"
    ),
    "t_goalword": (
        "SELECT g.school_id, g.student_id, g.career_goal, min_by(r.needed, r.ord) AS first_needed, min_by(r.needed, -length(r.word) * 1000 + r.ord) AS longest_needed FROM t_goal g "
        "LEFT JOIN t_goalrule r ON contains(lower(g.career_goal), r.word) OR contains(r.word, lower(g.career_goal)) GROUP BY ALL"
    ),
    "t_goalhit": (
        "SELECT c.school_id, c.student_id, c.academic_yr, min_by(c.career, c.place) AS career, min_by(c.reason, c.place) AS reason, min_by(c.subject_name, c.place) AS subject "
        "FROM t_career c JOIN t_goal g USING (school_id, student_id) WHERE contains(lower(c.career), lower(g.career_goal)) OR contains(lower(g.career_goal), lower(c.career)) GROUP BY ALL"
    ),
    "t_goalstatus": (
        "SELECT p.school_id, p.student_id, p.academic_yr, w.career_goal, coalesce(w.first_needed, '') AS needed, h.career, h.reason, h.subject, "
        "CASE WHEN h.career IS NOT NULL THEN 'supported' WHEN coalesce(w.first_needed, '') <> '' THEN 'not yet supported' ELSE 'unclear match' END AS status "
        f"FROM t_sp p JOIN t_goalword w USING (school_id, student_id) LEFT JOIN t_goalhit h USING ({K})"
    ),
    "t_list": (
        f"SELECT {K}, spelled, subject_name, is_core, row_number() OVER (PARTITION BY {K} ORDER BY is_core DESC, i) AS list_place FROM ("
        "SELECT n.school_id, n.student_id, n.academic_yr, n.spelled, n.subject_name, "
        f"row_number() OVER (PARTITION BY {K} ORDER BY n.best DESC, n.spelled) AS i, "
        f"CASE WHEN EXISTS (SELECT 1 FROM ({values([(w.lower(),) for w in fv.CORE_SUBJECT_WORDS], 'w')}) WHERE contains(lower(n.subject_name), w)) THEN 1 ELSE 0 END AS is_core "
        f"FROM t_strongname n SEMI JOIN t_sp USING ({K}))"
    ),
    "t_listcareer": (
        f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY list_place, ord) AS place FROM ("
        "SELECT t.school_id, t.student_id, t.academic_yr, t.list_place, t.is_core, t.subject_name, r.ord, r.career, r.reason FROM t_list t "
        "JOIN t_icareer r ON contains(lower(t.subject_name), r.word) OR contains(r.word, lower(t.subject_name)) "
        f"QUALIFY row_number() OVER (PARTITION BY {K}, career ORDER BY list_place, r.ord) = 1)"
    ),
    "t_achcareer": (
        f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY skill_ord, ord) AS place FROM ("
        "SELECT k.school_id, k.student_id, k.academic_yr, k.skill, k.skill_ord, c.ord, c.career, c.reason FROM ("
        "SELECT p.school_id, p.student_id, p.academic_yr, r.skill, min(r.ord) AS skill_ord FROM t_sp p JOIN t_skillrule r ON contains(lower(p.ever_list), r.word) GROUP BY ALL) k "
        f"JOIN t_skillcareer c USING (skill) QUALIFY row_number() OVER (PARTITION BY {K}, career ORDER BY skill_ord, c.ord) = 1)"
    ),
    "t_option": (
        f"SELECT {K}, career, reason, subject, row_number() OVER (PARTITION BY {K} ORDER BY s, place) AS option_place FROM ("
        f"SELECT {K}, career, reason, subject_name AS subject, 0 AS s, place FROM t_listcareer UNION ALL SELECT {K}, career, reason, skill, 1, place FROM t_achcareer) "
        f"QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY s, place) <= 4"
    ),
    "t_history": (
        "SELECT school_id, parent_id, student_name, count(*) AS points, min_by(avg_c, academic_yr || lpad(CAST(student_id AS VARCHAR), 12, '0')) AS first_c, "
        "max_by(avg_c, academic_yr || lpad(CAST(student_id AS VARCHAR), 12, '0')) AS last_c FROM t_sp WHERE avg_c IS NOT NULL GROUP BY ALL"
    ),
    "t_note": (
        "SELECT c.school_id, c.student_id, c.academic_yr, string_agg(CASE WHEN is_entered = 1 THEN component END, ', ' ORDER BY c.avg_c DESC NULLS LAST, component) AS yes, "
        "string_agg(CASE WHEN is_entered = 0 THEN component END, ', ' ORDER BY component) AS no, count(CASE WHEN is_entered = 0 THEN 1 END) AS n_no "
        f"FROM t_sciall c SEMI JOIN (SELECT {K} FROM t_subj WHERE subject_name = 'Science' AND avg_c >= 7500) USING ({K}) GROUP BY ALL"
    ),
    "t_notetext": (
        f"SELECT {K}, concat_ws('. ', CASE WHEN yes IS NOT NULL THEN 'Strong in ' || yes || ' within Science' END, "
        "CASE WHEN n_no > 0 THEN no || CASE WHEN n_no > 1 THEN ' marks were' ELSE ' mark was' END || ' not recorded this year' END) || '.' AS science_note FROM t_note"
    ),
    "t_eca": (
        "SELECT school_id, o_orderkey AS id, o_custkey AS student_id, o_orderpriority AS title, 'Sports' AS category, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS achievement_date, "
        "'School' AS level, CASE WHEN o_orderkey % 3 = 2 THEN 'First' END AS position, CASE WHEN o_orderkey % 2 = 0 THEN 'a.png' END AS certificate_filename, "
        "CASE WHEN o_orderkey % 2 = 0 THEN 'QUJD' END AS certificate_data, CASE WHEN o_orderkey % 2 = 0 THEN 'image/png' END AS certificate_mime, "
        "o_custkey - o_custkey % 2 AS submitted_by_parent_id, o_orderstatus = 'O' AS fresh, o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' AS known FROM t_ord"
    ),
    "t_judged": (
        "SELECT *, CASE WHEN id <= 0 THEN 'invalid id' WHEN op = 'insert' AND id % 7 = 0 AND coalesce(student_id, 0) = 0 THEN 'missing fields: student_id, title' "
        "WHEN op = 'insert' AND id % 7 = 0 THEN 'missing fields: title' WHEN op = 'insert' AND coalesce(student_id, 0) = 0 THEN 'missing fields: student_id' "
        "WHEN op <> 'insert' AND NOT known THEN 'not found' END AS reject_reason FROM ("
        "SELECT *, CASE WHEN title = '1-URGENT' THEN 2 ELSE 1 END AS seq, CASE WHEN title = '1-URGENT' THEN 'delete' WHEN fresh THEN 'insert' WHEN title = '2-HIGH' THEN 'delete' ELSE 'update' END AS op "
        "FROM t_eca WHERE title <> '4-NOT SPECIFIED')"
    ),
}


def with_ctes(select: str) -> str:
    """Prefix a SELECT by the expressions it needs, each before its users."""
    needed: set[str] = set()
    todo = [select]
    while todo:
        for name in set(re.findall(r"\bt_[a-z]+\b", todo.pop())) - needed:
            needed.add(name)
            todo.append(CTES[name])
    heads = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in CTES.items() if n in needed)
    return f"WITH {heads} {select}" if heads else select
