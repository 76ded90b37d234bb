"""Input table schemas and keys."""

from __future__ import annotations

INPUT_TABLES = {
    "school": "school_id int, name string, short_name string, is_active boolean",
    "student": (
        "school_id int, student_id bigint, academic_yr string, student_name string, reg_no string, "
        "gender string, dob string, class_id int, section_id int, nationality string, category string, "
        "parent_id bigint, guardian_name string, guardian_mobile string, is_delete string, is_active string"
    ),
    "parent": (
        "school_id int, parent_id bigint, father_name string, mother_name string, "
        "f_mobile string, m_mobile string, is_delete string"
    ),
    "class": "school_id int, class_id int, academic_yr string, name string",
    "section": "school_id int, section_id int, name string",
    "subject": "school_id int, sm_id int, class_id int, academic_yr string",
    "subject_master": "school_id int, sm_id int, name string, subject_type string",
    "exam": "school_id int, exam_id int, academic_yr string, name string",
    "marks_headings": "school_id int, marks_headings_id int, name string, written_exam string, sequence int",
    "student_marks": (
        "school_id int, marks_id bigint, class_id int, section_id int, exam_id int, subject_id string, "
        "student_id bigint, exam_date date, present string, mark_obtained string, highest_marks string, "
        "publish string, academic_yr string"
    ),
    "mark_master": (
        "school_id int, mark_id bigint, exam_id int, subject_id int, marks_headings_id int, academic_yr string"
    ),
    "mark_detail": (
        "school_id int, mark_id bigint, student_id bigint, present string, "
        "marks_obtained decimal(5,2), highest_marks decimal(5,2)"
    ),
    "attendance_clean": (
        "school_id int, student_id bigint, academic_yr string, attendance_date date, attendance_status string"
    ),
    "achievements_clean": (
        "school_id int, student_id bigint, academic_yr string, event string, achievement string, "
        "position string, date date, achievement_id bigint"
    ),
    "homework": "school_id int, homework_id bigint, academic_yr string",
    "homework_comments": "school_id int, homework_id bigint, student_id bigint",
    "name_aliases": "school_id int, parent_id bigint, raw_name string, canonical string",
    "teacher": (
        "school_id int, teacher_id bigint, name string, designation string, class_id int, section_id int, "
        "is_delete string"
    ),
    "user_master": "school_id int, user_id string, name string, reg_id bigint, role_id string, is_delete string",
    "extracurricular_achievements": (
        "school_id int, id bigint, student_id bigint, title string, category string, achievement_date date, "
        "level string, position string, description string, certificate_filename string, "
        "certificate_data string, certificate_mime string, submitted_by_parent_id bigint"
    ),
    "eca_changes": (
        "school_id int, seq int, op string, id bigint, student_id bigint, title string, category string, "
        "achievement_date date, level string, position string, description string, "
        "certificate_filename string, certificate_data string, certificate_mime string, "
        "submitted_by_parent_id bigint"
    ),
}

PARTITION_COLUMNS = ["school_id", "academic_yr"]
