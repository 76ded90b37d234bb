"""Scalar rules as Column expressions.  Everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv

KEY = ["school_id", "student_id", "academic_yr"]
#: The same as rows are dealt by it. Joins sort in this order, and the student's number alone tells most rows apart.
DEALT = ["student_id", "school_id", "academic_yr"]

PERCENT = "decimal(11,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal(value) -> str:
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: Mapping) -> Column:
    """A constant map column; Catalyst folds it to one literal."""
    return F.expr("map(" + ", ".join(_literal(x) for kv in pairs.items() for x in kv) + ")")


def lookup(pairs: Mapping, key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key)


def literal_array(items: Iterable) -> Column:
    return F.expr("array(" + ", ".join(_literal(x) for x in items) + ")")


def literal_rows(rows: Iterable[tuple], names: list[str]) -> Column:
    """A constant array of structs, used where a small rule table is matched in the row."""

    def row(r: tuple) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {_literal(v)}" for n, v in zip(names, r)) + ")"

    return F.expr("array(" + ", ".join(row(r) for r in rows) + ")")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; inside a lambda Spark would repeat it per element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def norm(text: Column) -> Column:
    return F.lower(F.trim(text))


# --- numbers ---------------------------------------------------------------------


def hundredths(value: Column) -> Column:
    """A two-decimal amount as a whole number, so sums stay in long arithmetic."""
    return (value * 100).cast("bigint")


def from_hundredths(value: Column) -> Column:
    return (value.cast("decimal(11,0)") * F.lit(Decimal("0.01"))).cast(PERCENT)


def _half_up(part: Column, whole: Column) -> Column:
    """Whole-number part / whole, halves away from zero; NULL when whole is 0."""
    size = F.call_function("div", F.abs(part) * 2 + F.abs(whole), F.abs(F.nullif(whole, F.lit(0))) * 2)
    return F.when((part < 0) != (whole < 0), -size).otherwise(size)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 to two decimals of two whole numbers in the same unit, half up."""
    return from_hundredths(_half_up(part * 10000, whole))


def mean2(value: Column) -> Column:
    """Aggregate: average of a two-decimal amount to two decimals, half up."""
    return from_hundredths(_half_up(F.sum(hundredths(value)), F.count(value)))


def mean_double(value: Column) -> Column:
    """Aggregate: exact sum of a two-decimal amount divided by the count, as a double."""
    n = F.count(value)
    return F.when(n > 0, F.sum(hundredths(value)).cast("double") / 100 / n)


def tenth(value: Column) -> Column:
    """Round a double to one decimal by its exact binary value, ties to even.

    ``bround`` decides on the shortest decimal text, so 82.35 (stored slightly below)
    would go up.  The product with 20 is split into a rounded part and its exact error;
    only an odd rounded part with zero error is a true tie.
    """
    x = value.cast("double")
    twenty = F.lit(20.0)
    hi = x * twenty
    c = x * F.lit(134217729.0)
    head = c - (c - x)
    error = (head * twenty - hi) + (x - head) * twenty
    low = F.floor(hi / 2).cast("double")
    rest = hi / 2 - low
    step = (
        F.when(rest > 0.5, 1.0)
        .when(rest < 0.5, 0.0)
        .when(error > 0, 1.0)
        .when(error < 0, 0.0)
        .otherwise(F.when(low % 2 == 0, 0.0).otherwise(1.0))
    )
    return (low + step) / 10


def whole(value: Column) -> Column:
    """Nearest whole number of a double, ties to even."""
    return F.rint(value.cast("double"))


def percent_text(value: Column) -> Column:
    """'82.4%' or 'N/A'."""
    return F.coalesce(F.concat(tenth_text(value), F.lit("%")), F.lit("N/A"))


def tenth_text(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.1f", tenth(value)))


def bar_value(value: Column) -> Column:
    return F.least(F.floor(F.coalesce(value.cast("double"), F.lit(0.0))), F.lit(100)).cast("int")


# --- text ------------------------------------------------------------------------


def not_null_like(text: Column, fallback: Column) -> Column:
    """Replace null and null-like words by ``fallback``."""
    return F.when(text.isNull() | norm(text).isin(fv.NULL_WORDS), fallback).otherwise(text)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    pieces = F.split(F.lower(text), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))),
        "",
    )


def first_word(text: Column) -> Column:
    return F.substring_index(F.trim(text), " ", 1)


def display_name(name: Column, father: Column) -> Column:
    n = F.trim(name)
    return (
        F.when(n.contains(" "), n)
        .when(father.isNotNull() & (F.trim(father) != ""), F.concat(n, F.lit(" "), first_word(father)))
        .otherwise(n)
    )


def has_name(name: Column) -> Column:
    return name.isNotNull() & (F.trim(name) != "")


def has_real_name(name: Column) -> Column:
    return has_name(name) & ~name.rlike("^[0-9]+$")


def initials(name: Column) -> Column:
    words = F.split(F.trim(name), r"\s+")
    last = F.when(F.size(words) > 1, F.substring(F.element_at(words, -1), 1, 1)).otherwise("")
    return F.upper(F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), last))


# A parenthesis may hold one more level, as in 'Science (Biology, Chemistry (not assessed))'.
_PARENTHESIS = r"\((?:[^()]|\([^()]*\))*\)"


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"\s*{_PARENTHESIS}", ""))


def split_outside_parentheses(text: Column) -> Column:
    """Split at separators that only whole parentheses follow."""
    return F.split(text, rf"[,/|;](?=(?:[^()]*{_PARENTHESIS})*[^()]*$)")


def text_items(text: Column) -> Column:
    """Comma list to array, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_subjects(text: Column) -> Column:
    """Array of aliased subject names, case-insensitive first occurrence kept."""
    empty = F.array().cast("array<string>")
    aliased = F.transform(text_items(text), lambda s: F.coalesce(lookup(fv.SUBJECT_ALIASES, F.lower(s)), s))
    kept = F.aggregate(
        aliased,
        empty,
        lambda found, s: F.when(F.exists(found, lambda f: F.lower(f) == F.lower(s)), found).otherwise(F.concat(found, F.array(s))),
    )
    return F.when(text.isNull() | norm(text).isin("", "none", "nan", "—"), empty).otherwise(kept)


# --- subjects, classes, exams -------------------------------------------------------

_CATEGORY = {s: c for c, names in fv.SUBJECTS_BY_CATEGORY.items() for s in names}


def subject_category(name: Column) -> Column:
    return F.coalesce(lookup(_CATEGORY, norm(name)), F.lit(fv.SCHOLASTIC))


def is_listed_scholastic(name: Column) -> Column:
    return norm(name).isin(fv.SUBJECTS_BY_CATEGORY[fv.SCHOLASTIC])


def category_rank(category: Column) -> Column:
    return lookup({c: i for i, c in enumerate(fv.CATEGORY_ORDER)}, category)


def effective_subject(class_name: Column, subject_id: Column) -> Column:
    """Physics, Chemistry and Biology count as Science in the science classes."""
    return F.when(in_science(class_name, subject_id), F.lit(fv.SCIENCE_ID)).otherwise(subject_id)


def in_science(class_name: Column, subject_id: Column) -> Column:
    return class_name.isin(fv.SCIENCE_CLASSES) & subject_id.isin(list(fv.SCIENCE_COMPONENTS))


def class_rank(class_name: Column) -> Column:
    bare = F.trim(F.regexp_replace(norm(class_name), "^(class |grade |std |standard )", ""))
    place = F.array_position(literal_array(fv.CLASS_SEQUENCE), bare).cast("int")
    return F.when(place > 0, place - 1).otherwise(len(fv.CLASS_SEQUENCE))


def is_senior_class(class_name: Column) -> Column:
    bare = F.trim(F.regexp_replace(norm(class_name), "^(standard|class|grade|std)", ""))
    bare = F.trim(F.regexp_replace(bare, "(th|st|nd|rd)$", ""))
    bare = F.coalesce(lookup(fv.ROMAN_CLASSES, bare), bare)
    return F.coalesce(bare.isin(fv.SENIOR_CLASSES), F.lit(False))


def is_upper_school(class_name: Column) -> Column:
    """First number in the class name is 7 or more."""
    number = F.regexp_extract(class_name, r"(\d+)", 1).try_cast("int")
    return F.coalesce(number, F.lit(0)) >= 7


def exam_title(name: Column) -> Column:
    return F.coalesce(lookup(fv.EXAM_NAMES, norm(name)), title_case(F.trim(name)))


def component_rank(label: Column) -> Column:
    return F.coalesce(lookup(fv.COMPONENT_RANKS, norm(label)), F.lit(fv.COMPONENT_RANK_ELSE))


def is_principal(designation: Column) -> Column:
    return F.coalesce(norm(designation).rlike("|".join(fv.PRINCIPAL_WORDS)), F.lit(False))


def heading_group(heading_id: Column) -> Column:
    return (
        F.when(heading_id.isin(fv.WRITTEN_HEADINGS), "Written")
        .when(heading_id.isin(fv.INTERNAL_HEADINGS), "Internal")
        .otherwise(fv.UNCLASSIFIED)
    )


# --- labels -------------------------------------------------------------------------


def attendance_band(pct: Column) -> Column:
    (high, high_label), (mid, mid_label) = fv.ATTENDANCE_BANDS
    return F.when(pct >= high, high_label).when(pct >= mid, mid_label).otherwise(fv.ATTENDANCE_BAND_ELSE)


def learning_style(written: Column, oral: Column) -> Column:
    return (
        F.when(written > oral, fv.STYLE_WRITTEN)
        .when(oral > written, fv.STYLE_ORAL)
        .otherwise(fv.STYLE_BALANCED)
    )


def engagement(homework: Column) -> Column:
    return F.when(homework > 0, fv.ENGAGED).otherwise(fv.NOT_ENGAGED)


def strength_axis(avg: Column, achievements: Column) -> Column:
    return (
        F.when(avg >= 85, fv.AXIS_ACADEMIC)
        .when(achievements > 0, fv.AXIS_ACTIVITY)
        .otherwise(fv.AXIS_ELSE)
    )


def performance_tier(avg: Column) -> Column:
    tier = F.when(avg.isNull(), F.lit(None).cast("string"))
    for low, label in fv.TIERS:
        tier = tier.when(avg >= low, label)
    return tier.otherwise(fv.TIER_ELSE)


def trend_label(current: Column, previous: Column) -> Column:
    return (
        F.when(previous.isNull(), fv.TREND_FIRST)
        .when(current > previous, fv.TREND_UP)
        .when(current < previous, fv.TREND_DOWN)
        .otherwise(fv.TREND_SAME)
    )


def subject_level(avg: Column) -> Column:
    return F.when(avg >= 70, "strong").when(avg >= 50, "developing").when(avg.isNotNull(), "weak")


def remedial_priority(avg: Column) -> Column:
    return F.when(avg < 35, fv.PRIORITY_URGENT).otherwise(fv.PRIORITY_SOME)


def communication_style(written: Column, oral: Column) -> Column:
    """A missing or zero side leaves the style unknown."""
    return (
        F.when((F.coalesce(written, F.lit(0)) == 0) | (F.coalesce(oral, F.lit(0)) == 0), "unknown")
        .when(oral > written + 10, fv.COMM_ORAL)
        .when(written > oral + 10, fv.COMM_WRITTEN)
        .otherwise(fv.COMM_BALANCED)
    )


def profile_word(avg: Column) -> Column:
    return F.when(avg >= 85, "exceptional").when(avg >= 70, "strong").otherwise("developing")


def role_label(role: Column) -> Column:
    return F.coalesce(lookup(fv.ROLE_LABELS, role), role)


def fingerprint(columns: list[Column]) -> Column:
    """md5 over the columns joined by a bar, nulls as empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
