"""Rule-word matching: small fixed rule tables matched inside the row.

The rule words are a constant array, so matching is a narrow expression: no join,
no shuffle, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import bind, literal_array, literal_rows, lookup, norm, without_parentheses


def _words(rows: list[tuple]) -> Column:
    return literal_array(dict.fromkeys(r[0] for r in rows))


def either_contains(text: Column, word: Column) -> Column:
    return text.contains(word) | word.contains(text)


def first_word_match(text: Column, rows: list[tuple]) -> Column:
    """First rule word that contains the text or is contained in it."""
    return bind(text, lambda t: F.get(F.filter(_words(rows), lambda w: either_contains(t, w)), F.lit(0)))


def longest_word_match(text: Column, rows: list[tuple]) -> Column:
    """The most specific matching rule word; the earlier word wins a tie."""
    hits = bind(text, lambda t: F.filter(_words(rows), lambda w: either_contains(t, w)))
    return F.aggregate(
        hits,
        F.lit(None).cast("string"),
        lambda best, w: F.when(best.isNull() | (F.length(w) > F.length(best)), w).otherwise(best),
    )


def word_match(text: Column, rows: list[tuple], match: str) -> Column:
    return {"first": first_word_match, "longest": longest_word_match}[match](text, rows)


def rows_of_word(word: Column, rows: list[tuple], names: list[str]) -> Column:
    """Rule rows of one word, with their place in the table as ``ord``."""
    table = literal_rows([(i, *r) for i, r in enumerate(rows)], ["ord", *names])
    return bind(word, lambda chosen: F.filter(table, lambda r: r[names[0]] == chosen))


def rows_matching(text: Column, rows: list[tuple], names: list[str]) -> Column:
    """All rule rows whose word contains the text or is contained in it."""
    table = literal_rows([(i, *r) for i, r in enumerate(rows)], ["ord", *names])
    return bind(text, lambda t: F.filter(table, lambda r: either_contains(t, r[names[0]])))


def subject_text(subject: Column) -> Column:
    return F.lower(without_parentheses(F.trim(subject)))


def analysis_careers(subject: Column, match: str = "first") -> Column:
    """Array of (ord, word, career, reason) for one subject, first matching word only."""
    word = word_match(subject_text(subject), fv.ANALYSIS_CAREERS, match)
    return rows_of_word(word, fv.ANALYSIS_CAREERS, ["word", "career", "reason"])


def insight_careers(subject: Column) -> Column:
    """Array of (ord, word, career, reason) for one subject, every matching word."""
    return rows_matching(subject_text(subject), fv.INSIGHT_CAREERS, ["word", "career", "reason"])


# Each achievement word with the careers of its skills, in word, skill and career order.
WORD_CAREERS = [
    (word, skill, career, reason)
    for word, skill in fv.ACHIEVEMENT_SKILLS
    for owner, career, reason in fv.SKILL_CAREERS
    if owner == skill
]


def achievement_careers(text: Column) -> Column:
    """Array of (word, skill, career, reason) from achievement words through skills.

    Skills follow the order of the word table; each career is kept once, at its first skill.
    """
    table = literal_rows(WORD_CAREERS, ["word", "skill", "career", "reason"])
    options = bind(F.lower(text), lambda t: F.filter(table, lambda r: t.contains(r["word"])))
    return F.aggregate(
        options,
        F.array().cast("array<struct<word:string,skill:string,career:string,reason:string>>"),
        lambda found, r: F.when(F.exists(found, lambda f: f["career"] == r["career"]), found).otherwise(
            F.concat(found, F.array(r))
        ),
    )


def required_subjects(goal: Column, match: str = "first") -> Column:
    """Subjects a goal needs, '' when no goal word matches."""
    word = word_match(norm(goal), fv.GOAL_SUBJECTS, match)
    return F.coalesce(lookup(dict(fv.GOAL_SUBJECTS), word), F.lit(""))


def achievement_titles(text: Column) -> Column:
    """The titles of an achievement list, without their years; none where the text only looks like one."""
    items = F.filter(F.transform(F.split(text, r",(?=\s*\d{4}[-]|\s*[A-Z])"), lambda x: F.trim(x)), lambda x: x != "")
    titles = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"^\d{4}-\d{4}\s*:\s*", "")))
    blank = text.isNull() | F.trim(text).isin("", "nan", "None")
    return F.when(blank, F.array().cast("array<string>")).otherwise(titles)


def achievement_signals(text: Column) -> Column:
    """Array of (title, category, signal): each item takes the first word of an unseen category."""
    rules = literal_rows(fv.ACHIEVEMENT_CATEGORIES, ["word", "category", "signal"])
    items = F.filter(
        F.transform(F.split(text, r",(?=\s*\d{4}[-]|\s*[A-Z])"), lambda x: F.trim(x)),
        lambda x: x != "",
    )
    titles = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"^\d{4}-\d{4}\s*:\s*", "")))
    found_type = "array<struct<title:string,category:string,signal:string>>"

    def first_hit(found: Column, title: Column) -> Column:
        seen = F.transform(found, lambda r: r["category"])
        return bind(
            F.struct(F.lower(title).alias("title"), seen.alias("seen")),
            lambda b: F.get(
                F.filter(rules, lambda r: b["title"].contains(r["word"]) & ~F.array_contains(b["seen"], r["category"])),
                F.lit(0),
            ),
        )

    def take(found: Column, title: Column) -> Column:
        def added(hit: Column) -> Column:
            row = F.struct(title.alias("title"), hit["category"].alias("category"), hit["signal"].alias("signal"))
            return F.when(hit.isNull(), found).otherwise(F.concat(found, F.array(row)))

        return bind(first_hit(found, title), added)

    found = F.aggregate(titles, F.array().cast(found_type), take)
    blank = text.isNull() | F.trim(text).isin("", "nan", "None")
    return F.when(blank, F.array().cast(found_type)).otherwise(found)


def is_core_subject(subject: Column) -> Column:
    words = literal_array(w.lower() for w in fv.CORE_SUBJECT_WORDS)
    return bind(F.lower(without_parentheses(subject)), lambda base: F.exists(words, lambda w: base.contains(w)))
