"""Rule-based careers, goals and insight text for all students at once.

Subject words are matched once per row of the subject dimension; student rows then join the
matches by subject id.  Other texts (achievements, goals, listed subjects) are matched once each, through
an index of the rule words, and found again by a 64-bit id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import fixed_values as fv
from chalkline.functions import matching as mt
from chalkline.functions.columns import (
    KEY, communication_style, fingerprint, is_senior_class, is_upper_school, norm, not_null_like, percent_text,
    profile_word, split_outside_parentheses, subject_level, tenth_text, title_case, without_parentheses,
)
from chalkline.operators import word_index as wi
from chalkline.operators.student_view import PERSON, history_trend

GOAL_KEY = [*KEY, "career_goal"]


def subject_levels(subjects: DataFrame) -> DataFrame:
    """Each subject's level: strong from 70, developing from 50, else weak."""
    return subjects.select(*KEY, "subject_id", "subject_name", "avg_percent", subject_level(F.col("avg_percent")).alias("level"))


def level_lists(levels: DataFrame) -> DataFrame:
    """Strong and weak subject names per student-year, best first; at most the school's subjects."""

    def names(level: str) -> Column:
        entry = F.struct((-F.col("avg_percent")).alias("s"), F.col("subject_name"), F.col("subject_id"))
        rows = F.array_sort(F.collect_list(F.when(F.col("level") == level, entry)))
        return F.transform(rows, lambda r: r["subject_name"])

    return levels.groupBy(*KEY).agg(names("strong").alias("strong"), names("weak").alias("weak"))


# --- careers from subjects -----------------------------------------------------------------------


def _career_steps(subject_dim: DataFrame, options) -> DataFrame:
    """Subject dimension rows exploded to their career options."""
    matched = subject_dim.select("school_id", "subject_id", "subject_name", options(F.col("subject_name")).alias("options"))
    return matched.select(
        "school_id", "subject_id", without_parentheses(F.col("subject_name")).alias("subject"),
        F.inline("options"),
    ).select("school_id", "subject_id", "subject", F.col("ord").alias("rule_ord"), "career", "reason")


def _first_of_each_career(rows: DataFrame, order: list[str]) -> DataFrame:
    """Keep a career at its first subject and number the careers in that order."""
    first = F.row_number().over(Window.partitionBy(*KEY, "career").orderBy(*order))
    kept = rows.withColumn("f", first).filter(F.col("f") == 1)
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return kept.withColumn("place", place).drop("f")


def grounded_careers(levels: DataFrame, subject_dim: DataFrame, match: str = "first") -> DataFrame:
    """Careers of strong subjects; each subject uses its first (or most specific) rule word."""
    steps = _career_steps(subject_dim, lambda s: mt.analysis_careers(s, match))
    strong = levels.filter(F.col("level") == "strong")
    # One row per strong subject of a student-year: a small, bounded window.
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("avg_percent"), "subject_name", "subject_id"))
    rows = strong.withColumn("subject_place", place).join(steps, ["school_id", "subject_id"])
    return _first_of_each_career(rows, ["subject_place", "rule_ord"]).select(
        *KEY, "place", "career", "reason", "subject"
    )


def one_career_per_subject(careers: DataFrame, most: int = 3) -> DataFrame:
    """The first career of each subject, at most three per student-year."""
    first = F.row_number().over(Window.partitionBy(*KEY, F.lower("subject")).orderBy("place"))
    kept = careers.withColumn("f", first).filter(F.col("f") == 1).drop("f")
    again = F.row_number().over(Window.partitionBy(*KEY).orderBy("place"))
    return kept.withColumn("shown_place", again).filter(F.col("shown_place") <= most)


def insight_subject_careers(core: DataFrame) -> DataFrame:
    """Careers for listed subjects (core first), all matching rule words.

    Works on the list rows' own text, which may differ from the dimension's names.
    """
    text = mt.subject_text(F.col("subject_name"))
    hits = wi.word_hits(wi.distinct_texts(core, text), [r[0] for r in fv.INSIGHT_CAREERS], two_way=True)
    rules = core.sparkSession.createDataFrame([(i, career, reason) for i, (_, career, reason) in enumerate(fv.INSIGHT_CAREERS)], "place int, career string, reason string")
    options = hits.join(F.broadcast(rules), "place").select("text_id", F.col("place").alias("rule_ord"), "career", "reason")
    rows = core.withColumn("text_id", wi.text_id(text)).withColumn("subject", without_parentheses(F.col("subject_name")))
    rows = rows.select(*KEY, "list_place", "subject", "text_id").join(options, "text_id").drop("text_id")
    return _first_of_each_career(rows, ["list_place", "rule_ord"]).select(*KEY, "place", "career", "reason", "subject")


def _of_achievements(profile: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for each achievement text, for all student-years that have it."""
    return profile.select(*KEY, wi.text_id(F.col("achievement_list")).alias("text_id")).join(found, "text_id").drop("text_id")


def achievement_career_rows(profile: DataFrame) -> DataFrame:
    """Careers by achievement words through skills; a career stays at its first word."""
    texts = wi.distinct_texts(profile, F.col("achievement_list")).withColumn("text", F.lower("text"))
    names = list(dict.fromkeys(word for word, *_ in mt.WORD_CAREERS))
    hits = wi.word_hits(texts, names)
    rules = [(i, names.index(word), skill, career, reason) for i, (word, skill, career, reason) in enumerate(mt.WORD_CAREERS)]
    rules = profile.sparkSession.createDataFrame(rules, "ord int, place int, skill string, career string, reason string")
    options = hits.join(F.broadcast(rules), "place")
    first = options.groupBy("text_id", "career").agg(F.min(F.struct("ord", "reason", "skill")).alias("r"))
    place = F.row_number().over(Window.partitionBy("text_id").orderBy("r.ord"))  # at most one row a career
    found = first.select("text_id", place.alias("place"), "career", F.col("r.reason").alias("reason"), F.col("r.skill").alias("skill"))
    return _of_achievements(profile, found)


def achievement_category_rows(profile: DataFrame) -> DataFrame:
    """Categories of an achievement list: each title, in order, takes the first word of a category not seen before."""
    texts = wi.distinct_texts(profile, F.col("achievement_list"))
    titles = texts.select("text_id", F.posexplode(mt.achievement_titles(F.col("text"))).alias("item", "title"))
    lowered = F.lower("title")
    hits = wi.word_hits(wi.distinct_texts(titles, lowered), [word for word, *_ in fv.ACHIEVEMENT_CATEGORIES])
    rules = [(i, category, signal) for i, (_, category, signal) in enumerate(fv.ACHIEVEMENT_CATEGORIES)]
    rules = profile.sparkSession.createDataFrame(rules, "place int, category string, career_signal string")
    hits = hits.join(F.broadcast(rules), "place").withColumnRenamed("text_id", "title_id")
    of_text = titles.withColumn("title_id", wi.text_id(lowered)).join(hits, "title_id")
    # A text has as many candidates as titles x words that fit them.
    each = F.array_sort(F.collect_list(F.struct("item", F.col("place").alias("ord"), "title", "category", "career_signal")))
    kind = "array<struct<item:int,ord:int,title:string,category:string,career_signal:string>>"
    taken = F.aggregate(
        each, F.array().cast(kind),
        lambda found, r: F.when(F.exists(found, lambda f: (f["item"] == r["item"]) | (f["category"] == r["category"])), found).otherwise(F.concat(found, F.array(r))),
    )
    found = of_text.groupBy("text_id").agg(taken.alias("taken")).select("text_id", F.posexplode("taken").alias("i", "s"))
    found = found.select("text_id", (F.col("i") + 1).alias("place"), F.col("s.title").alias("title"), F.col("s.category").alias("category"), F.col("s.career_signal").alias("career_signal"))
    return _of_achievements(profile, found)


# --- core and supporting subjects ------------------------------------------------------------------


def subject_list_rows(profile: DataFrame) -> DataFrame:
    """One row per entry of a student's subject list, core entries first.

    Only separators outside parentheses split, so 'Science (Physics, Biology)' stays one entry.
    """
    listed = F.coalesce(
        not_null_like(F.col("strong_subjects_ai"), F.lit(None)), not_null_like(F.col("strong_subjects"), F.lit(None)), F.lit("")
    )
    items = F.filter(F.transform(split_outside_parentheses(listed), lambda x: F.trim(x)), lambda x: x != "")
    rows = profile.select(*KEY, F.posexplode(items).alias("i", "subject_name"))
    base = F.lower(without_parentheses(F.col("subject_name")))
    hits = wi.word_hits(wi.distinct_texts(rows, base), [w.lower() for w in fv.CORE_SUBJECT_WORDS])
    core = F.col("core").isNotNull()
    rows = rows.withColumn("text_id", wi.text_id(base)).join(hits.select("text_id", F.lit(1).alias("core")).distinct(), "text_id", "left")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("is_core"), "i"))
    return rows.withColumn("is_core", core.cast("int")).withColumn("list_place", place).select(
        *KEY, "list_place", "subject_name", "is_core"
    )


def _joined(flag: int) -> Column:
    rows = F.array_sort(F.collect_list(F.when(F.col("is_core") == flag, F.struct("list_place", "subject_name"))))
    return F.array_join(F.transform(rows, lambda r: r["subject_name"]), ", ")


def core_supporting(list_rows: DataFrame) -> DataFrame:
    return list_rows.groupBy(*KEY).agg(_joined(1).alias("core"), _joined(0).alias("supporting"))


# --- career goals -------------------------------------------------------------------------------------


def with_required_subjects(goals: DataFrame, match: str, name: str) -> DataFrame:
    """Goals with the subjects they need, '' where no goal word fits; every distinct goal is matched once."""
    goal = norm(F.col("career_goal"))
    hits = wi.word_hits(wi.distinct_texts(goals, goal), list(dict(fv.GOAL_SUBJECTS)), two_way=True)
    needs = goals.sparkSession.createDataFrame([(i, subjects) for i, subjects in enumerate(dict(fv.GOAL_SUBJECTS).values())], f"place int, `{name}` string")
    needs = wi.first_or_longest(hits, match).join(F.broadcast(needs), "place").select("text_id", name)
    return goals.withColumn("text_id", wi.text_id(goal)).join(needs, "text_id", "left").withColumn(name, F.coalesce(name, F.lit(""))).drop("text_id")


def goal_status(goals: DataFrame, careers: DataFrame, match: str = "first") -> DataFrame:
    """Each (student-year, goal) with the supporting career, if any, and the subjects it needs."""
    goal = F.lower("career_goal")
    wanted = goals.withColumn("career_goal", F.trim("career_goal")).filter(F.coalesce("career_goal", F.lit("")) != "")
    hits = (
        wanted.select(*GOAL_KEY).join(careers, KEY)
        .filter(mt.either_contains(F.lower("career"), goal))
        .groupBy(*GOAL_KEY)
        .agg(F.min(F.struct("place", "career", "reason", "subject")).alias("hit"))
    )
    status = (
        F.when(F.col("hit").isNotNull(), "supported").when(F.col("required_subjects") != "", "not yet supported").otherwise("unclear match")
    )
    return (
        with_required_subjects(wanted.join(hits, GOAL_KEY, "left"), match, "required_subjects")
        .withColumn("status", status)
        .withColumns({
            "goal_career": F.col("hit.career"), "goal_reason": F.col("hit.reason"), "goal_subject": F.col("hit.subject"),
        })
        .drop("hit")
    )


def career_report(status: DataFrame, profile: DataFrame, lists: DataFrame, shown: DataFrame) -> DataFrame:
    """The written report per (student-year, goal), built from its parts in the row."""
    rows = F.array_sort(F.collect_list(F.struct("shown_place", "career", "subject", "reason")))
    options = shown.groupBy(*KEY).agg(rows.alias("options"))
    base = (
        status.join(profile.select(*KEY, "student_name", "class_name", "avg_percent"), KEY)
        .join(lists, KEY, "left")
        .join(options, KEY, "left")
    )
    words = F.split(F.trim("student_name"), r"\s+")
    who = F.when(F.coalesce(F.trim("student_name"), F.lit("")) != "", title_case(F.get(words, F.lit(0)))).otherwise("The student")
    overall = F.coalesce(F.col("avg_percent").cast("double"), F.lit(0.0))
    word = profile_word(overall)
    article = F.when(F.substring(word, 1, 1).isin("a", "e", "i", "o", "u"), "an").otherwise("a")
    strong = F.when(F.size("strong") > 0, F.array_join("strong", ", ")).otherwise("multiple subjects")
    goal, needed, key_subject = F.col("career_goal"), F.col("required_subjects"), F.col("goal_subject")
    heading = F.concat(F.lit("Goal: "), title_case(goal), F.lit(":"))

    def lines(*parts: Column | str) -> Column:
        return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    opening = text(
        who, " demonstrates ", article, " ", word, " academic profile with an overall average of ", tenth_text(overall),
        "%, showing particular strength in ", strong, ".",
    )
    supported = lines(
        text("The goal of becoming a ", goal, " is well-supported — ", who, " already scores strongly in ", key_subject,
             ", which is a key subject for this path."),
        "", heading,
        text("* Key supporting subject: ", key_subject),
        text("* Why it fits: ", F.col("goal_reason"), "."),
        text("* Next step: Build on ", key_subject, " and explore related entrance exams and college options early."),
    )
    not_yet = lines(
        text("To reach the goal of ", goal, ", ", who, " will need to build strong scores in ", needed,
             " — these are the core subjects for this career."),
        "", heading,
        text("* Subjects needed: ", needed),
        "* Next step: Focus on these subjects in upcoming terms to keep this goal within reach.",
    )
    unclear = lines(
        "", heading,
        "* This goal could not be directly matched to current subject scores.",
        "* Next step: Speak with a school counsellor to explore which subjects align with this career.",
    )
    about_goal = F.when(F.col("status") == "supported", supported).when(F.col("status") == "not yet supported", not_yet).otherwise(unclear)
    has_options = F.coalesce(F.size("options"), F.lit(0)) > 0
    paths = F.when(
        has_options,
        F.array_join(
            F.transform("options", lambda o: text("* ", o["career"], " — ", o["subject"], " — ", o["reason"], ".")), "\n"
        ),
    ).otherwise("* Focus on building subject scores to unlock more career path recommendations.")
    best = F.get("options", F.lit(0))
    colleges = F.when(
        has_options & is_senior_class(F.col("class_name")),
        lines(
            "", "Suggested Colleges & Entrance Exams:",
            text("* Research entrance exams aligned with ", best["career"], "."),
            text("* Look into universities offering programmes in ", best["subject"], "-related fields."),
            "* Speak with your school counsellor for institution-specific guidance.",
        ),
    )
    report = lines(opening, about_goal, "", "Potential Career Paths:", paths, colleges)
    return base.select(*GOAL_KEY, "status", report.alias("report"))


# --- insight inputs ------------------------------------------------------------------------------------


def _number_text(name: str) -> Column:
    return F.col(name).cast("string")


def science_note(components: DataFrame, subjects: DataFrame) -> DataFrame:
    """Which Science components of a strong Science row were assessed, from the components themselves."""
    strong = subjects.filter((F.col("subject_name") == fv.SCIENCE_NAME) & (F.col("avg_percent") >= 75)).select(*KEY)
    entry = F.struct((-F.coalesce("avg_percent", F.lit(-1))).alias("s"), "component")

    def names(flag: int) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("is_entered") == flag, entry)))
        return F.transform(rows, lambda r: r["component"])

    sets = components.join(strong, KEY, "left_semi").groupBy(*KEY).agg(names(1).alias("yes"), names(0).alias("no"))
    many = F.size("no") > 1
    assessed = F.when(F.size("yes") > 0, F.concat(F.lit("Strong in "), F.array_join("yes", ", "), F.lit(" within Science")))
    absent = F.when(
        F.size("no") > 0,
        F.concat(
            F.array_join("no", ", "), F.when(many, " marks were").otherwise(" mark was"), F.lit(" not recorded this year")
        ),
    )
    return sets.select(*KEY, F.concat(F.concat_ws(". ", assessed, absent), F.lit(".")).alias("science_note"))


def career_options(list_rows: DataFrame, profile: DataFrame, most: int = 4) -> DataFrame:
    """Subject careers, then achievement careers, cut at four per student-year."""
    from_subjects = insight_subject_careers(list_rows).withColumn("src", F.lit(0))
    from_achievements = achievement_career_rows(profile).withColumnRenamed("skill", "subject").withColumn("src", F.lit(1))
    both = from_subjects.unionByName(from_achievements)
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("src", "place"))
    return both.withColumn("option_place", place).filter(F.col("option_place") <= most).select(
        *KEY, "option_place", "career", "reason", "subject"
    )


def insight_context(
    profile: DataFrame, list_rows: DataFrame, options: DataFrame, notes: DataFrame,
) -> DataFrame:
    """Every input of the insight text, one row per student-year."""
    line = F.concat(F.lit("- "), F.col("career"), F.lit(" (because of "), F.col("subject"), F.lit(": "), F.col("reason"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("option_place", line.alias("line"))))
    block = options.groupBy(*KEY).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("career_block"))
    trend = history_trend(profile).filter(F.col("points") >= 2).select(
        *PERSON,
        F.concat(
            F.lit("Historical trend: "), F.col("direction"), F.lit(" (from "), tenth_text(F.col("first_score")), F.lit("% to "),
            tenth_text(F.col("last_score")), F.lit("%)"),
        ).alias("trend_note"),
    )
    written, oral = F.col("written_avg"), F.col("oral_avg")
    zero, missing = F.lit(0), F.lit("not available")
    def shown(name: str) -> Column:
        return F.when(F.coalesce(F.col(name), zero) != 0, _number_text(name)).otherwise(missing)

    def text(name: str, fallback: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)).otherwise(fallback)

    return (
        profile.join(core_supporting(list_rows), KEY, "left")
        .join(block, KEY, "left")
        .join(notes, KEY, "left")
        .join(trend, PERSON, "left")
        .select(
            *KEY, not_null_like(F.col("student_name"), F.lit("Student")).alias("student_name"),
            F.coalesce("class_name", F.lit("unknown")).alias("class_name"),
            shown("avg_percent").alias("overall"), shown("written_avg").alias("written"), shown("oral_avg").alias("internal"),
            text("core", "not identified").alias("core_subjects"), text("supporting", "none").alias("supporting_subjects"),
            text("achievement_list", "none recorded").alias("achievements"),
            communication_style(written, oral).alias("communication_style"),
            F.coalesce("science_note", F.lit("")).alias("science_note"),
            F.coalesce("trend_note", F.lit("")).alias("trend_note"),
            F.coalesce("career_block", F.lit("No strongly mapped careers identified from current subjects.")).alias("career_block"),
            is_upper_school(F.col("class_name")).cast("int").alias("is_senior"),
            _has_data().cast("int").alias("has_data"),
        )
    )


def _has_data() -> Column:
    zero = F.lit(0)
    return (
        (F.coalesce("avg_percent", zero) != 0) | (F.coalesce("written_avg", zero) != 0) | (F.coalesce("oral_avg", zero) != 0)
        | not_null_like(F.col("strong_subjects"), F.lit(None)).isNotNull()
    )


def insight_fallback(profile: DataFrame, list_rows: DataFrame) -> DataFrame:
    """The deterministic insight: two careers of core subjects, else two core subjects, else a waiting note."""
    core = list_rows.filter(F.col("is_core") == 1)
    careers = insight_subject_careers(core).filter(F.col("place") <= 2)
    fields = F.array_sort(F.collect_list(F.struct("place", "career")))
    careers = careers.groupBy(*KEY).agg(F.array_join(F.transform(fields, lambda r: r["career"]), ", ").alias("fields"))
    names = F.array_sort(F.collect_list(F.struct("list_place", without_parentheses(F.col("subject_name")).alias("name"))))
    first_two = core.filter(F.col("list_place") <= 2).groupBy(*KEY).agg(
        F.array_join(F.transform(names, lambda r: r["name"]), ", ").alias("core_names")
    )
    has_average = F.coalesce(F.col("avg_percent"), F.lit(0)) != 0
    has_subjects = not_null_like(F.col("strong_subjects"), F.lit(None)).isNotNull()
    overall = _number_text("avg_percent")
    named = F.coalesce("core_names", F.substring("strong_subjects", 1, 40))
    message = (
        F.when(~_has_data(), fv.NO_DATA_MESSAGE)
        .when(
            has_average & has_subjects & F.col("fields").isNotNull(),
            F.concat(F.lit("Strong performance across core subjects (overall "), overall,
                     F.lit("%). Based on subject profile, potential directions include: "), F.col("fields"), F.lit(".")),
        )
        .when(
            has_average & has_subjects,
            F.concat(F.lit("Strong performance in "), named, F.lit(" (overall "), overall,
                     F.lit("%). Detailed career mapping will appear once more assessment data is available.")),
        )
        .otherwise(fv.WAITING_MESSAGE)
    )
    page_text = F.concat(
        title_case(F.upper("student_name")), F.lit(" has an overall average of "), percent_text(F.col("avg_percent")),
        F.lit(" and attends "), percent_text(F.col("attendance_percentage")),
        F.lit(" of school days. Once more data is recorded, a personalised AI summary will appear here."),
    )
    return (
        profile.join(careers, KEY, "left").join(first_two, KEY, "left")
        .select(*KEY, message.alias("insight_text"), page_text.alias("page_text"))
    )


def profile_fingerprints(profile: DataFrame) -> DataFrame:
    """A change key over the fields the insight text depends on."""
    fields = [
        "student_name", "class_name", "avg_percent", "written_avg", "oral_avg", "strong_subjects", "strong_subjects_ai",
        "achievement_list",
    ]
    return profile.select(*KEY, fingerprint([F.col(f) for f in fields]).alias("fingerprint"))
