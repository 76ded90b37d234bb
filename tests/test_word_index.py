"""The index of rule words against a plain look at every word and text."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chalkline.operators import word_index as wi
from chalkline.plans.registry import queries

WORDS = ["art", "a", "ab", "maths", "mathematics", "computer science", "pe", "x-y", "日本", "", "art"]


def plain(texts, words, two_way):
    return {(t, i) for t in texts if t is not None for i, w in enumerate(words) if w in t or two_way and t in w}


@pytest.mark.parametrize("two_way", [False, True])
def test_hits(spark, two_way):
    texts = ["", "a", "ar", "art", "party", "mathematics and art", "math", "x-y", "日", "日本語", None, "science", "computer science", "zzz", "art"]

    def check(texts, words):
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        found = wi.word_hits(wi.distinct_texts(rows, F.col("t")), words, two_way).join(wi.distinct_texts(rows, F.col("t")), "text_id")
        got = [(r.text, r.place) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == plain(texts, words, two_way)

    check(texts, WORDS)
    check([], WORDS)

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text("abc ", max_size=8), max_size=12), st.lists(st.text("abc ", max_size=5), min_size=1, max_size=8))
    def any_texts(texts, words):
        check([*texts, None], words)

    any_texts()


def test_each_text_once_and_none_as_key(spark, small):
    """No join or grouping of these plans is over a text; the distinct texts are looked at once."""
    for name in ("achievement_careers", "achievement_categories", "careers_all_match", "goal_required_subjects"):
        plan = queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        keys = " ".join(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|hashpartitioning)[ (]\[?([^\]]*)\]?", plan))
        assert "text_id" in keys and not re.search(r"achievement_list|subject_name|career_goal|\btext#", keys), name
        assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan), name
