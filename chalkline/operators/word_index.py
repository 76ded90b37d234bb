"""An index of rule words by three-letter grams: which rule words stand in which text.

Every distinct text is looked at once, under a 64-bit id; results come back by that id, so no text is a join key. A word
can only stand in a text that holds the word's first gram, and a text in a word that holds the text's first gram: grams
are equi-joined, and only these candidates are compared. The rule words are a fixed, small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.matching import either_contains

GRAM = 3


def text_id(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def distinct_texts(rows: DataFrame, text: Column) -> DataFrame:
    """(text_id, text), each text once."""
    return rows.select(text_id(text).alias("text_id"), text.alias("text")).where("text_id IS NOT NULL").groupBy("text_id").agg(F.first("text").alias("text"))


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` letters."""
    if size == 0:
        return F.array(F.lit(""))
    whole = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, whole).otherwise(F.array().cast("array<string>"))


def _word_grams(word: str, sizes: Sequence[int]) -> set[str]:
    return {word[i : i + n] for n in sizes for i in range(len(word) - n + 1)}


def word_hits(texts: DataFrame, words: Sequence[str], two_way: bool = False) -> DataFrame:
    """(text_id, place) of the rule words in each text; ``two_way`` also those that the text stands in.

    ``place`` counts the words from 0. Rows are not ordered.
    """
    spark = texts.sparkSession
    firsts = [(i, w[:GRAM]) for i, w in enumerate(words)]
    sizes = sorted({len(g) for _, g in firsts})
    of_text = texts.select("text_id", F.explode(F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in sizes]))).alias("gram"))
    pairs = of_text.join(F.broadcast(spark.createDataFrame(firsts, "place int, gram string")), "gram")
    if two_way:
        inner = [(i, g) for i, w in enumerate(words) for g in sorted(_word_grams(w, range(GRAM + 1)))]
        first = texts.select("text_id", F.substring("text", 1, GRAM).alias("gram"))
        pairs = pairs.unionByName(first.join(F.broadcast(spark.createDataFrame(inner, "place int, gram string")), "gram"))
    table = spark.createDataFrame(list(enumerate(words)), "place int, word string")
    fits = either_contains(F.col("text"), F.col("word")) if two_way else F.col("text").contains(F.col("word"))
    found = pairs.select("text_id", "place").distinct().join(texts, "text_id").join(F.broadcast(table), "place")
    return found.where(fits).select("text_id", "place", "word")


def first_or_longest(hits: DataFrame, match: str) -> DataFrame:
    """(text_id, place) of one word of each text: the first of the table, or the longest (the earlier one of equals)."""
    rank = {"first": F.struct("place"), "longest": F.struct((-F.length("word")).alias("size"), "place")}[match]
    return hits.groupBy("text_id").agg(F.min(rank)["place"].alias("place"))
