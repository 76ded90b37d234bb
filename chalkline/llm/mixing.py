"""Mixing sources to target weights (operator 8).

Documents get hash-random keys and are range-sorted within their source: a document falls into one of the source's
equal key ranges, ranges are summed, and the prefix sum of a document is the sum of the ranges before its own plus
the sum before it inside its range. Each source is then cut at its exact budget, after as many whole epochs as the
budget holds. No task sees more than one range of one source. DataFrame operations only.

Results for odd input: null text counts as no words; null sources form one source, the last; rows with null ids take
part; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.common import WORD, join_on, staged, text_of

#: Rows of a source that one key range holds on average.
RANGE_ROWS = 4096


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, text64 (hash of the text), size in words, and the hash-random key (hex, so that any engine can make it)."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_of(text_col)).alias("text64"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    )


def targets(sources: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Adds `target`: shares by weight of `share` times all words; what exceeds `epochs` times a source goes to the rest.

    Resharing until none is above comes to one level: sort by the level at which a source is full; a source is full
    when the level reached with all before it full still exceeds its own.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(epochs))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("full_before")) / F.col("weight_left"))
        .withColumn("is_full", F.col("level") > F.col("cap") / F.col("weight"))
        .withColumn("shared", F.min(F.when(~F.col("is_full"), F.struct(F.col("full_before").alias("at"), "level"))).over(every))
    )
    return rows.select(
        "source", "source_size", "n_rows", "weight",
        F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(F.col("shared.level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source, key, text64."""
    rows = staged(sized(docs, id_col, text_col, source_col), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = staged(
        targets(sources, weights, share, epochs)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("least(budget div source_size, %d)" % epochs)).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n_rows") / F.lit(range_rows)).cast("long")), "mix-plan")
    placed = join_on(rows, plan, ["source"], "inner").withColumn(
        "range_no", F.expr("cast(conv(substring(key, 1, 7), 16, 10) as bigint) * ranges div 268435456"))
    sums = placed.groupBy("source", "range_no").agg(F.sum("size").alias("range_size"))
    before = W.partitionBy("source").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("source", "range_no", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "range_no").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = join_on(ranked, bases, ["source", "range_no"], "inner")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("inside")))
    return at.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + cut).cast("long").alias("taken"), "source", "key", "text64")


#: The same rows in plain SQL.
MIX_SQL = r"""
WITH s AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_extract([3, 1, 2], 1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT)) AS BIGINT) AS weight
  FROM s GROUP BY source),
lev AS (
  SELECT *, 2 * source_size AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
          - CAST(coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM src WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST)),
tgt AS (
  SELECT source, source_size,
         CASE WHEN level > CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight AS DOUBLE) * (SELECT arg_min(l2.level, l2.cap / CAST(l2.weight AS DOUBLE)) FROM lev l2
                         WHERE NOT l2.level > CAST(l2.cap AS DOUBLE) / CAST(l2.weight AS DOUBLE)) END AS target
  FROM lev),
b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN least(CAST(round(target) AS BIGINT) // source_size, 2) ELSE 0 END AS whole
  FROM tgt),
p AS (
  SELECT s.doc_id, s.size, s.source, s.key, b.source_size, b.target, b.whole, b.budget - b.whole * b.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken, source, key
FROM p
"""
