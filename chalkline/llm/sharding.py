"""Sharding by a hypergeometric communication matrix (operator 5).

A uniform shuffle sends to each shard, from each source partition, a number of rows that follows the multivariate
hypergeometric law with the partition sizes and shard sizes as margins. So the counts are drawn first, exactly; each
partition permutes its rows and cuts them by its row of the matrix; after the exchange each shard permutes again.
Shard sizes are then exact (law `rows`: at most one apart) and every assignment is equally likely.

The matrix is partitions x shards numbers, at most MAX_PARTITIONS x shards, drawn on the driver from counts alone;
all work on rows is DataFrame operations. A shard's second permutation is ranked in key ranges, so no task ever
holds a whole shard. Equal texts are not kept together: a group may be larger than a shard.

Results for odd input: null text has no bytes (size 8) and the checksum of the empty string; null and repeated ids
are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.common import join_on, random_key, staged, text_of

SEED = 20_240_607
#: Source partitions hold about this many rows, up to the largest number of partitions.
PARTITION_ROWS, MAX_PARTITIONS = 2000, 4096


def communication_matrix(rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """[partition, shard] counts with the given row sums and column sums that are at most one apart."""
    rng, total = np.random.default_rng(seed), sum(rows)
    # Which shards get one row more is itself drawn.
    left = np.full(shards, total // shards, dtype=np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        draw = left if n == left.sum() else np.zeros(shards, dtype=np.int64)
        if n and n != left.sum():
            draw, todo, rest = np.zeros(shards, dtype=np.int64), n, int(left.sum())
            for k in range(shards):
                # One shard after the other, each given the ones before: the margins of the joint law.
                rest -= int(left[k])
                draw[k] = _hypergeometric(rng, int(left[k]), rest, todo)
                todo -= int(draw[k])
        out[p] = draw
        left = left - draw
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw of n from good + bad. Above a thousand million rows the library's draw is replaced by its normal law, cut to the support."""
    if n == 0 or good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total, share = good + bad, good / (good + bad)
    sd = (n * share * (1 - share) * (total - n) / max(1, total - 1)) ** 0.5
    return int(min(good, n, max(0, n - bad, round(n * share + sd * rng.standard_normal()))))


def shard(docs: DataFrame, shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", max_partitions: int = MAX_PARTITIONS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, partition."""
    text = text_of(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row_no"))
    keyed = base.select("*", random_key(seed, F.col("doc_id"), F.col("row_no")).alias("key1"), random_key(seed + 1, F.col("doc_id"), F.col("row_no")).alias("key2"))
    # Written once: the row numbers, and with them every key, are then fixed for all that follows.
    rows = staged(keyed, "shard-rows")
    total = rows.count()
    parts = max(1, min(max_partitions, -(-total // PARTITION_ROWS)))
    ranges = max(1, min(max_partitions, -(-total // (shards * PARTITION_ROWS))))
    rows = rows.withColumn("partition", F.pmod("row_no", F.lit(parts)))
    counts = {r["partition"]: r["n"] for r in rows.groupBy("partition").agg(F.count("*").alias("n")).collect()}  # at most max_partitions rows
    cuts = np.cumsum(communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed), axis=1)
    # The matrix as a table: one row per partition, its running counts as an array.
    table = docs.sparkSession.createDataFrame([(p, [int(x) for x in c]) for p, c in enumerate(cuts)], "partition long, cuts array<long>")
    local = F.row_number().over(W.partitionBy("partition").orderBy("key1", "row_no")) - 1
    sent = join_on(rows.withColumn("place", local), table, ["partition"], "inner").withColumn(
        "shard", F.size(F.filter("cuts", lambda c: c <= F.col("place"))).cast("int")).drop("cuts", "place")
    # The key's upper 32 bits deal the shard into ranges in key order.
    sent = sent.withColumn("range_no", F.expr(f"shiftrightunsigned(key2, 32) * {ranges} div 4294967296"))
    inside = F.row_number().over(W.partitionBy("shard", "range_no").orderBy(F.expr("shiftrightunsigned(key2, 32)"), "key2", "row_no")) - 1
    before = W.partitionBy("shard").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    sizes = sent.groupBy("shard", "range_no").agg(F.count("*").alias("n"))
    bases = sizes.select("shard", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = join_on(sent.withColumn("inside", inside), bases, ["shard", "range_no"], "inner")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("partition").alias("source_partition"))
