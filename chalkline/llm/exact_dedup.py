"""Exact dedup over an extendible-hash index on shared files (operator 2).

Every document becomes an index entry (64-bit key, SHA-256, length), written to the shared folder. The directory
doubles where buckets overflow: a bucket with too many keys is split by one more leading bit, others keep their
depth. Owner tasks then work on their own range of keys: entries of one key form a chain, told apart by digest and
length, and the texts behind each link of a chain are compared byte by byte. All steps are DataFrame operations; a
group of copies is combined before it is shuffled, so no task ever holds one.

Results for odd input: null text counts as empty; an empty table gives no rows; a null id sorts after every other
id; of rows that repeat id and text exactly one is kept; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import WHITE, bits, join_on, staged, text_of

#: Keys that a bucket may hold before the directory doubles for it.
CAPACITY = 1 << 16
#: The directory is counted in cells finer than the mean bucket by this many bits.
FINER = 3
LINK = ["key64", "text_sha256", "n_bytes"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One index entry per row, with a row number that tells repeated rows apart once the table is written."""
    body = docs.select(F.col(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("body"))
    return body.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", F.xxhash64("body").alias("key64"),
        F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), F.octet_length("body").cast("long").alias("n_bytes"),
    )


def chains(rows: DataFrame) -> DataFrame:
    """Entries of equal key, digest and length: one link with the row that stays and the number of rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("first")
    return rows.groupBy(*LINK).agg(first, F.count("*").alias("group_size")).select(
        *LINK, F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_row"), "group_size")


def compared(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per link the number of different byte strings behind it; copies fold together before the shuffle."""
    body = docs.select(normalised(text_of(text_col)).alias("body"))
    return (
        body.groupBy(F.xxhash64("body").alias("key64"), "body").agg(F.count("*").alias("copies"))
        .groupBy("key64", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), F.octet_length("body").cast("long").alias("n_bytes"))
        .agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_rows"))
    )


def directory(links: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cell, depth, bucket): for each cell of leading bits the bucket that owns it.

    The counts of the finest cells are rolled up for every depth at once; a cell's bucket is the shallowest prefix
    that holds no more than `capacity` keys. Rows: at most 2**FINER for each bucket of mean size.
    """
    n = links.count()
    depth = min(40, (math.ceil(math.log2(n / capacity)) if n > capacity else 0) + FINER)
    cells = links.groupBy(bits(F.col("key64"), depth).alias("cell")).agg(F.countDistinct("key64").alias("n"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("keys"))
    fits = levels.join(sums.where((F.col("keys") <= capacity) | (F.col("depth") == depth)), ["depth", "prefix"])
    chosen = fits.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "keys")).alias("b"))
    return chosen.select(
        "cell", F.lit(depth).alias("cell_bits"), F.col("b.depth").alias("depth"), F.col("b.keys").alias("bucket_keys"),
        F.concat_ws("/", F.col("b.depth"), F.col("b.prefix")).alias("bucket"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, index, directory) on shared files; the index is written in key order, one key range to each owner."""
    rows = staged(entries(docs, id_col, text_col), "dedup-entries")
    links = staged(chains(rows), "dedup-chains")
    cells = staged(directory(links, capacity), "dedup-directory")
    top = cells.select("cell_bits").first()
    checked = join_on(links, compared(docs, text_col), LINK)
    # A link with two byte strings behind it would be a collision of key, digest and length: stop rather than merge.
    checked = checked.where(F.assert_true((F.col("n_texts") == 1) & (F.col("n_rows") == F.col("group_size")), "texts differ behind one digest").isNull())
    placed = checked.drop("n_texts", "n_rows").withColumn("cell", bits(F.col("key64"), top[0] if top else 0))
    owned = placed.join(cells.select("cell", "bucket", "depth"), "cell", "left").drop("cell")
    return rows, staged(owned.repartitionByRange("key64").sortWithinPartitions("key64"), "dedup-index"), cells


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    rows, index, _ = build_index(docs, id_col, text_col, capacity)
    found = join_on(rows, index, LINK)
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256", "bucket")
