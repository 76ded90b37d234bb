"""From raw documents to shards: language, near duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a table; every stage's
table is written to the shared folder and read again as the next one's input. All but the last return the columns of
`documents`. Rows are found again by id and a hash of the text; of rows that repeat both, one stays from the second
stage on (the mix may repeat it). Null ids and null texts are values like others; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import decontamination, language, mixing, ngram_join, sharding
from chalkline.llm.common import documents, new_folder, text_of

#: A document is rejected when no language reaches this share of the scores (or it has no letter at all).
LEAST_LANGUAGE_SCORE = 0.35
#: Similar documents over five words, Jaccard 4/5; the mix takes 150 % of all words, no document more than twice.
SHINGLE, SIMILAR, WEIGHTS, SHARE, EPOCHS, SHARDS = 5, (4, 5), (3, 1, 2), 1.5, 2, 24

#: The stages learn a classifier and find groups by hashing; no SQL gives their rows.
ORACLE_SQL = None


def _names(docs: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with two columns without nulls that name a document: its id and its text."""
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__text64": F.xxhash64(text_of("text"))})


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), F.col("text64").alias("__text64"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told (operator 7); `und` and undecided ones go. Learns from the documents of the input."""
    told = language.predict(docs, language.train(docs))
    return told.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*_names(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 3), the one with the smallest id."""
    classes = ngram_join.near_duplicates(docs, n=SHINGLE, threshold=SIMILAR)
    kept = _keys(classes.where("kept"))
    once = _keyed(docs).dropDuplicates(["__id", "__text64"])
    return once.join(kept, ["__id", "__text64"], "left_semi").select(*_names(docs))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 10)."""
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keyed(docs).join(_keys(found).distinct(), ["__id", "__text64"], "left_anti").select(*_names(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator 8). A document at a source's cut comes whole if at least half of it is taken."""
    taken = mixing.mix(docs, weights=WEIGHTS, share=SHARE, epochs=EPOCHS)
    times = taken.withColumn("n", F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(F.lit(0)))
    source = F.xxhash64(F.lit(0), F.col("source"), F.col("source").isNull()).alias("__source")
    wanted = times.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), F.col("text64").alias("__text64"), source, "n")
    keys = ["__id", "__text64", "__source"]
    wanted = wanted.groupBy(*keys).agg(F.sum("n").cast("int").alias("__times")).where(F.col("__times") > 0)
    once = _keyed(docs).select("*", source).dropDuplicates(keys)
    return once.join(wanted, keys).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*_names(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document (operator 5)."""
    return sharding.shard(docs, shards=SHARDS)


STAGES = [
    ("language id", known_language),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_leaks),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
