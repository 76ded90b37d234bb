"""Incremental intake of marks files: only marks not seen before are kept.

Each micro-batch owns one folder, ``<target>/batch=<id>``, so a repeated batch overwrites itself
and never doubles a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chalkline.operators.marks import unseen_marks
from chalkline.schemas import INPUT_TABLES


def stored_marks(spark: SparkSession, target: str, without_batch: int | None = None) -> DataFrame | None:
    """Marks taken in so far, or None before the first batch."""
    schema = INPUT_TABLES["student_marks"] + ", batch bigint"
    try:
        rows = spark.read.schema(schema).parquet(target)
    except AnalysisException:
        return None
    kept = rows if without_batch is None else rows.filter(F.col("batch") != without_batch)
    return kept.drop("batch")


def take_in(spark: SparkSession, files: str, target: str, progress: str) -> None:
    """Read all files that arrived since the last call, then stop."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = unseen_marks(batch.dropDuplicates(["school_id", "marks_id"]), stored_marks(spark, target, batch_id))
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    marks = spark.readStream.schema(INPUT_TABLES["student_marks"]).parquet(files)
    stream = (
        marks.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
