"""What the operators share: reading, words, staged tables and random keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.session import shared_folder

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark deletes the shuffle files of a query as it ends (from 4.1 on), and not only when the driver's memory is cleaned up.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def write_apart(df: DataFrame, path: str) -> None:
    """Write a table whose shuffles nothing reads again; their files go as soon as it is written."""
    conf = df.sparkSession.conf
    own = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if own is None else conf.set(CLEAN, own)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    write_apart(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_for_now(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """As ``staged``, with a call that deletes the table, for when nothing reads it any more."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    write_apart(df, path)

    def drop() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), drop


def same(left: Column, right: Column) -> Column:
    """Equality that also holds between two nulls."""
    return left.eqNullSafe(right)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match; the right side's keys are dropped."""
    other = right.select([F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    on = None
    for k in keys:
        c = same(left[k], other[f"__r_{k}"])
        on = c if on is None else on & c
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def bits(key: Column, n: int) -> Column:
    """The n highest bits of a 64-bit key, as a number from 0."""
    return F.lit(0).cast("long") if n == 0 else F.shiftrightunsigned(key, 64 - n)


def random_key(seed: int, *cols: Column) -> Column:
    """A 64-bit key that depends on the row and the seed alone, so that reruns agree."""
    return F.xxhash64(F.lit(seed).cast("long"), *cols)
