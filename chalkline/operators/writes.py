"""Incremental table writes: what to append, replace or keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.columns import has_name

def missing_rows(source: DataFrame, target: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not hold."""
    if target is None:
        return source
    return source.join(target.select(*keys), list(keys), "left_anti")


def first_rows(source: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return source.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def insert_first(
    source: DataFrame, target: DataFrame | None, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Rows to append so that each missing key gets its first source row."""
    return first_rows(missing_rows(source, target, keys), keys, order)


def upsert(source: DataFrame, target: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The whole target after source rows replace or join rows of the same key.

    Source keys are unique, so target rows of other keys stay and all source rows are added.
    """
    if target is None:
        return source
    return missing_rows(target, source, keys).unionByName(source)


def write_rows(source: DataFrame, target: DataFrame | None, keys: Sequence[str], on_existing: str) -> DataFrame:
    """The whole target after a load: ``keep`` leaves existing keys alone, ``replace`` refreshes them."""
    if target is None:
        return source
    if on_existing == "keep":
        return target.unionByName(missing_rows(source, target, keys))
    if on_existing == "replace":
        return upsert(source, target, keys)
    raise ValueError(on_existing)


def pin_row(df: DataFrame, key: Column, row: DataFrame) -> DataFrame:
    """Replace whatever matches ``key`` by exactly the given row."""
    return df.filter(~key | key.isNull()).unionByName(row)


def split_orphans(df: DataFrame, owner: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with an owner, rows without)."""
    ids = owner.select(*keys)
    return df.join(ids, list(keys), "left_semi"), df.join(ids, list(keys), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).filter("cnt > 1")


# --- change batches of extracurricular records ---------------------------------------

_ALWAYS = ["title", "category", "achievement_date", "level", "position", "description"]
_CERTIFICATE = ["certificate_filename", "certificate_data", "certificate_mime"]


def _last_change(changes: DataFrame) -> DataFrame:
    """A later change to an id stands in for all earlier ones."""
    return first_rows(changes, ["school_id", "id"], [F.desc("seq")])


def _missing_fields() -> Column:
    blank = {
        "student_id": F.col("student_id").isNull() | (F.col("student_id") == 0),
        "title": ~has_name(F.col("title")),
        "category": ~has_name(F.col("category")),
        "achievement_date": F.col("achievement_date").isNull(),
        "level": ~has_name(F.col("level")),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in blank.items()]))


def judge_changes(changes: DataFrame, records: DataFrame) -> DataFrame:
    """The last change per id with ``reject_reason``, NULL where the change applies."""
    known = records.select("school_id", "id", F.lit(True).alias("known"))
    missing = _missing_fields()
    return (
        _last_change(changes)
        .join(known, ["school_id", "id"], "left")
        .withColumn(
            "reject_reason",
            F.when(F.coalesce(F.col("id"), F.lit(0)) <= 0, "invalid id")
            .when(
                (F.col("op") == "insert") & (F.size(missing) > 0),
                F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")),
            )
            .when((F.col("op") == "insert") & F.col("known"), "id exists")
            .when((F.col("op") != "insert") & F.col("known").isNull(), "not found"),
        )
        .drop("known")
    )


def apply_changes(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Records after accepted changes.

    An update without certificate data keeps the old certificate, name and type included.
    """
    accepted = judged.filter(F.col("reject_reason").isNull())
    columns = records.columns
    fresh = accepted.filter("op = 'insert'").select(*columns)
    touch = accepted.filter("op <> 'insert'").select(
        "school_id", "id", "op", *[F.col(c).alias(f"new_{c}") for c in _ALWAYS + _CERTIFICATE]
    )
    touched = records.join(touch, ["school_id", "id"], "left")
    update, supplied = F.col("op") == "update", F.col("new_certificate_data").isNotNull()
    values = {c: F.when(update, F.col(f"new_{c}")).otherwise(F.col(c)) for c in _ALWAYS}
    values |= {c: F.when(update & supplied, F.col(f"new_{c}")).otherwise(F.col(c)) for c in _CERTIFICATE}
    kept = touched.filter(F.col("op").isNull() | (F.col("op") != "delete")).select(
        *[values.get(c, F.col(c)).alias(c) for c in columns]
    )
    return kept.unionByName(fresh)


def record_list(records: DataFrame) -> DataFrame:
    """Records with a has-certificate flag and blanks for absent texts, without the certificate itself."""
    blank = ["position", "description", "certificate_filename", "certificate_mime"]
    return records.select(
        "school_id", "id", "student_id", "title", "category", "achievement_date", "level",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in blank],
        F.when(F.length("certificate_data") > 0, 1).otherwise(0).alias("has_cert"),
    )
