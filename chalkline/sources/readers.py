"""Readers and writers for the operational tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.schemas import INPUT_TABLES, PARTITION_COLUMNS


#: Tables that grow with every exam, day and comment.
LARGE_TABLES = ("student_marks", "mark_detail", "attendance_clean", "homework_comments")
#: Bytes of files to a task. Parquet grows to some twenty times as much in rows.
PART_BYTES = 8 << 20
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_own_start: dict[str, str | None] = {}


def conform(df: DataFrame, table: str, optional: Iterable[str] = ()) -> DataFrame:
    """Give a frame the declared columns; extras go, and a value that does not fit its type becomes NULL.

    An absent column is an error, since a NULL in its place would silently change filters and joins; columns
    named in ``optional`` may be absent and are NULL then. ``bad_values`` counts what did not fit.
    """
    wanted = T.StructType.fromDDL(INPUT_TABLES[table])
    have = {c.lower(): c for c in df.columns}
    absent = [f.name for f in wanted.fields if f.name.lower() not in have and f.name not in set(optional)]
    if absent:
        raise ValueError(f"table {table} lacks columns: {', '.join(absent)}")
    return df.select(
        *[
            (F.col(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
    )


def bad_values(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, bad): values of each column that do not fit its declared type, in one aggregate."""
    wanted = [f for f in T.StructType.fromDDL(INPUT_TABLES[table]).fields if f.name.lower() in {c.lower() for c in df.columns}]
    counts = df.agg(*[F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in wanted])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("bad")) for f in wanted])
    return counts.select(F.lit(table).alias("table_name"), F.inline(pairs))


class TableFolder(Mapping[str, DataFrame]):
    """Operational tables kept as ``<root>/<table>`` in one file format."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", optional: Iterable[str] = (), **options: str):
        self.spark, self.root, self.fmt, self.options, self.optional = spark, root.rstrip("/"), fmt, options, tuple(optional)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in INPUT_TABLES:
            raise KeyError(table)
        return conform(self.raw(table), table, self.optional)

    def raw(self, table: str) -> DataFrame:
        """The table as it is stored, before types are given."""
        reader = self.spark.read.format(self.fmt).options(**self.options)
        if self.fmt in ("csv", "json"):
            # Text formats are read as strings and cast by name, so a bad value is a NULL and not a lost row.
            names = T.StructType.fromDDL(INPUT_TABLES[table]).fieldNames()
            reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        return reader.load(f"{self.root}/{table}")

    def __iter__(self) -> Iterator[str]:
        return iter(INPUT_TABLES)

    def __len__(self) -> int:
        return len(INPUT_TABLES)


class JdbcTables(Mapping[str, DataFrame]):
    """Operational tables in a relational database.

    ``split`` names, per table, a numeric column with its bounds; Spark then reads the table
    in that many range queries at once.  Other tables are read in one query, which is right for
    dimensions only; the large ones are refused without a split.
    """

    def __init__(self, spark: SparkSession, url: str, split: Mapping[str, tuple[str, int, int, int]], **options: str):
        self.spark, self.url, self.split, self.options = spark, url, split, options

    def __getitem__(self, table: str) -> DataFrame:
        if table not in INPUT_TABLES:
            raise KeyError(table)
        if table in LARGE_TABLES and table not in self.split:
            raise ValueError(f"table {table} needs a split: one query would read it in a single task")
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options)
        if table in self.split:
            column, low, high, parts = self.split[table]
            reader = reader.options(
                partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
            )
        return conform(reader.load(), table)

    def __iter__(self) -> Iterator[str]:
        return iter(INPUT_TABLES)

    def __len__(self) -> int:
        return len(INPUT_TABLES)


def parts_for(spark: SparkSession, size: int) -> int:
    """How many tasks tables of ``size`` bytes of files are dealt to: the session's shuffle partitions, more for larger tables.

    A task then holds a bounded share however large the tables are, and need not spill.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def start_shuffles_with(spark: SparkSession, parts: int) -> None:
    """Shuffles that adaptive execution sizes start with ``parts`` partitions, where that is more than the session's own;
    it joins the small ones again."""
    app = spark.sparkContext.applicationId
    if app not in _own_start:
        _own_start[app] = spark.conf.get(START, None)
    own = _own_start[app]
    if parts > int(own or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(START, str(parts))
    elif own is None:
        spark.conf.unset(START)
    else:
        spark.conf.set(START, own)


def read_query(spark: SparkSession, query: str, params: Mapping | None = None, **tables: DataFrame) -> DataFrame:
    """A SELECT with named parameters and named frames; values are bound, never spliced."""
    bound = {k: v.item() if hasattr(v, "item") else v for k, v in (params or {}).items()}
    return spark.sql(query, args=bound, **tables)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Iterable[str] | None = None) -> None:
    """Write Parquet, partitioned by school and year where the table has those columns.

    Rows are first spread by the partition columns and a row hash, so one large school-year is
    written by several tasks and a small one does not leave a file per task.
    """
    keys = [c for c in (PARTITION_COLUMNS if partition_by is None else partition_by) if c in df.columns]
    if not keys or len(keys) == len(df.columns):
        df.write.mode(mode).parquet(path)
        return
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write a table of the session's catalog in buckets of ``keys`` (one file each) below ``path``, and read it.

    A join or grouping whose keys hold all bucket columns needs no shuffle of this table. There are at least as many
    buckets as shuffle partitions, so that the other side of a join is dealt to as many tasks.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return spark.table(name)
