"""Batches of texts inside tasks: Python on executors, runs of bounded size, and rows for a bounded training sample."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.common import random_key


#: Rows of whole texts that are handed to Python at once. Spark's own 10,000 rows are some 20 MB of text and more where texts
#: are long; a task holds them several times over, as Arrow in the JVM and in Python and as what is made of them.
TEXT_ROWS = 1024
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()
_batch: dict[str, tuple[int, int]] = {}


def batches_of(spark: SparkSession, rows: int | None) -> None:
    """Plans made from now on hand Python `rows` rows at once, or the session's own number where that is smaller or `rows` is None."""
    app, now = spark.sparkContext.applicationId, int(spark.conf.get(BATCH))
    own, last = _batch.get(app, (now, now))
    own = now if now != last else own  # the session's own number was changed meanwhile
    most = own if rows is None or 0 < own < rows else rows
    spark.conf.set(BATCH, str(most))
    _batch[app] = own, most


def released(function: Callable) -> Callable:
    """`function`, after which the memory that Arrow keeps for later goes back to the system: workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return run


def map_arrow(rows: DataFrame, function: Callable, schema, batch_rows: int | None = None) -> DataFrame:
    """`mapInArrow`, with this package sent to the executors once per application (Spark's own file server deals it out).

    `batch_rows` bounds the rows of a batch; it is a session setting, which holds from here to the next call.
    """
    context = rows.sparkSession.sparkContext
    batches_of(rows.sparkSession, batch_rows)
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(package))
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)
    return rows.mapInArrow(released(function), schema)


def slices(texts: pa.Array, most: int = 8 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes of text and no more than `rows` rows."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size >= most or i + 1 - start >= rows:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def held_out(id_col: str) -> Column:
    """Rows whose checksum of the id, as text, leaves 2 when divided by 4; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def labelled_sample(rows: DataFrame, label: str, key: str, per_label: int, seed: int = 7) -> tuple[DataFrame, dict]:
    """About `per_label` rows of each label, by a hash of `key` (at most 1.3 times that and never more than 2), and the labels' counts."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).collect()}
    place = F.shiftrightunsigned(random_key(seed, F.col(key)), 33)  # 31 bits
    # One row a label; like the counts, it is as long as there are labels.
    most = [(v, int(2**31 * min(1.0, 1.3 * per_label / n))) for v, n in counts.items() if v is not None]
    kind = rows.schema[label].dataType.simpleString()
    bounds = F.broadcast(rows.sparkSession.createDataFrame(most, f"`__label` {kind}, `__below` long"))
    wanted = rows.join(bounds, (F.col(label) == F.col("__label")) & (place < F.col("__below")), "left_semi")
    return wanted.limit(2 * per_label * max(1, len(counts))), counts
