"""Hard negatives by slots of scores (operator 13).

A score is the integer inner product of two quantised vectors. For every anchor the best rows of its own label are its
positives; a positive with score s admits negatives (rows of another label) whose score lies from `low` to `high`
hundredths of s. The upper limits of an anchor's positives cut the scores into disjoint slots, highest first. All
windows of an anchor overlap, but the best k rows below a limit are among the best k of its slot and of the slots
under it: so each task keeps the best k per slot of its block of rows, a window over (anchor, slot) keeps the best k
of all blocks, and a list per anchor, at most slots x k long and sorted downwards, answers every window by its suffix.

The anchors are a stated query set and meet every row, in blocks: rows are dealt into blocks of bounded size, a task
holds its block and the anchors stream past it, with exact matrix products. The work grows with anchors x rows by its
nature. Nothing is sampled, no candidate is left out, and what is shuffled is per anchor, block and slot at most k rows.

Order is by score downwards, then by smaller id, then by the row's number. Results for odd input: rows with a null
label, a null vector or a null or non-finite component take no part; a null id comes after all others (and is no
anchor); repeated rows are rows of their own; vectors of different lengths are compared as if filled up with zeros, so
an empty vector scores 0; an anchor without positives, or a positive whose window is empty, has no rows; components
whose scores need more than 64 bits raise an error; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.batches import map_arrow
from chalkline.llm.common import staged

#: Rows of a block at most and at least (a smaller table is cut for the cores at hand, into SPREAD blocks at most).
BLOCK_ROWS, LEAST_ROWS, SPREAD = 1 << 18, 1 << 10, 128
#: Anchors and rows of one matrix product.
ANCHORS, COLUMNS = 256, 1 << 13
#: Stands for a null id while rows are ordered, and for a score that takes no part.
LAST, OUT = (1 << 63) - 1, -(1 << 63)
FOUND = "anchor long, anchor_id long, slot int, score long, id long, row long"


def quantised(x: Column, scale: int) -> Column:
    """floor(scale * x) per component, as long."""
    wide = F.exists(x, lambda v: F.abs(v.cast("double") * scale) >= float(1 << 62))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return F.when(wide, F.raise_error(F.lit("a component does not fit 64 bits")).cast("array<bigint>")).otherwise(q)


def vectors(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows that take part: row (a number of its own), id, label as text, q (the quantised vector)."""
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")))
    part = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    return part.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.col(label_col).cast("string").alias("label"), quantised(F.col(vector_col), scale).alias("q"))


def _matrix(q: pa.Array) -> np.ndarray:
    """One row a vector, filled up with zeros."""
    ends = q.offsets.to_numpy()
    flat, n = q.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    out = np.zeros((len(n), n.max(initial=0)), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = int(max(a.max(initial=0), -a.min(initial=0))) * int(max(b.max(initial=0), -b.min(initial=0))) * d
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    if any(abs(v) >= 1 << 63 for v in wide.flat):
        raise ValueError("a score does not fit 64 bits")
    return wide.astype(np.int64)


def best(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row; of equal ones the first columns. OUT never counts."""
    if found.shape[1] > k:
        least = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
        at, col = np.nonzero((found >= least[:, None]) & (found > OUT))
    else:
        at, col = np.nonzero(found > OUT)
    order = np.lexsort((col, ~found[at, col], at))
    at, col = at[order], col[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], col[place < k]


class Block:
    """The rows of one block in the order of their ids, and the best of them for anchors that stream past."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, rows = table.column("id").to_numpy(), table.column("row").to_numpy()
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.labels = table.column("label").combine_chunks().dictionary_encode()
        self.q = _matrix(table.column("q").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64())))[order]
        most = max(int(self.q.max(initial=0)), -int(self.q.min(initial=0)))
        self.q = self.q.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
        self.code = {v: i for i, v in enumerate(self.labels.dictionary.to_pylist())}
        self.codes = self.labels.indices.to_numpy()[order]

    def found(self, anchors: pa.RecordBatch, k: int, windows: bool) -> Iterator[dict]:
        own = np.array([self.code.get(v, -1) for v in anchors.column("label").to_pylist()], np.int64)
        q, rows, ids = _matrix(anchors.column("q")), anchors.column("row").to_numpy(), anchors.column("id").to_numpy()
        if windows:
            uppers, least = _matrix(anchors.column("uppers")), anchors.column("least").to_numpy()
            slots = np.array([len(u) for u in anchors.column("uppers").to_pylist()], np.int64)
        for lo in range(0, len(self.ids), COLUMNS):
            part = slice(lo, lo + COLUMNS)
            if windows:
                s = np.where(own[:, None] == self.codes[None, part], OUT, scores(q, self.q[part]))
                for slot in range(uppers.shape[1]):
                    here = np.flatnonzero(slots > slot)
                    under = uppers[:, slot + 1] + 1 if slot + 1 < uppers.shape[1] else least
                    under = np.where(slots > slot + 1, np.maximum(under, least), least)[here, None]
                    t = s[here]
                    yield self._rows(*best(np.where((t <= uppers[here, slot, None]) & (t >= under), t, OUT), k), t, lo, rows[here], ids[here], slot)
                continue
            # Rows of an anchor's own label only: a product per label.
            for code in np.unique(own[own >= 0]):
                here, cols = np.flatnonzero(own == code), np.flatnonzero(self.codes[part] == code)
                t = scores(q[here], self.q[part][cols])
                t = np.where(rows[here][:, None] == self.rows[part][cols][None, :], OUT, t)
                at, col = best(t, k)
                yield self._rows(at, col, t, lo, rows[here], ids[here], 0, cols)

    def _rows(self, at, col, t, lo, rows, ids, slot, cols=None) -> dict:
        to = lo + (col if cols is None else cols[col])
        return {"anchor": rows[at], "anchor_id": ids[at], "slot": np.full(len(at), slot, np.int32), "score": t[at, col], "id": self.ids[to], "row": self.rows[to]}


def _fold(parts: list[dict], k: int) -> dict:
    """The best k per anchor and slot of what one block found (a combiner before the shuffle)."""
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.lexsort((whole["row"], whole["id"], ~whole["score"], whole["slot"], whole["anchor"]))
    whole = {c: v[order] for c, v in whole.items()}
    new = np.ones(len(order), bool)
    new[1:] = (whole["anchor"][1:] != whole["anchor"][:-1]) | (whole["slot"][1:] != whole["slot"][:-1])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return {c: v[place < k] for c, v in whole.items()}


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, windows: bool) -> DataFrame:
    """The best k rows per anchor and slot: rows in blocks, all anchors past each of them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for b in batches:
            query = b.column("query").to_numpy(zero_copy_only=False).astype(bool)
            cut = int(np.searchsorted(query, True))
            if cut:
                held.append(b.slice(0, cut))
            for lo in range(cut, len(query), ANCHORS):
                if block is None and not held:
                    return
                block = block or Block(held)
                held = []
                parts = list(block.found(b.slice(lo, min(ANCHORS, len(query) - lo)), k, windows))
                if parts:
                    yield pa.RecordBatch.from_pydict(_fold(parts, k))

    bound = ["uppers", "least"] if windows else []
    empty = {"uppers": F.lit(None).cast("array<bigint>"), "least": F.lit(None).cast("bigint")}
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "row", "id", "label", "q", *[empty[c].alias(c) for c in bound])
    queries = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "row", "id", "label", "q", *bound)
    ordered = dealt.unionByName(queries).repartitionById(blocks, "block").drop("block").sortWithinPartitions("query")
    found = map_arrow(ordered, search, FOUND)
    place = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _blocks(spark, rows: int) -> int:
    cores = min(SPREAD, 2 * spark.sparkContext.defaultParallelism)
    return max(1, math.ceil(rows / BLOCK_ROWS), min(cores, rows // LEAST_ROWS))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a condition on `id` (null ids are never anchors)."""
    if not 0 <= low < high:
        raise ValueError("0 <= low < high")
    spark = rows.sparkSession
    table = staged(vectors(rows, scale, id_col, vector_col, label_col), "vectors")
    blocks = _blocks(spark, table.count())
    anchors = table.where((F.col("id") != LAST) & is_anchor)
    near = _search(table, anchors, blocks, positives, False).select("anchor", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    # With low < high a window is empty where the positive's score is below zero.
    wide = "cast(positive_score as decimal(20,0))"
    limits = near.where("positive_score >= 0").select("*", F.expr(f"{wide} * {high} div 100").alias("upper"), F.expr(f"({wide} * {low} + 99) div 100").alias("lower"))
    # At most `positives` entries a list.
    listed = limits.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("least"), F.collect_list(F.struct("place", "positive", "positive_score", "upper", "lower")).alias("windows"))
    listed = staged(listed, "positives")
    queries = anchors.join(listed.select(F.col("anchor").alias("row"), "uppers", "least"), "row")
    kept = _search(table, queries, blocks, negatives, True)
    down = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id", "row", "slot", "score")))
    lists = kept.groupBy("anchor").agg(F.first("anchor_id").alias("anchor_id"), down.alias("found"))  # positives x negatives entries at most
    each = lists.join(listed, "anchor").select("anchor", "anchor_id", "found", "uppers", F.explode("windows").alias("w"))
    slot = F.array_position("uppers", F.col("w.upper")) - 1
    suffix = F.slice(F.filter("found", lambda n: (n["slot"] >= slot) & (n["score"] >= F.col("w.lower"))), 1, negatives)
    rank = each.select("anchor_id", "w", F.posexplode(suffix).alias("at", "n"))
    return rank.select(
        "anchor_id", F.nullif(F.col("w.positive"), F.lit(LAST)).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.nullif(F.col("n.id"), F.lit(LAST)).alias("negative_id"), F.col("w.positive_score").alias("positive_score"), F.col("n.score").alias("negative_score"))
