"""Connected components by contraction, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is one node of the component.

    Each round every node joins its smallest neighbour and the graph shrinks to the joined nodes, until no edge is
    left; the rounds' tables are then followed from the last to the first. Every round is written to the shared folder.
    Neighbours are combined before the shuffle, and a node with very many edges only meets plain joins, which adaptive
    execution splits.
    """
    rest = staged(_ordered(edges.select("a", "b")), "cc-edges")
    rounds = []
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "cc-round")
        rounds.append(up)
        moved = rest.join(up.withColumnsRenamed({"node": "a", "up": "ua"}), "a").join(up.withColumnsRenamed({"node": "b", "up": "ub"}), "b")
        rest = staged(_ordered(moved.select(F.col("ua").alias("a"), F.col("ub").alias("b"))), "cc-edges")
    if not rounds:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = rounds[-1].withColumnRenamed("up", "label")
    for up in reversed(rounds[:-1]):
        last = label.withColumnsRenamed({"node": "up", "label": "top"})
        label = up.join(last, "up", "left").select("node", F.coalesce("top", "up").alias("label"))
    return staged(label, "cc-labels")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
