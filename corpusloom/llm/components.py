"""Connected components of an edge table, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node around: those above a node (large star), or those below it and itself."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("low"))
    least = stored(least.select("a", F.least("a", "low").alias("low")), "least")
    joined = pairs.join(least, "a")
    if large:
        made = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    made = stored(made.where("a != b").distinct(), "star")
    discard(least)
    return made


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge; the root is the least node of the component.

    Large and small stars alternate until every node hangs on its root. Each round stores its edges, whose number never
    grows; the number of rounds grows with the logarithm of a component's longest path.
    """
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b")
    now = stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    while True:
        # done when no node has two parents and no parent has a parent
        several = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("x"))
        chained = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").select(F.lit(1).alias("x"))
        if not several.unionByName(chained).take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        half = _star(now, large=True)
        discard(now)
        now = _star(half, large=False)
        discard(half)
