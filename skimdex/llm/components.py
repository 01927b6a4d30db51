"""Connected components of an edge table by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import stage


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _jumped(up: DataFrame) -> DataFrame:
    """``up`` (node, up) with each chain followed to its end: the length that is
    followed doubles with each join, so a chain of n steps takes log2(n) joins."""
    while True:
        on = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        far = stage(up.join(on, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "up")
        up = far.select("node", "up")
        if not far.filter("moved").limit(1).count():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) with a neighbour: root is the
    least node that can be reached. In each round a node with a smaller neighbour
    points to the least of them, chains of pointers are followed to their ends, and
    nodes move there with their edges; edges that become loops or equal vanish. The
    greatest node of the edges left always moves, so rounds end by themselves. Each
    round is written to the shared folder. Minima are combined on the map side, and a
    root that many nodes hold meets one row in the join, which Spark splits when it is
    skewed."""
    e, labels = stage(_ordered(edges), "edges"), None
    while labels is None or e.limit(1).count():
        up = _jumped(stage(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "up"))
        if labels is None:
            nodes = e.select(F.col("a").alias("root")).union(e.select("b")).distinct().withColumn("start", F.col("root"))
        else:
            nodes = labels.select("root", F.col("node").alias("start"))
        moved = nodes.join(up.withColumnRenamed("node", "root"), "root", "left")
        labels = stage(moved.select(F.col("start").alias("node"), F.coalesce("up", "root").alias("root")), "labels")
        low, high = up.select(F.col("node").alias("a"), F.col("up").alias("up_a")), up.select(F.col("node").alias("b"), F.col("up").alias("up_b"))
        e = stage(_ordered(e.join(high, "b").join(low, "a", "left").select(F.coalesce("up_a", "a").alias("a"), F.col("up_b").alias("b"))), "edges")
    return labels
