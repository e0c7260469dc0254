"""Connected components of an edge table by repeated contraction; no list of nodes leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare.session import staged, unstage


def connected(edges: DataFrame) -> DataFrame:
    """``(a, b)`` whole-number edges to ``(node, root)``: root is the smallest node of the component.

    Every node hooks on its smallest neighbour, pointers are shortened twice, and the edges are rewritten
    between the nodes that remain, until none is left. Self-loops are allowed; an empty table gives an empty
    table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    live = staged(both, "edges")
    labels = staged(live.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "labels")
    while True:
        hooks = staged(live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "hooks")
        up = hooks
        for _ in range(2):
            above = up.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
            up = up.join(above, F.col("up") == F.col("_a"), "left").select(
                "a", F.coalesce("_up", "up").alias("up"))
        up = staged(up, "hooks")
        moved = staged(labels.join(up, labels["root"] == up["a"], "left")
                       .select("node", F.coalesce("up", "root").alias("root")), "labels")
        unstage(labels, hooks)
        labels = moved
        left = up.select(F.col("a").alias("_l"), F.col("up").alias("l"))
        right = up.select(F.col("a").alias("_r"), F.col("up").alias("r"))
        rest = staged(live.join(left, F.col("a") == F.col("_l")).join(right, F.col("b") == F.col("_r"))
                      .filter("l != r").select(F.col("l").alias("a"), F.col("r").alias("b")).distinct(), "edges")
        unstage(live, up)
        live = rest
        if live.isEmpty():
            unstage(live)
            return labels
