"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.session import written


def components(links: DataFrame) -> DataFrame:
    """From ``a, b``: ``node, root`` for every node of a link; the root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks twice
    and contracts the links to where they lead; hooks only lead down, and the
    number of nodes falls by half at least. All steps aggregate or join; a round
    ends in the shared folder, and the hooks of all rounds are followed at the end.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct())
    rounds = []
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("at"), F.least("a", "b").alias("up"))
        for _ in range(2):
            higher = hooks.select(F.col("at").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(higher, "up").select("at", F.col("top").alias("up"))
        hooks = written(hooks)
        rounds.append(hooks)
        for side in ("a", "b"):
            edges = edges.join(hooks, F.col(side) == F.col("at")).drop(side, "at").withColumnRenamed("up", side)
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    for hooks in rounds:
        labels = labels.join(hooks, F.col("root") == F.col("at"), "left").select("node", F.coalesce("up", "root").alias("root"))
    return labels
