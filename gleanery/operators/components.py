"""Connected components of links between ids, as DataFrames all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): ``id``, ``component`` (the least id reachable), for every id that has a link to another.
    Links with a null end, repeated ones and those of an id with itself add nothing; no links give no rows.

    Each round hooks every id to its least lesser neighbour, follows the hooks one step further, and
    contracts the links; the number of ids that still have links at least halves, and groups that
    hang on one id go in one round. Tables are cut by writing them after each round. Keys with very many links
    are only aggregated with partial sums or stand on the side of a join that can be split.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    rounds = 0
    while not edges.isEmpty():
        hooks = written(edges.groupBy("a").agg(F.min("b").alias("to")), "hooks")
        further = hooks.select(F.col("a").alias("to"), F.col("to").alias("then"))
        roots = written(hooks.join(further, "to", "left").select("a", F.coalesce("then", "to").alias("root")), "roots")
        new = labels.join(roots.withColumnRenamed("a", "component"), "component", "left").select(
            "id", F.coalesce("root", "component").alias("component")
        )
        old = labels
        labels = written(new, "labels")
        if rounds:
            dropped(old)
        rounds += 1
        other = roots.select(F.col("a").alias("b"), F.col("root").alias("root_b"))
        moved = edges.join(roots, "a").join(other, "b", "left").select(
            F.col("root").alias("a"), F.coalesce("root_b", "b").alias("b")
        )
        contracted = written(
            moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
        )
        for done in (edges, hooks, roots):
            dropped(done)
        edges = contracted
    return labels
