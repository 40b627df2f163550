"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every end of an edge (a, b) the smallest id that can be reached from it.

    Each round every node takes the least label of its neighbours, and then the label of its label, so that rounds grow
    with the logarithm of the longest chain. Labels are written in each round; only whether any changed comes to the driver.
    The joins have a written table with one row per node on one side, so AQE can split the other side where a node has
    very many edges.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "edges")
    labels = stage(both.groupBy(F.col("u").alias("id")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("x"))
        jump = step.join(labels.select(F.col("id").alias("x"), F.col("component").alias("y")), "x", "left")
        new = stage(jump.select("id", "old", F.least("x", F.coalesce("y", "x")).alias("component")), "labels")
        labels = new.select("id", "component")
        if new.where("component != old").isEmpty():
            return labels
