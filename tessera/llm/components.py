"""Connected components by repeated contraction to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b): component is the least id reachable.

    A round points each vertex to the least of itself and its neighbours, follows the pointers to their roots by
    doubling, and contracts the edges to roots: at most half of the vertices are left. Nothing but a row's existence
    goes to the driver. Rounds are tables in the shared folder.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))
        least = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("p")), "least")
        while True:  # follow pointers to their roots, twice as far each time
            up = least.toDF("p", "pp")
            far = materialize(least.join(up, "p").select("id", F.col("pp").alias("q"), (F.col("pp") != F.col("p")).alias("moved")), "far")
            discard(least)
            least = far.select("id", F.col("q").alias("p"))
            if not far.where("moved").head(1):
                break
        if labels is None:
            labels = materialize(least.withColumnRenamed("p", "component"), "labels")
        else:
            step = least.withColumnRenamed("id", "component")
            older, labels = labels, materialize(labels.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
            discard(older)
        pa, pb = least.toDF("a", "pa"), least.toDF("b", "pb")
        older, edges = edges, materialize(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(older, least)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
