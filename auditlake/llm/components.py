"""Connected components of an edge table by repeated contraction.

In each round every node hooks onto the neighbour (or itself) that comes first in a fixed pseudo-random
order, takes one more step along the hooks, and the edges are renamed and made distinct. The order makes
long paths shrink by a constant factor a round whatever the ids look like. All steps are joins and
map-side-combining aggregates over written tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _distinct(edges: DataFrame) -> DataFrame:
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long); component is the smallest node reachable.

    Loops, repeated and reversed edges are harmless; edges with a null end are left out.
    """
    spark = edges.sparkSession
    edges = materialize(_distinct(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    names: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("v", "u")
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy("v").agg(F.min(order("u")).alias("u")).select("v", F.least("u", order("v"))["id"].alias("to"))
        hook = materialize(hook, "hooks")
        step = hook.select(F.col("v").alias("to"), F.col("to").alias("far"))
        hook = materialize(hook.join(step, "to").select("v", F.col("far").alias("to")), "hooks")
        if names is None:
            names = hook.toDF("node", "name")
        else:
            names = names.join(hook.toDF("name", "to"), "name", "left").select("node", F.coalesce("to", "name").alias("name"))
            names = materialize(names, "names")
        edges = edges.join(hook.toDF("a", "x"), "a").join(hook.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = materialize(_distinct(edges), "edges")
    if names is None:
        return spark.createDataFrame([], "node long, component long")
    least = names.groupBy("name").agg(F.min("node").alias("component"))
    return names.join(least, "name").select("node", "component")
