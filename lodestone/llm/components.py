"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every
step is a group-by and a join on the edges; the edges are written to the shared
folder after each round, so that the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


def _pointed(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs joined with the least of u and its neighbours, as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return pairs.join(least, "u")


def _edges(df: DataFrame) -> DataFrame:
    return df.where("u <> v").distinct()


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _edges(_pointed(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return _edges(small)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge; root is the least node of its component.

    ``edges`` has two columns of one ordered type; direction, repeats, loops and
    nulls do not matter (a node with only a loop is not returned).
    """
    current = materialize(_edges(edges.toDF("u", "v").where("u is not null and v is not null")), "components")
    state = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or seen[0] == 0:
            break
        state = tuple(seen)
        current = materialize(_round(current), "components")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
