"""Connected components by alternating large and small stars, staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(edges: DataFrame, max_rounds: int = 40, partial: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge (a, b) and isn't itself the smallest.

    ``partial``: stop after so many rounds.  Nodes of one label are then connected, but
    connected nodes may still have several labels: enough to skip links that are known.

    Each round is two aggregations over the edges, whose number never grows beyond that of
    nodes and edges; nothing but one number a round reaches the driver.  Null ends, loops
    and repeated edges are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = shared.stage(e, "edges")
    last = None
    for k in range(max_rounds):
        if k == partial:
            break
        # large star: each node links its larger neighbours to the smallest of its neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: each node links its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, shared.stage(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        shared.release(old)
        if partial is not None:
            continue
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
