"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root for every node that has an edge (of integers); nodes of one component share a root, one of them.

    Each round every node joins, of itself and its neighbours, the one with the least seeded hash, and the edges between
    groups make the next round's graph. The hash changes by round, so a constant share of the nodes goes in each, whatever
    the graph's shape: the rounds follow the logarithm of the nodes. Nothing but the count of open edges comes to the driver.
    """
    now = saved(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct(), "cc-edges")
    roots, k = None, 0
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        order = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        least = both.groupBy("x").agg(F.min(F.struct(order("y").alias("o"))).alias("o"))
        step = saved(least.select(F.col("x").alias("node"), F.least(F.col("o.o"), order("x"))["v"].alias("root")), f"cc-step-{k}")
        if roots is None:
            roots = step
        else:
            old = roots.select("node", F.col("root").alias("mid"))
            roots = saved(old.join(step.select(F.col("node").alias("mid"), "root"), "mid", "left").select("node", F.coalesce("root", "mid").alias("root")), f"cc-roots-{k}")
        x = step.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        y = step.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        now = now.join(x, "x").join(y, "y").where("rx <> ry")
        now = saved(now.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), f"cc-edges-{k}")
        k += 1
    return roots if roots is not None else now.select(F.col("x").alias("node"), F.col("y").alias("root"))
