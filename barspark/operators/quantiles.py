"""Exact quantiles of groups of any size, by refining histograms.

A group of up to SMALL values is interpolated by Spark's own percentile, in memory. For larger
groups no task ever holds one: each pass counts the values near each wanted rank in BUCKETS
equal slices of the range still open (partial counts are added map-side, so a group is at
most BUCKETS lines a rank and task), keeps the slice that holds the rank, with the least and
the greatest value seen in it, and ends when a slice holds one value only or few enough rows
to sort. A quantile lies between two neighbouring ranks, linearly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import saved

#: Values that a task may sort, and slices of a range.
SMALL, BUCKETS = 1 << 16, 1 << 10


def quantiles(df: DataFrame, by: list[str], value: str, points: list[float], small: int = SMALL, buckets: int = BUCKETS) -> DataFrame:
    """by, n (values that are not null) and q: an array with the quantile at each point, null for a group without a value. With by empty there is one line."""
    if not points or not all(0 <= p <= 1 for p in points):
        raise ValueError("points from 0 to 1 are asked for")
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_k0")]
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    key = rows.columns[:-1]
    sizes = saved(rows.groupBy(*key).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sizes")
    large = sizes.where(F.col("n") > small)
    array = F.array(*[F.lit(float(p)) for p in points])
    names = [F.col(k).alias(c) for k, c in zip(key, by)]
    if large.isEmpty():
        out = rows.groupBy(*key).agg(F.count("v").alias("n"), F.percentile("v", array).alias("q"))
        return out.select(*names, "n", "q")
    of = large.select(*[F.col(k).alias(f"_of{k}") for k in key])
    little = rows.join(of, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in key], "left_anti").groupBy(*key).agg(F.count("v").alias("n"), F.percentile("v", array).alias("q"))
    # The ranks on both sides of each point, counted from 0, and the slice that each is in: `below` values lie under it.
    at = F.col("p") * (F.col("n") - 1)
    ranks = large.withColumn("p", F.explode(array)).select(*key, "n", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank")).distinct()
    open_ = saved(ranks.withColumn("below", F.lit(0).cast("long")).withColumn("held", F.col("n")), "quantile-open")
    done = None
    while True:
        ready = open_.where("lo = hi").select(*key, "rank", F.col("lo").alias("v"))
        done = ready if done is None else done.unionByName(ready)
        left = open_.where(f"lo < hi and held > {small}")
        few = open_.where(f"lo < hi and held <= {small}")
        sorted_ = _met(rows, few, key).withColumn("place", F.row_number().over(W.partitionBy(*key, "rank").orderBy("v")) - 1 + F.col("below"))
        done = done.unionByName(sorted_.where("place = rank").select(*key, "rank", "v"))
        if left.isEmpty():
            break
        met = _met(rows, left, key)
        # Halves first, so that the whole range of doubles does not overflow.
        share = (met["v"] / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        slices = met.withColumn("slice", F.least(F.floor(share * buckets), F.lit(buckets - 1)))
        counts = slices.groupBy(*key, "n", "rank", "below", "slice").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("c").over(W.partitionBy(*key, "rank").orderBy("slice")) - F.col("c") + F.col("below")
        placed = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        open_ = saved(placed.select(*key, "n", F.col("a").alias("lo"), F.col("b").alias("hi"), "rank", F.col("before").alias("below"), F.col("c").alias("held")), "quantile-open")
    found = saved(done, "quantile-values").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two lines a point
    found = found.withColumnsRenamed({k: f"_of{k}" for k in key})
    both = large.join(found, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in key])
    place = lambda p: p * (F.col("n") - 1)
    one = lambda p: F.col("m")[F.floor(place(p))] + (F.col("m")[F.ceil(place(p))] - F.col("m")[F.floor(place(p))]) * (place(p) - F.floor(place(p)))
    big = both.select(*key, "n", F.transform(array, one).alias("q"))
    return little.unionByName(big).select(*names, "n", "q")


def _met(rows: DataFrame, ranks: DataFrame, key: list[str]) -> DataFrame:
    """The values inside each rank's slice; the ranks are a few lines a group."""
    ranks = ranks.withColumnsRenamed({k: f"_of{k}" for k in key})
    cond = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    return rows.join(ranks, cond).drop(*[f"_of{k}" for k in key])
