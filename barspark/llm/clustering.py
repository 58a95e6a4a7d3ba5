"""Centroid clustering: weighted Lloyd rounds over distinct quantised vectors.

Rows with identical quantised vectors are grouped into one with a multiplicity. Each round
reads the distinct vectors once: a task assigns its own to the nearest centroid, adds up
multiplicity times vector in whole numbers for each cluster, and gives one row a cluster;
those partial sums are added by cluster and component, and only k centroids (at most
MOST_CELLS numbers) come to the driver. After the last round the distinct vectors are
assigned once more and joined back to the rows by the vector itself.

Defined cases: vectors that are null, hold a null, NaN or infinite component, or have not
`dims` components are left out; components that would pass MOST after scaling count as MOST,
so squared distances fit a long; ties go to the centroid of the smaller number; rows with a
null id are clustered too (and are first centroids only where ids are too few); repeated ids
and rows are rows each; fewer vectors than k make fewer centroids; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .support import saved
from .topk import matrix, quantised

#: The size at which a quantised component is held, and the most numbers in all centroids.
MOST, MOST_CELLS = 1 << 27, 1 << 22


def bounded(vector: Column, scale: int) -> Column:
    """quantised(), with components between -MOST and MOST."""
    return F.transform(quantised(vector, scale), lambda x: F.least(F.greatest(x, F.lit(-MOST)), F.lit(MOST)))


def wide(column, dims: int) -> np.ndarray:
    """Rows of a list column, padded with 0 to dims."""
    out = matrix(column)
    return out if out.shape[1] == dims else np.pad(out, ((0, 0), (0, dims - out.shape[1])))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number (of equals the least) and the squared distance of each row, exactly."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4.0 * float(most) ** 2 * max(1, x.shape[1]) < 2.0**53 else np.int64  # sums of whole numbers are exact as floats below 2^53
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    own = d.argmin(1)
    return own, d[np.arange(len(d)), own].astype(np.int64)


def partial_sums(x: np.ndarray, n: np.ndarray, centroids: np.ndarray, total: np.ndarray) -> None:
    """Adds (n, n times vector) of each row to the line of its cluster in total."""
    own, _ = nearest(x, centroids)
    order = np.argsort(own, kind="stable")
    have, first = np.unique(own[order], return_index=True)
    if len(have):
        total[have] += np.add.reduceat(np.concatenate([n[:, None], x * n[:, None]], 1)[order], first)


def _summed(centroids: np.ndarray):
    def run(batches):
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for b in batches:
            partial_sums(wide(b.column(0), centroids.shape[1]), b.column(1).to_numpy(), centroids, total)
        have = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(list(total[have]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    return run


def fit(points: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after `rounds` rounds over points (v, n); a cluster without a vector keeps its own."""
    ship(points.sparkSession)
    for _ in range(rounds if len(centroids) else 0):
        sums = points.select("v", "n").mapInArrow(_summed(centroids), "cluster int, sums array<bigint>")
        each = sums.select("cluster", F.posexplode("sums").alias("place", "part"))
        lines = each.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("s")).collect()  # k * (dims + 1) at most
        new = centroids.copy()
        count = {r["cluster"]: int(r["s"]) for r in lines if r["place"] == 0}
        for r in lines:
            if r["place"]:
                new[r["cluster"], r["place"] - 1] = int(r["s"]) // count[r["cluster"]]
        centroids = new
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points' columns with cluster and distance (squared)."""
    ship(points.sparkSession)
    at = points.columns.index("v")

    def run(batches):
        for b in batches:
            own, distance = nearest(wide(b.column(at), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(distance, pa.int64())], names=[*b.schema.names, "cluster", "distance"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def first_centroids(rows: DataFrame, k: int, dims: int, seed: int = 1) -> np.ndarray:
    """The vectors of the k rows (id, v) with the smallest lower-case hex SHA-256 of `seed:id`, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    lines = rows.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    out = np.zeros((len(lines), dims), np.int64)
    for i, r in enumerate(lines):
        out[i, : len(r["v"])] = r["v"]
    return out


def distinct(rows: DataFrame) -> DataFrame:
    """v and n: each vector once, with the number of its rows; counted before the shuffle, so a hot vector is a line a task."""
    return saved(rows.groupBy("v").agg(F.count("*").alias("n")), "cluster-points")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept row of df: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    if k * (dims + 1) > MOST_CELLS:
        raise ValueError(f"k times dims may be {MOST_CELLS} at most")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), bounded(F.col(vector_col), scale).alias("v")).where(F.size("v") == dims)
    points = distinct(rows)
    centroids = fit(points, first_centroids(rows, k, dims, seed), rounds)
    found = saved(assign(points, centroids), "cluster-assigned")
    big = "decimal(38,0)"
    lines = found.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).cast(big).alias("s")).collect()  # k at most
    most = (1 << 63) - 1
    whole = min(most, sum(int(r["s"]) for r in lines))
    sums = spark.createDataFrame(
        [(r["cluster"], min(most, int(r["s"])), whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in lines],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    back = rows.join(found.select("v", "cluster", "distance"), "v").join(F.broadcast(sums), "cluster")  # a line a cluster
    return back.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
