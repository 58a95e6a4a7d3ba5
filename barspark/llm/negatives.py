"""Hard-negative mining over k-means inverted lists with exact bounds.

Every row goes into the list of its nearest centroid, and a list keeps its radius, the
distance of its farthest row. For a query q, Cauchy-Schwarz bounds the inner product with
any row of a list with centroid c and radius r: between q.c - |q| r and q.c + |q| r. A
query visits lists in the order of their upper bounds, some more in each round; a list whose
bounds lie outside the window of admitted scores is skipped, and a query stops when the
bound falls strictly below its k-th score (an equal bound may hide a tie of a smaller id).
The search runs twice: for an anchor's positives, then for the negatives of all its
positives at once, each with a window of its own.

A round is one shuffle: visiting queries, in slices of at most about SLICE, meet the visited
lists, in pieces of about PIECE rows, so a task's rows are bounded whatever list is hot. A
list's piece goes only to slices that visit it. The centroids (at most MOST_CELLS numbers)
come from Lloyd rounds over all rows; the bounds make any centroids give exact results.

Defined cases: rows with a null id, a null label, a null vector or a null, NaN or infinite
component take no part; components that would pass clustering.MOST after scaling count as
that; shorter vectors count as padded with 0; no row of the anchor's own id is a positive or
a negative; of rows repeated with id, label and vector all are candidates, and they ask
once; rows of one id and other labels or vectors are anchors each; a positive with a
negative score has an empty window; ties go to the smaller id; fewer rows than asked for
give all; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import clustering
from .clustering import wide
from .support import done_with, saved

#: Rows of a piece of a list and queries of a slice, about; the most lists.
PIECE, SLICE, MOST_LISTS = 4096, 1024, 1024
#: Lists visited in the first round, and how many times as many have been after each further one.
FIRST, GROW = 8, 8
#: Beyond any score.
FAR = 1 << 62
KEY = ["query_id", "which"]


class Index:
    """Inverted lists: the table (id, label, v, copies, cluster), and of each list its centroid, radius and size."""

    def __init__(self, rows: DataFrame, rounds: int = 3, seed: int = 1):
        ship(rows.sparkSession)
        n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        self.dims = max(1, dims or 0)
        k = max(1, min(MOST_LISTS, round(math.sqrt(n) / 4), clustering.MOST_CELLS // (self.dims + 1)))
        points = clustering.distinct(rows)
        self.centroids = clustering.fit(points, clustering.first_centroids(rows, k, self.dims, seed), rounds)
        done_with(points)
        self.rows = saved(clustering.assign(rows, self.centroids), "lists") if len(self.centroids) else rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
        self.radii, self.pieces = np.full(len(self.centroids), -1.0), [1] * max(1, len(self.centroids))
        for r in self.rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect():  # a line a list
            self.radii[r["cluster"]], self.pieces[r["cluster"]] = math.sqrt(r["d"]), max(1, -(-r["n"] // PIECE))

    def piece(self) -> Column:
        return F.pmod(F.xxhash64("id", "label", "v"), self.count()).cast("int")

    def count(self) -> Column:
        """How many pieces the list of a row has."""
        return F.get(F.array(*[F.lit(p) for p in self.pieces]), F.col("cluster"))


def _ragged(column, width: int, fill: int) -> np.ndarray:
    """Rows of a list<int64> column, filled up to width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.full((len(column), width), fill, np.int64)
    out[np.arange(width) < column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _windows(table) -> tuple[np.ndarray, np.ndarray]:
    """Least score wanted (the window's, or the k-th found if that is higher) and most, of each query and window."""
    width = max(1, max((len(x) for x in table.column("low")), default=0))
    low, high, kth = (_ragged(table.column(n), width, f) for n, f in (("low", FAR), ("high", -FAR), ("kth", -FAR)))
    return np.maximum(low, kth), high


def needed(q: np.ndarray, least: np.ndarray, high: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each query still needs each list, and the list's place in the query's order."""
    q, c = q.astype(float), centroids.astype(float)
    size = np.sqrt((q * q).sum(1))[:, None]
    middle, reach = q @ c.T, size * radii
    slack = 1e-9 * size * (np.sqrt((c * c).sum(1)) + radii + 1) + 1e-6  # more than what rounding can take away
    upper, lower = middle + reach + slack, middle - reach - slack
    place = np.empty(upper.shape, np.int64)
    np.put_along_axis(place, np.argsort(-upper, 1, kind="stable"), np.arange(upper.shape[1])[None, :], 1)
    need = np.zeros(upper.shape, bool)
    for w in range(least.shape[1]):
        need |= (upper >= least[:, w, None]) & (lower <= high[:, w, None]) & (least[:, w] <= high[:, w])[:, None]
    return need & (radii >= 0), place


def _visits(index: Index, begin: int, end: int):
    centroids, radii, dims = index.centroids, index.radii, index.dims

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            need, place = needed(wide(b.column(b.schema.get_field_index("v")), dims), *_windows(b), centroids, radii)
            q, c = np.nonzero(need & (place >= begin) & (place < end))
            for i in range(0, len(q), 4096):
                part = b.take(pa.array(q[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c[i : i + 4096], pa.int32())], names=[*b.schema.names, "cluster"])

    return run


FOUND = "query_id long, which long, window int, id long, score long, copies long"


def scored(q: np.ndarray, q_id: np.ndarray, q_label: np.ndarray, least: np.ndarray, high: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, same: bool):
    """Of each query and window the k best admitted rows: query number, window, row number, score."""
    exact = np.float64 if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2.0**53 else np.int64
    score = (q.astype(exact) @ x.astype(exact).T).astype(np.int64)
    fit = ((q_label[:, None] == labels) == same) & (q_id[:, None] != ids)
    out = []
    for w in range(least.shape[1]):
        ok = fit & (score >= least[:, w, None]) & (score <= high[:, w, None])
        if len(ids) > k:  # what is below the k-th best leaves before the sort
            top = np.where(ok, score, -FAR)
            ok &= score >= np.partition(top, len(ids) - k, 1)[:, len(ids) - k, None]
        qi, ri = np.nonzero(ok)
        order = np.lexsort((ids[ri], -score[qi, ri], qi))
        qi, ri = qi[order], ri[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi, "left") < k
        qi, ri = qi[keep], ri[keep]
        out.append((qi, np.full(len(qi), w), ri, score[qi, ri]))
    return [np.concatenate(x) for x in zip(*out)]


def _meet(k: int, same: bool, dims: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if queries.num_rows and rows.num_rows:
            own, which, label = (queries.column(n).to_numpy() for n in ("query_id", "which", "label"))
            ids, labels, copies = (rows.column(n).to_numpy() for n in ("id", "label", "copies"))
            qi, w, ri, s = scored(wide(queries.column("v"), dims), own, label, *_windows(queries), wide(rows.column("v"), dims), ids, labels, k, same)
            cols = own[qi], which[qi], w, ids[ri], s, copies[ri]
        else:
            cols = (np.empty(0, np.int64),) * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "which", "window", "id", "score", "copies"])

    return run


def search(queries: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """query_id, which, window, id, score, rank: the k best rows of the query's own label (same) or of any other, of each window.

    queries: query_id, which, label, v, slice, and low and high, arrays with the least and the most score of each window.
    """
    lists, begin, end, best = len(index.centroids), 0, FIRST, None
    rows = index.rows.select("cluster", index.piece().alias("piece"), "id", "label", "v", "copies")
    none = F.transform("low", lambda _: F.lit(-FAR))
    while begin < lists:
        if best is None:
            state = queries.withColumn("kth", none)
        else:
            full = best.where(F.col("rank") == k).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full"))  # a line a window
            kth = F.transform("low", lambda _, i: F.coalesce(F.element_at("full", i.cast("int")), F.lit(-FAR)))
            state = queries.join(full, KEY, "left").withColumn("kth", F.when(F.col("full").isNull(), none).otherwise(kth)).drop("full")
        schema = T.StructType([*state.schema.fields, T.StructField("cluster", T.IntegerType())])
        visits = saved(state.mapInArrow(_visits(index, begin, end), schema), "visits")
        every = F.explode(F.sequence(F.lit(0), index.count() - 1)).alias("piece")
        cells = visits.select("cluster", "slice").distinct().select(F.col("cluster").alias("cluster"), F.col("slice").alias("slice"), every)
        left = visits.select("*", every)
        right = rows.join(cells, ["cluster", "piece"])
        cell = ["cluster", "piece", "slice"]
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_meet(k, same, index.dims), FOUND)
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*KEY, "window", "id", "score")
        found = found if best is None else found.unionByName(best.drop("rank"))
        order = W.partitionBy(*KEY, "window").orderBy(F.desc("score"), "id")
        last, best = best, saved(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        done_with(visits, *([] if last is None else [last]))
        begin, end = end, end * GROW
    if best is None:
        best = queries.sparkSession.createDataFrame([], "query_id long, which long, window int, id long, score long, rank int")
    return best


def sliced(queries: DataFrame) -> DataFrame:
    """queries with slice: queries of neighbouring home lists together, about SLICE of them; a list with more is split by hash."""
    first, parts, slice_, room = {}, {}, -1, 0
    for r in queries.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect():  # a line a list
        if r["n"] > room:
            slice_, room = slice_ + 1, SLICE
        first[r["cluster"]], parts[r["cluster"]] = slice_, max(1, -(-r["n"] // SLICE))
        slice_, room = slice_ + parts[r["cluster"]] - 1, room - r["n"] if parts[r["cluster"]] == 1 else 0
    most = max(first, default=-1) + 1
    of = lambda d, c, none: F.get(F.array(*[F.lit(d.get(i, none)) for i in range(max(1, most))]), c)
    c = F.col("cluster")
    return queries.withColumn("slice", (of(first, c, 0) + F.pmod(F.xxhash64(*KEY), of(parts, c, 1))).cast("int"))


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    df holds whole numbers in id_col, label_col and the array vector_col; anchors says of which rows negatives are asked.
    A negative's score lies between low and high hundredths of the positive's.
    """
    own = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    most = max(positives, negatives)  # more copies of one row than are returned make no difference
    rows = saved(own.groupBy("id", "label", "v").agg(F.least(F.count("*"), F.lit(most)).alias("copies"), F.max("asks").alias("asks")), "mining-rows")
    index = Index(rows.drop("asks"))
    asks = rows.where("asks").select("id", "label", "v")
    asks = clustering.assign(asks, index.centroids) if len(index.centroids) else asks.withColumn("cluster", F.lit(0))
    queries = asks.select(F.col("id").alias("query_id"), F.xxhash64("label", "v").alias("which"), "label", "v", "cluster")
    queries = saved(sliced(queries).drop("cluster"), "anchors")
    all_ = queries.select("*", F.array(F.lit(-FAR)).alias("low"), F.array(F.lit(FAR)).alias("high"))
    liked = search(all_, index, positives, True).select(*KEY, F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    rest = F.pmod(p, F.lit(100))
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")  # in whole numbers, however large
    window = F.struct("window", F.when(p >= 0, hundreds * low + F.ceil(rest * low / 100)).otherwise(F.lit(FAR)).alias("low"), F.when(p >= 0, hundreds * high + F.floor(rest * high / 100)).otherwise(F.lit(-FAR)).alias("high"))
    windows = liked.groupBy(*KEY).agg(F.array_sort(F.collect_list(window)).alias("w"))  # `positives` at most
    windows = queries.join(windows.select(*KEY, F.col("w.low").alias("low"), F.col("w.high").alias("high")), KEY)
    found = search(windows, index, negatives, False)
    out = found.withColumn("window", F.col("window") + 1).join(liked, [*KEY, "window"])
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
