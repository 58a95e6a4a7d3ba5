"""Exact top-k search by MaxScore over integer vectors.

A vector's dimensions are a query's terms. Candidates fall into shards and queries into
slices by seeded hashes, both of bounded size, and each task scores one slice against
one shard: the rows that meet there are bounded whatever the table's size. In it, a
term's score lies between bounds that the shard's least and largest values give. Terms
are taken block by block, of falling spread, and after each block the k-th best partial
score with the least that is left bounds the k-th best score from below: the threshold
rises. Terms are essential as long as most candidates can still pass it; the others are
non-essential, and only the candidates that are still competitive are probed in them.
The shards' top k are merged. Dense vectors have every candidate in every posting list,
so the essential part is a product of matrices rather than a walk.

Defined cases: vectors that are null or hold null, NaN or infinite components take no
part; shorter vectors count as padded with 0; ties go to the smaller id; repeated ids
are candidates each, and no row of the query's own id is one; query rows of one id and
one vector ask once, those of one id and other vectors each; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Vectors in a shard and queries in a slice, about.
SHARD, SLICE = 4096, 1024
#: Terms between two thresholds, the share of competitive candidates under which the terms left are non-essential, and pairs probed at once.
BLOCK, FEW, PROBED = 16, 0.05, 65_536


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if any is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def matrix(column) -> np.ndarray:
    """Rows of a list<int64> column, padded with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each query the k best rows that have not its own id, as query number, row number and score; and how many pairs were probed one by one."""
    low, high = rows.min(0), rows.max(0)
    least, most = np.minimum(queries * low, queries * high), np.maximum(queries * low, queries * high)
    terms = np.argsort(-(most - least).sum(0), kind="stable")
    left = lambda x: np.concatenate([np.cumsum(x[:, terms][:, ::-1], 1)[:, ::-1], np.zeros((len(x), 1), x.dtype)], 1)
    least_left, most_left = left(least), left(most)
    # Products of whole numbers are exact as floats while sums stay below 2^53.
    exact = np.float64 if np.abs(queries).max(initial=0).astype(float) * np.abs(rows).max(initial=0) * max(1, rows.shape[1]) < 2.0**53 else np.int64
    q, x = queries[:, terms].astype(exact), rows[:, terms].astype(exact)
    open_ = own[:, None] != ids[None, :]
    partial, at = np.zeros(open_.shape, exact), 0
    floor = np.finfo(np.float64).min if exact is np.float64 else np.iinfo(np.int64).min // 2
    partial[~open_] = floor
    while at < len(terms) and open_.any():
        partial += q[:, at : at + BLOCK] @ x[:, at : at + BLOCK].T
        at = min(at + BLOCK, len(terms))
        if len(ids) > k:
            threshold = np.partition(partial, len(ids) - k, 1)[:, len(ids) - k] + least_left[:, at]
            open_ &= partial + most_left[:, at, None] >= threshold[:, None]
            if open_.mean() < FEW:
                break
    qi, ri = np.nonzero(open_)
    score = partial[qi, ri].astype(np.int64)
    probed = len(qi) if at < len(terms) else 0
    if probed:
        for i in range(0, len(qi), PROBED):
            part = slice(i, i + PROBED)
            score[part] += (queries[qi[part]][:, terms[at:]] * rows[ri[part]][:, terms[at:]]).sum(1)
    order = np.lexsort((ids[ri], -score, qi))
    qi, ri, score = qi[order], ri[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
    return qi[rank < k], ri[rank < k], score[rank < k], probed


def _score(k: int, names: list[str]):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = matrix(queries.column("v")), matrix(rows.column("v"))
        width = max(q.shape[1], x.shape[1])
        q, x = np.pad(q, ((0, 0), (0, width - q.shape[1]))), np.pad(x, ((0, 0), (0, width - x.shape[1])))
        q_ids, which, ids = queries.column("id").to_numpy(), queries.column("which").to_numpy(), rows.column("id").to_numpy()
        if len(q) and len(x):
            qi, ri, score, _ = best(q, q_ids, ids, x, k)
            cols = q_ids[qi], which[qi], ids[ri], score
        else:
            cols = (np.empty(0, np.int64),) * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "v", seed: int = 11, shard: int = SHARD, part: int = SLICE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Both tables hold id_col (an integer) and vector_col (array<bigint>)."""
    ship(rows.sparkSession)
    rows, queries = (x.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")) for x in (rows, queries))
    shards, slices = max(24, -(-rows.count() // shard)), max(1, -(-queries.count() // part))

    def by(n: int, name: str, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + salt), F.col("id")), F.lit(n)).cast("int").alias(name)

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    queries = queries.dropDuplicates(["id", "v"]).withColumn("which", F.xxhash64("v"))
    left = queries.select("id", "v", "which", by(slices, "slice", 0)).select("id", "v", "which", "slice", every(shards, "shard"))
    right = rows.select("id", "v", by(shards, "shard", 1)).select("id", "v", "shard", every(slices, "slice"))
    names = ["query_id", "which", "vec_id", "score"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    found = left.groupBy("slice", "shard").cogroup(right.groupBy("slice", "shard")).applyInArrow(_score(k, names), schema)
    order = W.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
