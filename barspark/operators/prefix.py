"""Running sums over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import saved


def running(df: DataFrame, at: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df and, per name, the sum of the column over all rows up to each in the order of `at`, then `order` (nulls first).

    The rows are range-sorted into partitions of like size and written with their partition's number, so a busy day or
    a null time is as many partitions as it needs (ties of the whole order stay together). Each partition's total is one
    row; the totals of those before are added to the sums within.
    """
    named = df.withColumns({f"_x_{n}": c for n, c in sums.items()})
    laid = saved(named.repartitionByRange(at, *order).withColumn("_part", F.spark_partition_id()), "running")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over a line a partition
    per = laid.groupBy("_part").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    per = per.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy("_part").orderBy(at, *order).rowsBetween(W.unboundedPreceding, 0)
    out = laid.join(F.broadcast(per), "_part").withColumns({n: F.col(f"_b_{n}") + F.sum(f"_x_{n}").over(inside) for n in sums})  # broadcast: a line a partition
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """df and, as `name`, each row's number (a double, from 1) among those of its `by` in the order of `at`; range-sorted as in running(), so one key's rows may be many partitions."""
    laid = saved(df.repartitionByRange(by, at).withColumn("_part", F.spark_partition_id()), "numbered")
    per = laid.groupBy(F.col("_part").alias("_of"), F.col(by).alias("_key")).agg(F.count("*").alias("_n"))  # a line a partition and key there
    before = F.sum("_n").over(W.partitionBy("_key").orderBy("_of").rowsBetween(W.unboundedPreceding, -1))
    per = per.select("_of", "_key", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part", by).orderBy(at))
    out = laid.withColumn("_i", inside).join(F.broadcast(per), (F.col("_part") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_key")))
    return out.select(*df.columns, (F.col("_before") + F.col("_i")).cast("double").alias(name))


def carried(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """df and, as `name`, the last value of the column that is not null up to each row in the order of `order` (nulls first); range-sorted as in running()."""
    laid = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "carried")
    held = F.col(column).isNotNull()
    last = F.max_by(F.struct(F.col(column).alias("v")), F.when(held, F.struct(*order)))
    per = laid.groupBy("_part").agg(last.alias("_l"))
    per = per.select("_part", F.last("_l", True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_l"))  # over a line a partition
    inside = F.last(column, True).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = laid.join(F.broadcast(per), "_part").withColumn(name, F.coalesce(inside, F.col("_l.v")))  # broadcast: a line a partition
    return out.select(*df.columns, *([name] if name not in df.columns else []))
