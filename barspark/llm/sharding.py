"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters records by seeded hashes into buckets that fit a task's memory: the
shard is the one of highest seeded hash for the id (rendezvous hashing, so the id and
the shard count decide, and one shard more takes rows only into itself); a shard is
split into as many buckets of about bucket_bytes as the table's bytes ask for. Pass
two Fisher-Yates shuffles each bucket (Spark's shuffle()) and lays the buckets of a
shard one after another, which numbers its slots without gaps.

A bucket's records are sorted by that hash before they are shuffled and each task owns its
buckets, so a task that runs again makes the same order.

Defined cases: null ids hash like any value; a null text has 0 bytes; repeated rows get
a slot each; an empty table gives an empty result; other columns pass along unchanged, but one named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import carried, fresh, saved

LAW = "key"


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is highest."""
    score = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(score)["s"].cast("int")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _hashable(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.to_json(F.struct(c)) if _has_map(df.schema[name].dataType) else c


def shard_records(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240229, bucket_bytes: int = 32 << 20, overhead: int = 16) -> DataFrame:
    """df's columns and size, law, shard, slot, grown_shard (its shard if there were one more)."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + F.lit(overhead)
    key = F.col(id_col).cast("string")
    shard = shard_of(key, shards, seed)
    held = {r["s"]: -(-r["b"] // bucket_bytes) for r in df.groupBy(shard.alias("s")).agg(F.sum(size).alias("b")).collect()}  # a line a shard
    parts = [max(1, held.get(s, 1)) for s in range(shards)]
    rec, bkt, arr, pos, off, n = fresh(df, "rec", "bucket", "arr", "pos", "off", "n")
    whole = F.xxhash64(F.lit(seed + 2), key, *[_hashable(df, c) for c in df.columns])
    placed = df.select(
        shard.alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), whole), F.get(F.array(*[F.lit(n) for n in parts]), shard)).cast("int").alias(bkt),
        F.struct(whole.alias("h"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), size.alias("size"), shard_of(key, shards + 1, seed).alias("grown")).alias(rec),
    )
    sizes = placed.groupBy("shard", bkt).agg(F.count("*").alias(n))
    offsets = saved(sizes.select("shard", bkt, (F.sum(n).over(W.partitionBy("shard").orderBy(bkt)) - F.col(n)).alias(off)), "shard-offsets")
    buckets = placed.repartition(sum(parts), "shard", bkt).sortWithinPartitions("shard", bkt)
    buckets = buckets.groupBy("shard", bkt).agg(F.collect_list(rec).alias(arr))
    places = F.shuffle(F.array_sort(F.transform(arr, lambda r, i: F.struct(r["h"].alias("h"), i.alias("i")))), F.lit(seed))
    mixed = buckets.select("shard", bkt, F.posexplode(F.transform(places, lambda p: F.get(F.col(arr), p["i"]))).alias(pos, rec))
    mixed = mixed.join(offsets, ["shard", bkt])
    own = ("size", "law", "shard", "slot", "grown_shard")
    return mixed.select(*[F.col(f"{rec}.row.`{c}`").alias(c) for c in carried(df, *own)], F.col(f"{rec}.size").alias("size"), F.lit(LAW).alias("law"), "shard", (F.col(off) + F.col(pos)).cast("long").alias("slot"), F.col(f"{rec}.grown").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int, file_bytes: int = 256 << 20, **kwargs) -> None:
    """Writes each shard in a folder of its own, in files of about file_bytes whose names and rows are in slot order."""
    placed = saved(shard_records(df, shards, **kwargs), "sharded")
    files = max(shards, -(-(placed.agg(F.sum("size").alias("b")).first()["b"] or 0) // file_bytes))
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
