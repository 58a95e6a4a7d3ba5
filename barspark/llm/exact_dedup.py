"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Rows whose length nobody shares leave after the first grouping, rows whose prefix
nobody of that length shares after the second; only what is left has its whole text
hashed and grouped. The groupings run on narrow rows; no text is shuffled. The scan that hashes
knows the shared prefixes by a copy of them or, where they are many, by a bitmap of bounded size.

Defined cases: a null text counts as empty; null ids are compared as values (and are
smallest); of rows repeated with the same id and text exactly one is kept; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .support import BROADCAST_ROWS, fresh, saved

#: One space for each run of ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"

#: Bits a shared key in the bitmaps, and bits in all.
PLACES, MOST_PLACES = 16, 1 << 30


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _shared(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def _keep_shared(df: DataFrame, *key: str) -> DataFrame:
    """Rows of df whose key occurs again. The keys are written first: both sides of the join then come by exchanges that Spark may split at a hot key."""
    keys = saved(_shared(df, *key), "dedup-shared")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, list(key), "left_semi")


def _bit(places: int) -> tuple[Column, Column]:
    """The bitmap, and the bit there, of a row's length and prefix hash."""
    place = F.pmod(F.xxhash64("_len", "_head"), F.lit(places))
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def _maybe_shared(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose length and prefix hash are among the keys, and about one in PLACES of the others (more beyond MOST_PLACES / PLACES keys).

    The keys are bits in bitmaps of 4 KB, MOST_PLACES bits (128 MB) in all at most, which every task has a copy of.
    """
    places = min(MOST_PLACES, max(1 << 15, count * PLACES))
    of, bit = _bit(places)
    maps = saved(keys.groupBy(of.alias("_of")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "dedup-bitmaps")
    met = rows.withColumns({"_of": of, "_bit": bit}).join(F.broadcast(maps), "_of")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    return met.withColumn("_byte", byte).where("shiftright(_byte, cast(_bit % 8 as int)) & 1 = 1").drop("_of", "_bit", "_bits", "_byte")


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest: bool = False) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept; with digest also text_sha256 of every row.

    digest asks for an output that needs every whole text, so it is made in the first scan and the third level
    groups by it; without it a second scan hashes only rows that the first two levels left.
    """
    out, _ = _classes(df, id_col, text_col, prefix, digest)
    return out.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), *([F.col("_full").alias("text_sha256")] if digest else []))


def _classes(df: DataFrame, id_col: str, text_col: str, prefix: int, digest: bool) -> tuple[DataFrame, DataFrame]:
    """_id, _keep, _size, _kept and _full (null for a text that was never hashed) of every row; and the ids of every row, written."""
    text = normalised(df[text_col])
    row = [df[id_col].alias("_id"), F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix)).alias("_head")]
    full = F.sha2(text, 256)
    rows = saved(df.select(*row, *([full.alias("_full")] if digest else [])), "dedup-keys")
    heads = saved(_shared(_keep_shared(rows, "_len"), "_len", "_head"), "dedup-heads")
    count = heads.count()
    small = count <= BROADCAST_ROWS
    of = F.broadcast(heads) if small else heads
    key = ["_len", "_head"]
    alone = rows.join(of, key, "left_anti")
    if digest:
        left = rows.join(of, key, "left_semi")
    else:  # only what the two levels left is hashed, in the scan, so that no text is shuffled
        texts = df.select(*row, text.alias("_text"))
        texts = texts.join(of, key, "left_semi") if small else _maybe_shared(texts, heads, count)
        left = texts.withColumn("_full", F.sha2("_text", 256)).drop("_text")
        left = left if small else left.join(heads, key, "left_semi")
    left = saved(left, "dedup-left")
    groups = saved(left.groupBy("_len", "_full").agg(F.min(F.struct("_id")).alias("_keep"), F.count("*").alias("_size")), "dedup-groups")
    single = groups.where("_size = 1").select("_len", "_full", F.col("_keep._id").alias("_id"), F.lit(1).cast("long").alias("_size"))
    many = groups.where("_size > 1").select("_len", "_full", "_keep", "_size")
    copies = left.join(many, ["_len", "_full"], "inner")
    again = W.partitionBy("_len", "_full", "_id").orderBy("_head")
    keeper = copies.where(F.col("_id").eqNullSafe(F.col("_keep._id")))
    other = copies.where(~F.col("_id").eqNullSafe(F.col("_keep._id")))
    copies = keeper.withColumn("_kept", F.row_number().over(again) == 1).unionByName(other.withColumn("_kept", F.lit(False)))
    sha = F.col("_full") if digest else F.lit(None).cast("string").alias("_full")
    out = alone.select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"), sha)
    out = out.unionByName(single.select("_id", F.col("_id").alias("_keep"), "_size", F.lit(True).alias("_kept"), "_full"))
    return out.unionByName(copies.select("_id", F.col("_keep._id").alias("_keep"), "_size", "_kept", "_full")), rows.select("_id")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """df's rows and columns without all but one row of each class of equal texts.

    Rows to drop are found narrow; an id all of whose rows go meets the documents by the id alone. Where an id
    has rows that go and rows that stay, the rows of just such ids are told apart by their texts' hash.
    """
    found, ids = _classes(df, id_col, text_col, prefix, False)
    gone = saved(found.where("not _kept").groupBy("_id", "_full").agg(F.count("*").alias("_n"), F.first(F.col("_id").eqNullSafe(F.col("_keep"))).alias("_own")), "dedup-gone")
    gone_id, rows, out = fresh(df, "gone", "sha", "row")
    of = gone.groupBy("_id").agg(F.sum("_n").alias("_n"))
    many = of.count() > BROADCAST_ROWS
    there = ids.join(of.select(F.col("_id").alias(gone_id)) if many else F.broadcast(of.select(F.col("_id").alias(gone_id))), F.col("_id").eqNullSafe(F.col(gone_id)), "left_semi").groupBy("_id").agg(F.count("*").alias("_all"))
    of = saved(of.join(there.withColumnRenamed("_id", gone_id), F.col("_id").eqNullSafe(F.col(gone_id))).select(F.col("_id").alias(gone_id), (F.col("_n") < F.col("_all")).alias("_part")), "dedup-gone-ids")
    drop = of.select(gone_id)
    kept = df.join(drop if many else F.broadcast(drop), df[id_col].eqNullSafe(drop[gone_id]), "left_anti")
    parted = of.where("_part").select(gone_id)
    if parted.isEmpty():
        return kept
    unsure = df.join(parted, df[id_col].eqNullSafe(parted[gone_id]), "left_semi").withColumn(rows, F.sha2(normalised(df[text_col]), 256))
    keys = gone.select(F.col("_id").alias(gone_id), "_full", "_own")
    same = unsure[id_col].eqNullSafe(keys[gone_id]) & (unsure[rows] == keys["_full"])
    stay = unsure.join(keys, same, "left_anti").drop(rows)
    one = unsure.join(keys.where("_own"), same, "left_semi").groupBy(rows).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.xxhash64(F.col(text_col))).alias(out))
    return kept.unionByName(stay).unionByName(one.select(F.col(f"{out}.*")))
