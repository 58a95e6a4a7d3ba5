"""Mixing sources to target weights by Poisson replication.

A source that should make up share w of `total` rows and has n rows repeats each of
them lambda = w * total / n times on average. How often a row repeats is the Poisson
quantile of a number in [0, 1) that a seeded hash of its id gives: the same row gets
the same count wherever and whenever it is computed, and no pass over other rows is
needed but the counts per source. The copies are dealt to partitions and sorted by a
second hash, which shuffles them globally.

Defined cases: a null source is a source of its own (weight `default`, as for any that
the weights do not name); weight 0 drops a source; null and repeated ids hash as they
are; an empty table gives an empty result; other columns pass along unchanged, but one named like an output column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import BROADCAST_ROWS, carried, fresh, saved

#: Cumulative probabilities are summed until this much is left; the hash has 52 bits.
TAIL = 2.0**-53
BITS = 52
#: A mean beyond this is split into a whole part and a Poisson remainder, so that exp(-mean) stays a normal number.
WHOLE = 256.0


def uniform(seed: int, *key: Column) -> Column:
    """52 bits of an MD5 over seed and key, as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") / F.lit(float(1 << BITS))


def cumulative(mean: float) -> list[float]:
    """Poisson probabilities of at most 0, 1, 2, ... until 1 is reached to the hash's precision."""
    term, out, k = math.exp(-mean), [], 0
    total = term
    while True:
        out.append(total)
        if k > mean and term < TAIL or total >= 1.0:
            return out
        k += 1
        term *= mean / k
        total += term


def mix(df: DataFrame, weights: dict[str, float], default: float = 0.0, total: int | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = 7, partitions: int | None = None, order: bool = True, numbers: bool = True) -> DataFrame:
    """df's columns and copy (from 0), copies, shuffle_key; rows in the order of shuffle_key. Without numbers: df's columns alone, whatever their names.

    The weights of the sources that df holds are scaled to sum to 1. total: rows wanted, by default as many as df has.
    Sources that the weights name come one by one to the driver, the others as one line for each rate they get;
    the plan holds one array per rate.
    """
    src = F.col(source_col).cast("string")
    named = F.when(src.isin(*weights), src) if weights else F.lit(None).cast("string")
    counts = df.groupBy(src.alias("s"), named.alias("named")).agg(F.count("*").alias("n"))
    known = {r["named"]: r["n"] for r in counts.where("named is not null").collect()}
    rest = counts.where("named is null").agg(F.count("*").alias("sources"), F.sum("n").alias("n")).first()
    rows = sum(known.values()) + (rest["n"] or 0)
    want = rows if total is None else total
    scale = sum(weights[s] for s in known) + default * rest["sources"]
    if scale <= 0 or rows == 0:
        rates: dict[str, float] = dict.fromkeys(known, 0.0)
    else:
        rates = {s: weights[s] / scale * want / n for s, n in known.items()}
    u = uniform(seed, F.col(id_col))
    copies, cop, key = fresh(df, "copies", "copy", "key")

    def count(mean: float) -> Column:
        whole = math.floor(mean - WHOLE) if mean > WHOLE else 0
        cdf = F.array(*[F.lit(x) for x in cumulative(mean - whole)])
        return F.lit(whole) + F.element_at(F.transform(F.array(u), lambda x: F.size(F.filter(cdf, lambda c: c <= x))), 1)

    chosen = None
    for s, rate in sorted(rates.items()):
        chosen = (F if chosen is None else chosen).when(src == s, count(rate) if rate > 0 else F.lit(0))
    if rest["sources"] and default > 0 and scale > 0:  # each of them has a rate of its own: joined, not written into the plan
        of, mean = fresh(df, "of", "mean")
        rates_of = saved(counts.where("named is null").select(F.col("s").alias(of), (F.lit(default / scale * want) / F.col("n")).alias(mean)), "mixing-rates")
        rates_of = F.broadcast(rates_of) if rest["sources"] <= BROADCAST_ROWS else rates_of
        joined = df.join(rates_of, src.eqNullSafe(F.col(of)), "left")
        times = F.element_at(F.transform(F.array(u), lambda x: poisson_quantile(F.col(mean), x)), 1)
        times = chosen.otherwise(times) if chosen is not None else times
        out = joined.withColumn(copies, times).drop(of, mean)
    else:
        out = df.withColumn(copies, chosen.otherwise(F.lit(0)) if chosen is not None else F.lit(0))
    out = out.where(F.col(copies) > 0).withColumn(cop, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    out = out.withColumn(key, F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string"), F.col(cop)))
    if order:
        out = out.repartitionByRange(*([partitions] if partitions else []), key).sortWithinPartitions(key)
    if not numbers:
        return out.select(*[F.col(f"`{c}`") for c in df.columns])
    return out.select(*carried(df, "copy", "copies", "shuffle_key"), F.col(cop).alias("copy"), F.col(copies).alias("copies"), F.col(key).alias("shuffle_key"))


def poisson_quantile(mean: Column, u: Column) -> Column:
    """The quantile where the mean is a column: terms are added until the sum passes u."""
    whole = F.when(mean > WHOLE, F.floor(mean - WHOLE)).otherwise(F.lit(0)).cast("int")
    rest = mean - whole
    most = (rest + 12 * F.sqrt(rest) + 40).cast("int")
    start = F.struct(F.exp(-rest).alias("term"), F.exp(-rest).alias("total"), F.lit(0).alias("k"))

    def step(s, i):
        more = s["total"] <= u
        term = s["term"] * (rest / i)
        return F.struct(F.when(more, term).otherwise(s["term"]).alias("term"), F.when(more, s["total"] + term).otherwise(s["total"]).alias("total"), F.when(more, i).otherwise(s["k"]).cast("int").alias("k"))

    return whole + F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])
