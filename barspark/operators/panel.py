"""Calendars, alignment, as-of and range joins of long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import running


def common_calendar(panel: DataFrame) -> DataFrame:
    """Times that every symbol has."""
    n = panel.agg(F.count_distinct("symbol").alias("n"))
    per = panel.select("symbol", "ts").distinct().groupBy("ts").agg(F.count("*").alias("k"))
    return per.join(F.broadcast(n), per["k"] == n["n"]).select("ts")


def on_common_calendar(panel: DataFrame) -> DataFrame:
    """Rows at times that every symbol has."""
    return panel.join(common_calendar(panel), "ts", "left_semi").select(panel.columns)


def align_to_calendar(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every symbol at every time of the calendar; running it fails if a value is missing."""
    want = calendar.select("ts").distinct().crossJoin(panel.select("symbol").distinct())
    got = want.join(panel, ["symbol", "ts"], "left")
    for c in [c for c in panel.columns if c not in ("symbol", "ts")]:
        got = got.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"no {c} of "), F.col("symbol"), F.lit(" at "), F.col("ts").cast("string"))).cast(panel.schema[c].dataType)))
    return got.select(panel.columns)


def dedupe(panel: DataFrame) -> DataFrame:
    """One row per symbol and time (the least of repeated rows)."""
    others = [c for c in panel.columns if c not in ("symbol", "ts")]
    one = panel.groupBy("symbol", "ts").agg(F.min(F.struct(*others)).alias("_r"))
    return one.select("symbol", "ts", *[F.col(f"_r.{c}").alias(c) for c in others]).select(panel.columns)


def time_slice(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from start to end, both included."""
    out = panel
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def ordinals(panel: DataFrame) -> DataFrame:
    """Each time of the panel and its number, from 0."""
    return running(panel.select("ts").distinct(), "ts", [], {"ordinal": F.lit(1)}).withColumn("ordinal", F.col("ordinal") - 1)


def positional_slice(panel: DataFrame, start: int, end: int) -> DataFrame:
    """Rows at times number start to end - 1 of the panel's calendar."""
    wanted = ordinals(panel).where(F.col("ordinal").between(start, end - 1)).select("ts")
    return panel.join(wanted, "ts", "left_semi").select(panel.columns)


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str = "ts", right_on: str = "ts", values: list[str] | None = None, strict: bool = False) -> DataFrame:
    """left's rows with the values of right's last row at or before (strict: before) them.

    One sort of the union by key and time: right's rows carry their values forward, so the cost follows the rows, not the matches.
    """
    values = values or [c for c in right.columns if c not in (*by, right_on)]
    a = left.select(*[F.col(c) for c in left.columns], F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side")).select(*by, F.col(on).alias("_at"), "_row", "_side")
    b = right.select(*by, F.col(right_on).alias("_at"), F.struct(*values).alias("_v"), F.lit(2 if strict else 0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    known = F.last("_v", True).over(W.partitionBy(*by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_known", known).where(F.col("_row").isNotNull())
    return out.select("_row.*", *[F.col(f"_known.{v}").alias(v) for v in values])


_SECONDS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86_400, "WEEK": 604_800, "MONTH": 31 * 86_400, "YEAR": 366 * 86_400}


def _slot_micros(before: str) -> int:
    """A length that the look-back ("3 HOURS") never passes."""
    n, unit = before.split()
    return max(1, int(n)) * _SECONDS[unit.upper().rstrip("S")] * 1_000_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(c).alias(f"event_{c}") for c in events.columns])


def range_join(bars: DataFrame, events: DataFrame, before: str, include_now: bool = True, unbounded_key: bool = True) -> DataFrame:
    """Pairs of bars and events with event time in [ts - before, ts] (without the end: include_now=False). before: a number and a unit.

    Times fall into slots as long as the look-back, and an event goes to its slot and the next: an equi-join on symbol and slot.
    Events without symbol match every bar (unless unbounded_key is False), by a join on the slot alone.
    """
    slot, span = F.lit(_slot_micros(before)), F.expr(f"INTERVAL {before}")
    b = bars.withColumn("_slot", F.floor(_micros(F.col("ts")) / slot))
    own = F.floor(_micros(F.col("event_ts")) / slot)
    e = _event_columns(events).withColumn("_slot", F.explode(F.array(own, own + 1)))
    inside = (F.col("event_ts") >= F.col("ts") - span) & ((F.col("event_ts") <= F.col("ts")) if include_now else (F.col("event_ts") < F.col("ts")))
    keyed = b.join(e, (b["symbol"] == e["event_symbol"]) & (b["_slot"] == e["_slot"]) & inside).drop("_slot")
    if not unbounded_key:
        return keyed
    free = e.where("event_symbol is null")
    return keyed.unionByName(b.join(free, (b["_slot"] == free["_slot"]) & inside).drop("_slot"))


#: Parts of a look-back, and shares of the symbols, that events without symbol are dealt by.
PARTS, SHARES = 64, 16


def has_event(bars: DataFrame, events: DataFrame, before: str, include_now: bool = True) -> DataFrame:
    """bars' rows and has_event: whether range_join would pair them. The last event before each bar tells, so no pairs are made.

    Events without symbol serve all symbols: a bar's last one is in its own part of the look-back (an as-of join within part
    and share of the symbols, where the part's events are few) or the last of the parts before (a line a part).
    """
    width = _slot_micros(before)
    slot, span = F.lit(width), F.expr(f"INTERVAL {before}")
    out = bars.withColumn("_slot", F.floor(_micros(F.col("ts")) / slot))
    own = F.floor(_micros(F.col("ts")) / slot)
    e = events.select("symbol", "ts", F.col("ts").alias("_seen"), F.explode(F.array(own, own + 1)).alias("_slot"))
    out = asof(out, e.where("symbol is not null"), ["symbol", "_slot"], values=["_seen"], strict=not include_now).withColumnRenamed("_seen", "_own")
    part = F.floor(_micros(F.col("ts")) / F.lit(max(1, width // PARTS)))
    free = events.where("symbol is null").select("ts", F.col("ts").alias("_seen"), part.alias("_part"))
    out = out.withColumns({"_part": part, "_share": F.pmod(F.xxhash64("symbol"), F.lit(SHARES))})
    last = free.groupBy("_part").agg(F.max("ts").alias("_t"))
    last = last.select("_t", F.explode(F.sequence(F.col("_part") + 1, F.col("_part") + PARTS + 1)).alias("_part")).groupBy("_part").agg(F.max("_t").alias("_before"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("_share")
    out = asof(out, free.select("*", every), ["_part", "_share"], values=["_seen"], strict=not include_now).join(last, "_part", "left")
    found = F.greatest("_own", "_seen", "_before") >= F.col("ts") - span
    return out.withColumn("has_event", F.coalesce(found, F.lit(False))).select(*bars.columns, "has_event")


def events_between(events: DataFrame, start, end, symbol: str | None = None, kind: str | None = None) -> DataFrame:
    """Events with start <= ts < end."""
    out = events.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    out = out.where(F.col("symbol") == symbol) if symbol else out
    return out.where(F.col("type") == kind) if kind else out


def events_at(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs on one date less than a second apart. An event goes to its second and both neighbours: an equi-join on symbol (where the event has one) and second."""
    second = lambda c: F.floor(_micros(F.col(c)) / 1_000_000)
    b = bars.withColumn("_s", second("ts"))
    e = _event_columns(events)
    e = e.withColumn("_s", F.explode(F.array(*[second("event_ts") + d for d in (-1, 0, 1)])))
    near = (F.to_date("ts") == F.to_date("event_ts")) & (F.abs(_micros(F.col("event_ts")) - _micros(F.col("ts"))) < 1_000_000)
    free = e.where("event_symbol is null")
    keyed = b.join(e, (b["symbol"] == e["event_symbol"]) & (b["_s"] == e["_s"]) & near)
    return keyed.drop("_s").unionByName(b.join(free, (b["_s"] == free["_s"]) & near).drop("_s"))


def first_in_period(period: str) -> Column:
    """True at a symbol's first bar of a day ('1D'), ISO week ('1W') or month ('1M')."""
    key = {"1D": F.to_date("ts"), "1W": F.date_trunc("week", "ts"), "1M": F.date_trunc("month", "ts")}[period]
    before = F.lag(key).over(W.partitionBy("symbol").orderBy("ts"))
    return before.isNull() | (before != key)


def at_open() -> Column:
    return first_in_period("1D")


def at_close(calendar: bool = True) -> Column:
    """True at the last bar of a day; without calendar by the clock (from 22:30 on)."""
    if not calendar:
        return (F.hour("ts") >= 23) | ((F.hour("ts") == 22) & (F.minute("ts") >= 30))
    day = F.to_date("ts")
    return F.coalesce(F.lead(day).over(W.partitionBy("symbol").orderBy("ts")) != day, F.lit(True))


def at_time(hour: int, minute: int = 0) -> Column:
    return (F.hour("ts") == hour) & (F.minute("ts") == minute)


def session_close(rule: str) -> Column:
    """True where the next bar lies in another bucket, and at the last bar."""
    from ..sources.bars import bucket

    now = bucket(F.col("ts"), rule)
    after = F.lead(now).over(W.partitionBy("symbol").orderBy("ts"))
    return after.isNull() | (after != now)
