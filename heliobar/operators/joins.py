"""Alignment, as-of joins and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def aligned_panel(bars: DataFrame) -> DataFrame:
    """Bars at times at which every symbol has a close; no value is carried forward."""
    n = bars.select("symbol").distinct().agg(F.count("*").alias("_all"))  # one row
    full = bars.where("close IS NOT NULL").groupBy("ts").agg(F.countDistinct("symbol").alias("_n"))
    full = full.join(F.broadcast(n)).where("_n = _all")
    return bars.join(full.select("ts"), "ts", "left_semi")


def asof(left: DataFrame, right: DataFrame, key: list[str], on: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the latest right row at or before it; never a later one.

    Both sides go into one window by key and time, so a plan has one exchange and no range join.
    """
    both = left.withColumn("_left", F.lit(True)).unionByName(right.select(*key, on, *values).withColumn("_left", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col(on), F.col("_left")) if key else Window.orderBy(F.col(on), F.col("_left"))
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(~F.col("_left"), F.struct(on, *values))
    out = both.withColumn("_hit", F.last(packed, ignorenulls=True).over(w)).where("_left")
    hit = F.when(F.col("_hit").isNull(), F.raise_error(F.lit("nothing at or before the row"))).otherwise(F.col("_hit")) if strict else F.col("_hit")
    out = out.withColumn("_hit", hit)
    return out.select(*left.columns, F.col(f"_hit.{on}").alias(f"asof_{on}"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def asof_buckets(left: DataFrame, right: DataFrame, on: str, values: list[str], seconds: int = 86400) -> DataFrame:
    """``asof`` without a key: rows meet inside buckets of time, which take over the last values of those before.

    A window over all rows would put them into one task; here that holds one row for each bucket.
    """
    at = lambda df: df.withColumn("_key", F.floor(F.unix_seconds(F.col(on).cast("timestamp")) / seconds))
    met = asof(at(left), at(right), ["_key"], on, values)
    ends = at(right).groupBy("_key").agg(F.max(F.struct(on, *values)).alias("_end"))
    keys = met.select("_key").distinct().join(ends, "_key", "full")
    before = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    carried = keys.withColumn("_end", F.last("_end", ignorenulls=True).over(before))
    out = met.join(carried, "_key", "left")
    own = F.col(f"asof_{on}").isNotNull()
    pick = lambda c, name: F.when(own, F.col(c)).otherwise(F.col(f"_end.{name}")).alias(c)
    return out.select(*left.columns, pick(f"asof_{on}", on), *[pick(v, v) for v in values])


def delisted(snapshots: DataFrame) -> DataFrame:
    """Symbols of the last snapshot but one that the last one lacks."""
    days = snapshots.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(2)
    ranked = days.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("snapshot_date"))))
    both = snapshots.join(F.broadcast(ranked), "snapshot_date")
    old, new = both.where("_r = 2").select("symbol").distinct(), both.where("_r = 1").select("symbol").distinct()
    return old.join(new, "symbol", "left_anti")


def canonical(symbol):
    return F.upper(F.replace(symbol, F.lit("/"), F.lit("")))


#: fixed values, longest first
QUOTES = ("USDT", "USDC", "USDG", "USD", "BTC")


def with_slash(symbol):
    """The pair's name with a slash before its quote currency, if it ends with a known one and has a base."""
    return F.regexp_replace(symbol, f"^([^/]+)({'|'.join(QUOTES)})$", "$1/$2")


def only_tradeable(bars: DataFrame, tradeable: DataFrame) -> DataFrame:
    keep = tradeable.select(canonical(F.col("symbol")).alias("_c")).distinct()
    return bars.withColumn("_c", canonical(F.col("symbol"))).join(keep, "_c", "left_semi").drop("_c")


def exits(held: DataFrame, winners: DataFrame) -> DataFrame:
    return held.join(winners.select("symbol"), "symbol", "left_anti")


def forward_fill(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
