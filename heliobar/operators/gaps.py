"""Expected grids, missing bars, completeness and data health."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def continuous_grid(spans: DataFrame, seconds: int) -> DataFrame:
    """(symbol, ts) of an epoch-aligned grid over first_ts..last_ts, both ends included."""
    start = F.ceil(F.unix_micros("first_ts") / (seconds * 1_000_000)) * seconds
    end = F.unix_seconds("last_ts")
    out = spans.select("symbol", start.alias("_a"), end.alias("_b")).where("_a <= _b")
    steps = out.select("symbol", F.explode(F.sequence("_a", "_b", F.lit(seconds).cast("long"))).alias("_s"))
    return steps.select("symbol", F.timestamp_seconds("_s").alias("ts"))


def missing(grid: DataFrame, bars: DataFrame) -> DataFrame:
    return grid.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def completeness(grid: DataFrame, bars: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Share of expected bars that are there; of ``symbols`` those with none expected are complete."""
    have = bars.select("symbol", "ts", F.lit(1.0).alias("_have"))
    out = grid.join(have, ["symbol", "ts"], "left").groupBy("symbol").agg(F.count("*").alias("expected"), F.coalesce(F.sum("_have"), F.lit(0.0)).cast("long").alias("present"), F.avg(F.coalesce("_have", F.lit(0.0))).alias("completeness"))
    if symbols is None:
        return out
    all_ = symbols.select("symbol").distinct().join(out, "symbol", "left")
    return all_.select("symbol", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("completeness", F.lit(1.0)).alias("completeness"))


def health(complete: DataFrame, spans: DataFrame, now, least: float = 0.95, stale_days: float = 3.0) -> DataFrame:
    """Completeness and age of each symbol, with a warning below ``least`` or beyond ``stale_days``."""
    age = (F.unix_seconds(now) - F.unix_seconds("last_ts")) / 86400.0
    out = complete.join(spans, "symbol").withColumn("stale_days", age)
    return out.withColumn("warn", (F.col("completeness") < least) | (F.col("stale_days") > stale_days))


def health_report(bars: DataFrame, now: datetime, seconds: int = 86400, days: int = 120) -> DataFrame:
    """``health`` over the last ``days`` days, with the mean completeness of all symbols beside each."""
    from ..sources.bars import coverage

    spans = coverage(bars)
    window = spans.select("symbol", F.lit(now - timedelta(days=days)).cast("timestamp").alias("first_ts"), F.lit(now).cast("timestamp").alias("last_ts"))
    complete = completeness(continuous_grid(window, seconds), bars, spans)
    out = health(complete, spans, F.lit(now).cast("timestamp"))
    return out.join(F.broadcast(complete.agg(F.avg("completeness").alias("mean_completeness"))))  # one row
