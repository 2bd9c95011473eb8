"""Connectors to vendors as file drops: what a vendor's answer would hold stands in files, with a schema.

Nothing here opens a connection. A drop is read as a table, conformed, and goes into the lake; what can't be used is
recorded beside it and never raised.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gaps import continuous_grid, missing
from ..staging import drop_stage, stage
from .bars import BarLake, TIMEFRAMES, coverage
from .stores import SNAPSHOT

DROP = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, trade_count long, vwap double, feed string, adjustment string"
ASSET = "symbol string, name string, asset_class string, exchange string, status string, tradable boolean, marginable boolean, shortable boolean, easy_to_borrow boolean, fractionable boolean, min_order_size string, min_trade_increment string, price_increment string"
PAGE = "page_token string, next_page_token string, news array<struct<id:long,created_at:timestamp,symbols:array<string>,headline:string,source:string>>"


def read_bar_drop(spark: SparkSession, path: str, feed: str | None = None, adjustment: str = "raw") -> DataFrame:
    """Bars of JSON lines of one feed (all, if None) and one adjustment; without a mark a bar is raw."""
    rows = spark.read.schema(DROP).json(path).where(F.coalesce("adjustment", F.lit("raw")) == adjustment)
    return (rows if feed is None else rows.where(F.col("feed") == feed)).drop("feed", "adjustment")


def read_universe_drop(spark: SparkSession, path: str, day) -> DataFrame:
    """A snapshot of the active shares and coins of a listing."""
    rows = spark.read.schema(ASSET).json(path).where("status = 'active' AND asset_class IN ('us_equity', 'crypto')")
    rows = rows.withColumn("snapshot_date", F.lit(day).cast("date"))
    cols = [c.split(" ") for c in SNAPSHOT.split(", ")]
    return rows.select(*[F.expr(f"try_cast({name} AS {kind})").alias(name) for name, kind in cols])


def read_news_drop(spark: SparkSession, path: str, most: int = 40) -> DataFrame:
    """Articles of the pages that the first one, without a token, leads to, ``most`` at most, by time."""
    pages = spark.read.schema(PAGE).json(path)
    reached = pages.where("page_token IS NULL").withColumn("_hop", F.lit(0))
    last = reached
    for hop in range(1, most):
        step = last.select(F.col("next_page_token").alias("page_token")).where("page_token IS NOT NULL")
        last = stage(pages.join(step, "page_token").withColumn("_hop", F.lit(hop)), "news-page")
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    return reached.select(F.inline("news")).orderBy("created_at", "id")


def macro_drop(raw: DataFrame, first_release: bool = False) -> DataFrame:
    """(series_id, date, value) of observations (series_id, date, value, realtime_start); unparsable values go.

    Of a date's releases the last counts, or the first.
    """
    rows = raw.select("series_id", F.col("date").cast("date").alias("date"), F.expr("try_cast(value AS double)").alias("value"), F.col("realtime_start").cast("date").alias("_r")).where("value IS NOT NULL")
    pick = F.min_by("value", "_r") if first_release else F.max_by("value", "_r")
    return rows.groupBy("series_id", "date").agg(F.coalesce(pick, F.max("value")).alias("value"))


def ingest(lake: BarLake, drop: DataFrame, symbols: DataFrame, timeframe: str, asset: str = "equity") -> dict:
    """Upserts the usable bars of ``symbols``: how many symbols and bars went in, and a table of what failed and why.

    A symbol without bars, or with one that lacks a price or has a high below its low, fails as a whole.
    """
    prices = ["open", "high", "low", "close"]
    bad = F.col("ts").isNull() | F.greatest(*[F.col(c).isNull().cast("int") for c in prices]).cast("boolean") | (F.col("high") < F.col("low"))
    rows = stage(drop.join(symbols.select("symbol").distinct(), "symbol").withColumn("_bad", bad), "ingest")
    judged = symbols.select("symbol").distinct().join(rows.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("_bad").alias("bad")), "symbol", "left")
    reason = F.when(F.col("bars").isNull(), "no bars").when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" unusable bars")))
    judged = stage(judged.withColumn("reason", reason), "ingest-judged")
    good = rows.join(judged.where("reason IS NULL").select("symbol"), "symbol", "left_semi").drop("_bad")
    written = lake.write(good, timeframe, asset)
    drop_stage(rows)
    return {"symbols": judged.where("reason IS NULL").count(), "bars": written, "failed": judged.where("reason IS NOT NULL").select("symbol", "reason")}


def backfill(lake: BarLake, source: DataFrame, symbols: DataFrame, timeframe: str, start: datetime, end: datetime, asset: str = "crypto") -> DataFrame:
    """Upserts the bars of ``source`` that the lake misses between the two times; returns what is still missing."""
    spans = symbols.select("symbol").distinct().withColumns({"first_ts": F.lit(start).cast("timestamp"), "last_ts": F.lit(end).cast("timestamp")})
    grid = stage(continuous_grid(spans, TIMEFRAMES[timeframe]), "backfill-grid")
    gaps = stage(missing(grid, lake.stored(asset, timeframe)), "backfill-gaps")
    if not gaps.isEmpty():
        lake.write(source.join(gaps, ["symbol", "ts"], "left_semi"), timeframe, asset)
    return missing(grid, lake.stored(asset, timeframe))


def refresh(lake: BarLake, source: DataFrame, symbols: DataFrame, timeframe: str, now: datetime, asset: str = "crypto", overlap_days: int = 3, fresh_hours: int = 20, since: datetime = datetime(2021, 1, 1)) -> dict:
    """Upserts what is new: from ``overlap_days`` before a symbol's last bar on, from ``since`` for one without bars.

    Symbols with a bar of the last ``fresh_hours`` hours are left alone.
    """
    known = symbols.select("symbol").distinct().join(coverage(lake.stored(asset, timeframe)).select("symbol", "last_ts"), "symbol", "left")
    due = known.where(F.col("last_ts").isNull() | (F.col("last_ts") <= F.lit(now - timedelta(hours=fresh_hours)).cast("timestamp")))
    start = F.coalesce(F.col("last_ts") - F.expr(f"INTERVAL {overlap_days} DAYS"), F.lit(since).cast("timestamp"))
    new = source.join(due.select("symbol", start.alias("_from")), "symbol").where("ts >= _from").drop("_from")
    new = stage(new.where(F.col("ts") <= F.lit(now).cast("timestamp")), "refresh")
    out = {"updated": new.select("symbol").distinct().count(), "fetched": lake.write(new, timeframe, asset)}
    drop_stage(new)
    return out
