"""News counts, macro panels and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rolling import div, roll, roll_before


def daily_news(news: DataFrame) -> DataFrame:
    """Articles and distinct sources of each symbol and UTC day; an article counts once."""
    once = news.dropDuplicates(["id", "symbol"]).withColumn("date", F.to_date("created_at"))
    return once.groupBy("symbol", "date").agg(F.count("*").alias("article_count"), F.countDistinct("source").alias("source_count"))


def news_score(daily: DataFrame, window: int = 30, lagged: bool = False) -> DataFrame:
    """Score of the day's count against the days with news before it; ``lagged`` scores the day before."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = F.col("article_count")
    z = div(x - roll_before(F.avg, x, window, w), roll_before(F.stddev_samp, x, window, w) + 1e-9)
    out = daily.withColumn("count_z", z)
    return out.withColumn("count_z", F.lag("count_z").over(w)) if lagged else out


def macro_panel(values: DataFrame, series: list[str]) -> DataFrame:
    """Wide panel by date, each series carried forward only."""
    wide = values.groupBy("date").pivot("series_id", series).agg(F.max("value"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    return wide.select("date", *[F.last(F.col(f"`{s}`"), ignorenulls=True).over(w).alias(s) for s in series])


def macro_features(filled: DataFrame, change: int = 21, window: int = 252) -> DataFrame:
    """Change over ``change`` rows and trailing score of (series_id, date, value)."""
    w = Window.partitionBy("series_id").orderBy("date")
    v = F.col("value")
    z = div(v - roll(F.avg, v, window, w), roll(F.stddev_samp, v, window, w))
    return filled.withColumns({"change": v - F.lag("value", change).over(w), "z": z})


def outer_panel(a: DataFrame, b: DataFrame, on: str = "date") -> DataFrame:
    return a.join(b, on, "full")
