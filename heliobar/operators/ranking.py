"""Cross-sectional scores, ranks and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.indicators import momentum, vwap_deviation
from ..functions.rolling import by_symbol, div, finite, roll


def momentum_scores(panel: DataFrame, lookback: int, skip: int = 0) -> DataFrame:
    name, build = momentum(lookback, skip)
    return panel.withColumn("score", build(by_symbol()))


def top_n(scored: DataFrame, n: int, tie: str = "symbol") -> DataFrame:
    """The n best finite scores of a time with weight 1 / n; times with fewer are left out. Ties go by symbol."""
    ok = scored.withColumn("score", finite(F.col("score"))).where("score IS NOT NULL")
    at = Window.partitionBy("ts")
    ranked = ok.withColumn("rank", F.row_number().over(at.orderBy(F.desc("score"), tie))).withColumn("_n", F.count("*").over(at))
    return ranked.where((F.col("rank") <= n) & (F.col("_n") >= n)).withColumn("weight", F.lit(1.0 / n)).drop("_n")


def executed_next(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """Targets decided at one time take effect at the next."""
    times = panel.select("ts").distinct().withColumn("exec_ts", F.lead("ts").over(Window.orderBy("ts")))
    return targets.join(times, "ts").where("exec_ts IS NOT NULL")


def ranking_changed(top: DataFrame) -> DataFrame:
    sets = top.groupBy("ts").agg(F.sort_array(F.collect_set("symbol")).alias("members"))
    before = F.lag("members").over(Window.orderBy("ts"))
    return sets.withColumn("changed", before.isNotNull() & (F.col("members") != before))


def long_short(panel: DataFrame, lookback: int = 60, longs: int = 3, shorts: int = 3, long_weight: float = 0.25, short_weight: float = 0.10) -> DataFrame:
    """Weights at every time: the best ``longs`` positive, the worst ``shorts`` negative; the worst prevail."""
    scored = momentum_scores(panel, lookback).withColumn("score", finite(F.col("score"))).where("score IS NOT NULL")
    at = Window.partitionBy("ts")
    up = F.row_number().over(at.orderBy(F.desc("score"), "symbol"))
    n = F.count("*").over(at)
    ranked = scored.withColumns({"_up": up, "_n": n}).where(F.col("_n") >= longs + shorts)
    weight = F.when(F.col("_up") > F.col("_n") - shorts, -short_weight).when(F.col("_up") <= longs, long_weight)
    return ranked.withColumn("weight", weight).where("weight IS NOT NULL").drop("_up", "_n")


def cross_z(x, at=None):
    """Cross-sectional score; zero where it isn't defined."""
    at = at or Window.partitionBy("ts")
    x = finite(x)
    z = div(x - F.avg(x).over(at), F.nullif(F.stddev_samp(x).over(at), F.lit(0.0)))
    return F.coalesce(F.when(F.count(x).over(at) >= 2, z), F.lit(0.0))


def composite_alpha(panel: DataFrame, lookback: int = 100, weights=(0.4, 0.2, 0.2, 0.2)) -> DataFrame:
    """Weighted sum of the scores of trend, reversion, calm and volume; zeros before ``lookback`` + 1 bars."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    w = by_symbol()
    c, before = F.col("close"), F.lag("close").over(w)
    simple = div(c - before, before)
    parts = panel.withColumns({
        "_row": F.row_number().over(w),
        "_trend": momentum(lookback)[1](w) + div(c, roll(F.avg, c, lookback, w)) - 1,
        "_reversion": -vwap_deviation(24)[1](w),
        "_calm": div(F.lit(1.0), roll(F.stddev_pop, simple, 23, w) + 1e-6),
        "_volume": div(F.col("volume"), roll(F.avg, F.col("volume"), 20, w)),
    })
    names = ("_trend", "_reversion", "_calm", "_volume")
    z = parts.withColumns({f"{n}_z": cross_z(F.col(n)) for n in names})
    total = sum((F.col(f"{n}_z") * k for n, k in zip(names, weights, strict=True)), F.lit(0.0))
    out = z.withColumn("alpha", F.when(F.col("_row") <= lookback, 0.0).otherwise(total))
    return out.drop("_row", *names, *[f"{n}_z" for n in names])


def buy_and_hold(panel: DataFrame, capital: float = 500.0, warmup: int = 0) -> DataFrame:
    """Equal weights bought at bar ``warmup`` and kept."""
    w = by_symbol()
    rows = panel.withColumn("_row", F.row_number().over(w) - 1).where(F.col("_row") >= warmup)
    first = F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_x", div(F.col("close"), first)).groupBy("ts").agg((capital * F.avg("_x")).alias("equity"))


def vol_target_size(equity, price, vol, periods: float = 365.0, conviction=1.0, cap: float = 0.25, target: float = 0.20, least: float = 1.0):
    scale = F.least(F.lit(1.0), div(F.lit(target), vol * periods**0.5))
    value = equity * cap * scale * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(conviction)))
    ok = (price > 0) & (equity > 0) & (vol > 0) & (value >= least)
    return F.coalesce(F.when(ok, div(value, price)), F.lit(0.0))


def _counted(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Distinct values with the number of rows up to each, and of all: equal values are counted before they are sorted."""
    values = rows.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    return values.withColumns({"_upto": F.sum("_c").over(w.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})


def value_at_rank(rows: DataFrame, by: list[str], x: str, rank) -> DataFrame:
    """``at``: the value at ``rank(n)``, from 0, of each group's n values in order."""
    at = _counted(rows, by, x)
    want = rank(F.col("_n"))
    return at.where((F.col("_upto") > want) & (F.col("_upto") - F.col("_c") <= want)).select(*by, F.col("_x").alias("at"))


def interpolated(rows: DataFrame, by: list[str], x: str, share: float, name: str) -> DataFrame:
    """The percentile of each group, between the two values around it."""
    place = (F.col("_n") - 1) * share
    low, high = F.floor(place), F.ceil(place)
    inside = lambda k: (F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k)
    ends = _counted(rows, by, x).groupBy(*by).agg(F.max(F.when(inside(low), F.col("_x"))).alias("_a"), F.max(F.when(inside(high), F.col("_x"))).alias("_b"), F.max(place - low).alias("_f"))
    return ends.select(*by, (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias(name))
