"""Rule strategies, evaluated for every bar of every symbol at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rolling import EPS, by_symbol, div, roll, roll_before


def _windowed_atr(n: int, w):
    """Mean over n bars of the two-term true range whose first bar is its own predecessor."""
    before = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before))
    inner = w.rowsBetween(1 - n, 0)
    first_low = F.first("high").over(inner) - F.first("low").over(inner)
    first_gap = F.abs(F.first("high").over(inner) - F.first("close").over(inner))
    rest = F.sum(tr).over(w.rowsBetween(2 - n, 0))
    return F.when(F.count("close").over(inner) == n, (rest + F.greatest(first_low, first_gap)) / n)


def _annual_vol(w, n: int = 168):
    """Volatility of up to n - 1 simple returns, a year having 8,760 bars."""
    before = F.lag("close").over(w)
    r = div(F.col("close") - before, before + EPS)
    return F.stddev_pop(r).over(w.rowsBetween(2 - n, 0)) * (365 * 24) ** 0.5


def with_squeeze(bars: DataFrame) -> DataFrame:
    w = by_symbol()
    c = F.col("close")
    out = bars.withColumns({"_ma": roll(F.avg, c, 20, w), "_sd": roll(F.stddev_pop, c, 20, w), "_atr": _windowed_atr(20, w), "_row": F.row_number().over(w)})
    return out.withColumn("squeeze", div(4 * F.col("_sd"), F.col("_ma") + EPS) < div(3 * F.col("_atr"), F.col("_ma") + EPS))


def vol_squeeze(bars: DataFrame, target: float = 0.30, min_rvol: float = 1.2) -> DataFrame:
    """Half a book, scaled to the target volatility, on a breakout from a squeeze with volume."""
    w = by_symbol()
    out = with_squeeze(bars).withColumns({"_rvol": div(F.col("volume"), roll(F.avg, F.col("volume"), 20, w) + EPS), "_vol": _annual_vol(w)})
    scale = F.least(F.lit(1.0), div(F.lit(target), F.greatest(F.lit(1e-4), F.col("_vol"))))
    hit = (F.col("_row") >= 50) & F.col("squeeze") & (F.col("close") > F.col("_ma") + 2 * F.col("_sd")) & (F.col("_rvol") >= min_rvol)
    return out.withColumn("weight", F.when(hit, 0.5 * scale).otherwise(0.0))


def pair_spread(bars: DataFrame, first: str, second: str, n: int = 100, threshold: float = 1.5) -> DataFrame:
    """Score of the two closes' ratio and the weights of its reversal."""
    a = bars.where(F.col("symbol") == first).select("ts", F.col("close").alias("_a"))
    b = bars.where(F.col("symbol") == second).select("ts", F.col("close").alias("_b"))
    both = a.join(b, "ts").withColumn("ratio", div(F.col("_a"), F.col("_b") + EPS)).withColumn("_k", F.lit(1))
    w = Window.partitionBy("_k").orderBy("ts")
    z = div(F.col("ratio") - roll(F.avg, F.col("ratio"), n, w), roll(F.stddev_pop, F.col("ratio"), n, w) + EPS)
    out = both.withColumn("z", z)
    return out.select("ts", "ratio", "z", F.when(F.col("z") < -threshold, 0.5).otherwise(0.0).alias("first_weight"), F.when(F.col("z") > threshold, 0.5).otherwise(0.0).alias("second_weight"))


def trend_vol_target(bars: DataFrame, majors: list[str], n: int = 20, target: float = 0.20) -> DataFrame:
    w = by_symbol()
    out = bars.where(F.col("symbol").isin(majors)).withColumns({"_sma": roll(F.avg, F.col("close"), n, w), "_vol": _annual_vol(w)})
    scale = F.least(F.lit(1.0), div(F.lit(target), F.greatest(F.lit(1e-4), F.col("_vol"))))
    return out.withColumn("weight", F.when(F.col("close") > F.col("_sma"), scale / len(majors)).otherwise(0.0))


def regime(panel: DataFrame) -> DataFrame:
    """Regime of each time: squeeze if any symbol is squeezed, trend if closes are far from their means, else range."""
    rows = with_squeeze(panel)
    per = rows.groupBy("ts").agg(F.min("_row").alias("_row"), F.max(F.coalesce("squeeze", F.lit(False))).alias("_any"), F.avg(F.abs(div(F.col("close"), F.col("_ma") + EPS) - 1)).alias("deviation"))
    kind = F.when(F.col("_row") < 30, "trend").when(F.col("_any"), "squeeze").when(F.col("deviation") >= 0.02, "trend").otherwise("rangebound")
    out = per.withColumn("regime", kind)
    return out.withColumn("confidence", F.when(F.col("regime") == "squeeze", 0.85).when(F.col("regime") == "trend", 0.90).otherwise(0.75)).drop("_row", "_any")


def routed(panel: DataFrame, majors: list[str], pair: tuple[str, str]) -> DataFrame:
    """The weights of the strategy that each time's regime calls for: (ts, symbol, regime, confidence, weight)."""
    by_time = regime(panel).select("ts", "regime", "confidence")
    squeeze = vol_squeeze(panel).select("ts", "symbol", F.lit("squeeze").alias("regime"), "weight")
    trend = trend_vol_target(panel, majors).select("ts", "symbol", F.lit("trend").alias("regime"), "weight")
    both = pair_spread(panel, *pair)
    sides = F.explode(F.array(F.struct(F.lit(pair[0]).alias("symbol"), F.col("first_weight").alias("weight")), F.struct(F.lit(pair[1]).alias("symbol"), F.col("second_weight").alias("weight"))))
    reversal = both.select("ts", sides.alias("s")).select("ts", "s.symbol", F.lit("rangebound").alias("regime"), "s.weight")
    every = squeeze.unionByName(trend).unionByName(reversal)
    return every.join(by_time, ["ts", "regime"]).select("ts", "symbol", "regime", "confidence", "weight")


def quick_move(bars: DataFrame, n: int = 24, min_rvol: float = 1.3, profit: float = 0.02, stop: float = 0.012, size: float = 0.40) -> DataFrame:
    """Breakouts of the close over the highs, or under the lows, of the n - 1 bars before, with volume."""
    w = by_symbol()
    k, c = n - 1, F.col("close")
    out = bars.withColumns({"_hi": roll_before(F.max, F.col("high"), k, w), "_lo": roll_before(F.min, F.col("low"), k, w), "_rvol": div(F.col("volume"), roll_before(F.avg, F.col("volume"), k, w) + EPS)})
    up = (c > F.col("_hi")) & (F.col("_rvol") >= min_rvol)
    down = (c < F.col("_lo")) & (F.col("_rvol") >= min_rvol)
    out = out.withColumn("action", F.when(up, "BUY").when(down, "SELL")).where("action IS NOT NULL")
    sign = F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0)
    return out.withColumns({"weight": sign * size, "take_profit": c * (1 + sign * profit), "stop_loss": c * (1 - sign * stop)})


def percent_b_reversion(bars: DataFrame, n: int = 20, rsi_n: int = 14, size: float = 0.33) -> DataFrame:
    """Entries at the bands' ends with an extreme relative strength, back to the mean, stopped at 1.5 ranges."""
    w = by_symbol()
    c = F.col("close")
    change = c - F.lag("close").over(w)
    out = bars.withColumns({
        "_ma": roll(F.avg, c, n, w), "_sd": roll(F.stddev_pop, c, n, w), "_atr": _windowed_atr(n, w),
        "_up": roll(F.avg, F.when(change > 0, change).when(change.isNotNull(), 0.0), rsi_n, w),
        "_down": roll(F.avg, F.when(change < 0, -change).when(change.isNotNull(), 0.0), rsi_n, w),
    })
    strength = F.when(F.col("_up").isNull(), 50.0).when(F.col("_down") == 0, 100.0).otherwise(100 - div(F.lit(100.0), 1 + div(F.col("_up"), F.col("_down"))))
    out = out.withColumns({"pct_b": div(c - (F.col("_ma") - 2 * F.col("_sd")), 4 * F.col("_sd") + EPS), "strength": strength})
    buy, sell = (F.col("pct_b") < 0.05) & (F.col("strength") < 35), (F.col("pct_b") > 0.95) & (F.col("strength") > 65)
    out = out.withColumn("action", F.when(buy, "BUY").when(sell, "SELL")).where("action IS NOT NULL")
    sign = F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0)
    return out.withColumns({"weight": sign * size, "target_price": F.col("_ma"), "stop_loss": c - sign * 1.5 * F.col("_atr")})


def composite_rule(rows: DataFrame, low: float = 40.0, high: float = 90.0) -> DataFrame:
    """1 where the fast mean leads and the strength is in its band; 0 elsewhere and where any input is null."""
    need = ("ema_9", "ema_21", "macd_hist", "volume", "vol_ma_20", "rsi_14")
    whole = F.lit(True)
    for c in need:
        whole = whole & F.col(c).isNotNull()
    ok = whole & (F.col("ema_9") > F.col("ema_21")) & (F.col("rsi_14") > low) & (F.col("rsi_14") < high)
    return rows.withColumn("weight", F.when(ok, 1.0).otherwise(0.0))
