"""Path-dependent labels: volatility, triple barrier, meta labels, panel datasets, trailing stops."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.indicators import DEFAULT, Feature, compute, feature_names
from ..functions.rolling import by_symbol, decayed_sum, div, finite
from ..staging import numbered, stage


def ew_volatility(bars: DataFrame, span: int = 100, causal_seed: bool = False) -> DataFrame:
    """Exponentially weighted volatility of log returns: var = a r^2 + (1 - a) var before.

    The first return is 0 and the variance before it is the square of the second, unless ``causal_seed``, and zeros
    take the first positive value, as the reference semantics have it. Prices must be positive.
    """
    a = 2.0 / (span + 1)
    w = by_symbol()
    price = F.when(F.col("close") <= 0, F.raise_error(F.lit("prices must be positive")).cast("double")).otherwise(F.col("close"))
    base = bars.withColumns({"_r": F.coalesce(F.ln(div(price, F.lag("close").over(w))), F.lit(0.0)), "_row": F.row_number().over(w)})
    seed = F.lit(0.0) if causal_seed else F.coalesce(F.pow(F.lead("_r").over(w), 2), F.lit(0.0))
    term = F.when(F.col("_row") == 1, (1 - a) * seed + a * F.pow("_r", 2)).otherwise(a * F.pow("_r", 2))
    out = decayed_sum(base.withColumn("_x", term), F.col("_x"), 1 - a, "_var").withColumn("_vol", F.sqrt("_var"))
    first = F.first(F.when(F.col("_vol") > 0, F.col("_vol")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    vol = F.col("_vol") if causal_seed else F.when(F.col("_vol") > 0, F.col("_vol")).otherwise(F.coalesce(first, F.lit(0.0)))
    return out.withColumn("ew_vol", vol).select(*bars.columns, "ew_vol")


def ema(bars: DataFrame, n: int, x: str = "close", name: str | None = None) -> DataFrame:
    """Adds the exponential mean of all values up to the row, weights adding up to 1; null before ``n`` rows."""
    a, name = 2.0 / (n + 1), name or f"ema_{n}"
    w = by_symbol()
    out = decayed_sum(bars, F.col(x), 1 - a, name).withColumn("_row", F.row_number().over(w))
    weight = (1 - F.pow(F.lit(1 - a), F.col("_row"))) / a
    return out.withColumn(name, F.when(F.col("_row") >= n, F.col(name) / weight)).drop("_row")


def macd_histogram(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds macd_hist: the two means' difference less its own exponential mean; null before slow + signal - 1 rows."""
    w = by_symbol()
    both = ema(ema(bars, fast, name="_fast"), slow, name="_slow")
    line = both.withColumn("_macd", F.coalesce(F.col("_fast") - F.col("_slow"), F.lit(0.0)))
    # the line's mean starts with the line, at row ``slow``
    a = 2.0 / (signal + 1)
    meant = decayed_sum(line, F.col("_macd"), 1 - a, "_mean").withColumn("_row", F.row_number().over(w) - (slow - 1))
    weight = (1 - F.pow(F.lit(1 - a), F.col("_row"))) / a
    hist = F.when(F.col("_row") >= signal, F.col("_macd") - F.col("_mean") / weight)
    return meant.withColumn("macd_hist", hist).drop("_fast", "_slow", "_macd", "_mean", "_row")


def triple_barrier(bars: DataFrame, vol: str, profit: float = 1.0, stop: float = 1.0, max_bars: int = 24, side: str | None = None, neutral_sign: bool = False, events: str | None = None) -> DataFrame:
    """Label, touch offset, return and barrier of every bar that has ``max_bars`` bars after it.

    ``events`` names a boolean column that marks the bars to label in their place; a path then ends with the bars,
    and a bar that has none after it returns 0.

    The path of closes after the bar is met by an upper and a lower barrier, multiples of its volatility; the
    first touch counts, the upper one on a tie, a multiple of 0 switches a barrier off. Without a touch the label
    is 0, or the return's sign. With ``side`` the label tells whether the signed return was positive; barriers
    stay as they are.
    """
    if max_bars < 1 or profit < 0 or stop < 0:
        raise ValueError("barriers must not be negative and the horizon at least 1")
    w = by_symbol()
    ahead = F.collect_list("close").over(w.rowsBetween(1, max_bars))
    n = F.count("*").over(Window.partitionBy("symbol"))
    rows = bars.withColumns({"_i": F.row_number().over(w) - 1, "_n": n, "_path": ahead})
    rows = rows.where(F.col(events) if events else F.col("_i") <= F.col("_n") - 1 - max_bars)
    up, down = F.col("close") * (1 + profit * F.col(vol)), F.col("close") * (1 - stop * F.col(vol))
    rows = rows.withColumns({"_up": up, "_down": down})
    at = lambda f: F.array_position(F.transform("_path", f), True)
    rows = rows.withColumns({"_pt": at(lambda x: x >= F.col("_up")) if profit else F.lit(0), "_sl": at(lambda x: x <= F.col("_down")) if stop else F.lit(0)})
    hit_up = (F.col("_pt") > 0) & ((F.col("_sl") == 0) | (F.col("_pt") <= F.col("_sl")))
    hit_down = (F.col("_sl") > 0) & ~hit_up
    touch = F.when(hit_up, F.col("_pt")).when(hit_down, F.col("_sl")).otherwise(F.size("_path"))
    rows = rows.withColumns({"touch": touch.cast("int"), "barrier": F.when(hit_up, "pt").when(hit_down, "sl").otherwise("vertical")})
    reached = F.when(F.col("touch") > 0, F.get("_path", F.col("touch") - 1)).otherwise(F.col("close"))
    rows = rows.withColumn("ret", div(reached, F.col("close")) - 1)
    if side is not None:
        rows = rows.withColumn("ret", F.col("ret") * F.col(side)).withColumn("label", F.when(F.col("ret") > 0, 1).otherwise(0))
    else:
        flat = F.signum("ret").cast("int") if neutral_sign else F.lit(0)
        rows = rows.withColumn("label", F.when(hit_up, 1).when(hit_down, -1).otherwise(flat))
    return rows.withColumnRenamed("_i", "event_idx").drop("_n", "_path", "_up", "_down", "_pt", "_sl")


def panel_dataset(bars: DataFrame, features: Iterable[Feature] = DEFAULT, horizon: int = 24, profit: float = 1.0, stop: float = 1.0, warmup: int = 90, span: int = 100) -> DataFrame:
    """Finite feature rows with their labels, in time order, and the row at which each label is known.

    Symbols with fewer than warmup + horizon + 10 bars are left out. Row numbers are global, by time and symbol.
    """
    features = list(features)
    n = bars.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= warmup + horizon + 10)
    kept = bars.join(n.select("symbol"), "symbol", "left_semi")
    w = by_symbol()
    featured = compute(ew_volatility(kept, span), features).withColumn("_t1", F.lead("ts", horizon).over(w))
    known = F.collect_list("ts").over(w.rowsBetween(1, horizon))
    featured = featured.withColumn("_after", known)
    labelled = triple_barrier(featured, "ew_vol", profit, stop, horizon).where(F.col("event_idx") >= warmup)
    names = feature_names(features)
    ok = labelled.withColumns({x: finite(F.col(x).cast("double")) for x in names}).dropna(subset=names)
    ok = ok.withColumns({"t1": F.get("_after", F.col("touch") - 1), "y": (F.col("label") == 1).cast("int")})
    ok = ok.select("symbol", "ts", "t1", "y", "ret", "label", *names)
    rows = stage(global_index(ok, ["ts", "symbol"], "row_idx"), "panel-dataset")
    # the last row of a time at or before t1, not before the row itself: times are few beside rows, and each is met
    # by those that stand between it and the next
    last = rows.groupBy("ts").agg(F.max("row_idx").alias("last_idx"))
    times = rows.select(F.col("t1").alias("ts")).distinct()
    from .joins import asof_buckets

    known = asof_buckets(times, last, "ts", ["last_idx"])
    out = rows.join(known.select(F.col("ts").alias("t1"), "last_idx"), "t1", "left")
    return out.withColumn("t1_idx", F.greatest("row_idx", F.coalesce("last_idx", F.col("row_idx")))).drop("last_idx")


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 in a global order."""
    return numbered(df, order, name)


def trailing_stop(positions: DataFrame, multiple: float = 3.0, key: str = "position_id") -> DataFrame:
    """Water mark since entry, stop price and whether the price breaches it; rows hold close, atr and is_short."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("is_short"), F.min("close").over(w)).otherwise(F.max("close").over(w))
    stop = F.when(F.col("is_short"), F.col("mark") + multiple * F.col("atr")).otherwise(F.col("mark") - multiple * F.col("atr"))
    out = positions.withColumn("mark", mark).withColumn("stop_price", stop)
    return out.withColumn("triggered", F.when(F.col("is_short"), F.col("close") >= F.col("stop_price")).otherwise(F.col("close") <= F.col("stop_price")))


def signal_returns(rows: DataFrame, threshold: float = 0.5, cost_bps: float = 0.0) -> DataFrame:
    """Net return of taking each finite prediction above the threshold, 0 otherwise."""
    ok = rows.withColumns({"oof": finite(F.col("oof")), "ret": finite(F.col("ret"))}).dropna(subset=["oof", "ret"])
    return ok.withColumn("net_ret", F.when(F.col("oof") > threshold, F.col("ret") - cost_bps / 1e4).otherwise(0.0))
