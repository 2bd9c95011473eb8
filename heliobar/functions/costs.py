"""Trading costs as column expressions over a small table of venues."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import div

# fixed values
SEC_PER_DOLLAR, TAF_PER_SHARE, TAF_CAP = 27.80 / 1_000_000, 0.000166, 8.30
#: name, asset, commission, half spread, slippage (bps), least commission, regulatory fees
VENUES = [
    ("alpaca-equity", "equity", 0.0, 1.0, 0.5, 0.0, True),
    ("alpaca-equity-broad", "equity", 0.0, 5.0, 1.5, 0.0, True),
    ("alpaca-crypto", "crypto", 25.0, 6.0, 1.0, 0.0, False),
    ("alpaca-crypto-alts", "crypto", 25.0, 20.0, 2.0, 0.0, False),
    ("binance-spot", "crypto", 10.0, 1.0, 1.0, 0.0, False),
    ("coinbase-advanced", "crypto", 60.0, 1.5, 1.0, 0.0, False),
    ("kraken-spot", "crypto", 26.0, 1.5, 1.0, 0.0, False),
]


def venues(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame(VENUES, "venue string, asset string, commission_bps double, half_spread_bps double, slippage_bps double, min_commission double, regulatory boolean")
    return table.withColumn("adverse_selection_bps", F.lit(None).cast("double"))


def venue_named(name: str) -> tuple:
    return next(v for v in VENUES if v[0] == name)


def fill_cost(notional: Column, qty: Column, sell: Column, passive: Column, whole_cents: bool = True) -> Column:
    """Commission, spread, slippage and regulatory cost of a fill at the row's venue, as a struct with its total.

    A passive fill earns the spread and pays the venue's adverse selection, adverse_selection_bps, which is the
    spread again where the table of venues doesn't have the column or it is null. Sales of shares pay fees, rounded
    up to the cent unless ``whole_cents`` is off.
    """
    n = F.abs(notional)
    commission = F.greatest(n * F.col("commission_bps") / 1e4, F.col("min_commission"))
    half = n * F.col("half_spread_bps") / 1e4
    adverse = F.coalesce(F.col("adverse_selection_bps"), F.col("half_spread_bps"))
    spread = F.when(passive, n * adverse / 1e4 - half).otherwise(half)
    slippage = F.when(passive, 0.0).otherwise(n * F.col("slippage_bps") / 1e4)
    raw = n * SEC_PER_DOLLAR + F.least(qty * TAF_PER_SHARE, F.lit(TAF_CAP))
    fees = F.when(F.col("regulatory") & sell, F.ceil(raw * 100.0) / 100.0 if whole_cents else raw).otherwise(0.0)
    return F.struct(commission.alias("commission"), spread.alias("spread"), slippage.alias("slippage"), fees.alias("fees"), (commission + spread + slippage + fees).alias("total"))


def with_spread(table: DataFrame, half_spread_bps: float) -> DataFrame:
    """The venues at another spread."""
    return table.withColumn("half_spread_bps", F.lit(float(half_spread_bps)))


def round_trip_bps(notional: float = 500.0, passive: bool = False) -> Column:
    n, q, p = F.lit(notional), F.lit(notional / 100.0), F.lit(passive)
    buy = fill_cost(n, F.lit(0.0), F.lit(False), p)["total"]
    return 1e4 * (buy + fill_cost(n, q, F.lit(True), p)["total"]) / notional


def min_hold_days(cost_bps: Column, daily_vol: Column, ic: float = 0.03, selection: float = 1.75, coverage: float = 2.0) -> Column:
    edge = F.lit(ic) * daily_vol * 1e4 * selection
    return F.when(edge > 0, F.pow(div(coverage * cost_bps, edge), 2)).otherwise(F.lit(float("inf")))


def feasibility(table: DataFrame, notional: float = 500.0, coverage: float = 2.0, ic: float = 0.03) -> DataFrame:
    """Shortest holds, trades a year and whether a strategy at the venue can ever be validated; needs daily_vol."""
    out = table.withColumn("round_trip_bps", round_trip_bps(notional))
    out = out.withColumns({"breakeven_hold_days": min_hold_days(F.col("round_trip_bps"), F.col("daily_vol"), ic, coverage=1.0), "min_hold_days": min_hold_days(F.col("round_trip_bps"), F.col("daily_vol"), ic, coverage=coverage)})
    days = F.when(F.col("asset") == "crypto", 365.0).otherwise(252.0)
    out = out.withColumn("trades_per_year", F.coalesce(div(days, F.col("min_hold_days")), F.lit(float("inf"))))
    out = out.withColumn("years_to_100_trades", F.coalesce(div(F.lit(100.0), F.col("trades_per_year")), F.lit(float("inf"))))
    return out.withColumn("viable", (F.col("min_hold_days") < 60) & (F.col("trades_per_year") >= 25))


def edge_required(cost_bps: float, trades_per_day: float, annual: float = 0.20) -> float:
    per_year = trades_per_day * 252
    return 1e4 * annual / per_year + cost_bps if per_year > 0 else math.inf


def array_fill_cost(venue: tuple, value: np.ndarray, qty: np.ndarray, sell: bool) -> np.ndarray:
    """The same cost for arrays of marketable fills, for sequential books."""
    _, _, commission, half, slip, least, regulated = venue
    cost = np.maximum(value * commission / 1e4, least) + value * (half + slip) / 1e4
    if regulated and sell:
        cost = cost + np.ceil((value * SEC_PER_DOLLAR + np.minimum(qty * TAF_PER_SHARE, TAF_CAP)) * 100.0) / 100.0
    return cost


def hold_check(entry: Column, now: Column, minimum_days: Column) -> Column:
    """Whether a position may be closed, days held and days that remain."""
    held = (F.unix_seconds(now) - F.unix_seconds(entry)) / 86400.0
    return F.struct((held >= minimum_days).alias("allowed"), held.alias("days_held"), F.greatest(minimum_days - held, F.lit(0.0)).alias("days_remaining"))


def holding_policy(table: DataFrame, floor_days: float = 5.0, ic: float = 0.03, coverage: float = 2.0, symbols: int = 1, target: int = 100) -> DataFrame:
    """Shortest hold of each venue by its costs, shares never below ``floor_days``; trades a year over ``symbols``
    symbols, and the years until ``target`` of them. Needs daily_vol."""
    hold = min_hold_days(round_trip_bps(500.0), F.col("daily_vol"), ic, coverage=coverage)
    out = table.withColumn("min_hold_days", F.when(F.col("asset") == "crypto", hold).otherwise(F.greatest(hold, F.lit(floor_days))))
    days = F.when(F.col("asset") == "crypto", 365.0).otherwise(252.0)
    out = out.withColumn("trades_per_year", F.coalesce(div(days, F.nullif(F.col("min_hold_days"), F.lit(0.0))) * symbols, F.lit(float("inf"))))
    return out.withColumn("years_to_target", div(F.lit(float(target)), F.col("trades_per_year")))


def earliest_exit(entry: Column, minimum_days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(entry) + F.round(minimum_days * 86_400_000_000).cast("long"))


def exit_check(entry: Column, now: Column, minimum_days: Column, asset: Column) -> Column:
    """``hold_check`` with a reason where the position may not be closed yet."""
    check = hold_check(entry, now, minimum_days)
    hours = F.ceil(check["days_remaining"] * 24 - 1e-9)
    left = F.format_string("%s is held for some days to earn its costs, %d hours are left", asset, hours)
    return F.struct(*[check[c].alias(c) for c in ("allowed", "days_held", "days_remaining")], F.when(check["allowed"], "").otherwise(left).alias("reason"))


def capacity_text(account: Column, asset: Column, cap: Column, margin_minimum: float = 2000.0) -> Column:
    """How often an account can trade in a day, in words: by asset, the broker's cap and the kind of account."""
    return (
        F.when(asset == "crypto", "no limit but cost: settlement is instant, at all hours")
        .when(cap.isNotNull(), F.format_string("%d day trades in five business days, by the broker's own rule", cap.cast("long")))
        .when(account == "cash", "no cap on day trades, about one round trip of the whole balance a day: sales settle on the next day")
        .otherwise(F.lit(f"no cap on day trades; below {margin_minimum:,.0f} dollars a margin account settles like cash"))
    )
