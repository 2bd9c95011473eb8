"""Risk rules and order checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rolling import div


def kill_switch(marks: DataFrame, capital: float = 500.0, max_drawdown: float = 0.20, max_daily_loss: float = 0.05) -> DataFrame:
    """Drawdown from the peak, loss of the day and whether trading is halted by then; a halt stays."""
    w = Window.partitionBy("account").orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy("account", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(capital), F.max("equity").over(run))
    start = F.first("equity").over(day)
    out = marks.withColumns({"drawdown": div(F.col("equity") - peak, peak), "daily_pnl": div(F.col("equity") - start, start)})
    breach = (F.col("drawdown") <= -max_drawdown) | (F.col("daily_pnl") <= -max_daily_loss)
    return out.withColumn("halted", F.coalesce(F.max(breach).over(run), F.lit(False)))


def kill_switch_with_resets(marks: DataFrame, resets: DataFrame, capital: float = 500.0, max_drawdown: float = 0.20, max_daily_loss: float = 0.05) -> DataFrame:
    """``kill_switch`` that a person can lift: ``resets`` has account, ts and a note, which must not be blank.

    A halt lasts to the first reset at or after it; limits count from the same peak and day afterwards. trades_today
    is the running sum of ``trades``, if marks have it, from the day's start.
    """
    blank = F.length(F.trim(F.coalesce("note", F.lit("")))) == 0
    noted = F.when(blank, F.raise_error(F.lit("a reset needs a note")).cast("boolean")).otherwise(F.lit(True))
    seen = kill_switch(marks, capital, max_drawdown, max_daily_loss)
    breach = (F.col("drawdown") <= -max_drawdown) | (F.col("daily_pnl") <= -max_daily_loss)
    # at one time the reset comes after the mark
    both = seen.withColumns({"_breach": breach, "_reset": F.lit(False)}).unionByName(resets.select("account", "ts", F.lit(False).alias("_breach"), noted.alias("_reset")), allowMissingColumns=True)
    w = Window.partitionBy("account").orderBy("ts", "_reset").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_breach"), True).when(F.col("_reset"), False), ignorenulls=True).over(w)
    out = both.withColumn("halted", F.coalesce(last, F.lit(False))).where("NOT _reset").drop("_breach", "_reset")
    if "trades" not in marks.columns:
        return out
    day = Window.partitionBy("account", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("trades_today", F.sum("trades").over(day))


def equity_guard(marks: DataFrame, capital: float = 500.0, halve: float = 0.10, stop: float = 0.15) -> DataFrame:
    """Scale of leverage allowed by the drawdown: 1, a half, or none."""
    w = Window.partitionBy("account").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(capital), F.max("equity").over(w))
    down = F.abs(div(F.col("equity") - peak, peak))
    return marks.withColumn("drawdown", down).withColumn("scale", F.when(F.col("drawdown") >= stop, 0.0).when(F.col("drawdown") >= halve, 0.5).otherwise(1.0))


def check_orders(orders: DataFrame, position: float = 0.25, gross: float = 1.0, short: float = 0.10, gross_short: float = 0.30, trades: int = 25, least: float = 1.0) -> DataFrame:
    """Approves, shrinks or rejects each order: adds approved and approved_qty.

    Orders have side, qty, price, equity, position_value, gross_exposure, current_qty, gross_short, allow_short,
    halted and trades_today. Closing is always allowed; what a sale opens beyond that is a short.
    """
    c = F.col
    closing = F.least(c("qty"), F.greatest(F.lit(0.0), c("current_qty")))
    rest = c("qty") - closing
    cap_room = c("equity") * min(short, position) - F.greatest(F.lit(0.0), -c("current_qty")) * c("price")
    step1 = F.least(rest * c("price"), cap_room)
    gross_room = c("equity") * gross_short - c("gross_short")
    step2 = F.least(step1, gross_room)
    dead = ((rest * c("price") > cap_room) & (cap_room < least)) | ((step1 > gross_room) & (gross_room < least))
    opened = F.when(~c("allow_short") | c("halted") | dead, 0.0).otherwise(div(step2, c("price")))
    sell = F.when(rest <= 1e-12, c("qty")).otherwise(closing + opened)
    notional = c("qty") * c("price")
    room1 = c("equity") * position - c("position_value")
    value1 = F.least(notional, room1)
    room2 = c("equity") * gross - c("gross_exposure")
    value2 = F.least(value1, room2)
    no = c("halted") | (c("trades_today") >= trades) | (notional < least) | ((notional > room1) & (room1 < least)) | ((value1 > room2) & (room2 < least))
    buy = F.when(no, 0.0).when((notional <= room1) & (value1 <= room2), c("qty")).otherwise(div(value2, c("price")))
    out = orders.withColumn("approved_qty", F.when(c("side") == "sell", sell).otherwise(buy))
    return out.withColumn("approved", F.when(c("side") == "sell", (c("approved_qty") > 0) | (rest <= 1e-12)).otherwise(~no))


def day_trades(fills: DataFrame, cal: DataFrame, window: int = 5) -> DataFrame:
    """Symbols an account both bought and sold on a day, and their sum over the trailing trading days; no crypto."""
    eq = fills.where("asset_class = 'equity'")
    per = eq.groupBy("account", "day", "symbol").agg((F.max(F.col("side") == "buy") & F.max(F.col("side") == "sell")).cast("long").alias("_round"), F.count("*").alias("_n"))
    daily = per.groupBy("account", "day").agg(F.sum("_round").alias("day_trades"), F.sum("_n").alias("fills"))
    placed = daily.join(F.broadcast(cal.select("day", "td_ordinal")), "day")
    w = Window.partitionBy("account").orderBy("td_ordinal").rangeBetween(1 - window, 0)
    return placed.withColumns({"day_trades_5d": F.sum("day_trades").over(w), "fills_5d": F.sum("fills").over(w)})


def day_trade_status(counted: DataFrame, cap: int | None) -> DataFrame:
    """Adds whether a broker's cap of day trades is reached and how many are left; no cap restricts nobody."""
    if cap is None:
        return counted.withColumns({"restricted": F.lit(False), "remaining": F.lit(None).cast("long")})
    left = F.greatest(F.lit(0), cap - F.col("day_trades_5d")).cast("long")
    return counted.withColumns({"restricted": F.col("day_trades_5d") >= cap, "remaining": left})


def can_short(max_position: Column):
    """Whether one whole share fits the cap of a position, over columns shortable, easy_to_borrow and price."""
    price = F.col("price")
    return F.coalesce(F.col("shortable") & F.col("easy_to_borrow") & (price > 0) & (price <= max_position), F.lit(False))


def twap_slices(orders: DataFrame, slices: int = 3, least: float = 10.0) -> DataFrame:
    """One order, or equal slices where each is large enough."""
    n = F.when(F.col("notional") < least * slices, 1).otherwise(slices)
    out = orders.withColumn("_n", n).withColumn("slice", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.withColumn("slice_notional", F.round(F.col("notional") / F.col("_n"), 2)).drop("_n")


def valid_order(qty, notional, order_type, limit_price, asset, tif):
    """Quantity or notional, not both; a limit needs a price; crypto isn't for the day."""
    return (qty.isNull() != notional.isNull()) & ((order_type != "limit") | limit_price.isNotNull()) & ~((asset == "crypto") & (tif == "day"))


def liquidity(quotes: DataFrame, max_age: float = 900.0, max_spread: float = 30.0) -> DataFrame:
    """Spread in bps, whether the symbol can be traded, and why not; missing figures fail."""
    mid = (F.col("bid") + F.col("ask")) / 2
    out = quotes.withColumn("spread_bps", 1e4 * div(F.col("ask") - F.col("bid"), mid))
    stale, wide = F.coalesce(F.col("age_s") > max_age, F.lit(True)), F.coalesce(F.col("spread_bps") > max_spread, F.lit(True))
    return out.withColumns({"tradeable": ~stale & ~wide, "reason": F.concat_ws("; ", F.when(stale, "stale"), F.when(wide, "wide"))})


def shortable(universe: DataFrame, prices: DataFrame, max_price: float = 125.0) -> DataFrame:
    ok = universe.where("asset_class = 'us_equity' AND tradable AND shortable AND easy_to_borrow")
    return ok.join(prices, "symbol").where((F.col("price") > 0) & (F.col("price") <= max_price))


def top_by_dollar_volume(bars: DataFrame, n: int, last: int = 5) -> DataFrame:
    """The n symbols with the highest mean dollar volume over their last bars, with their last price."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    recent = bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    got = recent.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("dollar_volume"), F.max_by("close", "ts").alias("price"))
    return got.orderBy(F.desc("dollar_volume"), "symbol").limit(n)
