"""Queries over joins, screens, labels, costs, risk, strategies and statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import costs, indicators as ind, text
from ..functions.rolling import r6 as sr6, sum_in_order
from ..operators import cv, joins, labels, portfolio, ranking, risk, series, statistics as stats, strategies
from ..operators import calendar as cal
from ..staging import stage
from .common import BASE, DAY, HOUR, PANEL, WEEK, bars_cte, daily, ew_cte, hourly, lines_cte, out, over, panel_base, prepared, rolled, weekly_lines
from .lake import EVENT_CAL, local_time
from .registry import register

_R = rolled

# --- joins and membership --------------------------------------------------------------------------------------

_SNAP = "snap AS (SELECT DISTINCT CAST(ts AS DATE) AS snapshot_date, user_id AS symbol FROM events)"


def _snapshots(spark, d):
    return prepared(spark).read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("snapshot_date"), F.col("user_id").alias("symbol")).distinct()


@register("asof_universe", f"""WITH {bars_cte(HOUR)}, q AS (SELECT symbol, ts FROM bars), d AS (SELECT symbol, ts, close FROM bars WHERE ts % 21600 = 0)
SELECT q.symbol, q.ts, d.ts AS asof_ts, round(d.close, 6) AS close FROM q ASOF LEFT JOIN d ON q.symbol = d.symbol AND q.ts >= d.ts""")
def asof_universe(spark, d):
    bars = hourly(spark, d)
    right = bars.where(F.pmod(F.unix_seconds("ts"), F.lit(21600)) == 0).select("symbol", "ts", "close")
    return out(joins.asof(bars.select("symbol", "ts"), right, ["symbol"], "ts", ["close"]))


@register("asof_index", f"""WITH {bars_cte(HOUR)}, e AS (SELECT event_type AS symbol, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events), n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS row_idx FROM bars)
SELECT e.event_id, n.row_idx FROM e ASOF LEFT JOIN n ON e.symbol = n.symbol AND e.ts >= n.ts""")
def asof_index(spark, d):
    bars = hourly(spark, d).withColumn("row_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("long"))
    left = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("ts"), "event_id")
    return out(joins.asof(left, bars, ["symbol"], "ts", ["row_idx"]), "event_id", "row_idx")


@register("delistings", f"""WITH {_SNAP}, days AS (SELECT DISTINCT snapshot_date FROM snap ORDER BY 1 DESC LIMIT 2)
SELECT symbol FROM snap WHERE snapshot_date = (SELECT min(snapshot_date) FROM days) AND (SELECT count(*) FROM days) = 2
EXCEPT SELECT symbol FROM snap WHERE snapshot_date = (SELECT max(snapshot_date) FROM days)""")
def delistings(spark, d):
    return joins.delisted(_snapshots(spark, d))


@register("semi_join_tradeable", f"WITH {bars_cte(DAY)} SELECT symbol, count(*) AS n FROM bars WHERE upper(symbol) IN ('CLICK', 'VIEW') GROUP BY 1")
def semi_join_tradeable(spark, d):
    names = prepared(spark).createDataFrame([("CL/ICK",), ("view",)], "symbol string")
    return joins.only_tradeable(daily(spark, d), names).groupBy("symbol").agg(F.count("*").alias("n"))


@register("anti_join_exits", """SELECT DISTINCT o_custkey AS symbol FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def anti_join_exits(spark, d):
    orders = prepared(spark).read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("symbol"), "o_orderpriority")
    held = orders.where("o_orderpriority = '1-URGENT'").select("symbol").distinct()
    return joins.exits(held, orders.where("o_orderpriority = '5-LOW'").select("symbol"))


@register("union_relaxed", """SELECT o_orderkey AS id, o_orderstatus AS status, NULL::BIGINT AS part FROM orders
UNION ALL SELECT l_orderkey, NULL, l_partkey FROM lineitem""")
def union_relaxed(spark, d):
    a = prepared(spark).read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@register("append_live_row", f"""WITH {bars_cte(DAY)}, l AS (SELECT symbol, max(ts) + 86400 AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1)
SELECT symbol, ts, round(close, 6) AS close FROM bars UNION ALL SELECT symbol, ts, round(CASE WHEN symbol = 'view' THEN 42.5 ELSE close END, 6) FROM l""")
def append_live_row(spark, d):
    bars = daily(spark, d).select("symbol", "ts", "close")
    live = spark.createDataFrame([("view", 42.5)], "symbol string, live double")
    last = bars.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close")).join(F.broadcast(live), "symbol", "left")
    fresh = last.select("symbol", F.timestamp_seconds(F.unix_seconds("ts") + DAY).alias("ts"), F.coalesce("live", "close").alias("close"))
    return out(bars.unionByName(fresh))


# --- screens, deduplication, aggregates -------------------------------------------------------------------------


@register("flag_screen", "SELECT p_partkey AS symbol, p_retailprice AS price FROM part WHERE p_type LIKE 'STANDARD%' AND p_size % 2 = 0 AND p_retailprice > 0 AND p_retailprice <= 1200")
def flag_screen(spark, d):
    part = prepared(spark).read.parquet(f"{d}/part.parquet")
    flags = part.where("p_type LIKE 'STANDARD%'").select(F.col("p_partkey").alias("symbol"), F.lit("us_equity").alias("asset_class"), F.lit(True).alias("tradable"), (F.col("p_size") % 2 == 0).alias("shortable"), F.lit(True).alias("easy_to_borrow"))
    prices = part.select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"))
    return risk.shortable(flags, prices, 1200.0).select("symbol", "price")


@register("liquidity_screen", """WITH q AS (SELECT o_orderkey AS symbol, CAST(o_custkey % 1500 AS DOUBLE) AS age_s, o_totalprice AS bid, o_totalprice * (1 + (o_orderkey % 50) / 10000.0::DOUBLE) AS ask FROM orders),
s AS (SELECT *, 10000 * (ask - bid) / ((bid + ask) / 2) AS spread FROM q)
SELECT symbol, round(spread, 4) AS spread_bps, (age_s <= 900 AND spread <= 30) AS tradeable, concat_ws('; ', CASE WHEN age_s > 900 THEN 'stale' END, CASE WHEN spread > 30 THEN 'wide' END) AS reason FROM s""")
def liquidity_screen(spark, d):
    orders = prepared(spark).read.parquet(f"{d}/orders.parquet")
    quotes = orders.select(F.col("o_orderkey").alias("symbol"), (F.col("o_custkey") % 1500).cast("double").alias("age_s"), F.col("o_totalprice").alias("bid"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 50) / 10000.0)).alias("ask"))
    return out(risk.liquidity(quotes), "symbol", "spread_bps", "tradeable", "reason", digits=4)


@register("dedup_keep_last", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_keep_last(spark, d):
    from ..sources.bars import keep_last

    events = prepared(spark).read.parquet(f"{d}/events.parquet")
    return keep_last(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@register("top_dollar_volume", f"""WITH {lines_cte(WEEK, 'p_brand')}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars)
SELECT symbol, round(avg(close * volume), 4) AS dollar_volume, round(arg_max(close, ts), 4) AS price FROM r WHERE k <= 5 GROUP BY 1 ORDER BY avg(close * volume) DESC, symbol LIMIT 10""")
def top_dollar_volume(spark, d):
    return out(risk.top_by_dollar_volume(weekly_lines(spark, d, "p_brand"), 10), "symbol", "dollar_volume", "price", digits=4)


@register("group_flags", "SELECT o_orderpriority AS class, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS active, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY 1")
def group_flags(spark, d):
    return prepared(spark).read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("active"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@register("upper_median", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(value, 6) AS median FROM r WHERE k = n // 2 + 1""")
def upper_median(spark, d):
    rows = prepared(spark).read.parquet(f"{d}/events.parquet").select("event_type", "value")
    return out(ranking.value_at_rank(rows, ["event_type"], "value", lambda n: F.floor(n / 2)).select("event_type", F.col("at").alias("median")))


@register("interp_percentiles", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS median FROM events GROUP BY 1")
def interp_percentiles(spark, d):
    rows = prepared(spark).read.parquet(f"{d}/events.parquet").select("event_type", "value")
    p95 = ranking.interpolated(rows, ["event_type"], "value", 0.95, "p95")
    return out(p95.join(ranking.interpolated(rows, ["event_type"], "value", 0.5, "median"), "event_type"))


@register("ols_slope", f"WITH {bars_cte(DAY)} SELECT symbol, round(coalesce(regr_slope(close, open), 0), 6) + 0.0 AS slope FROM bars GROUP BY 1")
def ols_slope(spark, d):
    return out(daily(spark, d).groupBy("symbol").agg(F.coalesce(F.regr_slope("close", "open"), F.lit(0.0)).alias("slope")))


_LAB = "lab AS (SELECT d.doc_id, d.lang, CAST(length(text) AS DOUBLE) AS x, CAST(quality AS DOUBLE) AS y FROM documents d JOIN labels USING (doc_id))"


def _labelled(spark, d):
    docs = prepared(spark).read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.length("text").cast("double").alias("x"))
    return docs.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")


@register("spearman_ic", f"""WITH {_LAB}, r AS (SELECT lang, x, y, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS ry FROM lab)
SELECT lang, count(*) AS n, round(CASE WHEN count(*) < 10 THEN 0 ELSE coalesce(corr(rx, ry), 0) END, 6) + 0.0 AS ic FROM r GROUP BY 1""")
def spearman_ic(spark, d):
    return out(cv.information_coefficient(_labelled(spark, d), "x", "y", ["lang"]), "lang", "n", "ic")


@register("auc_rank_sum", f"""WITH {_LAB}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx FROM lab),
s AS (SELECT lang, sum(CASE WHEN y = 1 THEN rx END) AS rs, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY 1)
SELECT lang, round(coalesce((rs - p * (p + 1) / 2) / nullif(p * q, 0), 0.5), 6) AS auc FROM s""")
def auc_rank_sum(spark, d):
    return out(cv.auc(_labelled(spark, d), "x", "y", ["lang"]), "lang", "auc")


@register("mode_share", "WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, round(max(n) / sum(n), 6) AS share FROM c GROUP BY 1")
def mode_share(spark, d):
    c = prepared(spark).read.parquet(f"{d}/events.parquet").groupBy("event_type", "user_id").count()
    return out(c.groupBy("event_type").agg((F.max("count") / F.sum("count")).alias("share")))


# --- labels and validation --------------------------------------------------------------------------------------

_PATH = f"""{bars_cte(HOUR)}, {BASE}, v AS (SELECT *, {_R('stddev_samp', 'r', 20)} AS vol, count(*) OVER (PARTITION BY symbol) AS n FROM base),
p AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS path FROM v),
t AS (SELECT *, coalesce(list_position(list_transform(path, lambda z: z >= close * (1 + 0.3 * vol)), true), 0) AS pt, coalesce(list_position(list_transform(path, lambda z: z <= close * (1 - 0.3 * vol)), true), 0) AS sl FROM p WHERE rn - 1 <= n - 25 AND vol IS NOT NULL),
l AS (SELECT *, CASE WHEN pt > 0 AND (sl = 0 OR pt <= sl) THEN 'pt' WHEN sl > 0 THEN 'sl' ELSE 'vertical' END AS barrier FROM t),
lab AS (SELECT *, CASE barrier WHEN 'pt' THEN pt WHEN 'sl' THEN sl ELSE 24 END AS touch FROM l),
done AS (SELECT *, path[touch] / close - 1 AS ret FROM lab)"""


def _events(spark, d):
    return ind.compute(hourly(spark, d), [ind.realized_vol(20)])


@register("triple_barrier", f"""WITH {_PATH} SELECT symbol, ts, barrier, CAST(touch AS INTEGER) AS touch, round(ret, 6) + 0.0 AS ret, CAST(CASE barrier WHEN 'pt' THEN 1 WHEN 'sl' THEN -1 ELSE 0 END AS INTEGER) AS label FROM done""")
def triple_barrier(spark, d):
    got = labels.triple_barrier(_events(spark, d), "vol_20", 0.3, 0.3, 24).where("vol_20 IS NOT NULL")
    return out(got, "symbol", "ts", "barrier", "touch", "ret", "label")


@register("meta_labels", f"""WITH {_PATH}, s AS (SELECT symbol, ts, ret * (CASE WHEN ts % 7200 = 0 THEN 1 ELSE -1 END) AS ret FROM done)
SELECT symbol, ts, round(ret, 6) + 0.0 AS ret, CAST(CASE WHEN ret > 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM s""")
def meta_labels(spark, d):
    rows = _events(spark, d).withColumn("side", F.when(F.pmod(F.unix_seconds("ts"), F.lit(7200)) == 0, 1.0).otherwise(-1.0))
    got = labels.triple_barrier(rows, "vol_20", 0.3, 0.3, 24, side="side").where("vol_20 IS NOT NULL")
    return out(got, "symbol", "ts", "ret", "label")


@register("panel_dataset", f"""WITH RECURSIVE {bars_cte(HOUR)}, {BASE}, {ew_cte()}, v AS (SELECT base.*, ew.vol AS ev, count(*) OVER (PARTITION BY symbol) AS n FROM base JOIN ew USING (symbol, rn)),
p AS (SELECT *, close / lag(close, 20) OVER {over()} - 1 AS mom, {_R('stddev_samp', 'r', 20)} AS vol20, (close - {_R('avg', 'close', 20)}) / nullif({_R('stddev_samp', 'close', 20)}, 0) AS z,
 list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS path, list(ts) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS times FROM v WHERE n >= 124),
t AS (SELECT *, coalesce(list_position(list_transform(path, lambda x: x >= close * (1 + 0.3 * ev)), true), 0) AS pt, coalesce(list_position(list_transform(path, lambda x: x <= close * (1 - 0.3 * ev)), true), 0) AS sl FROM p WHERE rn - 1 BETWEEN 90 AND n - 25 AND mom IS NOT NULL AND vol20 IS NOT NULL AND z IS NOT NULL),
l AS (SELECT *, pt > 0 AND (sl = 0 OR pt <= sl) AS up FROM t), k AS (SELECT *, CASE WHEN up THEN pt WHEN sl > 0 THEN sl ELSE 24 END AS touch FROM l),
i AS (SELECT *, times[touch] AS t1, row_number() OVER (ORDER BY ts, symbol) - 1 AS row_idx FROM k), e AS (SELECT ts, max(row_idx) AS last_idx FROM i GROUP BY 1)
SELECT i.row_idx, greatest(i.row_idx, coalesce(e.last_idx, i.row_idx)) AS t1_idx, symbol, i.ts, CAST(up AS INTEGER) AS y, round(path[touch] / close - 1, 6) + 0.0 AS ret, round(mom, 6) + 0.0 AS mom_20, round(vol20, 6) AS vol_20, round(z, 6) + 0.0 AS z_20 FROM i ASOF LEFT JOIN e ON i.t1 >= e.ts""")
def panel_dataset(spark, d):
    got = labels.panel_dataset(hourly(spark, d), [ind.momentum(20), ind.realized_vol(20), ind.zscore(20)], 24, 0.3, 0.3)
    return out(got, "row_idx", "t1_idx", "symbol", "ts", "y", "ret", "mom_20", "vol_20", "z_20")


_ROWS = f"""{bars_cte(HOUR)}, idx AS (SELECT row_number() OVER (ORDER BY ts, symbol) - 1 AS row_idx FROM bars), n AS (SELECT count(*) AS n FROM idx),
rows_ AS (SELECT row_idx, least(row_idx + 24, n - 1) AS t1_idx, n FROM idx, n),
folds AS (SELECT CAST(k AS INTEGER) AS fold, CAST(floor(n * k / 5.0) AS BIGINT) AS lo, CAST(floor(n * (k + 1) / 5.0) AS BIGINT) - 1 AS hi, CAST(floor(n * 0.01::DOUBLE) AS BIGINT) AS wait FROM n, range(5) t(k)),
roles AS (SELECT fold, row_idx, t1_idx, CASE WHEN row_idx BETWEEN lo AND hi THEN 'test' WHEN row_idx <= hi AND t1_idx >= lo THEN 'purged' WHEN row_idx > hi AND row_idx <= hi + wait THEN 'embargo' ELSE 'train' END AS role FROM rows_, folds)"""


def _roles(spark, d):
    bars = stage(hourly(spark, d).select("ts", "symbol"), "roles-bars")
    n = bars.count()
    rows = labels.global_index(bars, ["ts", "symbol"], "row_idx").select("row_idx")
    return cv.purged_roles(rows.withColumn("t1_idx", F.least(F.col("row_idx") + 24, F.lit(n - 1))), n=n)


@register("purged_kfold_roles", f"WITH {_ROWS} SELECT fold, row_idx, role FROM roles")
def purged_kfold_roles(spark, d):
    return _roles(spark, d).select("fold", "row_idx", "role")


@register("leakage_report", f"""WITH {_ROWS}, s AS (SELECT fold, count(*) FILTER (role <> 'test') AS naive_train, count(*) FILTER (role = 'train') AS purged_train, avg(t1_idx - row_idx) AS mean_span FROM roles GROUP BY 1)
SELECT fold, naive_train, purged_train, round(mean_span, 6) AS mean_span, round(1 - purged_train / naive_train, 6) + 0.0 AS dropped FROM s""")
def leakage_report(spark, d):
    return out(cv.leakage_report(_roles(spark, d)), "fold", "naive_train", "purged_train", "mean_span", "dropped")


@register("signal_net_returns", f"WITH {_PATH} SELECT symbol, ts, round(CASE WHEN vol > 0.8 THEN ret - 0.0064 ELSE 0 END, 6) + 0.0 AS net_ret FROM done")
def signal_net_returns(spark, d):
    got = labels.triple_barrier(_events(spark, d), "vol_20", 0.3, 0.3, 24).withColumn("oof", F.col("vol_20"))
    return out(labels.signal_returns(got, 0.8, 64.0), "symbol", "ts", "net_ret")


_ATR = f"{bars_cte(HOUR)}, {BASE}, a AS (SELECT symbol, ts, close, {_R('avg', 'tr', 14)} AS atr FROM base), s AS (SELECT symbol, ts, close, atr, max(close) OVER {over()} - 1.5 * atr AS stop FROM a WHERE atr IS NOT NULL)"


@register("trailing_stop", f"""WITH {_ATR.replace("max(close) OVER " + over() + " - 1.5 * atr AS stop", "symbol IN ('click', 'error') AS short, max(close) OVER " + over() + " AS hi, min(close) OVER " + over() + " AS lo")}
SELECT symbol, ts, round(CASE WHEN short THEN lo + 1.5 * atr ELSE hi - 1.5 * atr END, 6) + 0.0 AS stop_price, CASE WHEN short THEN close >= lo + 1.5 * atr ELSE close <= hi - 1.5 * atr END AS triggered FROM s""")
def trailing_stop(spark, d):
    rows = ind.compute(hourly(spark, d), [("atr", lambda w: ind.roll(F.avg, ind.true_range(w), 14, w))]).where("atr IS NOT NULL")
    got = labels.trailing_stop(rows.withColumn("is_short", F.col("symbol").isin("click", "error")), 1.5, "symbol")
    return out(got, "symbol", "ts", "stop_price", "triggered")


# --- costs, rules -----------------------------------------------------------------------------------------------

_VENUES = "venues(venue, asset, commission, half, slip, least_, regulated) AS (VALUES " + ", ".join(f"('{v[0]}', '{v[1]}', {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}::DOUBLE, {v[5]}::DOUBLE, {str(v[6]).lower()})" for v in costs.VENUES) + ")"


def _cost(n: str, q: str, sell: str, passive: str = "false") -> str:
    return f"""(greatest({n} * commission / 1e4, least_) + CASE WHEN {passive} THEN 0 ELSE {n} * (half + slip) / 1e4 END
+ CASE WHEN regulated AND {sell} THEN ceil(({n} * 27.8::DOUBLE / 1000000 + least({q} * 0.000166::DOUBLE, 8.3)) * 100) / 100 ELSE 0 END)"""


@register("fill_costs", f"""WITH {_VENUES}, f AS (SELECT o_orderkey, o_totalprice AS n, o_totalprice / 100 AS q, o_orderstatus = 'F' AS sell FROM orders)
SELECT o_orderkey, venue, round({_cost('n', 'q', 'sell')}, 8) AS cost FROM f, venues""")
def fill_costs(spark, d):
    fills = prepared(spark).read.parquet(f"{d}/orders.parquet")
    both = fills.join(F.broadcast(costs.venues(spark)))  # seven venues
    cost = costs.fill_cost(F.col("o_totalprice"), F.col("o_totalprice") / 100, F.col("o_orderstatus") == "F", F.lit(False))["total"]
    return both.select("o_orderkey", "venue", F.round(cost, 8).alias("cost"))


_RT = f"1e4 * ({_cost('500', '0', 'false')} + {_cost('500', '5', 'true')}) / 500"
_RTP = f"1e4 * ({_cost('500', '0', 'false', 'true')} + {_cost('500', '5', 'true', 'true')}) / 500"


@register("breakeven_table", f"WITH {_VENUES} SELECT venue, round({_RT}, 4) AS taker_bps, round({_RTP}, 4) AS maker_bps FROM venues")
def breakeven_table(spark, d):
    v = costs.venues(prepared(spark))
    return v.select("venue", F.round(costs.round_trip_bps(500.0), 4).alias("taker_bps"), F.round(costs.round_trip_bps(500.0, True), 4).alias("maker_bps"))


@register("feasibility_map", f"""WITH {_VENUES}, c AS (SELECT venue, asset, {_RT} AS rt, CASE WHEN asset = 'crypto' THEN 0.035::DOUBLE ELSE 0.018::DOUBLE END AS vol FROM venues),
h AS (SELECT *, (rt / (0.03 * vol * 1e4 * 1.75)) ** 2 AS be, (2 * rt / (0.03 * vol * 1e4 * 1.75)) ** 2 AS mh FROM c), y AS (SELECT *, (CASE WHEN asset = 'crypto' THEN 365 ELSE 252 END) / mh AS per FROM h)
SELECT venue, round(rt, 4) AS round_trip_bps, round(be, 4) AS breakeven_hold_days, round(mh, 4) AS min_hold_days, round(per, 4) AS trades_per_year, round(100 / per, 4) AS years_to_100_trades, (mh < 60 AND per >= 25) AS viable FROM y""")
def feasibility_map(spark, d):
    v = costs.venues(prepared(spark)).withColumn("daily_vol", F.when(F.col("asset") == "crypto", 0.035).otherwise(0.018))
    return out(costs.feasibility(v), "venue", "round_trip_bps", "breakeven_hold_days", "min_hold_days", "trades_per_year", "years_to_100_trades", "viable", digits=4)


@register("holding_policy_checks", """SELECT event_id, (1735689600 - CAST(floor(epoch(ts)) AS BIGINT)) / 86400.0::DOUBLE >= 48.5::DOUBLE AS allowed, round(greatest(48.5::DOUBLE - (1735689600 - CAST(floor(epoch(ts)) AS BIGINT)) / 86400.0::DOUBLE, 0), 6) AS days_remaining FROM events""")
def holding_policy_checks(spark, d):
    rows = prepared(spark).read.parquet(f"{d}/events.parquet")
    check = costs.hold_check(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.lit(1735689600)), F.lit(48.5))
    return out(rows.select("event_id", check["allowed"].alias("allowed"), check["days_remaining"].alias("days_remaining")))


_WEEKDAYS = "days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"


@register("day_trades_5d", f"""WITH {EVENT_CAL}, f AS (SELECT user_id AS account, CAST({local_time('ts')} AS DATE) AS day, json_extract_string(props, '$.k') AS symbol, event_type = 'purchase' AS buy FROM events),
p AS (SELECT account, day, symbol, CAST(bool_or(buy) AND bool_or(NOT buy) AS INTEGER) AS r, count(*) AS n FROM f GROUP BY 1, 2, 3),
g AS (SELECT account, day, sum(r) AS r, sum(n) AS n FROM p GROUP BY 1, 2), o AS (SELECT g.*, td_ordinal FROM g JOIN cal USING (day))
SELECT account, strftime(day, '%Y-%m-%d') AS day, CAST(r AS BIGINT) AS day_trades, CAST(n AS BIGINT) AS fills, CAST(sum(r) OVER w AS BIGINT) AS day_trades_5d, CAST(sum(n) OVER w AS BIGINT) AS fills_5d FROM o WINDOW w AS (PARTITION BY account ORDER BY td_ordinal RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def day_trades_5d(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet")
    day, _ = cal.market_minute(F.col("ts").cast("timestamp"))
    fills = events.select(F.col("user_id").alias("account"), day.alias("day"), F.get_json_object("props", "$.k").alias("symbol"), F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"), F.lit("equity").alias("asset_class"))
    got = risk.day_trades(fills, cal.calendar(spark, date(2023, 1, 1), date(2026, 12, 31)))
    return out(got, "account", "day", "day_trades", "fills", "day_trades_5d", "fills_5d")


_MARKS = f"""{bars_cte(HOUR)}, m AS (SELECT symbol AS account, ts, 400 + close AS equity FROM bars)"""


def _marks(spark, d):
    return hourly(spark, d).select(F.col("symbol").alias("account"), "ts", (400 + F.col("close")).alias("equity"))


@register("kill_switch", f"""WITH {_MARKS}, k AS (SELECT *, greatest(500, max(equity) OVER (PARTITION BY account ORDER BY ts)) AS peak, first_value(equity) OVER (PARTITION BY account, ts // 86400 ORDER BY ts) AS start_ FROM m),
x AS (SELECT account, ts, (equity - peak) / peak AS dd, (equity - start_) / start_ AS pnl FROM k)
SELECT account, ts, round(dd, 6) + 0.0 AS drawdown, round(pnl, 6) + 0.0 AS daily_pnl, bool_or(dd <= -0.2 OR pnl <= -0.05) OVER (PARTITION BY account ORDER BY ts) AS halted FROM x""")
def kill_switch(spark, d):
    return out(risk.kill_switch(_marks(spark, d)), "account", "ts", "drawdown", "daily_pnl", "halted")


@register("equity_guard", f"""WITH {_MARKS}, k AS (SELECT *, greatest(500, max(equity) OVER (PARTITION BY account ORDER BY ts)) AS peak FROM m), x AS (SELECT account, ts, abs((equity - peak) / peak) AS dd FROM k)
SELECT account, ts, round(dd, 6) AS drawdown, CASE WHEN dd >= 0.15 THEN 0.0::DOUBLE WHEN dd >= 0.1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM x""")
def equity_guard(spark, d):
    return out(risk.equity_guard(_marks(spark, d)), "account", "ts", "drawdown", "scale")


@register("order_risk_check", """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag = 'R' AS sell, l_quantity AS qty, l_extendedprice / l_quantity / 100 AS price, l_discount * 1000 AS pos, l_tax * 5000 AS gross, CAST(l_linenumber * 5 AS INTEGER) AS trades,
  CASE WHEN l_linestatus = 'O' THEN l_quantity / 2 ELSE 0 END AS cur, l_tax * 2000 AS shorted, l_suppkey % 2 = 0 AS allowed, l_linenumber = 6 AS halted FROM lineitem),
a AS (SELECT *, qty * price AS n, 125 - pos AS room1, 500 - gross AS room2, least(qty, greatest(0, cur)) AS closing FROM o), b AS (SELECT *, least(n, room1) AS v1, qty - closing AS rest, 50.0 AS short1, 150 - shorted AS short2 FROM a),
c AS (SELECT *, least(v1, room2) AS v2, (halted OR trades >= 25 OR n < 1 OR (n > room1 AND room1 < 1) OR (v1 > room2 AND room2 < 1)) AS no, least(rest * price, short1) AS s1 FROM b),
e AS (SELECT *, CASE WHEN NOT allowed OR halted OR (s1 > short2 AND short2 < 1) THEN 0 ELSE least(s1, short2) / price END AS opened FROM c),
f AS (SELECT *, CASE WHEN NOT sell THEN CASE WHEN no THEN 0 WHEN n <= room1 AND v1 <= room2 THEN qty ELSE v2 / price END WHEN rest <= 1e-12 THEN qty ELSE closing + opened END AS q FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN sell THEN q > 0 OR rest <= 1e-12 ELSE NOT no END AS approved, round(q, 6) AS approved_qty FROM f""")
def order_risk_check(spark, d):
    """Buys and sales; sales close a position or open a short, where shorts are allowed; some accounts are halted."""
    c = F.col
    line = prepared(spark).read.parquet(f"{d}/lineitem.parquet")
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = line.select(
        *names, F.when(c("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), c("l_quantity").alias("qty"),
        (c("l_extendedprice") / c("l_quantity") / 100).alias("price"), F.lit(500.0).alias("equity"), (c("l_discount") * 1000).alias("position_value"),
        (c("l_tax") * 5000).alias("gross_exposure"), F.when(c("l_linestatus") == "O", c("l_quantity") / 2).otherwise(0.0).alias("current_qty"),
        (c("l_tax") * 2000).alias("gross_short"), (c("l_suppkey") % 2 == 0).alias("allow_short"), (c("l_linenumber") == 6).alias("halted"),
        (c("l_linenumber") * 5).alias("trades_today"),
    )
    return out(risk.check_orders(orders), *names, "approved", "approved_qty")


@register("twap_slices", """WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS n FROM orders), s AS (SELECT *, CASE WHEN n < 30 THEN 1 ELSE 3 END AS k FROM o)
SELECT o_orderkey, CAST(i AS INTEGER) AS slice, round(n / k, 2) AS slice_notional FROM s, range(1, 4) t(i) WHERE i <= k""")
def twap_slices(spark, d):
    orders = prepared(spark).read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("notional"))
    return risk.twap_slices(orders).select("o_orderkey", "slice", "slice_notional")


_POLICY = f"""c AS (SELECT venue, asset, {_RT} AS rt, CASE WHEN asset = 'crypto' THEN 0.035::DOUBLE ELSE 0.018::DOUBLE END AS vol FROM venues),
h AS (SELECT venue, asset, CASE WHEN asset = 'crypto' THEN (2 * rt / (0.03 * vol * 1e4 * 1.75)) ** 2 ELSE greatest(5.0, (2 * rt / (0.03 * vol * 1e4 * 1.75)) ** 2) END AS mh FROM c)"""


@register("holding_policy", f"WITH {_VENUES}, {_POLICY}, y AS (SELECT *, 4 * (CASE WHEN asset = 'crypto' THEN 365 ELSE 252 END) / mh AS per FROM h) SELECT venue, round(mh, 4) AS min_hold_days, round(per, 4) AS trades_per_year, round(100 / per, 4) AS years_to_target FROM y")
def holding_policy(spark, d):
    v = costs.venues(prepared(spark)).withColumn("daily_vol", F.when(F.col("asset") == "crypto", 0.035).otherwise(0.018))
    return out(costs.holding_policy(v, symbols=4), "venue", "min_hold_days", "trades_per_year", "years_to_target", digits=4)


@register("exit_checks", """WITH e AS (SELECT event_id, event_type, epoch(ts) // 1 AS s FROM events), x AS (SELECT *, CASE WHEN event_type = 'view' THEN 5.0 ELSE 20.5 END AS least_, (1706745600 - CAST(floor(s) AS BIGINT)) / 86400.0::DOUBLE AS held FROM e)
SELECT event_id, held >= least_ AS allowed, CAST(round(greatest(least_ - held, 0) * 86400) AS BIGINT) AS seconds_remaining, CASE WHEN held >= least_ THEN '' ELSE printf('%s is held for some days to earn its costs, %d hours are left', event_type, CAST(ceil(greatest(least_ - held, 0) * 24 - 1e-9) AS BIGINT)) END AS reason FROM x""")
def exit_checks(spark, d):
    rows = prepared(spark).read.parquet(f"{d}/events.parquet")
    least = F.when(F.col("event_type") == "view", 5.0).otherwise(20.5)
    check = costs.exit_check(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.lit(1706745600)), least, F.col("event_type"))
    return rows.select("event_id", check["allowed"].alias("allowed"), F.round(check["days_remaining"] * 86400).cast("long").alias("seconds_remaining"), check["reason"].alias("reason"))


@register("spread_stress", f"WITH {_VENUES.replace('venues(venue, asset, commission, half,', 'given(venue, asset, commission, half0,')}, venues AS (SELECT *, 40.0::DOUBLE AS half FROM given), adv AS (SELECT *, 500 * (10 - half) / 1e4 AS earned FROM venues) SELECT venue, round({_RT}, 4) AS taker_bps, round({_RTP} + 1e4 * 2 * earned / 500, 4) AS maker_bps FROM adv")
def spread_stress(spark, d):
    """All venues at a half spread of 40 basis points, of which adverse selection takes 10 back."""
    v = costs.with_spread(costs.venues(prepared(spark)), 40.0).withColumn("adverse_selection_bps", F.lit(10.0))
    return v.select("venue", F.round(costs.round_trip_bps(500.0), 4).alias("taker_bps"), F.round(costs.round_trip_bps(500.0, True), 4).alias("maker_bps"))


@register("capacity_text", """WITH c AS (SELECT DISTINCT c_mktsegment AS seg, c_nationkey % 3 AS k FROM customer)
SELECT seg, k, CASE WHEN seg = 'BUILDING' THEN 'no limit but cost: settlement is instant, at all hours' WHEN k = 0 THEN '3 day trades in five business days, by the broker''s own rule' WHEN seg = 'MACHINERY' THEN 'no cap on day trades, about one round trip of the whole balance a day: sales settle on the next day' ELSE 'no cap on day trades; below 2,000 dollars a margin account settles like cash' END AS capacity FROM c""")
def capacity_text(spark, d):
    rows = prepared(spark).read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") % 3).alias("k")).distinct()
    asset = F.when(F.col("seg") == "BUILDING", "crypto").otherwise("equity")
    account = F.when(F.col("seg") == "MACHINERY", "cash").otherwise("margin")
    return rows.select("seg", "k", costs.capacity_text(account, asset, F.when(F.col("k") == 0, 3)).alias("capacity"))


@register("can_short", "SELECT p_partkey AS symbol, p_size % 2 = 0 AND p_type LIKE '%A%' AND p_retailprice > 0 AND p_retailprice <= 1200 AS can_short FROM part")
def can_short(spark, d):
    part = prepared(spark).read.parquet(f"{d}/part.parquet")
    rows = part.select(F.col("p_partkey").alias("symbol"), (F.col("p_size") % 2 == 0).alias("shortable"), F.col("p_type").like("%A%").alias("easy_to_borrow"), F.col("p_retailprice").alias("price"))
    return rows.select("symbol", risk.can_short(F.lit(1200.0)).alias("can_short"))


@register("day_trade_status", """WITH t AS (SELECT user_id AS account, CAST(ts AS DATE) AS day, count(*) % 6 AS n FROM events GROUP BY 1, 2)
SELECT account, strftime(day, '%Y-%m-%d') AS day, n >= 3 AS restricted, CAST(greatest(0, 3 - n) AS BIGINT) AS remaining FROM t""")
def day_trade_status(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet")
    counted = events.groupBy(F.col("user_id").alias("account"), F.to_date("ts").alias("day")).agg((F.count("*") % 6).alias("day_trades_5d"))
    return out(risk.day_trade_status(counted, 3), "account", "day", "restricted", "remaining")


@register("kill_switch_resets", f"""WITH {_MARKS}, k AS (SELECT *, greatest(500, max(equity) OVER (PARTITION BY account ORDER BY ts)) AS peak, first_value(equity) OVER (PARTITION BY account, ts // 86400 ORDER BY ts) AS start_ FROM m),
x AS (SELECT account, ts, (equity - peak) / peak <= -0.2 OR (equity - start_) / start_ <= -0.05 AS breach FROM k), r AS (SELECT account, ts FROM m WHERE ts % 604800 = 0),
h AS (SELECT x.*, (SELECT max(b.ts) FROM x b WHERE b.account = x.account AND b.ts <= x.ts AND b.breach) AS tripped, (SELECT max(r.ts) FROM r WHERE r.account = x.account AND r.ts < x.ts) AS lifted FROM x)
SELECT account, ts, coalesce(tripped > coalesce(lifted, 0), false) AS halted, row_number() OVER (PARTITION BY account, ts // 86400 ORDER BY ts) AS trades_today FROM h""")
def kill_switch_resets(spark, d):
    marks = _marks(spark, d).withColumn("trades", F.lit(1))
    resets = marks.where("unix_seconds(ts) % 604800 = 0").select("account", "ts", F.lit("checked by hand").alias("note"))
    return out(risk.kill_switch_with_resets(marks, resets), "account", "ts", "halted", "trades_today")


# --- simulation -------------------------------------------------------------------------------------------------


def _curve(spark, d):
    panel = stage(joins.aligned_panel(daily(spark, d)), "curve-panel")
    targets = ranking.executed_next(ranking.top_n(ranking.momentum_scores(panel, 5, 1), 2), panel)
    return portfolio.shadow_books(portfolio.orders_from_targets(panel, targets), hold_days=2.0)


@register("shadow_book")
def shadow_book(spark, d):
    return out(_curve(spark, d))


@register("shadow_book_stats")
def shadow_book_stats(spark, d):
    return out(portfolio.book_stats(_curve(spark, d)))


@register("runner_stats")
def runner_stats(spark, d):
    got = portfolio.cross_sectional(hourly(spark, d), lookback=60, top=2, every=20, warmup=60)
    return out(got["stats"].withColumn("rebalances", F.lit(got["rebalances"]).cast("long")))


@register("runner_targets", f"""WITH {bars_cte(HOUR)}, {PANEL}, times AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, lead(ts) OVER (ORDER BY ts) AS exec_ts FROM (SELECT DISTINCT ts FROM panel)),
s AS (SELECT symbol, ts, close / lag(close, 60) OVER {over()} - 1 AS score FROM panel), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS rank FROM s WHERE score IS NOT NULL)
SELECT symbol, ts, exec_ts, CAST(rank AS INTEGER) AS rank FROM k JOIN times USING (ts) WHERE rank <= 2 AND i >= 60 AND (i - 60) % 20 = 0 AND exec_ts IS NOT NULL""")
def runner_targets(spark, d):
    """What the runner decides every 20 bars after its warm-up, with the bar at which it takes effect."""
    panel = stage(joins.aligned_panel(hourly(spark, d)), "runner-panel")
    return out(portfolio.decisions(panel, 60, 0, 2, 20, 60), "symbol", "ts", "exec_ts", "rank")


_CASH = f"""{EVENT_CAL}, nx AS (SELECT c.day, (SELECT min(o.day) FROM cal o WHERE o.is_trading_day AND o.day > c.day) AS settles FROM cal c WHERE c.day BETWEEN DATE '2023-12-01' AND DATE '2024-03-01'),
f AS (SELECT CAST(user_id AS VARCHAR) AS account, event_id AS seq, CAST(ts AS DATE) AS day, event_type = 'purchase' AS buy, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT f.*, settles FROM f JOIN nx USING (day)),
r(account, k, seq, buy, cash, due, qty, until, strikes, ok, bad) AS (
  SELECT DISTINCT account, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(500 AS DOUBLE), CAST([] AS STRUCT(d DATE, a DOUBLE)[]), CAST(0 AS DOUBLE), CAST(NULL AS DATE), 0, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN) FROM f
  UNION ALL SELECT account, k, seq, buy, CASE WHEN buy AND ok THEN greatest(0, c1 - v) ELSE c1 END, CASE WHEN buy THEN d1 ELSE list_append(d1, {{'d': settles, 'a': v}}) END,
    CASE WHEN buy AND ok THEN 1 WHEN buy THEN qty ELSE greatest(qty - 1, 0) END,
    CASE WHEN buy AND ok THEN CASE WHEN v > c1 AND len(d1) > 0 THEN s[coalesce(list_filter(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: x.a)) >= v - c1)[1], len(s))].d END WHEN buy THEN until WHEN qty > 1 THEN until END,
    strikes + CAST(NOT buy AND qty > 0 AND until IS NOT NULL AND day < until AS INTEGER), ok, coalesce(NOT buy AND qty > 0 AND until IS NOT NULL AND day < until, false)
  FROM (SELECT *, list_sort(d1) AS s, NOT buy OR v - c1 <= coalesce(list_sum(list_transform(d1, lambda x: x.a)), 0) + 1e-9 AS ok FROM (
    SELECT g.account, g.k, g.seq, g.buy, g.v, g.day, g.settles, r.qty, r.until, r.strikes, r.cash + coalesce(list_sum(list_transform(list_filter(r.due, lambda x: x.d <= g.day), lambda x: x.a)), 0) AS c1, list_filter(r.due, lambda x: x.d > g.day) AS d1 FROM r JOIN g ON g.account = r.account AND g.k = r.k + 1)))"""


@register("cash_settlement", f"""WITH RECURSIVE {_CASH} SELECT account, seq, 'S' AS symbol, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS side, ok AS accepted, bad AS violation, round(cash, 6) AS settled_cash, round(coalesce(list_sum(list_transform(due, lambda x: x.a)), 0), 6) AS unsettled_cash, strikes >= 3 AS restricted FROM r WHERE k > 0""")
def cash_settlement(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet")
    days = events.select(F.to_date("ts").alias("day")).distinct()
    settles = cal.with_next_previous(days, cal.calendar(spark, date(2023, 1, 1), date(2026, 12, 31))).select("day", F.col("next_day").alias("settles"))
    fills = events.select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), F.lit("S").alias("symbol"), F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"), F.lit(1.0).alias("qty"), F.col("value").alias("price"))
    return out(portfolio.cash_settlement(fills.join(F.broadcast(settles), "day")))


@register("rebalance_plan", """WITH p AS (SELECT o_custkey AS account, o_orderpriority AS symbol, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY v DESC, symbol) AS k FROM p),
h AS (SELECT account, symbol, k, CASE WHEN k > 2 THEN floor(v) % 100 ELSE floor(v) % 300 END AS mv FROM k), a AS (SELECT account, greatest(0, 500 - sum(mv)) AS room, max(CASE WHEN k = 1 THEN mv END) AS h1 FROM h GROUP BY 1),
b AS (SELECT *, 250 - h1 AS g1, least(250 - h1, room) AS v1 FROM a), c AS (SELECT account, room - CASE WHEN g1 >= 25 AND v1 >= 62.5 THEN round(v1, 2) ELSE 0 END AS room2 FROM b),
w AS (SELECT h.account, symbol, mv, 250 - mv AS gap, least(250 - mv, CASE WHEN k = 1 THEN room ELSE room2 END) AS v FROM h JOIN a USING (account) JOIN c USING (account) WHERE k <= 2),
x AS (SELECT *, CASE WHEN gap < 25 THEN 'hold' WHEN v < 62.5 THEN 'blocked' ELSE 'buy' END AS action FROM w)
SELECT CAST(account AS VARCHAR) AS account, symbol, CASE WHEN k = 4 THEN 'blocked' ELSE 'sell' END AS action, mv AS current, 0.0::DOUBLE AS target, CASE WHEN k = 4 THEN 0.0 ELSE mv END AS value FROM h WHERE k > 2 AND mv > 0
UNION ALL SELECT CAST(account AS VARCHAR), symbol, action, mv, 250.0, CASE WHEN action = 'buy' THEN round(v, 2) ELSE 0 END FROM x""")
def rebalance_plan(spark, d):
    orders = prepared(spark).read.parquet(f"{d}/orders.parquet")
    rows = orders.select(F.col("o_custkey").cast("string").alias("account"), F.col("o_orderpriority").alias("symbol"), "o_orderkey", F.col("o_totalprice").alias("_v"))
    # floor() below turns the last digit of a sum into a whole unit, so the order of adding is that of the orders
    per = sum_in_order(rows, ["account", "symbol"], ["o_orderkey", "_v"], "_v")
    ranked = per.withColumn("_k", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("_v"), "symbol")))
    held = F.when(F.col("_k") > 2, F.floor("_v") % 100).otherwise(F.floor("_v") % 300).cast("double")
    rows = ranked.select("account", "symbol", F.when(F.col("_k") <= 2, F.col("_k")).alias("rank"), held.alias("market_value"), (F.col("_k") == 4).alias("locked"))
    return out(portfolio.rebalance_plan(rows, 500.0, 2))


@register("tweaker_path", """WITH t AS (SELECT event_type AS strategy, event_id AS seq, value - 50 AS pnl, value / 20 AS fees FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY seq) AS k, coalesce(sum(CASE WHEN pnl > 0 THEN pnl END) OVER r, 0) AS gross, sum(fees) OVER r AS f, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) OVER r AS rate FROM t WINDOW r AS (PARTITION BY strategy ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
s AS (SELECT strategy, seq, count(*) FILTER (k >= 3 AND gross > 0 AND f / gross > 0.2) OVER u AS a, count(*) FILTER (k >= 3 AND rate >= 0.65) OVER u AS b, count(*) FILTER (k >= 3 AND rate < 0.4) OVER u AS c FROM w WINDOW u AS (PARTITION BY strategy ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT strategy, seq, round(least(2.0::DOUBLE, 1.3::DOUBLE + 0.1::DOUBLE * a), 6) AS volume_threshold, round(least(0.05::DOUBLE, 0.02::DOUBLE + 0.003::DOUBLE * b), 6) AS take_profit_pct, round(greatest(0.008::DOUBLE, 0.012::DOUBLE - 0.002::DOUBLE * c), 6) AS stop_loss_pct, greatest(12.0::DOUBLE, 24.0::DOUBLE - 2.0::DOUBLE * c) AS max_hold_hours FROM s""")
def tweaker_path(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet")
    trades = events.select(F.col("event_type").alias("strategy"), F.col("event_id").alias("seq"), (F.col("value") - 50).alias("net_pnl"), (F.col("value") / 20).alias("fees"))
    return out(portfolio.tweaker_path(trades))


@register("mark_to_market", """WITH p AS (SELECT o_orderkey AS symbol, CAST(o_custkey % 7 - 3 AS DOUBLE) AS qty, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice / 100 END AS entry, o_totalprice / 50 AS mv, o_totalprice / 1000 - 100 AS pl, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS since FROM orders),
l AS (SELECT l_orderkey AS symbol, avg(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), m AS (SELECT p.*, price, price IS NOT NULL AND entry <> 0 AS live, (epoch(TIMESTAMP '2001-08-02') - epoch(since)) / 86400.0::DOUBLE AS held FROM p LEFT JOIN l USING (symbol)),
v AS (SELECT *, CASE WHEN live THEN abs(qty) * price ELSE abs(mv) END AS value, CASE WHEN live THEN (price - entry) * qty ELSE pl END AS unrealised FROM m)
SELECT symbol, live AS live_mark, round(value, 6) AS value, round(unrealised, 6) + 0.0 AS unrealised, round(coalesce(unrealised / nullif(value, 0), 0), 6) + 0.0 AS pct, coalesce(held >= 48.5, true) AS unlocked FROM v""")
def mark_to_market(spark, d):
    orders = prepared(spark).read.parquet(f"{d}/orders.parquet")
    positions = orders.select(F.col("o_orderkey").alias("symbol"), (F.col("o_custkey") % 7 - 3).cast("double").alias("qty"), F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice") / 100).alias("avg_entry_price"), (F.col("o_totalprice") / 50).alias("market_value"), (F.col("o_totalprice") / 1000 - 100).alias("unrealized_pl"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate").cast("timestamp")).alias("entry_time"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'N'")
    prices = lines.groupBy(F.col("l_orderkey").alias("symbol")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    got = portfolio.mark_to_market(positions, prices, F.lit("2001-08-02").cast("timestamp"), 48.5)
    return out(got, "symbol", "live_mark", "value", "unrealised", "pct", "unlocked")


# --- strategies -------------------------------------------------------------------------------------------------

_W20 = over(20)
_SQ = f"""sq AS (SELECT *, {_R('avg', 'close', 20)} AS ma, {_R('stddev_pop', 'close', 20)} AS sd,
 list(high) OVER {_W20} AS hs, list(low) OVER {_W20} AS ls, list(close) OVER {_W20} AS cs FROM base),
sx AS (SELECT *, CASE WHEN rn >= 20 THEN list_avg(list_transform(range(1, 21), lambda i: greatest(hs[i] - ls[i], abs(hs[i] - cs[greatest(i - 1, 1)])))) END AS atr2 FROM sq)"""
_ANN = f"(stddev_pop(sr) OVER {over(167)} * sqrt(8760.0::DOUBLE))"


@register("vol_squeeze", f"""WITH {bars_cte(HOUR)}, {BASE}, {_SQ}, w AS (SELECT *, {_ANN} AS ann, volume / ({_R('avg', 'volume', 20)} + 1e-12) AS rv FROM sx)
SELECT symbol, ts, round(CASE WHEN rn >= 50 AND 4 * sd / (ma + 1e-12) < 3 * atr2 / (ma + 1e-12) AND close > ma + 2 * sd AND rv >= 1.2 THEN 0.5 * least(1, 0.3 / greatest(1e-4, ann)) ELSE 0 END, 6) AS weight FROM w""")
def vol_squeeze(spark, d):
    return out(strategies.vol_squeeze(hourly(spark, d)), "symbol", "ts", "weight")


_RAT = [rolled(a, "ratio", 100, 0, "1", "ts") for a in ("avg", "stddev_pop")]


@register("pair_spread", f"""WITH {bars_cte(HOUR)}, q AS (SELECT a.ts, a.close / (b.close + 1e-12) AS ratio FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'),
z AS (SELECT ts, ratio, (ratio - {_RAT[0]}) / ({_RAT[1]} + 1e-12) AS z FROM q)
SELECT ts, round(ratio, 6) AS ratio, round(z, 6) + 0.0 AS z, CASE WHEN z < -1.5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS first_weight, CASE WHEN z > 1.5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS second_weight FROM z""")
def pair_spread(spark, d):
    return out(strategies.pair_spread(hourly(spark, d), "click", "view"))


@register("trend_vol_target", f"""WITH {bars_cte(HOUR)}, {BASE}, t AS (SELECT symbol, ts, close, {_R('avg', 'close', 20)} AS sma, {_ANN} AS ann FROM base WHERE symbol IN ('click', 'purchase', 'view'))
SELECT symbol, ts, round(CASE WHEN close > sma THEN least(1, 0.2 / greatest(1e-4, ann)) / 3 ELSE 0 END, 6) AS weight FROM t""")
def trend_vol_target(spark, d):
    return out(strategies.trend_vol_target(hourly(spark, d), ["click", "purchase", "view"]), "symbol", "ts", "weight")


@register("regime_route", f"""WITH {bars_cte(HOUR)}, {panel_base()}, {_SQ}, g AS (SELECT ts, min(rn) AS rn, coalesce(bool_or(4 * sd / (ma + 1e-12) < 3 * atr2 / (ma + 1e-12)), false) AS q, avg(abs(close / (ma + 1e-12) - 1)) AS dev FROM sx GROUP BY 1),
r AS (SELECT *, CASE WHEN rn < 30 THEN 'trend' WHEN q THEN 'squeeze' WHEN dev >= 0.02 THEN 'trend' ELSE 'rangebound' END AS regime FROM g)
SELECT ts, round(dev, 6) AS deviation, regime, CASE regime WHEN 'squeeze' THEN 0.85::DOUBLE WHEN 'trend' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM r""")
def regime_route(spark, d):
    return out(strategies.regime(joins.aligned_panel(hourly(spark, d))), "ts", "deviation", "regime", "confidence")


@register("quick_move", f"""WITH {bars_cte(HOUR)}, x AS (SELECT *, {_R('max', 'high', 23, 1)} AS hi, {_R('min', 'low', 23, 1)} AS lo, volume / ({_R('avg', 'volume', 23, 1)} + 1e-12) AS rv FROM bars),
a AS (SELECT *, CASE WHEN close > hi AND rv >= 1.3 THEN 1 WHEN close < lo AND rv >= 1.3 THEN -1 END AS s FROM x)
SELECT symbol, ts, CASE s WHEN 1 THEN 'BUY' ELSE 'SELL' END AS action, s * 0.4::DOUBLE AS weight, round(close * (1 + s * 0.02), 6) AS take_profit, round(close * (1 - s * 0.012), 6) AS stop_loss FROM a WHERE s IS NOT NULL""")
def quick_move(spark, d):
    return out(strategies.quick_move(hourly(spark, d)), "symbol", "ts", "action", "weight", "take_profit", "stop_loss")


_G = "CASE WHEN close - c1 > 0 THEN close - c1 WHEN c1 IS NOT NULL THEN 0 END"
_L = "CASE WHEN close - c1 < 0 THEN c1 - close WHEN c1 IS NOT NULL THEN 0 END"


@register("percent_b_reversion", f"""WITH {bars_cte(HOUR)}, {BASE}, {_SQ}, u AS (SELECT *, {_R('avg', f'({_G})', 14)} AS up, {_R('avg', f'({_L})', 14)} AS down FROM sx),
y AS (SELECT *, (close - (ma - 2 * sd)) / (4 * sd + 1e-12) AS pb, CASE WHEN up IS NULL THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS st FROM u),
a AS (SELECT *, CASE WHEN pb < 0.05 AND st < 35 THEN 1 WHEN pb > 0.95 AND st > 65 THEN -1 END AS s FROM y)
SELECT symbol, ts, CASE s WHEN 1 THEN 'BUY' ELSE 'SELL' END AS action, s * 0.33::DOUBLE AS weight, round(ma, 6) AS target_price, round(close - s * 1.5 * atr2, 6) + 0.0 AS stop_loss FROM a WHERE s IS NOT NULL""")
def percent_b_reversion(spark, d):
    return out(strategies.percent_b_reversion(hourly(spark, d)), "symbol", "ts", "action", "weight", "target_price", "stop_loss")


_K = {n: 1 - 2 / (n + 1) for n in (9, 12, 21, 26)}
_MEAN = {n: f"({{x}} * {1 - k!r} / (1 - pow({k!r}, {{m}})))" for n, k in _K.items()}
_MACD = f"({_MEAN[12].format(x=f'(b.close + {_K[12]!r} * e.s12)', m='b.rn')} - {_MEAN[26].format(x=f'(b.close + {_K[26]!r} * e.s26)', m='b.rn')})"
_EMAS = f"""em(symbol, rn, s9, s21, s12, s26, macd, sm) AS (SELECT symbol, rn, close, close, close, close, 0.0::DOUBLE, 0.0::DOUBLE FROM base WHERE rn = 1
  UNION ALL SELECT b.symbol, b.rn, b.close + {_K[9]!r} * e.s9, b.close + {_K[21]!r} * e.s21, b.close + {_K[12]!r} * e.s12, b.close + {_K[26]!r} * e.s26, {_MACD}, CASE WHEN b.rn >= 26 THEN {_MACD} ELSE 0 END + {_K[9]!r} * e.sm FROM em e JOIN base b ON b.symbol = e.symbol AND b.rn = e.rn + 1),
ind AS (SELECT b.*, CASE WHEN rn >= 9 THEN {_MEAN[9].format(x='s9', m='rn')} END AS e9, CASE WHEN rn >= 21 THEN {_MEAN[21].format(x='s21', m='rn')} END AS e21, CASE WHEN rn >= 34 THEN macd - {_MEAN[9].format(x='sm', m='(rn - 25)')} END AS hist FROM base b JOIN em USING (symbol, rn)),
ru AS (SELECT *, CASE WHEN close - c1 > 0 THEN close - c1 ELSE 0 END AS gain, CASE WHEN close - c1 < 0 THEN c1 - close ELSE 0 END AS loss FROM ind),
rs AS (SELECT *, 100 - 100 / (1 + {_R('avg', 'gain', 14)} / ({_R('avg', 'loss', 14)} + 1e-12)) AS rsi, {_R('avg', 'volume', 20)} AS vm FROM ru)"""


@register("composite_rule", f"""WITH RECURSIVE {bars_cte(HOUR)}, {BASE}, {_EMAS}
SELECT symbol, ts, round(e9, 6) AS ema_9, round(e21, 6) AS ema_21, round(hist, 6) + 0.0 AS macd_hist, CASE WHEN hist IS NOT NULL AND vm IS NOT NULL AND e9 > e21 AND rsi > 40 AND rsi < 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM rs""")
def composite_rule(spark, d):
    rows = labels.macd_histogram(labels.ema(labels.ema(ind.compute(hourly(spark, d), [ind.rsi(14)]), 9), 21))
    rows = rows.withColumn("vol_ma_20", ind.roll(F.avg, F.col("volume"), 20, Window.partitionBy("symbol").orderBy("ts")))
    return out(strategies.composite_rule(rows), "symbol", "ts", "ema_9", "ema_21", "macd_hist", "weight")


@register("regime_dispatch", f"""WITH {bars_cte(HOUR)}, {panel_base()}, {_SQ}, g AS (SELECT ts, min(rn) AS rn, coalesce(bool_or(4 * sd / (ma + 1e-12) < 3 * atr2 / (ma + 1e-12)), false) AS q, avg(abs(close / (ma + 1e-12) - 1)) AS dev FROM sx GROUP BY 1),
rg AS (SELECT ts, CASE WHEN rn < 30 THEN 'trend' WHEN q THEN 'squeeze' WHEN dev >= 0.02 THEN 'trend' ELSE 'rangebound' END AS regime FROM g),
w AS (SELECT *, {_ANN} AS ann, volume / ({_R('avg', 'volume', 20)} + 1e-12) AS rv, {_R('avg', 'close', 20)} AS sma FROM sx),
q AS (SELECT a.ts, a.close / (b.close + 1e-12) AS ratio FROM panel a JOIN panel b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'), z AS (SELECT ts, (ratio - {_RAT[0]}) / ({_RAT[1]} + 1e-12) AS z FROM q),
every AS (SELECT ts, symbol, 'squeeze' AS r, CASE WHEN rn >= 50 AND 4 * sd / (ma + 1e-12) < 3 * atr2 / (ma + 1e-12) AND close > ma + 2 * sd AND rv >= 1.2 THEN 0.5 * least(1, 0.3 / greatest(1e-4, ann)) ELSE 0 END AS weight FROM w
 UNION ALL SELECT ts, symbol, 'trend', CASE WHEN close > sma THEN least(1, 0.2 / greatest(1e-4, ann)) / 2 ELSE 0 END FROM w WHERE symbol IN ('click', 'purchase')
 UNION ALL SELECT ts, 'click', 'rangebound', CASE WHEN z < -1.5 THEN 0.5 ELSE 0 END FROM z UNION ALL SELECT ts, 'view', 'rangebound', CASE WHEN z > 1.5 THEN 0.5 ELSE 0 END FROM z)
SELECT e.ts, symbol, regime, CASE regime WHEN 'squeeze' THEN 0.85::DOUBLE WHEN 'trend' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence, round(CAST(weight AS DOUBLE), 6) AS weight FROM every e JOIN rg ON rg.ts = e.ts AND rg.regime = e.r""")
def regime_dispatch(spark, d):
    panel = stage(joins.aligned_panel(hourly(spark, d)), "regime-panel")
    return out(strategies.routed(panel, ["click", "purchase"], ("click", "view")), "ts", "symbol", "regime", "confidence", "weight")


# --- statistics -------------------------------------------------------------------------------------------------

_RET = f"""{lines_cte(WEEK, 'p_type')}, full_ AS (SELECT ts FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)),
al AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 2 AS t FROM bars WHERE ts IN (SELECT ts FROM full_)),
m AS (SELECT symbol AS strategy, t, ret FROM al WHERE ret IS NOT NULL)"""


def _matrix(spark, d):
    panel = joins.aligned_panel(stage(weekly_lines(spark, d).select("symbol", "ts", "close"), "matrix-bars"))
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = panel.select(F.col("symbol").alias("strategy"), (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret"), (F.row_number().over(w) - 2).cast("long").alias("t"))
    return rows.where("ret IS NOT NULL")


_SHARPE = "CASE WHEN count(ret) < 2 THEN 0 ELSE coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) END"


@register("sharpe_by_strategy", f"WITH {_RET} SELECT strategy, round({_SHARPE}, 6) + 0.0 AS sharpe FROM m GROUP BY 1")
def sharpe_by_strategy(spark, d):
    return out(_matrix(spark, d).groupBy("strategy").agg(stats.sharpe(F.col("ret")).alias("sharpe")))


_MOM = f"""{_RET}, c AS (SELECT strategy, avg(ret) AS mu, stddev_samp(ret) AS sd, count(*) AS n FROM m GROUP BY 1),
mo AS (SELECT strategy, any_value(n) AS n, any_value(mu / sd) AS sharpe, avg(((ret - mu) / sd) ** 3) AS skew, avg(((ret - mu) / sd) ** 4) AS kurt FROM m JOIN c USING (strategy) GROUP BY 1)"""


@register("sharpe_moments", f"WITH {_MOM} SELECT strategy, n, round(sharpe, 6) + 0.0 AS sharpe, round(skew, 6) + 0.0 AS skew, round(kurt, 6) AS kurt FROM mo")
def sharpe_moments(spark, d):
    return out(stats.moments(_matrix(spark, d), ["strategy"]), "strategy", "n", "sharpe", "skew", "kurt")


@register("psr_statistic", f"WITH {_MOM} SELECT strategy, round(sharpe * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12)), 6) + 0.0 AS z FROM mo")
def psr_statistic(spark, d):
    return out(stats.moments(_matrix(spark, d), ["strategy"]).select("strategy", stats.psr_statistic().alias("z")))


_PHI = "(exp(-z * z / 2) / sqrt(2 * pi()) * (" + " + ".join(f"{c}::DOUBLE * pow(1 / (1 + 0.2316419::DOUBLE * abs(z)), {k})" for k, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1)) + "))"


@register("psr_probability", f"WITH {_MOM}, q AS (SELECT strategy, sharpe * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12)) AS z FROM mo) SELECT strategy, round(CASE WHEN z >= 0 THEN 1 - {_PHI} ELSE {_PHI} END, 6) AS psr FROM q")
def psr_probability(spark, d):
    return out(stats.moments(_matrix(spark, d), ["strategy"]).select("strategy", stats.phi(stats.psr_statistic()).alias("psr")))


_PBO = f"""{_RET}, tt AS (SELECT (max(t) + 1) // 16 AS size FROM m), cn AS (SELECT strategy, avg(ret) AS c FROM m GROUP BY 1),
k AS (SELECT strategy, c, t // size AS block, count(*) AS n, sum(ret - c) AS s, sum((ret - c) * (ret - c)) AS q FROM m JOIN cn USING (strategy), tt WHERE t < 16 * size GROUP BY 1, 2, 3),
al2 AS (SELECT strategy, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM k GROUP BY 1),
halves AS (SELECT mask, row_number() OVER (ORDER BY mask DESC) - 1 AS i FROM (SELECT unnest(range(65536)) AS mask) WHERE bit_count(mask::INTEGER) = 8),
sp AS (SELECT mask FROM halves WHERE i IN (SELECT j * 12870 // 5000 FROM range(5000) x(j))),
ins AS (SELECT mask, strategy, c, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM k, sp WHERE (mask >> (15 - block::INTEGER)) & 1 = 1 GROUP BY 1, 2, 3),
both_ AS (SELECT mask, i.strategy, c, i.n AS n1, i.s AS s1, i.q AS q1, a.n - i.n AS n2, a.s - i.s AS s2, a.q - i.q AS q2 FROM ins i JOIN al2 a USING (strategy)),
p AS (SELECT mask, strategy, coalesce((c + s1 / n1) / sqrt(nullif(greatest((q1 - s1 * s1 / n1) / (n1 - 1), 0), 0)), 0) AS is_sr, coalesce((c + s2 / n2) / sqrt(nullif(greatest((q2 - s2 * s2 / n2) / (n2 - 1), 0), 0)), 0) AS oos_sr FROM both_),
best AS (SELECT mask, strategy AS best, is_sr, oos_sr AS oos FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY is_sr DESC, strategy) AS k FROM p) WHERE k = 1),
r AS (SELECT b.mask, best, b.is_sr, oos, count(*) FILTER (p.oos_sr <= oos) / (count(*) + 1) AS rank FROM best b JOIN p USING (mask) GROUP BY 1, 2, 3, 4)"""


@register("pbo_cscv", f"WITH {_PBO} SELECT best, round(is_sr, 6) + 0.0 AS is_sr, round(oos, 6) + 0.0 AS oos_sr, round(rank, 6) AS rank FROM r")
def pbo_cscv(spark, d):
    return out(stats.pbo(_matrix(spark, d)), "best", "is_sr", "oos_sr", "rank")


@register("pbo_summary", f"""WITH {_PBO} SELECT count(*) AS splits, round(avg(CASE WHEN ln(rank / (1 - rank)) <= 0 THEN 1.0 ELSE 0 END), 6) AS pbo, round(coalesce(regr_slope(oos, is_sr), 0), 6) + 0.0 AS slope,
round(avg(CASE WHEN oos <= 0 THEN 1.0 ELSE 0 END), 6) AS loss_probability, round(median(oos), 6) + 0.0 AS median_oos, round((SELECT max(n) FROM (SELECT count(*) AS n FROM r GROUP BY best)) / count(*), 6) AS stability FROM r""")
def pbo_summary(spark, d):
    return out(stats.pbo_summary(stage(stats.pbo(_matrix(spark, d)), "pbo-splits")))


@register("pairwise_corr", f"WITH {_RET} SELECT a.strategy AS a, b.strategy AS b, round(corr(a.ret, b.ret), 6) + 0.0 AS corr FROM m a JOIN m b ON a.t = b.t AND a.strategy < b.strategy GROUP BY 1, 2")
def pairwise_corr(spark, d):
    return out(stats.pairwise_correlation(_matrix(spark, d)))


@register("mean_pairwise_corr", f"WITH {_RET}, c AS (SELECT corr(a.ret, b.ret) AS c FROM m a JOIN m b ON a.t = b.t AND a.strategy < b.strategy GROUP BY a.strategy, b.strategy) SELECT round(avg(c), 6) + 0.0 AS mean_corr FROM c")
def mean_pairwise_corr(spark, d):
    return out(stats.mean_pairwise_correlation(_matrix(spark, d)))


_LEDGER = """tr AS (SELECT CAST(user_id AS VARCHAR) AS variant_id, avg(value - 50) / nullif(stddev_samp(value), 0) AS sharpe, count(*) AS n_observations, CASE WHEN user_id % 10 = 0 THEN 'hypothesis' WHEN user_id % 7 = 0 THEN 'observation' ELSE 'variant' END AS kind FROM events GROUP BY user_id HAVING count(*) > 1)"""


@register("ledger_metrics", f"""WITH {_LEDGER}, v AS (SELECT * FROM tr WHERE kind = 'variant')
SELECT (SELECT count(*) FROM tr) AS n_trials, (SELECT count(*) FROM v) AS n_variants, (SELECT count(*) FROM tr WHERE kind = 'observation') AS n_observations_kind, (SELECT count(*) FROM tr WHERE kind = 'hypothesis') AS n_hypotheses,
round(CASE WHEN (SELECT count(*) FROM v) < 10 THEN (SELECT 1.0 / max(n_observations) FROM v) ELSE (SELECT var_samp(sharpe) FROM v) END, 6) AS sharpe_variance, (SELECT arg_max(variant_id, sharpe) FROM v) AS best_variant, (SELECT round(max(sharpe), 6) FROM v) AS best_sharpe""")
def ledger_metrics(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet")
    u = F.col("user_id")
    trials = events.groupBy("user_id").agg(F.try_divide(F.avg(F.col("value") - 50), F.nullif(F.stddev_samp("value"), F.lit(0.0))).alias("sharpe"), F.count("*").alias("n_observations")).where("n_observations > 1")
    trials = trials.select(u.cast("string").alias("variant_id"), "sharpe", "n_observations", F.when(u % 10 == 0, "hypothesis").when(u % 7 == 0, "observation").otherwise("variant").alias("kind"))
    return out(stats.ledger_metrics(trials))


_ONE = f"{_RET}, one AS (SELECT t, avg(ret) AS ret FROM m GROUP BY 1), n AS (SELECT count(*) AS n FROM one)"


def _mean_series(spark, d):
    """The equal-weight return of all strategies, and its length."""
    one = stage(_matrix(spark, d).groupBy("t").agg(F.avg("ret").alias("ret")), "mean-series")
    return one, one.count()


@register("block_bootstrap_indexed", f"""WITH {_ONE},
st AS (SELECT s AS sample_id, b AS block, (s * 37 + b * 11) % n AS start FROM n, range(3) a(s), range(8) c(b)), p AS (SELECT sample_id, block * 5 + j AS i, (start + j) % n AS t FROM st, n, range(5) x(j))
SELECT sample_id, i, t, round(ret, 6) + 0.0 AS ret FROM p JOIN one USING (t)""")
def block_bootstrap_indexed(spark, d):
    one, n = _mean_series(spark, d)
    if not n:
        return out(one.select(F.lit(0).cast("long").alias("sample_id"), F.col("t").alias("i"), "t", "ret"))
    starts = spark.range(24).select(F.expr("id div 8").alias("sample_id"), (F.col("id") % 8).alias("block")).withColumn("start", (F.col("sample_id") * 37 + F.col("block") * 11) % n)
    return out(stats.block_bootstrap(one, starts, 5, n, 40))


@register("null_verdict", f"""WITH {_ONE}, l AS (SELECT n, CASE WHEN n < 20 THEN greatest(1, n // 2) ELSE CAST(least(greatest(1, round(pow(n, 1 / 3.0::DOUBLE))), greatest(2, n // 10)) AS BIGINT) END AS l FROM n),
st AS (SELECT s, b, (s * 37 + b * 101) % n AS start, n, l FROM l, range(50) a(s), range(1000) c(b) WHERE b * l < n), p AS (SELECT s, b * l + j AS i, (start + j) % n AS t FROM st, range(100) x(j) WHERE j < l AND b * l + j < n),
c AS (SELECT s, ret - (SELECT avg(ret) FROM one) AS ret FROM p JOIN one USING (t)), sr AS (SELECT s, {_SHARPE} AS sr FROM c GROUP BY 1)
SELECT round(max(sr), 6) + 0.0 AS best, round(quantile_cont(sr, 0.95), 6) + 0.0 AS p95, round(median(sr), 6) + 0.0 AS median, round(avg(CASE WHEN sr >= 0.1 THEN 1.0 ELSE 0 END), 6) AS p_value, 0.1 > max(sr) AS beats_best FROM sr""")
def null_verdict(spark, d):
    one, n = _mean_series(spark, d)
    length = stats.block_size(n, 0.0)
    blocks = -(-n // length)
    starts = spark.range(50).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))).alias("block"))
    starts = starts.withColumn("start", (F.col("sample_id") * 37 + F.col("block") * 101) % max(n, 1))
    return out(stats.null_verdict(stats.null_cohort(one, 50, length, n, starts=starts), 0.1))


# --- text -------------------------------------------------------------------------------------------------------

_UP, _DOWN = ["the", "and", "of"], ["is", "la", "der"]


@register("lexicon_polarity", f"""WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\s+'), lambda x: lower(trim(x, '.,!?"''()'))) AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS p, len(list_filter(w, lambda x: x IN ('is', 'la', 'der'))) AS q FROM w)
SELECT doc_id, round(coalesce((p - q) / nullif(p + q, 0), 0), 6) + 0.0 AS polarity FROM c""")
def lexicon_polarity(spark, d):
    docs = prepared(spark).read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", sr6(text.polarity(F.col("text"), _UP, _DOWN)).alias("polarity"))


@register("news_surge_flag", """WITH n AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, count(*) AS c, avg(value) AS v FROM events GROUP BY 1, 2), a AS (SELECT *, avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM n)
SELECT symbol, strftime(date, '%Y-%m-%d') AS date, round(c / greatest(1, m), 6) AS surge, CASE WHEN v > 30 THEN 'HIGH_VOL_SPIKE' WHEN v > 22 THEN 'ELEVATED_RISK' ELSE 'LOW_VOL' END AS flag FROM a""")
def news_surge_flag(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet")
    n = events.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(F.count("*").alias("c"), F.avg("value").alias("v"))
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-5, -1)
    return out(n.withColumns({"surge": text.news_surge(F.col("c"), F.avg("c").over(w)), "flag": text.volatility_flag(F.col("v"))}), "symbol", "date", "surge", "flag")


@register("feed_delay_verdict", """WITH a AS (SELECT user_id, count(*) AS n, min((SELECT max(epoch(ts)) FROM events) - epoch(ts)) AS age FROM events GROUP BY 1)
SELECT user_id, n, CASE WHEN n < 20 THEN 'inconclusive' WHEN age <= 120 THEN 'real-time' WHEN age <= 1200 THEN 'upper bound' ELSE 'delayed' END AS verdict FROM a""")
def feed_delay_verdict(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    now = events.agg(F.max("s").alias("_now"))
    ages = events.join(F.broadcast(now)).groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.col("_now") - F.col("s")).alias("_age"))
    return ages.select("user_id", "n", text.feed_verdict(F.col("n"), F.col("_age")).alias("verdict"))


@register("canonical_symbol", """WITH s AS (SELECT DISTINCT upper(event_type) || q AS s FROM events, (VALUES ('/USD'), ('/USDT'), ('/BTC')) t(q))
SELECT s AS symbol, replace(s, '/', '') AS canonical, s AS with_slash FROM s""")
def canonical_symbol(spark, d):
    names = prepared(spark).read.parquet(f"{d}/events.parquet").select(F.upper("event_type").alias("e")).distinct()
    rows = names.select("e", F.explode(F.array(F.lit("/USD"), F.lit("/USDT"), F.lit("/BTC"))).alias("q"))
    rows = rows.select(F.concat("e", "q").alias("symbol"))
    return rows.select("symbol", joins.canonical(F.col("symbol")).alias("canonical")).withColumn("with_slash", joins.with_slash(F.col("canonical")))


@register("boosted_trees_oof")
def boosted_trees_oof(spark, d):
    """The default features and folds; 100 of the 300 default rounds, see the README."""
    got = stage(labels.panel_dataset(hourly(spark, d), ind.DEFAULT, 24, 0.3, 0.3), "boosted-panel")
    fitted = cv.train_boosted_trees(got, ind.feature_names(), rounds=100)
    if fitted is None:
        return got.select("row_idx", F.lit(0).alias("fold"), "y", F.lit(0.5).alias("oof")).limit(0)
    return out(fitted, "row_idx", "fold", "y", "oof")
