"""Queries over bars: derivation, upsert, ranges, coverage, gaps, calendar."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import gaps
from ..sources.bars import BarLake, coverage, keep_last, with_min_bars
from ..sources.drops import backfill, ingest, refresh
from ..sources.stores import SelectedUniverse
from ..staging import scratch_path
from .common import calendar_cte, DAY, HOUR, WEEK, bars_cte, daily, hourly, lines_cte, out, prepared, r6, weekly_lines
from .registry import register

_BAR_SQL = ", ".join(r6(c, c) for c in ("open", "high", "low", "close", "volume"))
_BAR = ("symbol", "ts", "open", "high", "low", "close", "volume", "trade_count")


@register("bars_from_events", f"WITH {bars_cte(HOUR)} SELECT symbol, ts, {_BAR_SQL}, trade_count FROM bars")
def bars_from_events(spark, d):
    return out(hourly(spark, d), *_BAR)


@register("bars_from_lineitem", f"WITH {lines_cte(WEEK)} SELECT symbol, ts, {_BAR_SQL}, trade_count FROM bars")
def bars_from_lineitem(spark, d):
    return out(weekly_lines(spark, d), *_BAR)


@register("bar_upsert_keep_last", f"""WITH {bars_cte(DAY)}
SELECT symbol, ts, round(CASE WHEN ts % (2 * {DAY}) = 0 THEN close * 2 ELSE close END, 6) AS close FROM bars""")
def bar_upsert_keep_last(spark, d):
    old = daily(spark, d).withColumn("_seq", F.lit(0))
    late = old.where(F.pmod(F.unix_seconds("ts"), F.lit(2 * DAY)) == 0).withColumn("close", F.col("close") * 2).withColumn("_seq", F.lit(1))
    return out(keep_last(old.unionByName(late), ["symbol", "ts"], "_seq"), "symbol", "ts", "close")


@register("bar_range_read", f"""WITH {bars_cte(HOUR)} SELECT symbol, ts, round(close, 6) AS close FROM bars
WHERE symbol IN ('purchase', 'click') AND ts >= (SELECT min(ts) FROM bars) + 86400 AND ts <= (SELECT min(ts) FROM bars) + 864000""")
def bar_range_read(spark, d):
    bars = hourly(spark, d)
    first = bars.agg(F.min("ts")).first()[0]
    if first is None:
        return out(bars.limit(0), "symbol", "ts", "close")
    s = F.unix_seconds("ts") - F.unix_seconds(F.lit(first))
    return out(bars.where(F.col("symbol").isin("purchase", "click") & s.between(86400, 864000)), "symbol", "ts", "close")


@register("bar_coverage", f"WITH {bars_cte(HOUR)} SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1")
def bar_coverage(spark, d):
    return out(coverage(hourly(spark, d)))


@register("symbol_row_counts", f"WITH {bars_cte(DAY)} SELECT symbol, count(*) AS n FROM bars GROUP BY 1")
def symbol_row_counts(spark, d):
    return daily(spark, d).groupBy("symbol").agg(F.count("*").alias("n"))


@register("universe_min_bars", f"""WITH {lines_cte(WEEK, 'p_brand')}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM bars)
SELECT symbol, count(*) AS bars FROM n WHERE c >= 300 GROUP BY 1""")
def universe_min_bars(spark, d):
    return with_min_bars(weekly_lines(spark, d, "p_brand"), 300).groupBy("symbol").agg(F.count("*").alias("bars"))


_GRID = f"""{bars_cte(HOUR)}, spans AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1),
grid AS (SELECT symbol, unnest(generate_series(a, b, 3600)) AS ts FROM spans)"""


def _grid(spark, d):
    bars = hourly(spark, d)
    return bars, gaps.continuous_grid(coverage(bars), HOUR)


@register("expected_grid_24x7", f"WITH {_GRID} SELECT symbol, ts FROM grid")
def expected_grid_24x7(spark, d):
    return out(_grid(spark, d)[1])


@register("missing_bars", f"WITH {_GRID} SELECT g.symbol, g.ts FROM grid g ANTI JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts")
def missing_bars(spark, d):
    bars, grid = _grid(spark, d)
    return out(gaps.missing(grid, bars))


_COMPLETE = f"""{_GRID}, complete AS (SELECT g.symbol, count(*) AS expected, count(b.ts) AS present, count(b.ts) / count(*) AS completeness
FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts GROUP BY 1)"""


@register("completeness", f"WITH {_COMPLETE} SELECT symbol, expected, present, round(completeness, 6) AS completeness FROM complete")
def completeness(spark, d):
    bars, grid = _grid(spark, d)
    return out(gaps.completeness(grid, bars))


@register("data_health", f"""WITH {_COMPLETE}, h AS (SELECT c.*, (1735689600 - b) / 86400.0 AS stale_days FROM complete c JOIN spans USING (symbol))
SELECT symbol, round(completeness, 6) AS completeness, round(CAST(stale_days AS DOUBLE), 6) AS stale_days, (completeness < 0.95 OR stale_days > 3) AS warn FROM h""")
def data_health(spark, d):
    bars, grid = _grid(spark, d)
    now = F.timestamp_seconds(F.lit(1735689600))
    return out(gaps.health(gaps.completeness(grid, bars), coverage(bars), now), "symbol", "completeness", "stale_days", "warn")


_FIRST, _LAST = date(1991, 12, 1), date(2002, 1, 31)
_CAL = calendar_cte(str(_FIRST), str(_LAST))

_DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


def _order_days(spark, d):
    return prepared(spark).read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct()


@register("trading_calendar", f"WITH {_CAL}, {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, is_trading_day, close_minute FROM days JOIN cal USING (day)")
def trading_calendar(spark, d):
    return out(_order_days(spark, d).join(F.broadcast(cal.calendar(spark, _FIRST, _LAST)), "day"), "day", "is_trading_day", "close_minute")


@register("next_prev_trading_day", f"""WITH {_CAL}, {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day,
strftime((SELECT min(c.day) FROM cal c WHERE c.is_trading_day AND c.day > days.day), '%Y-%m-%d') AS next_day,
strftime((SELECT max(c.day) FROM cal c WHERE c.is_trading_day AND c.day < days.day), '%Y-%m-%d') AS previous_day FROM days""")
def next_prev_trading_day(spark, d):
    return out(cal.with_next_previous(_order_days(spark, d), cal.calendar(spark, _FIRST, _LAST)), "day", "next_day", "previous_day")


@register("settlement_dates", f"""WITH {_CAL}, {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day,
strftime((SELECT min(c.day) FROM cal c WHERE c.is_trading_day AND c.day > days.day), '%Y-%m-%d') AS settles FROM days""")
def settlement_dates(spark, d):
    met = cal.with_next_previous(_order_days(spark, d), cal.calendar(spark, _FIRST, _LAST))
    return out(met.withColumnRenamed("next_day", "settles"), "day", "settles")


_EVENT_FIRST, _EVENT_LAST = date(2023, 1, 1), date(2026, 12, 31)
EVENT_CAL = calendar_cte(str(_EVENT_FIRST), str(_EVENT_LAST))


def local_time(ts: str) -> str:
    """New York time of a UTC timestamp by the rule of the second Sunday of March and the first of November."""
    sunday = lambda month: f"(make_date(year({ts}), {month}, 1) + CAST((7 - dayofweek(make_date(year({ts}), {month}, 1))) % 7 AS INTEGER))"
    summer = f"{ts} >= {sunday(3)} + INTERVAL 7 DAY + INTERVAL 7 HOUR AND {ts} < {sunday(11)} + INTERVAL 6 HOUR"
    return f"(CASE WHEN {summer} THEN {ts} - INTERVAL 4 HOUR ELSE {ts} - INTERVAL 5 HOUR END)"


@register("market_open_flag", f"""WITH {EVENT_CAL}, e AS (SELECT event_id, {local_time('ts')} AS l FROM events),
m AS (SELECT event_id, CAST(l AS DATE) AS day, hour(l) * 60 + minute(l) AS mi FROM e)
SELECT event_id, coalesce(is_trading_day AND mi >= 570 AND mi < close_minute, false) AS is_open, coalesce(is_trading_day AND mi >= 240 AND mi < 1200, false) AS is_extended FROM m LEFT JOIN cal USING (day)""")
def market_open_flag(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    flagged = cal.with_market_open(events, cal.calendar(spark, _EVENT_FIRST, _EVENT_LAST))
    return flagged.select("event_id", "is_open", "is_extended")


@register("expected_grid_sessions", f"""WITH {EVENT_CAL}, span AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events),
u AS (SELECT CAST(a AS TIMESTAMP) + INTERVAL 1 HOUR * k AS h FROM span, range(100000) t(k) WHERE k < (date_diff('day', a, b) + 2) * 24),
h AS (SELECT h + INTERVAL 30 MINUTE AS ts FROM u), l AS (SELECT ts, {local_time('ts')} AS l FROM h)
SELECT CAST(epoch(ts) AS BIGINT) AS ts FROM l JOIN cal ON cal.day = CAST(l AS DATE), span WHERE is_trading_day AND cal.day BETWEEN a AND b AND hour(l) * 60 + minute(l) >= 570 AND hour(l) * 60 + minute(l) < close_minute""")
def expected_grid_sessions(spark, d):
    spark = prepared(spark)
    span = spark.read.parquet(f"{d}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    first, last = (x.date() if isinstance(x, datetime) else _EVENT_FIRST for x in span)
    return out(cal.session_grid(cal.calendar(spark, first, last), HOUR))


# --- sources as file drops ----------------------------------------------------------------------------------------


def _lake(spark):
    return BarLake(prepared(spark), scratch_path(spark, "lake"))


@register("lake_backfill", f"""WITH {_GRID} SELECT g.symbol, count(*) AS expected, count(b.ts) AS present, round(sum(b.close), 4) AS closes
FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts GROUP BY 1""")
def lake_backfill(spark, d):
    """A lake that lacks every third bar is filled up from the source; then the grid is held against it."""
    lake, bars = _lake(spark), hourly(spark, d)
    lake.write(bars.where(F.pmod(F.unix_seconds("ts"), F.lit(3 * HOUR)) != 0), "1h", "crypto")
    span = coverage(bars).agg(F.min("first_ts"), F.max("last_ts")).first()
    if span[0] is not None:
        backfill(lake, bars, bars.select("symbol"), "1h", span[0], span[1], "crypto")
    stored = lake.stored("crypto", "1h")
    grid = gaps.continuous_grid(coverage(stored), HOUR)
    met = grid.join(stored.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    return out(met.groupBy("symbol").agg(F.count("*").alias("expected"), F.count("close").alias("present"), F.sum("close").alias("closes")), digits=4)


@register("lake_refresh", f"""WITH {bars_cte(DAY)}, old AS (SELECT symbol, max(ts) AS last_ts FROM bars WHERE ts < 1705536000 AND symbol <> 'view' GROUP BY 1),
new AS (SELECT b.* FROM bars b LEFT JOIN old USING (symbol) WHERE b.ts <= 1706054400 AND (last_ts IS NULL OR b.ts >= last_ts - 3 * {DAY}))
SELECT symbol, count(*) AS bars, max(ts) AS last_ts, round(sum(volume), 4) AS volume FROM (SELECT symbol, ts, volume FROM bars WHERE ts < 1705536000 AND symbol <> 'view' UNION SELECT symbol, ts, volume FROM new) GROUP BY 1""")
def lake_refresh(spark, d):
    """Bars of the first weeks, one symbol left out, refreshed to a later day."""
    lake, bars = _lake(spark), daily(spark, d)
    lake.write(bars.where("unix_seconds(ts) < 1705536000 AND symbol <> 'view'"), "1d", "crypto")
    refresh(lake, bars, bars.select("symbol"), "1d", datetime(2024, 1, 24))
    got = lake.stored("crypto", "1d").groupBy("symbol").agg(F.count("*").alias("bars"), F.max("ts").alias("last_ts"), F.sum("volume").alias("volume"))
    return out(got, digits=4)


@register("ingest_failures", f"""WITH {bars_cte(DAY)}, j AS (SELECT symbol, count(*) FILTER (close > 2 * open) AS bad FROM bars GROUP BY 1)
SELECT symbol, CASE WHEN bad > 0 THEN bad || ' unusable bars' END AS reason FROM j UNION ALL SELECT 'nothing', 'no bars'""")
def ingest_failures(spark, d):
    """Bars of which some have a high below their low; one symbol has none at all."""
    bars = daily(spark, d).withColumn("high", F.when(F.col("close") > 2 * F.col("open"), F.col("low") - 1).otherwise(F.col("high")))
    names = bars.select("symbol").distinct()
    failed = ingest(_lake(spark), bars, names.unionByName(spark.createDataFrame([("nothing",)], "symbol string")), "1d")["failed"]
    return names.join(failed, "symbol", "full").select("symbol", "reason")


@register("health_report", f"""WITH {bars_cte(DAY)}, g AS (SELECT symbol, 1706745600 - {DAY} * k AS ts FROM (SELECT DISTINCT symbol FROM bars), range(121) t(k)),
c AS (SELECT g.symbol, count(b.ts) / count(*) AS completeness FROM g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts GROUP BY 1),
l AS (SELECT symbol, (1706745600 - max(ts)) / 86400.0 AS stale_days FROM bars GROUP BY 1)
SELECT symbol, round(completeness, 6) AS completeness, round(CAST(stale_days AS DOUBLE), 6) AS stale_days, (completeness < 0.95 OR stale_days > 3) AS warn, round((SELECT avg(completeness) FROM c), 6) AS mean_completeness FROM c JOIN l USING (symbol)""")
def health_report(spark, d):
    return out(gaps.health_report(daily(spark, d), datetime(2024, 2, 1)), "symbol", "completeness", "stale_days", "warn", "mean_completeness")


@register("session_window", f"""WITH {_CAL}, {_DAYS}, t AS (SELECT day, CAST(day AS TIMESTAMP) + INTERVAL 570 MINUTE AS a, CAST(day AS TIMESTAMP) + INTERVAL 960 MINUTE AS b FROM days)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime((a AT TIME ZONE 'America/New_York') AT TIME ZONE 'Asia/Tokyo', '%H:%M') AS opens, strftime((b AT TIME ZONE 'America/New_York') AT TIME ZONE 'Asia/Tokyo', '%H:%M') AS closes FROM t""")
def session_window(spark, d):
    return out(cal.with_session_window(_order_days(spark, d), 570, 960, "Asia/Tokyo"), "day", "opens", "closes")


@register("selected_universe_asof", """WITH e AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, avg(value) AS price, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-04' AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 2),
s AS (SELECT * FROM e WHERE day IN (DATE '2024-01-01', DATE '2024-01-03')), q AS (SELECT CAST(unnest(['2024-01-01', '2024-01-02', '2024-01-03', '2024-01-09']) AS DATE) AS d)
SELECT strftime(q.d, '%Y-%m-%d') AS as_of, symbol, round(price, 6) AS price FROM q JOIN s ON s.day = (SELECT max(s2.day) FROM s s2 WHERE s2.day <= q.d)""")
def selected_universe_asof(spark, d):
    events = prepared(spark).read.parquet(f"{d}/events.parquet").withColumn("day", F.to_date("ts"))
    store = SelectedUniverse(spark, scratch_path(spark, "universe"))
    for day in (date(2024, 1, 1), date(2024, 1, 3)):
        per = events.where(F.col("day") == F.lit(day)).groupBy(F.col("event_type").alias("symbol")).agg(F.avg("value").alias("price"))
        store.save(per.selectExpr("symbol", "price", "price AS dollar_volume", "true AS shortable", "true AS easy_to_borrow", "true AS fractionable"), day)
    got = None
    for day in (date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 9)):
        part = store.asof(day).select(F.lit(str(day)).alias("as_of"), "symbol", "price")
        got = part if got is None else got.unionByName(part)
    return out(got)
