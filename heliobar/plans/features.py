"""Queries over indicators, series and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import joins, labels, portfolio, ranking, series
from .common import BASE, DAY, HOUR, PANEL, bars_cte, daily, ew_cte, hourly, out, over, panel_base, prepared, r6, rolled
from .registry import register

_LIN = "b2 AS (SELECT *, (high + low + close) / 3 * volume AS tpv, volume * close AS dv, ln(high / low) * ln(high / low) AS hl2, CASE WHEN close - c1 > 0 THEN close - c1 ELSE 0 END AS gain, CASE WHEN close - c1 < 0 THEN c1 - close ELSE 0 END AS loss FROM base)"
_VOL = f"b3 AS (SELECT *, {rolled('stddev_samp', 'r', 20)} AS vol20 FROM b2)"
_R = rolled
_BB = f"(4 * {_R('stddev_samp', 'close', 20)} / ({_R('avg', 'close', 20)} + 1e-12))"
_KC = f"(3 * {_R('avg', 'tr', 20)} / ({_R('avg', 'close', 20)} + 1e-12))"


def _lag(n: int) -> str:
    return f"lag(close, {n}) OVER {over()}"


#: name of the query: feature, its SQL over b3
INDICATORS = {
    "ind_logret": (ind.log_return(1), "r"),
    "ind_mom": (ind.momentum(20), f"close / {_lag(20)} - 1"),
    "ind_mom_skip": (ind.momentum(60, 7), f"{_lag(7)} / {_lag(67)} - 1"),
    "ind_px_sma": (ind.price_to_sma(20), f"close / {_R('avg', 'close', 20)}"),
    "ind_sma_ratio": (ind.sma_ratio(10, 50), f"{_R('avg', 'close', 10)} / {_R('avg', 'close', 50)}"),
    "ind_from_high": (ind.distance_from_high(60), f"close / {_R('max', 'close', 60)} - 1"),
    "ind_from_low": (ind.distance_from_low(60), f"close / {_R('min', 'close', 60)} - 1"),
    "ind_vol": (ind.realized_vol(20), "vol20"),
    "ind_parkinson": (ind.parkinson_vol(20), f"sqrt({_R('avg', 'hl2', 20)} / (4 * ln(2.0::DOUBLE)))"),
    "ind_atr": (ind.atr(14), f"{_R('avg', 'tr', 14)} / close"),
    "ind_volvol": (ind.vol_of_vol(20), f"{_R('stddev_samp', 'vol20', 20)} / nullif(vol20, 0)"),
    "ind_chandelier": (ind.chandelier_exit(22, 3.0), f"{_R('max', 'high', 22)} - 3 * {_R('avg', 'tr', 22)}"),
    "ind_bb_width": (ind.bollinger_width(20), _BB),
    "ind_kc_width": (ind.keltner_width(20), _KC),
    "ind_vol_squeeze": (ind.volatility_squeeze(20), f"{_BB} < {_KC}"),
    "ind_zscore": (ind.zscore(20), f"(close - {_R('avg', 'close', 20)}) / nullif({_R('stddev_samp', 'close', 20)}, 0)"),
    "ind_rsi": (ind.rsi(14), f"100 - 100 / (1 + {_R('avg', 'gain', 14)} / ({_R('avg', 'loss', 14)} + 1e-12))"),
    "ind_volratio": (ind.volume_ratio(20), f"volume / {_R('avg', 'volume', 20)}"),
    "ind_rvol": (ind.rvol(20), f"volume / ({_R('avg', 'volume', 20)} + 1e-12)"),
    "ind_vwap_dev": (ind.vwap_deviation(24), f"close / ({_R('sum', 'tpv', 24)} / ({_R('sum', 'volume', 24)} + 1e-12)) - 1"),
    "ind_dollarvol": (ind.dollar_volume(20), f"ln(1 + {_R('avg', 'dv', 20)})"),
}
_FEATURES = f"WITH {bars_cte(HOUR)}, {BASE}, {_LIN}, {_VOL}"


def _one(name: str, feature: ind.Feature, sql: str) -> None:
    value = sql if name == "ind_vol_squeeze" else f"round({sql}, 6) + 0.0"

    @register(name, f"{_FEATURES} SELECT symbol, ts, {value} AS {feature[0]} FROM b3")
    def query(spark, d):
        return out(ind.compute(hourly(spark, d), [feature]), "symbol", "ts", feature[0])


for _name, (_feature, _sql) in INDICATORS.items():
    _one(_name, _feature, _sql)

_DEFAULT_SQL = {
    "mom_20": INDICATORS["ind_mom"][1], "mom_60": f"close / {_lag(60)} - 1", "mom_90_7": f"{_lag(7)} / {_lag(97)} - 1",
    "px_sma_20": INDICATORS["ind_px_sma"][1], "px_sma_60": f"close / {_R('avg', 'close', 60)}",
    "sma_10_50": INDICATORS["ind_sma_ratio"][1], "from_high_60": INDICATORS["ind_from_high"][1],
    "from_low_60": INDICATORS["ind_from_low"][1], "vol_20": "vol20", "vol_60": _R("stddev_samp", "r", 60),
    "parkinson_20": INDICATORS["ind_parkinson"][1], "atr_14": INDICATORS["ind_atr"][1],
    "volvol_20": INDICATORS["ind_volvol"][1], "z_20": INDICATORS["ind_zscore"][1],
    "z_60": f"(close - {_R('avg', 'close', 60)}) / nullif({_R('stddev_samp', 'close', 60)}, 0)",
    "rsi_14": INDICATORS["ind_rsi"][1], "logret_1": "r", "logret_5": f"ln(close / {_lag(5)})",
}


@register("features_default", f"{_FEATURES} SELECT symbol, ts, {', '.join(r6(v, k) for k, v in _DEFAULT_SQL.items())} FROM b3")
def features_default(spark, d):
    return out(ind.compute(hourly(spark, d)), "symbol", "ts", *ind.feature_names())


@register("ew_volatility", f"WITH RECURSIVE {bars_cte(HOUR)}, {BASE}, {ew_cte()} SELECT symbol, ts, round(vol, 6) AS ew_vol FROM ew")
def ew_volatility(spark, d):
    return out(labels.ew_volatility(hourly(spark, d)), "symbol", "ts", "ew_vol")


_NEWS = """news AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, count(DISTINCT event_id) AS article_count, count(DISTINCT user_id) AS source_count FROM events GROUP BY 1, 2)"""


def _news(spark, d):
    rows = prepared(spark).read.parquet(f"{d}/events.parquet")
    return series.daily_news(rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("symbol"), F.col("user_id").alias("source")))


@register("daily_counts_sources", f"WITH {_NEWS} SELECT symbol, strftime(date, '%Y-%m-%d') AS date, article_count, source_count FROM news")
def daily_counts_sources(spark, d):
    return out(_news(spark, d), "symbol", "date", "article_count", "source_count")


_NZ = [rolled(a, "article_count", 10, 1, "symbol", "date").replace(" = 10", " = 10") for a in ("avg", "stddev_samp")]


@register("trailing_self_excluding_z", f"WITH {_NEWS} SELECT symbol, strftime(date, '%Y-%m-%d') AS date, round((article_count - {_NZ[0]}) / ({_NZ[1]} + 1e-9), 6) + 0.0 AS count_z FROM news")
def trailing_self_excluding_z(spark, d):
    return out(series.news_score(_news(spark, d), 10), "symbol", "date", "count_z")


_MACRO = """macro AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
ids AS (SELECT DISTINCT series_id FROM macro), dates AS (SELECT DISTINCT date FROM macro),
sparse AS (SELECT series_id, date, value FROM ids CROSS JOIN dates LEFT JOIN macro USING (series_id, date)),
filled AS (SELECT series_id, date, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM sparse)"""


def _macro(spark, d):
    orders = prepared(spark).read.parquet(f"{d}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value"))


def _filled(spark, d):
    macro = _macro(spark, d)
    ids, dates = macro.select("series_id").distinct(), macro.select("date").distinct()
    sparse = dates.join(F.broadcast(ids)).join(macro, ["series_id", "date"], "left")  # a handful of series
    return joins.forward_fill(sparse, "series_id", "date", "value")


@register("forward_fill", f"WITH {_MACRO} SELECT series_id, strftime(date, '%Y-%m-%d') AS date, round(value, 4) AS value FROM filled")
def forward_fill(spark, d):
    return out(_filled(spark, d), "series_id", "date", "value", digits=4)


_M = [rolled(a, "value", 252, 0, "series_id", "date") for a in ("avg", "stddev_samp")]


@register("macro_features", f"""WITH {_MACRO} SELECT series_id, strftime(date, '%Y-%m-%d') AS date,
round(value - lag(value, 21) OVER (PARTITION BY series_id ORDER BY date), 4) + 0.0 AS change, round((value - {_M[0]}) / nullif({_M[1]}, 0), 4) + 0.0 AS z FROM filled""")
def macro_features(spark, d):
    return out(series.macro_features(_filled(spark, d)), "series_id", "date", "change", "z", digits=4)


@register("full_outer_macro_panel", f"""WITH {_MACRO}, a AS (SELECT date, value AS urgent FROM macro WHERE series_id = '1-URGENT'), b AS (SELECT date, value AS low FROM macro WHERE series_id = '5-LOW')
SELECT strftime(coalesce(a.date, b.date), '%Y-%m-%d') AS date, round(urgent, 4) AS urgent, round(low, 4) AS low FROM a FULL JOIN b ON a.date = b.date""")
def full_outer_macro_panel(spark, d):
    macro = _macro(spark, d)
    a = macro.where("series_id = '1-URGENT'").select("date", F.col("value").alias("urgent"))
    b = macro.where("series_id = '5-LOW'").select("date", F.col("value").alias("low"))
    return out(series.outer_panel(a, b), "date", "urgent", "low", digits=4)


@register("ew_volatility_short", f"WITH RECURSIVE {bars_cte(HOUR)}, {BASE}, {ew_cte(5)} SELECT symbol, ts, round(vol, 6) AS ew_vol FROM ew")
def ew_volatility_short(spark, d):
    return out(labels.ew_volatility(hourly(spark, d), 5), "symbol", "ts", "ew_vol")


@register("drawdown_curve", f"""WITH {bars_cte(DAY)}, p AS (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c1 FROM bars)
SELECT symbol, ts, round(peak, 6) AS peak, round((close - peak) / peak, 6) + 0.0 AS drawdown, round((close - c1) / c1, 6) + 0.0 AS ret FROM p""")
def drawdown_curve(spark, d):
    curve = daily(spark, d).withColumn("equity", F.col("close"))
    return out(portfolio.drawdown(curve, "symbol"), "symbol", "ts", "peak", "drawdown", "ret")


# --- ranks ---------------------------------------------------------------------------------------------------


def _panel(spark, d, bars=hourly):
    return joins.aligned_panel(bars(spark, d))


@register("aligned_panel", f"WITH {bars_cte(HOUR)}, {PANEL} SELECT symbol, ts, round(close, 6) AS close FROM panel")
def aligned_panel(spark, d):
    return out(_panel(spark, d), "symbol", "ts", "close")


_SCORED = f"""WITH {bars_cte(HOUR)}, {PANEL}, scored AS (SELECT symbol, ts, lag(close, 7) OVER {over()} / lag(close, 67) OVER {over()} - 1 AS score FROM panel),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY ts) AS n FROM scored WHERE score IS NOT NULL),
top AS (SELECT * FROM ranked WHERE rank <= 2 AND n >= 2)"""


def _top(spark, d):
    panel = _panel(spark, d)
    return panel, ranking.top_n(ranking.momentum_scores(panel, 60, 7), 2)


@register("momentum_topn", f"""{_SCORED}, times AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS exec_ts FROM (SELECT DISTINCT ts FROM panel))
SELECT symbol, ts, exec_ts, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score, 0.5::DOUBLE AS weight FROM top JOIN times USING (ts) WHERE exec_ts IS NOT NULL""")
def momentum_topn(spark, d):
    panel, top = _top(spark, d)
    return out(ranking.executed_next(top, panel), "symbol", "ts", "exec_ts", "rank", "score", "weight")


@register("ranking_changed", f"""{_SCORED}, sets AS (SELECT ts, list_sort(list(DISTINCT symbol)) AS m FROM top GROUP BY 1)
SELECT ts, coalesce(m <> lag(m) OVER (ORDER BY ts), false) AS changed FROM sets""")
def ranking_changed(spark, d):
    return out(ranking.ranking_changed(_top(spark, d)[1]), "ts", "changed")


@register("long_short_weights", f"""WITH {bars_cte(HOUR)}, {PANEL}, scored AS (SELECT symbol, ts, close / lag(close, 60) OVER {over()} - 1 AS score FROM panel),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS k, count(*) OVER (PARTITION BY ts) AS n FROM scored WHERE score IS NOT NULL)
SELECT symbol, ts, round(score, 6) + 0.0 AS score, CASE WHEN k > n - 2 THEN -0.1::DOUBLE WHEN k <= 2 THEN 0.25::DOUBLE END AS weight FROM ranked WHERE n >= 4 AND (k > n - 2 OR k <= 2)""")
def long_short_weights(spark, d):
    return out(ranking.long_short(_panel(spark, d), 60, 2, 2), "symbol", "ts", "score", "weight")


def _z(x: str) -> str:
    w = "OVER (PARTITION BY ts)"
    return f"coalesce(CASE WHEN count({x}) {w} >= 2 THEN ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0) END, 0)"


@register("composite_alpha", f"""WITH {bars_cte(HOUR)}, {panel_base()}, parts AS (SELECT symbol, ts, rn,
  close / lag(close, 100) OVER {over()} - 1 + close / {_R('avg', 'close', 100)} - 1 AS trend,
  -(close / ({_R('sum', '((high + low + close) / 3 * volume)', 24)} / ({_R('sum', 'volume', 24)} + 1e-12)) - 1) AS rev,
  1 / ({_R('stddev_pop', 'sr', 23)} + 1e-6) AS calm, volume / {_R('avg', 'volume', 20)} AS vol FROM base)
SELECT symbol, ts, round(CASE WHEN rn <= 100 THEN 0 ELSE 0.4 * {_z('trend')} + 0.2 * {_z('rev')} + 0.2 * {_z('calm')} + 0.2 * {_z('vol')} END, 5) + 0.0 AS alpha FROM parts""")
def composite_alpha(spark, d):
    return out(ranking.composite_alpha(_panel(spark, d)), "symbol", "ts", "alpha", digits=5)


@register("buy_hold_benchmark", f"""WITH {bars_cte(HOUR)}, {PANEL}, f AS (SELECT ts, close / first(close) OVER {over()} AS x FROM (SELECT *, row_number() OVER {over()} - 1 AS k FROM panel) WHERE k >= 60)
SELECT ts, round(500 * avg(x), 6) AS equity FROM f GROUP BY 1""".replace("first(close) OVER (PARTITION BY symbol ORDER BY ts)", "first_value(close) OVER (PARTITION BY symbol ORDER BY ts)"))
def buy_hold_benchmark(spark, d):
    return out(ranking.buy_and_hold(_panel(spark, d), 500.0, 60), "ts", "equity")


@register("vol_target_size", f"""{_FEATURES} SELECT symbol, ts, round(CASE WHEN vol20 > 0 AND 125 * least(1, 0.2 / (vol20 * sqrt(365.0::DOUBLE))) >= 1 THEN 125 * least(1, 0.2 / (vol20 * sqrt(365.0::DOUBLE))) / close ELSE 0 END, 6) AS qty FROM b3""")
def vol_target_size(spark, d):
    rows = ind.compute(hourly(spark, d), [ind.realized_vol(20)])
    return out(rows.withColumn("qty", ranking.vol_target_size(F.lit(500.0), F.col("close"), F.col("vol_20"))), "symbol", "ts", "qty")
