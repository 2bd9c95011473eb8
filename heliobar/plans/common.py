"""Fragments that queries and oracle statements share. Oracles are written on their own, in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import event_bars, line_bars

HOUR, DAY, WEEK = 3600, 86400, 604800


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return event_bars(prepared(spark), d, HOUR)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return event_bars(prepared(spark), d, DAY)


def weekly_lines(spark: SparkSession, d: str, symbol: str = "p_type") -> DataFrame:
    return line_bars(prepared(spark), d, WEEK, symbol)


def rounded(x: Column, digits: int) -> Column:
    """Rounds as the SQL does: the product with a power of ten goes to the nearest whole number.

    F.round goes by the shortest decimals of x instead, which differ where x lies next to a tie. Beyond 2^53 the product
    has no fraction to round.
    """
    scale = 10.0**digits
    return F.when(F.abs(x) < 2.0**53 / scale, F.round(x * scale) / scale).otherwise(F.round(x, digits))


def out(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns as the oracle has them: times as seconds, doubles rounded."""
    kinds = dict(df.dtypes)
    cols = []
    for c in columns or df.columns:
        if kinds[c] == "double":
            cols.append(rounded(F.col(c), digits).alias(c))
        elif kinds[c].startswith("timestamp"):
            cols.append(F.unix_seconds(F.col(c).cast("timestamp")).alias(c))
        elif kinds[c] == "date":
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def bars_cte(step: int = HOUR) -> str:
    return f"""bars AS (
  SELECT event_type AS symbol, CAST(floor(epoch(ts) / {step}) AS BIGINT) * {step} AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trade_count
  FROM events GROUP BY 1, 2)"""


def lines_cte(step: int = WEEK, symbol: str = "p_type") -> str:
    order = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    return f"""bars AS (
  SELECT {symbol} AS symbol, CAST(floor(epoch(l_shipdate) / {step}) AS BIGINT) * {step} AS ts,
         first(l_extendedprice / l_quantity ORDER BY {order}) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {order}) AS close,
         sum(l_quantity) AS volume, count(*) AS trade_count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def over(n: int | None = None, shift: int = 0, key: str = "symbol", order: str = "ts") -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1 + shift} PRECEDING AND " + (f"{shift} PRECEDING" if shift else "CURRENT ROW")
    return f"(PARTITION BY {key} ORDER BY {order}{frame})"


def rolled(agg: str, x: str, n: int, shift: int = 0, key: str = "symbol", order: str = "ts") -> str:
    w = over(n, shift, key, order)
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END)"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


#: Bars with the previous close, the log and simple return and the true range.
BASE = """base AS (
  SELECT *, ln(close / c1) AS r, (close - c1) / c1 AS sr, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c1,
               row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars))"""
PANEL = """panel AS (
  SELECT * FROM bars WHERE ts IN (
    SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)))"""


def panel_base() -> str:
    return PANEL + ", " + BASE.replace("FROM bars))", "FROM panel))")


#: Good Fridays of the years that the tables' dates and their neighbours fall into.
GOOD_FRIDAYS = ["1991-03-29", "1992-04-17", "1993-04-09", "1994-04-01", "1995-04-14", "1996-04-05", "1997-03-28", "1998-04-10", "1999-04-02", "2000-04-21", "2001-04-13", "2002-03-29", "2022-04-15", "2023-04-07", "2024-03-29", "2025-04-18", "2026-04-03"]


def calendar_cte(first: str, last: str) -> str:
    """The exchange calendar in SQL, by rules of its own: nothing here comes from the package's calendar."""
    nth = lambda month, weekday, n: f"make_date(y, {month}, 1) + CAST(({weekday} - dayofweek(make_date(y, {month}, 1)) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"
    last_monday = "make_date(y, 5, 31) - CAST((dayofweek(make_date(y, 5, 31)) + 6) % 7 AS INTEGER)"
    fixed = "(SELECT y, make_date(y, 1, 1) AS d, true AS ny FROM yrs UNION ALL SELECT y, make_date(y, 6, 19), false FROM yrs WHERE y >= 2022 UNION ALL SELECT y, make_date(y, 7, 4), false FROM yrs UNION ALL SELECT y, make_date(y, 12, 25), false FROM yrs)"
    return f"""yrs AS (SELECT unnest(range(year(DATE '{first}') - 1, year(DATE '{last}') + 2)) AS y),
off_days AS (
  SELECT CASE dayofweek(d) WHEN 0 THEN d + 1 WHEN 6 THEN d - 1 ELSE d END AS day FROM {fixed} WHERE NOT (ny AND dayofweek(d) = 6)
  UNION SELECT {nth(1, 1, 3)} FROM yrs UNION SELECT {nth(2, 1, 3)} FROM yrs UNION SELECT {last_monday} FROM yrs
  UNION SELECT {nth(9, 1, 1)} FROM yrs UNION SELECT {nth(11, 4, 4)} FROM yrs
  UNION SELECT CAST(unnest({GOOD_FRIDAYS}) AS DATE)),
short_days AS (SELECT {nth(11, 4, 4)} + 1 AS day FROM yrs UNION SELECT make_date(y, 12, 24) FROM yrs UNION SELECT make_date(y, 7, 3) FROM yrs),
span_days AS (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day),
open_days AS (SELECT day, dayofweek(day) BETWEEN 1 AND 5 AND day NOT IN (SELECT day FROM off_days) AS is_trading_day FROM span_days),
cal AS (SELECT day, is_trading_day, CASE WHEN is_trading_day THEN CASE WHEN day IN (SELECT day FROM short_days) THEN 780 ELSE 960 END END AS close_minute,
  CAST(sum(CAST(is_trading_day AS INTEGER)) OVER (ORDER BY day) AS INTEGER) AS td_ordinal FROM open_days)"""


def ew_cte(span: int = 100) -> str:
    """The exponentially weighted volatility as a recursion over the rows of ``base``."""
    a = 2 / (span + 1)
    return f"""ew0(symbol, rn, ts, var) AS (
  SELECT b.symbol, b.rn, b.ts, {1 - a} * coalesce((SELECT s.r * s.r FROM base s WHERE s.symbol = b.symbol AND s.rn = 2), 0) FROM base b WHERE b.rn = 1
  UNION ALL SELECT b.symbol, b.rn, b.ts, {a} * b.r * b.r + {1 - a} * e.var FROM ew0 e JOIN base b ON b.symbol = e.symbol AND b.rn = e.rn + 1),
ew AS (SELECT symbol, rn, ts, CASE WHEN var > 0 THEN sqrt(var) ELSE coalesce(sqrt(first_value(var) OVER (PARTITION BY symbol ORDER BY CASE WHEN var > 0 THEN 0 ELSE 1 END, rn)), 0) END AS vol FROM ew0)"""
