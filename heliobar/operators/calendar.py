"""Exchange calendar as a small table: holidays, early closes, sessions and trading-day ordinals."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = timedelta(days=1)


def easter(year: int) -> date:
    """Gregorian Easter from the moon's age on the first of March."""
    golden, century = year % 19, year // 100
    moon = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon -= (moon // 28) * (1 - (29 // (moon + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    return date(year, 3, 28) + timedelta(days=moon - weekday)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (Monday 0) of a month; a negative n counts from its end."""
    days = [d for d in (date(year, month, 1) + i * _DAY for i in range(31)) if d.month == month and d.weekday() == weekday]
    return days[n - 1 if n > 0 else n]


def observed(day: date) -> date | None:
    """Saturdays move to Friday, Sundays to Monday; a New Year on a Saturday isn't kept at all."""
    shift = {5: -1, 6: 1}.get(day.weekday(), 0)
    return None if shift < 0 and (day.month, day.day) == (1, 1) else day + shift * _DAY


def holidays(year: int) -> set[date]:
    fixed = [(1, 1), (7, 4), (12, 25)] + [(6, 19)] * (year >= 2022)
    floating = [(1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (11, 3, 4)]
    days = {observed(date(year, m, d)) for m, d in fixed} | {nth_weekday(year, *f) for f in floating}
    return (days | {easter(year) - 2 * _DAY}) - {None}


def early_closes(year: int) -> set[date]:
    eves = {d for d in (date(year, 12, 24), date(year, 7, 3)) if d.weekday() < 5} - holidays(year)
    return eves | {nth_weekday(year, 11, 3, 4) + _DAY}


def calendar_rows(first: date, last: date) -> list[tuple]:
    """(day, trading day?, closing minute, ordinal of the last trading day up to the day)."""
    off = set().union(*(holidays(y) for y in range(first.year, last.year + 1)))
    short = set().union(*(early_closes(y) for y in range(first.year, last.year + 1)))
    rows, n, d = [], 0, first
    while d <= last:
        opened = d.weekday() < 5 and d not in off
        n += opened
        rows.append((d, opened, (780 if d in short else 960) if opened else None, n))
        d += _DAY
    return rows


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row a day: at most 366 a year, so it is broadcast."""
    return spark.createDataFrame(calendar_rows(first, last), "day date, is_trading_day boolean, close_minute int, td_ordinal int")


def with_next_previous(days: DataFrame, cal: DataFrame, n: int = 1) -> DataFrame:
    """The n-th trading day after and before each day, by ordinals; settlement is the first after."""
    t = cal.where("is_trading_day").select(F.col("td_ordinal").alias("_o"), F.col("day").alias("_d"))
    here = days.join(F.broadcast(cal.select("day", "is_trading_day", "td_ordinal")), "day")
    after = F.broadcast(t.select(F.col("_o").alias("_oa"), F.col("_d").alias("next_day")))
    before = F.broadcast(t.select(F.col("_o").alias("_ob"), F.col("_d").alias("previous_day")))
    out = here.join(after, F.col("_oa") == F.col("td_ordinal") + n, "left")
    back = F.col("td_ordinal") - n + F.when(F.col("is_trading_day"), 0).otherwise(1)
    return out.join(before, F.col("_ob") == back, "left").drop("_oa", "_ob")


def market_minute(ts: Column) -> tuple[Column, Column]:
    """Exchange-local day and minute of a UTC time."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    return F.to_date(local), F.hour(local) * 60 + F.minute(local)


def with_market_open(df: DataFrame, cal: DataFrame, ts: str = "ts") -> DataFrame:
    """is_open from 9:30 to the close, is_extended from 4:00 to 20:00, ends left out."""
    day, minute = market_minute(F.col(ts))
    out = df.withColumns({"_day": day, "_minute": minute}).join(F.broadcast(cal.select(F.col("day").alias("_day"), "is_trading_day", "close_minute")), "_day", "left")
    trading = F.coalesce("is_trading_day", F.lit(False))
    out = out.withColumn("is_open", trading & (F.col("_minute") >= 570) & (F.col("_minute") < F.col("close_minute")))
    out = out.withColumn("is_extended", trading & (F.col("_minute") >= 240) & (F.col("_minute") < 1200))
    return out.withColumn("is_open", F.coalesce("is_open", F.lit(False))).drop("_day", "_minute", "is_trading_day", "close_minute")


def session_grid(cal: DataFrame, seconds: int) -> DataFrame:
    """Expected times of a session calendar: midnight for days, else from 9:30 local, stepped to before the close."""
    days = cal.where("is_trading_day")
    if seconds >= 86400:
        return days.select(F.col("day").cast("timestamp").alias("ts"))
    opens = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr("INTERVAL 570 MINUTES"), "America/New_York")
    steps = F.explode(F.sequence(F.lit(0), (F.col("close_minute") - 570) * 60 - 1, F.lit(seconds)))
    return days.select(F.unix_seconds(opens).alias("_open"), steps.alias("_step")).select(F.timestamp_seconds(F.col("_open") + F.col("_step")).alias("ts"))


def session_window(start: str, end: str, zone: str, day: date, exchange: str = "America/New_York") -> tuple[str, str]:
    """An exchange's hours (HH:MM) of a day as a clock in another zone shows them."""
    here = lambda t: datetime.combine(day, time.fromisoformat(t), ZoneInfo(exchange)).astimezone(ZoneInfo(zone))
    return f"{here(start):%H:%M}", f"{here(end):%H:%M}"


def with_session_window(days: DataFrame, start_minute: int, end_minute: int, zone: str, exchange: str = "America/New_York") -> DataFrame:
    """The same for a column ``day``: opens and closes, as HH:MM in ``zone``."""

    def shown(minute: int) -> Column:
        utc = F.to_utc_timestamp(F.timestamp_seconds(F.unix_date("day") * 86400 + minute * 60), exchange)
        return F.date_format(F.from_utc_timestamp(utc, zone), "HH:mm")

    return days.withColumns({"opens": shown(start_minute), "closes": shown(end_minute)})
