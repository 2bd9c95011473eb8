from datetime import date

from heliobar.operators import calendar as cal


def test_easter_on_published_dates():
    assert [cal.easter(y) for y in (2024, 2025, 2026)] == [date(2024, 3, 31), date(2025, 4, 20), date(2026, 4, 5)]


def test_holidays_of_2025():
    days = {(1, 1), (1, 20), (2, 17), (4, 18), (5, 26), (6, 19), (7, 4), (9, 1), (11, 27), (12, 25)}
    assert cal.holidays(2025) == {date(2025, m, d) for m, d in days}


def test_new_year_on_saturday_is_not_kept():
    assert date(2021, 12, 31) not in cal.holidays(2022) | cal.holidays(2021)


def test_juneteenth_from_2022():
    assert date(2021, 6, 18) not in cal.holidays(2021)
    assert date(2022, 6, 20) in cal.holidays(2022)


def test_early_closes():
    assert cal.early_closes(2025) == {date(2025, 7, 3), date(2025, 11, 28), date(2025, 12, 24)}


def test_navigation_and_sessions(spark):
    table = cal.calendar(spark, date(2026, 1, 1), date(2026, 1, 31))
    days = spark.createDataFrame([(date(2026, 1, 17),), (date(2026, 1, 20),)], "day date")
    rows = {r["day"]: r for r in cal.with_next_previous(days, table).collect()}
    assert rows[date(2026, 1, 17)]["next_day"] == date(2026, 1, 20)  # a weekend and a holiday
    assert rows[date(2026, 1, 17)]["previous_day"] == date(2026, 1, 16)
    assert rows[date(2026, 1, 20)]["previous_day"] == date(2026, 1, 16)
    grid = cal.session_grid(table.where("day between '2026-01-16' and '2026-01-20'"), 3600)
    assert grid.count() == 14  # two sessions of seven hours


def test_market_open(spark):
    table = cal.calendar(spark, date(2025, 7, 1), date(2025, 7, 31))
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2025-07-03 16:59:00'), (2, timestamp'2025-07-03 17:00:00'), (3, timestamp'2025-07-04 15:00:00'), (4, timestamp'2025-07-07 08:00:00') AS t(i, ts)")
    got = {r["i"]: (r["is_open"], r["is_extended"]) for r in cal.with_market_open(rows, table).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False), 4: (False, True)}
