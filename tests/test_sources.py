import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heliobar.operators import calendar, cv, gaps, portfolio, risk
from heliobar.functions import indicators as ind
from heliobar.sources import drops, stores
from heliobar.sources.bars import BarLake, check_symbol

T0 = datetime(2025, 1, 1)


def bars(spark, days, symbol="A", close=10.0):
    rows = [(symbol, T0 + timedelta(days=i), close + i, close + i + 1, close + i - 1, close + i, 5.0) for i in days]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def closes(lake, symbol="A", asset="crypto"):
    return [r["close"] for r in lake.read([symbol], "1d", asset=asset).collect()]


def test_lake_swap_survives_a_broken_run(spark, tmp_path):
    lake = BarLake(spark, str(tmp_path))
    lake.write(bars(spark, range(5)), "1d", "crypto")
    path = lake.path("crypto", "1d")
    # a run that broke after it took the old partition away, and left a half-written one aside
    (tmp_path / "bars/crypto/1d/_old-x/symbol=A").mkdir(parents=True)
    (tmp_path / "bars/crypto/1d/symbol=A/year=2025").rename(tmp_path / "bars/crypto/1d/_old-x/symbol=A/year=2025")
    (tmp_path / "bars/crypto/1d/_new-x/symbol=A/year=2025").mkdir(parents=True)
    lake.write(bars(spark, [4, 5], close=20.0), "1d", "crypto")
    assert closes(lake) == [10.0, 11.0, 12.0, 13.0, 24.0, 25.0]
    assert not [p for p in (tmp_path / "bars/crypto/1d").iterdir() if p.name.startswith("_")] and path.endswith("1d")
    lake.write(bars(spark, [0], "B/C"), "1d", "crypto")
    assert lake.symbols("1d", "crypto") == ["A", "B/C"] and lake.row_count("B/C", "1d", "crypto") == 1


@pytest.mark.parametrize("symbol", ["", "..", "A/..", "A//B", ".A", "A" * 33, "A B", "É", "-A", "A..B"])
def test_unusable_symbols(symbol):
    with pytest.raises(ValueError):
        check_symbol(symbol)
    assert check_symbol("BRK.B") == "BRK.B" and check_symbol("BTC/USD") == "BTC/USD"


def test_backfill_and_refresh(spark, tmp_path):
    lake, source = BarLake(spark, str(tmp_path)), bars(spark, range(10))
    lake.write(bars(spark, [0, 1, 4], close=90.0), "1d", "crypto")
    left = drops.backfill(lake, source.where("day(ts) <> 4"), source.select("symbol"), "1d", T0, T0 + timedelta(days=5))
    assert [r["ts"].day for r in left.collect()] == [4]
    assert closes(lake) == [90.0, 91.0, 12.0, 94.0, 15.0]  # what is there stays
    got = drops.refresh(lake, source, source.select("symbol"), "1d", T0 + timedelta(days=8))
    assert got == {"updated": 1, "fetched": 7} and closes(lake) == [90.0, 91.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0]
    assert drops.refresh(lake, source, source.select("symbol"), "1d", T0 + timedelta(days=8, hours=10)) == {"updated": 0, "fetched": 0}


def test_ingest_records_failures(spark, tmp_path):
    lake = BarLake(spark, str(tmp_path))
    drop = bars(spark, range(3)).unionByName(bars(spark, range(2), "B").withColumn("high", F.lit(0.0)))
    got = drops.ingest(lake, drop, spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"), "1d")
    assert (got["symbols"], got["bars"]) == (1, 3)
    assert sorted(map(tuple, got["failed"].collect())) == [("B", "2 unusable bars"), ("C", "no bars")]
    assert lake.symbols("1d") == ["A"]


def test_drops_of_bars_listings_news_and_macro(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(map(json.dumps, rows)))
        return str(tmp_path / name)

    price = {"open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0, "ts": "2025-01-01T00:00:00Z"}
    path = put("bars", [price | {"symbol": "A", "feed": "iex"}, price | {"symbol": "B", "feed": "sip", "adjustment": "raw"}, price | {"symbol": "C", "feed": "iex", "adjustment": "all"}])
    assert [r["symbol"] for r in drops.read_bar_drop(spark, path).orderBy("symbol").collect()] == ["A", "B"]
    assert [r["symbol"] for r in drops.read_bar_drop(spark, path, "iex").collect()] == ["A"]
    asset = {"status": "active", "asset_class": "us_equity", "tradable": True, "min_order_size": "0.5"}
    path = put("assets", [asset | {"symbol": "A"}, asset | {"symbol": "B", "status": "inactive"}, asset | {"symbol": "C", "asset_class": "option"}, asset | {"symbol": "D", "min_order_size": "n/a"}])
    got = drops.read_universe_drop(spark, path, date(2025, 1, 2)).orderBy("symbol").collect()
    assert [(r["symbol"], r["min_order_size"], r["snapshot_date"]) for r in got] == [("A", 0.5, date(2025, 1, 2)), ("D", None, date(2025, 1, 2))]
    article = lambda i: {"id": i, "created_at": f"2025-01-0{i}T00:00:00Z", "symbols": ["A", "B"] if i == 1 else [], "headline": "h", "source": "s"}
    path = put("news", [{"page_token": None, "next_page_token": "x", "news": [article(3)]}, {"page_token": "x", "next_page_token": "y", "news": [article(1)]}, {"page_token": "y", "next_page_token": None, "news": [article(2)]}, {"page_token": "z", "next_page_token": None, "news": [article(4)]}])
    assert [r["id"] for r in drops.read_news_drop(spark, path).collect()] == [1, 2, 3]
    assert [r["id"] for r in drops.read_news_drop(spark, path, 2).collect()] == [1, 3]
    assert sorted((r["id"], r["symbol"]) for r in stores.news_rows(drops.read_news_drop(spark, path)).collect()) == [(1, "A"), (1, "B"), (2, "*"), (3, "*")]
    raw = spark.createDataFrame([("g", "2025-01-01", "1.5", "2025-02-01"), ("g", "2025-01-01", "1.7", "2025-03-01"), ("g", "2025-01-02", ".", "2025-02-01"), ("g", "2025-01-03", "2", None)], "series_id string, date string, value string, realtime_start string")
    assert sorted((r["date"].day, r["value"]) for r in drops.macro_drop(raw).collect()) == [(1, 1.7), (3, 2.0)]
    assert sorted((r["date"].day, r["value"]) for r in drops.macro_drop(raw, first_release=True).collect()) == [(1, 1.5), (3, 2.0)]


def test_selected_universe_never_looks_forward(spark, tmp_path):
    store = stores.SelectedUniverse(spark, str(tmp_path / "u"))
    with pytest.raises(LookupError):
        store.latest()
    pick = lambda *names: spark.createDataFrame([(n, 1.0, 2.0, True, True, False) for n in names], stores.SELECTED)
    store.save(pick("A"), date(2025, 1, 2))
    store.save(pick("B"), date(2025, 1, 4))
    store.save(pick("C", "D"), date(2025, 1, 4))
    assert store.dates() == [date(2025, 1, 2), date(2025, 1, 4)]
    assert [r["symbol"] for r in store.asof(date(2025, 1, 3)).collect()] == ["A"]
    assert sorted(r["symbol"] for r in store.latest().collect()) == ["C", "D"]
    with pytest.raises(LookupError):
        store.asof(date(2025, 1, 1))


def test_health_report_covers_the_trailing_days(spark):
    rows = bars(spark, range(100, 121)).unionByName(bars(spark, range(10), "B"))
    got = {r["symbol"]: r for r in gaps.health_report(rows, T0 + timedelta(days=120), days=20).collect()}
    assert (got["A"]["completeness"], got["A"]["warn"]) == (1.0, False) and (got["B"]["completeness"], got["B"]["warn"]) == (0.0, True)
    assert got["A"]["mean_completeness"] == got["B"]["mean_completeness"] == 0.5
    none = gaps.completeness(gaps.continuous_grid(spark.createDataFrame([], "symbol string, first_ts timestamp, last_ts timestamp"), 86400), rows, rows)
    assert {r["completeness"] for r in none.collect()} == {1.0}


def test_session_window_in_another_zone(spark):
    assert calendar.session_window("09:30", "16:00", "Europe/Berlin", date(2026, 1, 9)) == ("15:30", "22:00")
    assert calendar.session_window("09:30", "16:00", "Europe/Berlin", date(2026, 3, 10)) == ("14:30", "21:00")  # summer time starts apart
    df = spark.createDataFrame([(date(2026, 1, 9),), (date(2026, 3, 10),)], "day date")
    got = {(r["opens"], r["closes"]) for r in calendar.with_session_window(df, 570, 960, "Europe/Berlin").collect()}
    assert got == {("15:30", "22:00"), ("14:30", "21:00")}


def test_resets_need_a_note(spark):
    marks = spark.createDataFrame([("a", T0 + timedelta(hours=i), e) for i, e in enumerate([500.0, 390.0, 400.0, 410.0, 480.0])], "account string, ts timestamp, equity double")
    reset = lambda note: spark.createDataFrame([("a", T0 + timedelta(hours=3), note)], "account string, ts timestamp, note string")
    got = [r["halted"] for r in risk.kill_switch_with_resets(marks, reset("looked at")).orderBy("ts").collect()]
    assert got == [False, True, True, True, False]
    with pytest.raises(Exception, match="a reset needs a note"):
        risk.kill_switch_with_resets(marks, reset("  ")).collect()


def test_runner_needs_bars_and_counts_rebalances(spark):
    rows = None
    for k, s in enumerate("ABC"):
        part = bars(spark, range(40), s, 10.0 + 50 * k)
        rows = part if rows is None else rows.unionByName(part)
    with pytest.raises(ValueError, match="too few"):
        portfolio.cross_sectional(rows, warmup=38)
    got = portfolio.cross_sectional(rows, lookback=5, top=2, every=10, warmup=10)
    assert got["rebalances"] == 3 and got["curve"].count() == 30
    stats = got["stats"].first()
    assert stats["trades"] > 0 and stats["periods"] == 29
    assert got["benchmark"].count() == 30 and got["benchmark"].orderBy("ts").first()["equity"] == pytest.approx(500.0)


def test_short_histories_pass_the_filter(spark):
    got = cv.signal_filter(bars(spark, range(50)), [ind.momentum(5)]).collect()
    assert [(r["symbol"], r["allowed"], r["confidence"], r["reason"]) for r in got] == [("A", True, 0.5, "too few bars")]
