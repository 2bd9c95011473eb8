import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliobar.functions import costs, indicators as ind, text
from heliobar.functions.rolling import by_symbol
from heliobar.operators import cv, joins, labels, portfolio, risk, statistics as stats
from heliobar.sources.bars import BarLake, check_symbol
from heliobar.sources import stores

T0 = datetime(2025, 1, 1)


def bars(spark, closes, symbol="A", step=3600):
    rows = [(symbol, T0 + timedelta(seconds=step * i), float(c), float(c) + 1, float(c) - 1, float(c), 10.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def walk(n, seed=1):
    import random

    r, out = random.Random(seed), [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(r.gauss(0, 0.01)))
    return out


def test_warm_up_is_null(spark):
    rows = ind.compute(bars(spark, range(1, 31)), [ind.price_to_sma(20), ind.realized_vol(20)]).orderBy("ts").collect()
    assert [r["px_sma_20"] is None for r in rows] == [True] * 19 + [False] * 11
    assert [r["vol_20"] is None for r in rows] == [True] * 20 + [False] * 10


def test_default_features_are_causal(spark):
    features = [*ind.DEFAULT, *ind.VOLUME, ind.vwap_deviation(), ind.rvol(), ind.volatility_squeeze(), ind.chandelier_exit()]
    names = ind.feature_names(features)
    report = cv.audit(bars(spark, walk(120)), lambda df: ind.compute(df, features), names, [100, 118])
    assert report["leaking"] == []


def test_a_leak_is_found(spark):
    fn = lambda df: df.withColumn("leak", F.lead("close").over(by_symbol()))
    assert cv.audit(bars(spark, walk(40)), fn, ["leak"], [20, 30])["leaking"] == ["leak"]
    with pytest.raises(AssertionError):
        cv.assert_causal(bars(spark, walk(40)), fn, ["leak"])


def test_lake_upsert_is_idempotent_and_last_write_wins(spark, tmp_path):
    lake = BarLake(spark, str(tmp_path))
    first = bars(spark, walk(30), step=86400 * 20)
    assert lake.write(first, "1d") == 30 == lake.write(first, "1d")
    lake.write(bars(spark, [7.0], step=86400 * 20), "1d")
    got = lake.read(["A"], "1d").collect()
    assert len(got) == 30 and got[0]["close"] == 7.0
    assert lake.row_count("A", "1d") == 30 and lake.symbols("1d") == ["A"]
    some = lake.read(["A"], "1d", T0 + timedelta(days=20), T0 + timedelta(days=60)).count()
    assert some == 3
    assert lake.write(first.limit(0), "1d") == 0
    with pytest.raises(ValueError):
        check_symbol("../x")


def test_triple_barrier_by_hand(spark):
    rows = bars(spark, [100, 101, 103, 90, 100, 100]).withColumn("vol", F.lit(0.02))
    got = {r["event_idx"]: (r["label"], r["touch"], r["barrier"]) for r in labels.triple_barrier(rows, "vol", 1.0, 1.0, 3).collect()}
    assert got == {0: (1, 2, "pt"), 1: (-1, 2, "sl"), 2: (-1, 1, "sl")}
    off = {r["event_idx"]: r["barrier"] for r in labels.triple_barrier(rows, "vol", 0.0, 0.0, 3).collect()}
    assert set(off.values()) == {"vertical"}
    with pytest.raises(ValueError):
        labels.triple_barrier(rows, "vol", max_bars=0)


def recurrence(x, keep, before=0.0):
    out = []
    for v in x:
        before = v + keep * before
        out.append(before)
    return out


@pytest.mark.parametrize("span", [5, 10, 20, 100])
def test_ew_volatility_equals_the_recurrence(spark, span):
    """Also over more bars than one block of the window sums holds, with a stretch of flat prices in between."""
    closes = walk(21_000)
    closes[9_000:12_000] = [closes[9_000]] * 3_000
    got = [r["ew_vol"] for r in labels.ew_volatility(bars(spark, closes), span).orderBy("ts").collect()]
    a = 2 / (span + 1)
    r = [0.0] + [math.log(y / x) for x, y in zip(closes, closes[1:])]
    var = recurrence([a * v * v for v in r], 1 - a, r[1] ** 2)
    first = math.sqrt(next(v for v in var if v > 0))  # what takes the place of a variance that has died away
    assert all(g == pytest.approx(math.sqrt(v) if v else first, rel=1e-9) for g, v in zip(got, var, strict=True) if not 0 < v < 1e-290)


def test_prices_must_be_positive(spark):
    with pytest.raises(Exception, match="prices must be positive"):
        labels.ew_volatility(bars(spark, [1.0, 2.0, 0.0, 1.0])).collect()


def test_exponential_means(spark):
    closes = walk(3_000)
    rows = labels.macd_histogram(labels.ema(bars(spark, closes), 9)).orderBy("ts").collect()

    def mean(x, n):
        keep = 1 - 2 / (n + 1)
        top, low = recurrence(x, keep), recurrence([1.0] * len(x), keep)
        return [u / v for u, v in zip(top, low, strict=True)]

    fast, slow = mean(closes, 12), mean(closes, 26)
    line = [u - v for u, v in zip(fast, slow, strict=True)][25:]
    hist = [u - v for u, v in zip(line, mean(line, 9), strict=True)]
    assert [r["ema_9"] is None for r in rows[:10]] == [True] * 8 + [False] * 2
    assert all(r["ema_9"] == pytest.approx(v) for r, v in zip(rows[8:], mean(closes, 9)[8:], strict=True))
    assert all(r["macd_hist"] is None for r in rows[:33])
    assert all(r["macd_hist"] == pytest.approx(v, abs=1e-9) for r, v in zip(rows[33:], hist[8:], strict=True))


def test_given_events_are_labelled_to_the_end(spark):
    rows = bars(spark, [100, 101, 103, 90, 100, 100]).withColumns({"vol": F.lit(0.02), "event": F.col("close") == 100})
    got = {r["event_idx"]: (r["label"], r["touch"], r["barrier"]) for r in labels.triple_barrier(rows, "vol", 1.0, 1.0, 3, events="event").collect()}
    assert got == {0: (1, 2, "pt"), 4: (0, 1, "vertical"), 5: (0, 0, "vertical")}


def test_asof_over_buckets_equals_asof(spark):
    left = spark.createDataFrame([(T0 + timedelta(hours=7 * i), i) for i in range(60)], "ts timestamp, i int")
    right = spark.createDataFrame([(T0 + timedelta(hours=31 * i + 40), i) for i in range(9)], "ts timestamp, v int")
    a, b = joins.asof(left, right, [], "ts", ["v"]), joins.asof_buckets(left, right, "ts", ["v"])
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)


def test_purge_leaves_no_overlap(spark):
    rows = spark.range(200).select(F.col("id").alias("row_idx"), F.least(F.col("id") + 10, F.lit(199)).alias("t1_idx"))
    roles = cv.purged_roles(rows, 5, 0.02)
    test = roles.where("role = 'test'").groupBy("fold").agg(F.min("row_idx").alias("a"), F.max("t1_idx").alias("b"), F.max("row_idx").alias("z"))
    bad = roles.where("role = 'train'").join(test, "fold").where("row_idx <= z AND t1_idx >= a")
    assert bad.count() == 0 and roles.where("role = 'test'").count() == 200


def test_costs_of_round_trips(spark):
    got = {r["venue"]: r["x"] for r in costs.venues(spark).select("venue", costs.round_trip_bps(500.0).alias("x")).collect()}
    for venue, bps in {"alpaca-equity": 3.3, "alpaca-crypto": 64.0, "alpaca-crypto-alts": 94.0, "binance-spot": 24.0, "coinbase-advanced": 125.0}.items():
        assert abs(got[venue] - bps) < 0.5
    column = costs.venues(spark).select("venue", costs.fill_cost(F.lit(123.0), F.lit(3.0), F.lit(True), F.lit(False))["total"].alias("x")).collect()
    for r in column:
        assert abs(r["x"] - costs.array_fill_cost(costs.venue_named(r["venue"]), np.array([123.0]), np.array([3.0]), True)[0]) < 1e-12


def test_book_conserves_equity():
    book = portfolio.Book(2, 500.0, "alpaca-crypto")
    prices = np.array([10.0, 20.0])
    book.rebalance(np.datetime64(T0), prices, np.array([0.5, 0.5]))
    assert abs(book.equity(prices) + book.costs - 500.0) < 1e-9
    assert book.cash >= -1e-9


def test_book_holds_blocks_and_trims():
    now, day = np.datetime64("2025-01-01"), np.timedelta64(1, "D")
    book = portfolio.Book(3, 500.0, "alpaca-crypto", hold_days=2.0)
    prices = np.array([10.0, 20.0, np.nan])
    book.rebalance(now, prices, np.array([1.5, -1.0, np.nan]))
    assert book.trades == 1 and book.qty[1] == book.qty[2] == 0 and 0 <= book.cash < 0.02  # trimmed to the cash
    book.rebalance(now + day, prices, np.array([0.0, 1.0, np.nan]))
    assert book.by_hold == 1 and book.qty[0] > 0
    book.rebalance(now + 3 * day, prices, np.array([0.0, 1.0, np.nan]))
    assert book.qty[0] == 0 and book.qty[1] > 0
    held = book.qty[1]
    book.rebalance(now + 9 * day, np.array([10.0, np.nan, 1.0]), np.array([0.0, 0.0, 0.0]))
    assert book.qty[1] == held  # without a price nothing is sold


def test_settlement_violation(spark):
    d = [datetime(2025, 1, 6).date(), datetime(2025, 1, 7).date()]
    rows = [("x", 1, d[0], d[1], "A", "buy", 5.0, 100.0), ("x", 2, d[0], d[1], "A", "sell", 5.0, 100.0), ("x", 3, d[0], d[1], "B", "buy", 1.0, 300.0), ("x", 4, d[0], d[1], "B", "sell", 1.0, 300.0)]
    fills = spark.createDataFrame(rows, "account string, seq long, day date, settles date, symbol string, side string, qty double, price double")
    got = portfolio.cash_settlement(fills, 500.0).orderBy("seq").collect()
    assert [r["violation"] for r in got] == [False, False, False, True]


def test_tweaker_widens_profit_after_wins(spark):
    rows = spark.createDataFrame([("s", i, 10.0, 0.1) for i in range(5)], "strategy string, seq long, net_pnl double, fees double")
    last = portfolio.tweaker_path(rows).orderBy(F.desc("seq")).first()
    assert abs(last["take_profit_pct"] - 0.029) < 1e-12 and last["volume_threshold"] == 1.3


def test_plan_blocks_without_room(spark):
    rows = spark.createDataFrame([("a", "A", 1, 0.0, False), ("a", "B", 2, 0.0, False), ("a", "C", None, 500.0, True)], "account string, symbol string, rank int, market_value double, locked boolean")
    got = {r["symbol"]: r["action"] for r in portfolio.rebalance_plan(rows, 500.0, 2).collect()}
    assert got == {"A": "blocked", "B": "blocked", "C": "blocked"}


def test_orders_shrink_and_reject(spark):
    base = dict(side="buy", qty=100.0, price=1.0, equity=500.0, position_value=100.0, gross_exposure=0.0, current_qty=0.0, gross_short=0.0, allow_short=False, halted=False, trades_today=0)
    cases = [base, base | {"position_value": 125.0}, base | {"halted": True}, base | {"side": "sell"}, base | {"side": "sell", "current_qty": 40.0}, base | {"side": "sell", "allow_short": True}]
    rows = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(cases)], "i int, side string, qty double, price double, equity double, position_value double, gross_exposure double, current_qty double, gross_short double, allow_short boolean, halted boolean, trades_today int")
    got = {r["i"]: (r["approved"], round(r["approved_qty"], 6)) for r in risk.check_orders(rows).collect()}
    assert got == {0: (True, 25.0), 1: (False, 0.0), 2: (False, 0.0), 3: (False, 0.0), 4: (True, 40.0), 5: (True, 50.0)}


def test_asof_never_looks_forward(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 9, "y")], "k string, t int, v string")
    got = {r["t"]: r["v"] for r in joins.asof(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {1: None, 5: "x", 9: "y"}
    with pytest.raises(Exception, match="nothing at or before"):
        joins.asof(left, right, ["k"], "t", ["v"], strict=True).collect()


def test_symbols(spark):
    row = spark.sql("SELECT 'BTC/USD' a, 'ETHUSDT' b, 'USD' c").select(joins.canonical(F.col("a")), joins.with_slash(F.col("b")), joins.with_slash(F.col("c"))).first()
    assert tuple(row) == ("BTCUSD", "ETH/USDT", "USD")


def test_text(spark):
    row = spark.sql("SELECT 'Record growth, but a lawsuit.' a, '' b, 'GET api_key=123 failed: 429' c").select(text.polarity(F.col("a")), text.polarity(F.col("b")), text.error_status(F.lit(429), F.lit(None)), text.error_status(F.lit(None).cast("int"), F.lit("ReadTimeout")), text.redacted(F.lit("GET /x?key=123&day=4 with s3cret failed"), ["s3cret"])).first()
    assert abs(row[0] - 1 / 3) < 1e-12 and row[1] == 0.0 and row[2] == "rate_limited" and row[3] == "unreachable" and row[4] == "GET /x?key=***&day=*** with *** failed"


def test_polarity_against_words(spark):
    words = ["growth", "'Growth'", "(profit)", "profits", "re-cut", "cut", "CUT!", "x.cut", '"loss".', "...", "beat\tbeat", "risk\nrisk,"]
    texts = [" ".join(words[i:] + words[:i]) for i in range(len(words))] + ["", None, "nothing here"]

    def want(t):
        w = [x.strip(text.STRIPPED).lower() for x in (t or "").split()]
        up, down = sum(x in text.BULLISH for x in w), sum(x in text.BEARISH for x in w)
        return (up - down) / (up + down) if up + down else 0.0

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.polarity(F.col("t")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(want(r["t"])) for r in rows)


def test_statistics(spark):
    assert abs(stats.effective_trials(100, 0.9) - 10.9) < 1e-12
    assert stats.expected_max_sharpe(1, 1.0) == 0.0 and stats.min_track_record(0.0, 0, 3) == math.inf
    assert stats.block_size(10, 0.0) == 5 and stats.block_size(1000, 0.0) == 10
    gate = stats.promotion_gate(0.3, 400, 0.0, 3.0, 1, 0.01)
    assert gate["passed"] and not stats.promotion_gate(0.05, 50, 0.0, 3.0, 500, 0.01)["passed"]
    x = spark.range(41).select(((F.col("id") - 20) / 5).alias("x")).select("x", stats.phi(F.col("x")).alias("p")).collect()
    from statistics import NormalDist

    assert all(abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-6 for r in x)


def test_noise_is_not_overfit_proof_and_an_edge_is(spark):
    noise = spark.range(600).crossJoin(spark.range(8)).toDF("t", "s").select("t", F.col("s").cast("string").alias("strategy"), F.randn(3).alias("ret"))
    noise = noise.withColumn("ret", F.when(F.col("strategy") == "7", F.col("ret") + 0.5).otherwise(F.col("ret"))).cache()
    row = stats.pbo_summary(stats.pbo(noise, 6)).first()
    assert row["splits"] == 20 and row["pbo"] < 0.1 and row["stability"] == 1.0
    with pytest.raises(ValueError, match="two strategies"):
        stats.pbo(noise.where("strategy = '1'"), 6)
    with pytest.raises(ValueError, match="don't fit"):
        stats.pbo(noise.where("t < 20"), 16)


def test_splits_are_thinned_evenly():
    assert len(stats.balanced_splits(10, 5000)) == 252
    some = stats.balanced_splits(16, 5000)
    assert len(set(some)) == 5000 and some == sorted(some) and some[0] == tuple(range(8))


def test_equal_bests_and_losses_at_zero(spark):
    """Of equal strategies the first by name counts; a split that ends at 0 is a loss."""
    rows = spark.range(24).select(F.col("id").alias("t"), F.explode(F.array(*map(F.lit, "ba"))).alias("strategy"), F.lit(0.0).alias("ret"))
    splits = stats.pbo(rows, 4)
    assert {r["best"] for r in splits.collect()} == {"a"}
    assert stats.pbo_summary(splits).first()["loss_probability"] == 1.0


def test_label_shuffle_and_order_rules(spark):
    rows = spark.range(50).select(F.col("id").alias("row_idx"), (F.col("id") % 7).alias("y"))
    got = cv.shuffled_labels(rows, "y", 3).collect()
    assert sorted(r["y"] for r in got) == sorted(i % 7 for i in range(50)) and {r["row_idx"] for r in got} == set(range(50))
    assert any(r["y"] != r["row_idx"] % 7 for r in got)
    cases = [(1.0, None, "market", None, "equity", "day", True), (1.0, 2.0, "market", None, "equity", "day", False), (None, None, "market", None, "equity", "day", False), (1.0, None, "limit", None, "equity", "day", False), (1.0, None, "limit", 3.0, "crypto", "gtc", True), (None, 5.0, "market", None, "crypto", "day", False)]
    df = spark.createDataFrame(cases, "q double, n double, o string, p double, a string, t string, want boolean")
    assert df.where(~risk.valid_order(F.col("q"), F.col("n"), F.col("o"), F.col("p"), F.col("a"), F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_gate_calibration_on_noise(spark):
    series = spark.range(200).select(F.col("id").alias("t"), F.randn(5).alias("ret"))
    got = stats.gate_calibration(series, 10, 8, 5, 200).first()
    assert got["repeats"] == 10 and got["false_promotions"] <= 0.3


def test_ledger_skips_torn_lines(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    (path / "a.json").write_text('{"variant_id": "a", "sharpe": 0.1, "n_observations": 10, "kind": "variant"}\n{"variant_id": "b", "sha\n')
    trials = stores.read_trials(spark, str(path))
    assert [r["variant_id"] for r in trials.collect()] == ["a"]
    assert stats.ledger_metrics(trials).first()["sharpe_variance"] == pytest.approx(0.1)


def test_snapshots_are_strict(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2025, 1, 2).date(), "A"), (datetime(2025, 1, 3).date(), "B")], "snapshot_date date, symbol string")
    stores.write_snapshot(rows, str(tmp_path / "u"))
    got = stores.read_snapshots(spark, str(tmp_path / "u"))
    assert stores.snapshot_asof(got, datetime(2025, 1, 2).date()).first()["symbol"] == "A"
    with pytest.raises(LookupError):
        stores.snapshot_asof(got, datetime(2025, 1, 1).date())
    assert [r[0] for r in joins.delisted(got).collect()] == ["A"]


def test_stream_of_bars_equals_batch(spark, tmp_path):
    from heliobar.sources.bars import from_ticks
    from heliobar.streaming.bars import stream_bars

    rows = [("A" if i % 2 else "B", T0 + timedelta(minutes=7 * i), i, float(i % 11 + 1), 1.0) for i in range(60)]
    rows.append(("A", T0 + timedelta(days=2), 999, 1.0, 1.0))  # moves the watermark beyond the rest
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, tick_id long, price double, volume double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = from_ticks(ticks, 3600, ["tick_id"]).where(F.col("ts") < F.lit(T0 + timedelta(days=1)))
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume", "trade_count"]
    assert sorted(map(tuple, spark.table("bars_out").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
