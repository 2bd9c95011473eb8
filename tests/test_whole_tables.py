"""Queries against their SQL on the smallest tables, whole."""

import duckdb
import pytest

import __spark_entry__

SOURCE = "/root/testdata/sf0.001"
TABLES = ["customer", "part", "orders", "lineitem", "events", "documents", "labels"]
NAMES = [
    "fill_costs", "union_relaxed", "order_risk_check", "forward_fill", "full_outer_macro_panel", "macro_features", "cash_settlement",
    "rebalance_plan", "panel_dataset", "composite_rule", "ew_volatility_short", "pbo_summary", "null_verdict", "trading_calendar",
    "kill_switch_resets", "lake_refresh", "lexicon_polarity", "interp_percentiles", "upper_median",
]


def alike(x, y):
    if isinstance(y, float) and isinstance(x, (int, float)):
        return x == pytest.approx(y, rel=1e-6, abs=2e-4)
    return x == y


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SOURCE}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SOURCE)
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
    b = sorted(want.fetchall(), key=repr)
    assert len(a) == len(b)
    assert all(alike(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def test_macro_scores_look_back_a_year(spark):
    got = __spark_entry__.queries()["macro_features"](spark, SOURCE)
    filled = __spark_entry__.queries()["forward_fill"](spark, SOURCE).orderBy("series_id", "date").toPandas()
    z, scored = {(r["series_id"], r["date"]): r["z"] for r in got.collect()}, 0
    for series, rows in filled.groupby("series_id"):
        last = rows["value"].rolling(252)
        for date, score in zip(rows["date"], (rows["value"] - last.mean()) / last.std(), strict=True):
            assert z[series, date] is None if score != score else z[series, date] == pytest.approx(score, abs=2e-4)
            scored += score == score
    assert scored > 1000
