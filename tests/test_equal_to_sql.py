"""Queries against their SQL on small tables of their own, to the last digit."""

import duckdb

import __spark_entry__
from heliobar.functions import indicators as ind
from heliobar.operators import cv
from heliobar.plans.common import hourly


def both(spark, folder, name, table, rows, columns, stored=None):
    """Rows of the SQL over ``rows`` and of the query over ``stored``, the same rows as they lie in the file."""
    path = str(folder / f"{table}.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    values = lambda given: f"SELECT * FROM (VALUES {', '.join(map(str, given))}) t({columns})"
    con.sql(f"COPY ({values(stored or rows)}) TO '{path}' (FORMAT parquet)")
    con.sql(f"CREATE TABLE {table} AS {values(rows)}")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(repr(tuple(r)) for r in got.collect()), sorted(map(repr, want.fetchall()))


def test_rebalance_plan_adds_orders_by_their_key(spark, tmp_path):
    totals = [(15980.11, 18076.42, 341549.47), (326427.73, 240437.69, 218277.58), (223222.58, 308457.11, 315496.31)]
    totals += [(141318.58, 407443.92, 227311.5), (411792.38, 270995.54, 148509.08), (367074.12, 485947.81, 17651.07)]
    orders = [(10 * a + k, a, "1-URGENT", f"{v}::DOUBLE") for a, group in enumerate(totals) for k, v in enumerate(group)]
    orders = [f"({k}, {a}, '{p}', {v})" for k, a, p, v in orders]
    columns = "o_orderkey, o_custkey, o_orderpriority, o_totalprice"
    a, b = both(spark, tmp_path, "rebalance_plan", "orders", orders, columns, orders[::-1])
    assert len(a) == 6 and a == b


EVENT = "event_id, ts, event_type, value"


def events(hours):
    """Two events an hour of one type: (first value, last value) of each hour."""
    at = lambda i, minute: f"TIMESTAMP '2024-01-01' + INTERVAL {i} HOUR + INTERVAL {minute} MINUTE"
    return [f"({2 * i + k}, {at(i, 10 + k)}, 'view', {v}::DOUBLE)" for i, pair in enumerate(hours) for k, v in enumerate(pair)]


def walk(n):
    return [(20 + (i * 37 % 23) / 4, 15 + (i * 53 % 29) / 8) for i in range(n)]


def test_parkinson_of_a_range_from_zero(spark, tmp_path):
    hours = walk(120)
    hours[5], hours[60] = (0.0, 7.5), (0.0, 0.0)  # a low of zero, and a range of nothing but zero
    a, b = both(spark, tmp_path, "ind_parkinson", "events", events(hours), EVENT)
    assert a == b and sum("inf" in r for r in a) == 6 and sum("nan" in r for r in a) == 20


def test_audit_takes_infinite_features_for_missing(spark, tmp_path):
    hours = walk(60)
    hours[25] = (0.0, 7.5)
    both(spark, tmp_path, "ind_parkinson", "events", events(hours), EVENT)
    bars = hourly(spark, str(tmp_path))
    assert cv.audit(bars, lambda df: ind.compute(df, [ind.parkinson_vol(20)]), ["parkinson_20"], [30, 50])["leaking"] == []


def test_default_features_where_a_close_is_zero(spark, tmp_path):
    hours = walk(240)
    hours[30], hours[120] = (9.0, 0.0), (0.0, 0.0)
    a, b = both(spark, tmp_path, "features_default", "events", events(hours), EVENT)
    assert len(a) == 240 and a == b
    assert sum("inf" in r for r in a) > 100 and sum("nan" in r for r in a) > 100


def test_default_features_round_as_sql(spark, tmp_path):
    hours = walk(70)
    hours[2], hours[62] = (5.0, 6.4), (5.0, 59.83)  # 59.83 / 6.4 - 1 lies next to 8.3484375
    a, b = both(spark, tmp_path, "features_default", "events", events(hours), EVENT)
    assert a == b and any("8.348437," in r for r in a)
