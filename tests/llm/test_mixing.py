from collections import Counter, defaultdict

import pytest

from heliobar.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def brute_force(keys, weights, cap=3.0):
    """Times that each unit's copies are taken, by the rule: hash order, what doesn't fit is passed over."""
    sizes = defaultdict(int)
    for source, _, size in keys:
        sizes[source] += size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    target = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], cap), strict=True))
    out = Counter()
    for s in names:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        room = target[s] - whole * sizes[s]
        for k, size in sorted(((k, n) for x, k, n in keys if x == s and n), key=lambda x: (x[0] % mixing.BUCKETS, *x)):
            fits = size <= room
            room -= size * fits
            out[s, k, size, whole + fits] += 1
        for k, size in ((k, n) for x, k, n in keys if x == s and not n):
            out[s, k, size, 0] += 1
    return target, out


def check(spark, rows, weights):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keys = [(r["source"], r["key"], r["size"]) for r in mixing.keyed(docs, 17).collect()]
    target, want = brute_force(keys, weights)
    mixed = mixing._mixed(docs, weights, 3.0, 17, "doc_id").collect()
    key = {(*r["row"],): r["key"] for r in mixing.keyed(docs, 17).collect()}
    got = Counter((r["row"]["source"], key[(*r["row"],)], r["size"], r["repeats"]) for r in mixed)
    assert got == want
    assert all(r["target"] == pytest.approx(target[r["row"]["source"]]) for r in mixed)
    return target, mixed


def test_a_long_text_at_the_threshold_leaves_no_gap(spark):
    """A text of half of what is taken stands in the order; the rows behind it fill the target all the same."""
    rows = [(i, "ab"[i % 2], "w " * (1500 if i % 90 == 0 else 5 + i % 11)) for i in range(800)]
    target, mixed = check(spark, rows, (1.0, 3.0))
    for s in "ab":
        assert 0 <= target[s] - sum(r["size"] * r["repeats"] for r in mixed if r["row"]["source"] == s) < 5


def test_copies_of_a_row_are_taken_one_by_one(spark):
    rows = [(1, "a", "one two three four five")] * 40 + [(2, "b", "x " * 1000)] + [(None, None, "z y")] * 7 + [(3, "c", ""), (3, "c", None)]
    target, mixed = check(spark, rows, (1.0, 20.0))
    taken = Counter()
    for r in mixed:
        taken[r["row"]["source"]] += r["size"] * r["repeats"]
    assert len(mixed) == len(rows) and 0 <= target["a"] - taken["a"] < 5


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_rows_that_share_an_id_have_their_own_fates(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(i % 5, "s", f"w{i} " * (3 + i % 4)) for i in range(200)] + [(0, "t", "u " * 900)]
    check(spark, rows, (1.0, 5.0))


def test_more_sources_than_a_list_holds(spark):
    rows = [(i, f"s{i:04d}", "w " * (1 + i % 50)) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["source"]: r["target"] for r in mixing.mix_sources(docs).collect()}
    want = mixing.water_fill([1 + i % 50 for i in range(1500)], [1.0 + i % 3 for i in range(1500)], 3.0)
    assert [got[f"s{i:04d}"] for i in range(1500)] == pytest.approx(want)


def test_columns_that_clash_stay(spark):
    names = ["_key", "_source", "key", "row", "bucket", "parts", "whole", "n", "block", "size", "taken"]
    docs = spark.createDataFrame([(1, "a", "b c", *names)], f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix_sources(docs).first().asDict()
    assert all(got[n] == n for n in names if n not in mixing.MEASURES)
    assert (got["size"], got["taken"], got["source_size"]) == (2, 2, 2)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
