"""Innermost intervals by a sweep, against every pair."""

import random

import pytest

from lodestar.operators import intervals


def want(points, spans):
    out = []
    for key, at, tag in points:
        hits = [s for s in spans if None not in (key, at, s[1], s[2]) and s[0] == key and s[1] <= at <= s[2]]
        best = min(hits, key=lambda s: (s[2] - s[1], -s[1], s[3]), default=None)
        out.append((tag, None if best is None else best[2] - best[1], None if best is None else best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "chunk_rows"), [(0, 7), (1, 7), (1, 40), (2, 40), (2, 10**6)])
def test_innermost(spark, seed, chunk_rows):
    r = random.Random(seed)
    key = lambda: r.choice(["a"] * 8 + ["b", None])
    place = lambda: r.choice([None] + [r.randrange(100)] * 12)
    points = [(key(), place(), k) for k in range(150)]
    spans = [(key(), lo := place(), None if lo is None else lo + r.choice([-1, 0, 1, 5, 60, 99]), k) for k in range(60)] + [("a", 0, 99, 99), ("a", 0, 99, 99), ("b", 50, 50, 98)]
    left = spark.createDataFrame(points, "key string, at int, tag int")
    right = spark.createDataFrame(spans, "key string, lo int, hi int, name int")
    got = intervals.innermost(left, right, ["key"], "at", "lo", "hi", chunk_rows=chunk_rows)
    assert got.columns == ["key", "at", "tag", "lo", "hi", "name"]
    assert sorted(((q["tag"], None if q["lo"] is None else q["hi"] - q["lo"], q["lo"]) for q in got.collect()), key=str) == want(points, spans)


def test_innermost_of_nothing(spark):
    left, right = spark.createDataFrame([("a", 1)], "key string, at int"), spark.createDataFrame([], "key string, lo int, hi int")
    assert [tuple(q) for q in intervals.innermost(left, right, ["key"], "at", "lo", "hi").collect()] == [("a", 1, None, None)]
    assert intervals.innermost(left.limit(0), left.selectExpr("key", "at AS lo", "at AS hi"), ["key"], "at", "lo", "hi").count() == 0


def test_a_hot_key_is_dealt_out(spark):
    """All points lie under one wide interval of one key, which sends one row to each chunk at most."""
    points = spark.range(5000).selectExpr("'k' AS key", "id AS at")
    spans = spark.createDataFrame([("k", -1, 10_000)] + [("k", 100 * k, 100 * k + 9) for k in range(50)], "key string, lo long, hi long")
    got = intervals.innermost(points, spans, ["key"], "at", "lo", "hi", chunk_rows=200).groupBy("lo").count().collect()
    assert {q["lo"]: q["count"] for q in got} == {-1: 4500} | {100 * k: 10 for k in range(50)}


def test_equal_intervals_go_by_their_other_columns(spark):
    """Of intervals with equal bounds the one with the least other columns is told, wherever it lies."""
    left = spark.createDataFrame([("a", 5, k) for k in range(4)], "key string, at int, tag int")
    spans = [("a", 0, 9, name, n) for name, n in (("z", 1), ("m", 2), (None, 0), ("c", 7), ("c", 3), ("x", 0))]
    for some in (spans, spans[::-1]):
        right = spark.createDataFrame(some, "key string, lo int, hi int, name string, n int").repartition(3, "name")
        got = intervals.innermost(left, right, ["key"], "at", "lo", "hi").collect()
        assert {(q["name"], q["n"]) for q in got} == {("c", 3)} and len(got) == 4
