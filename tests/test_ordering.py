"""Blocked windows against plain Python, with blocks far smaller than the data."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tideglass.functions.ordering import Running, last_rows, numbered, order_statistic, running, sliding_sum


def rows(seed: int, n: int = 200):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(50)])) for i in rng.sample(range(1, 4 * n), n)]


def test_running_aggregates(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "o long, k string, v long")
    specs = {"s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), False), "l": Running("last", F.col("v"), False), "c": Running("count", F.col("v"))}
    got = {r["o"]: r for r in running(df, ["k"], "o", specs, block=7).collect()}
    seen: dict = {}
    for o, k, v in sorted(data):
        before = seen.setdefault(k, [])
        known = [x for x in before if x is not None]
        assert got[o]["m"] == max(known, default=None)
        assert got[o]["l"] == (known[-1] if known else None)
        before.append(v)
        known = [x for x in before if x is not None]
        assert got[o]["s"] == sum(known) and got[o]["c"] == len(known)


def test_last_rows(spark):
    data = [(o, k, v or 0) for o, k, v in rows(2)]
    df = spark.createDataFrame(data, "o long, k string, v long")
    got = {r["o"]: (r["s"], r["p"], r["__n"]) for r in last_rows(df, ["k"], "o", 5, {"s": sliding_sum(F.col("v"), 5), "p": lambda w: F.lag("v").over(w)}, block=8).collect()}
    seen: dict = {}
    for o, k, v in sorted(data):
        before = seen.setdefault(k, [])
        last = before[-1] if before else None
        before.append(v)
        assert got[o] == (sum(before[-5:]), last, len(before))


def test_numbered_empty(spark):
    assert numbered(spark.createDataFrame([], "o long"), [], "o", "n").collect() == []


def test_order_statistic(spark):
    df = spark.createDataFrame([("a", v) for v in [5, 1, 3, 3, 9]] + [("b", 4), ("c", None)], "k string, v long")
    got = {r["k"]: (r["x"], r["n"]) for r in order_statistic(df, ["k"], "v", F.floor(F.col("n") * 50 / 100).cast("long"), "x").collect()}
    assert got == {"a": (3, 5), "b": (4, 1)}
