"""Distributed exact percentile_cont against numpy's linear interpolation."""

import random

import numpy as np
import pytest

from tracelens.operators.quantiles import percentile_cont


def test_percentile_cont_matches_numpy(spark):
    rng = random.Random(11)
    rows = []
    for i in range(4000):
        g = "hot" if i % 3 else f"g{rng.randint(0, 9)}"  # one group holds two thirds
        rows.append((g, float(rng.randint(0, 500)) / 7 if i % 5 else None))
    rows.append(("single", 4.5))
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in percentile_cont(df, ["g"], "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0},
                                           pieces=7).collect()}
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert set(got) == set(by)
    for g, xs in by.items():
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p0", 0.0), ("p100", 1.0)):
            assert getattr(got[g], name) == pytest.approx(float(np.percentile(xs, p * 100)), rel=1e-12, abs=1e-12), (g, name)


def test_percentile_cont_global_group(spark):
    xs = [float(i * i % 97) for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = percentile_cont(df, [], "x", {"p50": 0.5, "p99": 0.99}, pieces=16).first()
    assert r.p50 == pytest.approx(float(np.percentile(xs, 50))) and r.p99 == pytest.approx(float(np.percentile(xs, 99)))


def test_ties_of_two_thirds(spark):
    xs = [0.0] * 2000 + [float((i * 37) % 101) for i in range(1000)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 3.0)], "g string, x double")
    got = {r.g: (r.p50, r.p95) for r in percentile_cont(df, ["g"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got["a"] == pytest.approx((float(np.percentile(xs, 50)), float(np.percentile(xs, 95))))
    assert got["b"] == (3.0, 3.0)
