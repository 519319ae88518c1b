"""Sums of parts: a made series taken apart, classes that hang on one part, folds whatever the partitions."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators import additive, learning

START = datetime(2024, 1, 1)


def test_parts_of_a_made_series_are_found(spark):
    """A line and a wave of period 12 in two folds of other size and slope: each part comes back, the sum is the value, and no part is made up."""
    rng, rows, made = np.random.default_rng(4), [], {}
    for symbol, slope, height in (("A", 0.05, 2.0), ("B", -0.2, 0.0)):
        for k in range(240):
            wave = height * np.sin(2 * np.pi * k / 12 + 0.4)
            made[symbol, START + timedelta(hours=k)] = (slope * k, wave)
            rows.append((symbol, START + timedelta(hours=k), float(50 + slope * k + wave + 0.1 * rng.normal()), 1))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, other int")
    got = additive.parts(df).collect()
    assert len(got) == 480 and {r.fold for r in got} == {0, 1}
    assert all(r.level + r.linear + r.periodic + r.smooth + r.rest == pytest.approx(r.value, abs=1e-9) for r in got)
    assert max(abs(r.periodic - made[r.symbol, r.ts][1]) for r in got) < 0.2
    trend = lambda r: r.level + r.linear + r.smooth - 50
    assert max(abs(trend(r) - made[r.symbol, r.ts][0]) for r in got) < 0.3 and max(abs(r.rest) for r in got) < 0.6
    again = {(r.symbol, r.ts): r for r in additive.parts(df.repartition(7)).collect()}
    assert all(abs(again[r.symbol, r.ts].smooth - r.smooth) < 1e-9 for r in got)


def test_short_flat_and_missing(spark):
    rows = [("A", START + timedelta(hours=k), 5.0) for k in range(20)] + [("B", START, 1.0), ("B", START + timedelta(hours=1), None)]
    got = additive.parts(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")).collect()
    assert len(got) == 21 and all(r.level == pytest.approx(5) and abs(r.rest) < 1e-6 for r in got if r.symbol == "A")
    assert [(r.value, r.level, r.rest) for r in got if r.symbol == "B"] == [(1.0, None, None)]
    assert additive.parts(spark.createDataFrame([], "symbol string, ts timestamp_ntz, close double")).count() == 0


def test_the_most_likely_variances():
    """Another variance of a part's prior makes normal values less likely."""
    rng = np.random.default_rng(6)
    t = np.arange(60.0)
    f, part = additive.functions_of(((t - 30) / 15)[:, None], t, 12)
    y = np.sin(2 * np.pi * t / 12) + 0.3 * rng.normal(size=60)
    fitted = additive.Fitted(f, part, y, classes=False, rounds=300)

    def likelihood(variance, noise):
        c = (f * np.where(part < 0, 1e4, variance[part])) @ f.T + noise * np.eye(60)
        return -0.5 * (np.linalg.slogdet(c)[1] + y @ np.linalg.solve(c, y))

    best = likelihood(fitted.variance, fitted.noise)
    assert likelihood(fitted.variance * [1, 2, 1], fitted.noise) < best and likelihood(fitted.variance * [1, 0.5, 1], fitted.noise) < best
    assert likelihood(fitted.variance, fitted.noise * 1.5) < best and likelihood(fitted.variance, fitted.noise / 1.5) < best
    assert fitted.variance[1] > 10 * fitted.variance[0]


def test_classes_that_come_round(spark):
    """Classes by the place in a period of 12 rows: the sum of parts finds them, the linear model of the sequence can't."""
    rng = np.random.default_rng(8)
    rows = [("A", START + timedelta(hours=k), rng.normal(size=3).tolist(), (k % 12) // 4) for k in range(160)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, sequence array<double>, label int")
    right = lambda kind: np.mean([r.label == r.prediction for r in learning.walk_forward(df, 48, 3, kind).collect()])
    assert right("kernels") > 0.9 and right("linear") < 0.7
    one, many = ({(r.fold, r.prediction) for r in learning.walk_forward(df.repartition(n), 48, 3, "kernels").collect()} for n in (1, 5))
    assert one == many and len(one) == len({f for f, _ in one}) == 38
