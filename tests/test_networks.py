"""Networks: gradients against differences, what they learn, the same draws whatever the partitions."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators import networks


def differences(loss, values, grads):
    for v, g in zip(values, grads):
        for at in list(np.ndindex(v.shape))[:12]:
            old, around = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = old + step
                around.append(loss())
            v[at] = old
            assert (around[0] - around[1]) / 2e-5 == pytest.approx(g[at], abs=1e-6, rel=1e-4)


def test_gradients_of_dropout():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    net = networks.Dropout(3, rng, (5, 4), 0.3)
    for _, b in net.weights:  # away from the kink of units whose inputs are all dropped
        b[:] = rng.normal(size=b.shape)
    masks = net.masks(20)
    grads = [g for pair in networks.gradients(net.weights, x, y, masks) for g in pair]
    differences(lambda: networks.loss_of(networks.forward(net.weights, x, masks)[0], y), [v for pair in net.weights for v in pair], grads)


def test_gradients_of_distributions():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    net = networks.Variational(3, rng, (4,), prior=0.7)
    noise = net.noise()
    loss = lambda: networks.loss_of(networks.forward(net.drawn(noise), x)[0], y) + net.divergence() / len(x)
    values = [v for pair in net.mean for v in pair] + [v for pair in net.spread for v in pair]
    differences(loss, values, net.slopes(x, y, noise))


def test_gradients_through_the_steps():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(12, 8)), rng.integers(0, 2, 12).astype(float)
    net = networks.Recurrent(8, rng, steps=4, hidden=(3, 2), dense=4, rate=0.3)
    net.head[0][1][:] = rng.normal(size=4)
    masks = net.masks(12)
    differences(lambda: networks.loss_of(net.run(x, masks)[0], y), net.values(), net.slopes(x, y, masks))
    with pytest.raises(ValueError):
        networks.Recurrent(7, rng, steps=4)


def test_stops_and_puts_the_best_back():
    value, losses = [np.array([0.0])], iter([5.0, 3.0, 4.0, 4.0, 4.0, 1.0])

    def step():
        value[0][0] += 1

    assert networks.until_worse(value, step, lambda: next(losses), 10, 3) == 2 and value[0][0] == 2


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = np.random.default_rng(3), []
    for symbol in "AB":
        for k in range(150):
            u, v = rng.normal(size=2).tolist()
            rows.append((symbol, datetime(2024, 1, 1) + timedelta(hours=k), u, v if k != 7 else None, int(u + 0.1 * rng.normal() > 0)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, u double, v double, target int")


@pytest.mark.parametrize("kind", ["dropout", "variational"])
def test_folds_learn_and_do_not_depend_on_partitions(table, kind):
    runs = [{(r.symbol, r.fold, r.ts): r for r in networks.walk_forward(table.repartition(n), ["u", "v"], kind, samples=30).collect()} for n in (1, 6)]
    assert runs[0].keys() == runs[1].keys() and all(abs(r.probability - runs[1][k].probability) < 1e-9 and abs(r.uncertainty - runs[1][k].uncertainty) < 1e-9 for k, r in runs[0].items())
    got = list(runs[0].values())
    assert len(got) == 2 * (149 - 80) and {r.fold for r in got} == {0, 1, 2, 3}
    assert np.mean([r.prediction == r.target for r in got]) > 0.85 and all(r.uncertainty > 0 and 0.5 <= r.confidence <= 1 and 0 < r.epochs <= 300 for r in got)


def test_sequences_are_read_in_order(spark):
    """The class follows from the value three rows before alone: a recurrent network learns it from the rows before, whatever the partitions."""
    rng, rows = np.random.default_rng(5), []
    for symbol in "AB":
        u = rng.normal(size=240).tolist()
        rows += [(symbol, datetime(2024, 1, 1) + timedelta(hours=k), u[k], 2.0 * k, int(u[k - 3] > 0)) for k in range(240)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, u double, v double, target int")
    table = networks.sequences(bars, ["u", "v"], 4)
    third = {r.ts: r.sequence for r in table.where("symbol = 'A'").collect()}
    assert len(third) == 236 and third[rows[4][1]] == [x for k in range(4) for x in rows[k][2:4]]
    cut = table.select("symbol", "ts", "target", networks.F.expr("filter(sequence, (x, i) -> i % 2 = 0)").alias("s"))
    fit = lambda n: {(r.symbol, r.fold, r.ts): r for r in networks.walk_forward(cut.repartition(n), "s", "recurrent", train=160, step=76, samples=30, form={"steps": 4}).collect()}
    one, six = fit(1), fit(6)
    assert one.keys() == six.keys() and all(abs(r.probability - six[k].probability) < 1e-9 for k, r in one.items())
    assert len(one) == 2 * 76 and np.mean([r.prediction == r.target for r in one.values()]) > 0.8


def test_report(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 0)] * 4 + [(0, 1)] + [(2, 1)] + [(None, 1), (1, None)]
    got = {r["class"]: r for r in networks.report(spark.createDataFrame(rows, "target int, prediction int")).collect()}
    assert (got[1].precision, got[1].recall, got[1].support) == (3 / 5, 3 / 5, 5) and got[1].f1 == pytest.approx(0.6)
    assert (got[0].precision, got[0].recall) == (4 / 6, 4 / 5) and (got[2].precision, got[2].recall, got[2].f1) == (None, 0, 0)
    assert all(math.isclose(r.accuracy, 7 / 11) for r in got.values())
    assert networks.report(spark.createDataFrame([], "target int, prediction int")).count() == 0
