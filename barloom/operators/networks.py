"""Small Bayesian classifiers, fitted fold by fold: a network with dropout in training and prediction, one with distributions for weights, and
a recurrent one with dropout that reads the rows before.

A fold is a window of ``train`` rows of a symbol and the ``step`` rows after it, so a group is bounded whatever the series; folds are the
work of many tasks. The last fifth of a fold's training rows (by time) stops the fit: the weights with the least loss there stay.
Random numbers follow from the seed, the symbol and the fold alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.slices import place
from barloom.operators.labels import windows_before

Weights = list[tuple[np.ndarray, np.ndarray]]
FORM = "symbol string, fold long, ts timestamp_ntz, target int, probability double, uncertainty double, prediction int, confidence double, epochs int"


def started(sizes: list[int], rng: np.random.Generator) -> Weights:
    return [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def forward(weights: Weights, x: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The log odds of each row, and the inputs of each layer; hidden units are cut at zero and, with ``masks``, dropped or enlarged."""
    inputs = [x]
    for k, (w, b) in enumerate(weights):
        x = x @ w + b
        if k < len(weights) - 1:
            x = np.maximum(x, 0)
            if masks is not None:
                x = x * masks[k]
            inputs.append(x)
    return x[:, 0], inputs


def loss_of(odds: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, odds) - y * odds))


def gradients(weights: Weights, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray] | None = None) -> Weights:
    """Of ``loss_of``, by each weight."""
    odds, inputs = forward(weights, x, masks)
    return backward(weights, inputs, slope_of(odds, y), masks)[0]


def slope_of(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of ``loss_of``, by the log odds of each row."""
    return (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - y) / len(y)


def backward(weights: Weights, inputs: list[np.ndarray], slope: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[Weights, np.ndarray]:
    """Gradients by each weight and by the first input, from those by the log odds."""
    back, out = slope[:, None], []
    for k in range(len(weights) - 1, -1, -1):
        out.append((inputs[k].T @ back, back.sum(axis=0)))
        if k:
            back = (back @ weights[k][0].T) * (inputs[k] > 0)
            if masks is not None:
                back = back * masks[k - 1]
    return out[::-1], back @ weights[0][0].T


class Adam:
    def __init__(self, values: list[np.ndarray], rate: float) -> None:
        self.values, self.rate, self.t = values, rate, 0
        self.first, self.second = ([np.zeros_like(v) for v in values] for _ in range(2))

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for v, g, m, s in zip(self.values, grads, self.first, self.second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)


def until_worse(values: list[np.ndarray], step: Callable[[], None], loss: Callable[[], float], epochs: int, patience: int) -> int:
    """Steps until ``loss`` hasn't fallen for ``patience`` of them; the values with the least loss are put back. The number of steps that led to them."""
    best, kept, at = np.inf, [v.copy() for v in values], 0
    for epoch in range(1, epochs + 1):
        step()
        now = loss()
        if now < best - 1e-6:
            best, kept, at = now, [v.copy() for v in values], epoch
        elif epoch - at >= patience:
            break
    for v, k in zip(values, kept):
        v[...] = k
    return at


class Dropout:
    """A network whose hidden units are dropped with probability ``rate``, in training and in each sample of a prediction."""

    def __init__(self, width: int, rng: np.random.Generator, hidden: tuple[int, ...] = (16, 8), rate: float = 0.2) -> None:
        self.weights, self.rng, self.hidden, self.rate = started([width, *hidden, 1], rng), rng, hidden, rate

    def masks(self, rows: int) -> list[np.ndarray]:
        return [(self.rng.random((rows, n)) >= self.rate) / (1 - self.rate) for n in self.hidden]

    def fit(self, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 300, patience: int = 20, pace: float = 0.01) -> int:
        values = [v for pair in self.weights for v in pair]
        adam = Adam(values, pace)
        step = lambda: adam.step([g for pair in gradients(self.weights, x, y, self.masks(len(x))) for g in pair])
        return until_worse(values, step, lambda: loss_of(forward(self.weights, xv)[0], yv), epochs, patience)

    def sample(self, x: np.ndarray) -> np.ndarray:
        return forward(self.weights, x, self.masks(len(x)))[0]


class Variational:
    """A network whose weights are normal distributions, learned by reparametrised samples against a normal prior."""

    def __init__(self, width: int, rng: np.random.Generator, hidden: tuple[int, ...] = (8,), prior: float = 1.0) -> None:
        self.mean = started([width, *hidden, 1], rng)
        self.spread: Weights = [(np.full_like(w, -4.0), np.full_like(b, -4.0)) for w, b in self.mean]  # before softplus
        self.rng, self.prior = rng, prior

    def noise(self) -> Weights:
        return [(self.rng.normal(size=w.shape), self.rng.normal(size=b.shape)) for w, b in self.mean]

    def drawn(self, noise: Weights) -> Weights:
        return [tuple(m + np.logaddexp(0, s) * e for m, s, e in zip(*layer)) for layer in zip(self.mean, self.spread, noise)]  # type: ignore[misc]

    def divergence(self) -> float:
        """Of the weights' distributions from the prior."""
        out = 0.0
        for m, r in ((m, r) for layer in zip(self.mean, self.spread) for m, r in zip(*layer)):
            s = np.logaddexp(0, r) / self.prior
            out += float(np.sum(0.5 * (s * s + (m / self.prior) ** 2 - 1) - np.log(s)))
        return out

    def slopes(self, x: np.ndarray, y: np.ndarray, noise: Weights) -> list[np.ndarray]:
        """Gradients of the loss of a draw, and of the divergence shared out over the rows, by all means and then by all spreads."""
        by_weight = [g for pair in gradients(self.drawn(noise), x, y) for g in pair]
        flat = [(m, r, e) for layer in zip(self.mean, self.spread, noise) for m, r, e in zip(*layer)]
        means, spreads = [], []
        for g, (m, r, e) in zip(by_weight, flat):
            s, slope = np.logaddexp(0, r), 1 / (1 + np.exp(-r))
            means.append(g + m / self.prior**2 / len(x))
            spreads.append((g * e + (s / self.prior**2 - 1 / s) / len(x)) * slope)
        return means + spreads

    def fit(self, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 300, patience: int = 30, pace: float = 0.02) -> int:
        values = [v for pair in self.mean for v in pair] + [v for pair in self.spread for v in pair]
        adam = Adam(values, pace)
        return until_worse(values, lambda: adam.step(self.slopes(x, y, self.noise())), lambda: loss_of(forward(self.mean, xv)[0], yv), epochs, patience)

    def sample(self, x: np.ndarray) -> np.ndarray:
        return forward(self.drawn(self.noise()), x)[0]


def _squash(a: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * a)


def gated(w: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The outputs of a layer of cells with input, forget and output gates over ``x`` (row, step, channel), and what its gradients need."""
    m = len(b) // 4
    h = c = np.zeros((len(x), m))
    out, kept = [], []
    for t in range(x.shape[1]):
        z = np.concatenate([x[:, t], h], axis=1)
        a = z @ w + b
        gates, new = _squash(a[:, : 3 * m]), np.tanh(a[:, 3 * m :])
        take, keep, show = gates[:, :m], gates[:, m : 2 * m], gates[:, 2 * m :]
        before, c = c, keep * c + take * new
        shown = np.tanh(c)
        h = show * shown
        out.append(h)
        kept.append((z, take, keep, show, new, before, shown))
    return np.stack(out, axis=1), kept


def gated_back(w: np.ndarray, kept: list[tuple], slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients by weights, offsets and inputs of ``gated``, through all steps, from those by its outputs."""
    n, steps, m = slope.shape
    channels = len(w) - m
    by_w, by_b, by_x = np.zeros_like(w), np.zeros(w.shape[1]), np.empty((n, steps, channels))
    by_h = by_c = np.zeros((n, m))
    for t in range(steps - 1, -1, -1):
        z, take, keep, show, new, before, shown = kept[t]
        d = slope[:, t] + by_h
        dc = by_c + d * show * (1 - shown**2)
        da = np.concatenate([dc * new * take * (1 - take), dc * before * keep * (1 - keep), d * shown * show * (1 - show), dc * take * (1 - new**2)], axis=1)
        by_w += z.T @ da
        by_b += da.sum(axis=0)
        back = da @ w.T
        by_x[:, t], by_h, by_c = back[:, :channels], back[:, channels:], dc * keep
    return by_w, by_b, by_x


class Recurrent:
    """Two layers of gated cells over the ``steps`` rows before, then a network with one hidden layer; the outputs of all layers are dropped
    with probability ``rate``, in training and in each sample. A row is its steps one after the other, each of width / steps values."""

    def __init__(self, width: int, rng: np.random.Generator, steps: int = 10, hidden: tuple[int, int] = (8, 8), dense: int = 8, rate: float = 0.2) -> None:
        if width % steps:
            raise ValueError("a row has to hold as many values in each step")
        self.steps, self.hidden, self.dense, self.rate, self.rng = steps, hidden, dense, rate, rng
        sizes = [width // steps, *hidden]
        self.cells: Weights = []
        for a, m in zip(sizes, hidden):
            offset = np.zeros(4 * m)
            offset[m : 2 * m] = 1  # cells remember at first
            self.cells.append((rng.normal(0, np.sqrt(1 / (a + m)), (a + m, 4 * m)), offset))
        self.head = started([hidden[-1], dense, 1], rng)

    def values(self) -> list[np.ndarray]:
        return [v for pair in [*self.cells, *self.head] for v in pair]

    def masks(self, rows: int) -> list[np.ndarray]:
        return [(self.rng.random((rows, n)) >= self.rate) / (1 - self.rate) for n in (*self.hidden, self.dense)]

    def run(self, x: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray], list[list[tuple]]]:
        """The log odds, the inputs of the network on top, and what the cells kept. A unit is dropped in all steps or in none."""
        series, kept = x.reshape(len(x), self.steps, -1), []
        for k, (w, b) in enumerate(self.cells):
            series, memory = gated(w, b, series)
            if masks is not None:
                series = series * masks[k][:, None]
            kept.append(memory)
        odds, inputs = forward(self.head, series[:, -1], masks and masks[2:])
        return odds, inputs, kept

    def slopes(self, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Gradients of the loss, in the order of ``values``."""
        odds, inputs, kept = self.run(x, masks)
        on_top, last = backward(self.head, inputs, slope_of(odds, y), masks and masks[2:])
        slope = np.zeros((len(x), self.steps, self.hidden[-1]))
        slope[:, -1] = last
        out: Weights = []
        for k in range(len(self.cells) - 1, -1, -1):
            if masks is not None:
                slope = slope * masks[k][:, None]
            by_w, by_b, slope = gated_back(self.cells[k][0], kept[k], slope)
            out.append((by_w, by_b))
        return [g for pair in [*out[::-1], *on_top] for g in pair]

    def fit(self, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 200, patience: int = 20, pace: float = 0.02) -> int:
        adam = Adam(self.values(), pace)
        return until_worse(adam.values, lambda: adam.step(self.slopes(x, y, self.masks(len(x)))), lambda: loss_of(self.run(xv)[0], yv), epochs, patience)

    def sample(self, x: np.ndarray) -> np.ndarray:
        return self.run(x, self.masks(len(x)))[0]


KINDS = {"dropout": Dropout, "variational": Variational, "recurrent": Recurrent}


def sequences(df: DataFrame, columns: list[str], steps: int = 10, label: str = "target") -> DataFrame:
    """(symbol, ts, sequence, ``label``): the ``columns`` of the ``steps`` rows before each row, one row after the other in one array."""
    one = df.withColumn("__row", F.array(*[F.col(c).cast("double") for c in columns]))
    return windows_before(one, steps, "__row", label).withColumn("sequence", F.flatten("sequence"))


def folds(df: DataFrame, train: int, step: int) -> DataFrame:
    """Each row under the ``fold`` (and ``__rn``) of every window that it trains or tests: fold f trains on rows f * step and the ``train`` - 1 after it."""
    rows = df.withColumn("__rn", place(df))
    first = F.greatest(F.floor((F.col("__rn") - train - step) / step) + 1, F.lit(0))
    return rows.withColumn("fold", F.explode(F.sequence(first, F.floor(F.col("__rn") / step))))


def walk_forward(df: DataFrame, columns: list[str] | str, kind: str = "dropout", train: int = 80, step: int = 20, samples: int = 100, seed: int = 42, form: dict | None = None) -> DataFrame:
    """Predictions of the test rows of all folds: mean and spread of the probability of class 1 over ``samples`` draws of one fit.

    Needs ``target`` (0 or 1); rows with a missing column are left out. A fold needs all its ``train`` rows and one to test.
    ``columns`` may name one array of doubles, of one length in all rows; ``form`` has further arguments of the network. Columns are centred and scaled by the training rows. ``epochs`` is how long the fit went on to the weights that were kept.
    """
    x = F.col(columns) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    asked = df.select("symbol", "ts", F.col("target").cast("int").alias("target"), x.alias("__x")).where(~F.exists("__x", lambda v: v.isNull() | F.isnan(v)) & F.col("target").isNotNull())

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        symbol, fold = key
        p = p.sort_values("__rn", ignore_index=True)
        known, test = p[p["__rn"] < fold * step + train], p[p["__rn"] >= fold * step + train]
        if len(known) < train or test.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in FORM.split(", ")])
        x, y = np.stack(known["__x"].to_numpy()), known["target"].to_numpy().astype(float)
        mean, spread = x.mean(axis=0), x.std(axis=0)
        scaled = lambda v: (v - mean) / np.where(spread > 0, spread, 1)
        edge = train - max(1, train // 5)
        net = KINDS[kind](x.shape[1], np.random.default_rng([seed, zlib.crc32(str(symbol).encode()), int(fold)]), **(form or {}))
        epochs = net.fit(scaled(x[:edge]), y[:edge], scaled(x[edge:]), y[edge:])
        z = scaled(np.stack(test["__x"].to_numpy()))
        chance = np.stack([1 / (1 + np.exp(-np.clip(net.sample(z), -500, 500))) for _ in range(samples)])
        p1 = chance.mean(axis=0)
        return pd.DataFrame({"symbol": symbol, "fold": int(fold), "ts": test["ts"], "target": test["target"], "probability": p1, "uncertainty": chance.std(axis=0), "prediction": (p1 > 0.5).astype(int), "confidence": np.maximum(p1, 1 - p1), "epochs": epochs})

    return folds(asked, train, step).groupBy("symbol", "fold").applyInPandas(run, FORM)


def report(predicted: DataFrame, label: str = "target") -> DataFrame:
    """One row a class that occurs or is predicted: (class, precision, recall, f1, support, accuracy); quotients by zero are NULL, ``accuracy`` is that of all rows."""
    both = predicted.where(F.col(label).isNotNull() & F.col("prediction").isNotNull()).select(F.col(label).cast("int").alias("a"), F.col("prediction").cast("int").alias("p"))
    counts = both.groupBy("a", "p").agg(F.count("*").alias("n"))
    classes = counts.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("c")).select("c.*")
    by_class = classes.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    every = Window.partitionBy()  # a row a class
    out = by_class.withColumn("accuracy", F.sum("hit").over(every) / F.sum("support").over(every))
    return out.select("class", F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "support").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support", "accuracy")
