"""Learning on feature tables with Spark ML: components, forests with a seeded search, spread over seeds, walk-forward folds."""

from __future__ import annotations

import math
import random
from collections.abc import Generator, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DoubleType, StructField, StructType

from barloom.operators import additive

#: Fits that the driver asks Spark for at once.
AT_ONCE = 8
#: Forests that grow at once (as fast as eight, with less on the driver), and rows of a partition of what they grow on.
FORESTS, ROWS = 4, 10_000


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Rows with all columns present, as one vector."""
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df.na.drop("any", subset=columns))


def _width(df: DataFrame, column: str) -> int:
    """The length of an assembled vector, from the schema."""
    return df.schema[column].metadata["ml_attr"]["num_attrs"]


def components(df: DataFrame, share: float = 0.96, column: str = "features") -> tuple[DataFrame, int]:
    """``df`` with ``pca``: as many centred components as explain ``share`` of the variance, fitted on the training rows."""
    train = df.where("is_train")
    centred = StandardScaler(inputCol=column, outputCol="__c", withMean=True, withStd=False).fit(train)
    d = centred.transform(df)
    width = _width(df, column)
    full = PCA(k=width, inputCol="__c", outputCol="__p").fit(d.where("is_train"))
    k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), share) + 1)
    k = min(k, width)
    return PCA(k=k, inputCol="__c", outputCol="pca").fit(d.where("is_train")).transform(d).drop("__c"), k


def dealt(df: DataFrame) -> DataFrame:
    """All rows in as many partitions as their number asks for, sorted, cached, under a plan of one node.

    A fit sends two jobs a level with a task for each partition, and plans anew all that its rows were made by.
    """
    spark = df.sparkSession
    rows = df.repartition(math.ceil(df.count() / ROWS) or 1).sortWithinPartitions(*[f"`{f.name}`" for f in df.schema if isinstance(f.dataType, AtomicType)])
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD(), rows._jdf.schema()), spark).cache()


def predicted(forest: RandomForestClassifier, known: DataFrame, asked: DataFrame) -> DataFrame:
    """``forest.fit(known).transform(asked)``, without objects in Python for each tree and its parameters, made on one core of the driver (100 trees: 1.6 s beside 2.8 s for their fit on few rows, under a profiler)."""
    return DataFrame(forest._fit_java(known).transform(asked._jdf), asked.sparkSession)


def forest_search(df: DataFrame, trials: int = 5, seed: int = 42, label: str = "target") -> tuple[RandomForestClassifier, dict]:
    """The forest with the best accuracy on the later part of the training rows, over seeded random settings."""
    rng = random.Random(seed)
    train = dealt(df.where("is_train"))
    edge = train.approxQuantile("__order", [0.8], 0.001)[0] if "__order" in df.columns else None
    fit_on, check = (train.where(F.col("__order") <= edge), train.where(F.col("__order") > edge)) if edge is not None else train.randomSplit([0.8, 0.2], seed)
    settings = [{"numTrees": rng.choice([20, 50, 100]), "maxDepth": rng.randint(3, 10), "minInstancesPerNode": rng.randint(1, 10), "featureSubsetStrategy": rng.choice(["sqrt", "log2", "onethird"])} for _ in range(trials)]
    fit_on, check = fit_on.cache(), check.cache()

    def tried(setting: dict) -> tuple[float, RandomForestClassifier]:
        forest = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed, cacheNodeIds=True, **setting)  # rows keep their places in the trees: else each level walks them down from the root
        got = predicted(forest, known, check).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        return got or 0.0, forest

    longest = sorted(range(trials), key=lambda k: -settings[k]["numTrees"] * settings[k]["maxDepth"])
    try:
        fit_on.count(), check.count()  # once, before several fits ask for them
        known = fit_on
        if "ml_attr" not in fit_on.schema[label].metadata:  # else each fit looks for the largest label
            known = fit_on.withMetadata(label, {"ml_attr": {"type": "nominal", "num_vals": int(fit_on.agg(F.max(label)).first()[0] or 0) + 1}})
        with ThreadPool(FORESTS) as pool:
            got = dict(zip(longest, pool.map(tried, [settings[k] for k in longest], chunksize=1)))
    finally:
        for made in (fit_on, check, train):
            made.unpersist()
    best = max(range(trials), key=lambda k: got[k][0])  # the first of equals
    return got[best][1], settings[best]


def _first_weights(layers: list[int], samples: int) -> np.ndarray:
    """A row of weights for each seed, as Spark's perceptron starts with: what it has after no step at all."""
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), float(k)) for k in range(layers[-1])], StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])).coalesce(1).cache()
    start = lambda seed: MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=0).fit(rows).weights.toArray()
    try:
        with ThreadPool(AT_ONCE) as pool:
            return np.stack(pool.map(start, range(samples)))
    finally:
        rows.unpersist()


class _Stuck(Exception):
    """A line search without a result."""


def _between(a: tuple, b: tuple) -> float:
    """Where the cubic through two places (t, value, slope) is least, away from both."""
    (s, fs, ds), (t, ft, dt) = sorted((a, b))
    bend = ds + dt - 3 * (fs - ft) / (s - t)
    root = math.sqrt(max(bend * bend - ds * dt, 0.0))
    at = t - (t - s) * (dt + root - bend) / (dt - ds + 2 * root or 1e-300)
    return min(max(at, s + 0.1 * (t - s)), s + 0.9 * (t - s))


def _line(x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, t: float) -> Generator:
    """A step along ``way`` that meets the strong Wolfe conditions: the point, its value and gradient. Asks as ``descent`` does."""
    slope = float(grad @ way)
    if not slope <= 0:
        raise _Stuck
    low, high = (0.0, value, slope), None
    for k in range(20):
        if k == 10 and high is None:
            break
        t = t if high is None else _between(low, high)
        point = x + t * way
        f, g = yield point
        here = (t, f, float(g @ way))
        if high is None and not math.isfinite(f):
            t /= 2
            continue
        if f > value + 1e-4 * t * slope or (f >= low[1] and (high is not None or k > 0)):
            high = here
        elif abs(here[2]) <= 0.9 * abs(slope):
            return point, f, g
        elif high is not None:
            low, high = here, low if here[2] * (high[0] - low[0]) >= 0 else high
        elif here[2] >= 0:
            low, high = here, low
        else:
            low, t = here, 1.5 * t
    raise _Stuck


def descent(x: np.ndarray, steps: int, tol: float, memory: int = 10) -> Generator:
    """L-BFGS that asks: yields points, is sent their (value, gradient), and returns the last point. It stops as Spark's does."""
    value, grad = yield x
    first, past, pairs, failed, k = value, [math.inf], [], False, 0
    while k < steps and np.linalg.norm(grad) > max(tol * abs(value), 1e-8) and not (len(past) > 1 and abs(value - max(past)) <= tol * first):
        way, shares = grad.copy(), []
        for s, y in pairs:  # the newest first
            shares.append(float(s @ way) / float(s @ y))
            way -= shares[-1] * y
        if pairs:
            way *= float(pairs[0][0] @ pairs[0][1]) / float(pairs[0][1] @ pairs[0][1])
        for (s, y), share in zip(pairs[::-1], shares[::-1]):
            way += (share - float(y @ way) / float(s @ y)) * s
        try:
            point, f, g = yield from _line(x, value, grad, -way, 1.0 if k else 1 / float(np.linalg.norm(way)))
        except _Stuck:
            if failed:
                break
            pairs, failed = [], True
            continue
        pairs = [(point - x, g - grad), *pairs][:memory]
        x, value, grad, failed, k = point, f, g, False, k + 1
        past = [*past, value][-20:]
    return x


class _Nets:
    """Networks of one hidden layer and two classes, side by side; a row of weights each, laid out as Spark's perceptron has them."""

    def __init__(self, weights: np.ndarray, width: int, hidden: int):
        self.n, self.hidden = len(weights), hidden
        a, b, c = np.cumsum([width * hidden, hidden, 2 * hidden])
        # Inputs x (networks * hidden), the last row of them the bias; of two classes only the difference counts.
        self.inner = np.concatenate([weights[:, :a].reshape(self.n, width, hidden), weights[:, a:b].reshape(self.n, 1, hidden)], axis=1).transpose(1, 0, 2).reshape(width + 1, -1)
        outer, bias = weights[:, b:c].reshape(self.n, hidden, 2), weights[:, c:]
        self.outer, self.bias = outer[:, :, 1] - outer[:, :, 0], bias[:, 1] - bias[:, 0]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the hidden units say (rows x networks x hidden) and the log odds of class 1 (rows x networks). ``x`` ends with ones."""
        units = (1 / (1 + np.exp(-np.clip(x @ self.inner, -700, 700)))).reshape(len(x), self.n, self.hidden)
        return units, np.einsum("rnh,nh->rn", units, self.outer) + self.bias

    def slopes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Per network the sum of losses over the rows, and the sums of gradients in the layout of its weights."""
        units, odds = self.run(x)
        loss = np.logaddexp(0, odds) - y[:, None] * odds
        off = 1 / (1 + np.exp(-np.clip(odds, -700, 700))) - y[:, None]
        outer = np.einsum("rnh,rn->nh", units, off)
        units *= (1 - units) * self.outer
        units *= off[:, :, None]
        inner = (x.T @ units.reshape(len(x), -1)).reshape(x.shape[1], self.n, self.hidden).transpose(1, 0, 2).reshape(self.n, -1)
        bias = off.sum(axis=0)
        return np.concatenate([loss.sum(axis=0)[:, None], inner, np.stack([-outer, outer], axis=2).reshape(self.n, -1), -bias[:, None], bias[:, None]], axis=1)


def _inputs(column: pa.Array, width: int) -> np.ndarray:
    x = np.ones((len(column), width + 1))
    x[:, :width] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x


def fitted(known: DataFrame, weights: np.ndarray, width: int, hidden: int, steps: int = 50, tol: float = 1e-3) -> np.ndarray:
    """The weights of all networks after ``descent`` on the mean loss over the rows (x array, y double) of ``known``.

    The networks descend side by side: a pass over the rows answers what all of them ask. A task streams its rows and gives one
    row of sums, some hundred kilobytes whatever the input; the sums of the tasks meet on the driver.
    """
    rows = known.count()

    def ask(points: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nets, sums = _Nets(points, width, hidden), np.zeros((len(points), points.shape[1] + 1))
            for batch in batches:
                x, y = _inputs(batch.column(0), width), batch.column(1).to_numpy()
                if not np.isin(y, (0, 1)).all():
                    raise ValueError("labels must be 0 or 1")
                for k in range(0, len(x), 512):
                    sums += nets.slopes(x[k : k + 512], y[k : k + 512])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        got = known.mapInArrow(run, "sums binary").toArrow().column("sums")
        return np.sum([np.frombuffer(v.as_py()).reshape(len(points), -1) for v in got], axis=0) / rows

    out = weights.copy()
    running = {k: descent(w, steps, tol) for k, w in enumerate(weights)}
    asked = {k: next(net) for k, net in running.items()}
    while asked:
        answers = ask(np.stack(list(asked.values())))
        for k, answer in zip(list(asked), answers):
            try:
                asked[k] = running[k].send((float(answer[0]), answer[1:]))
            except StopIteration as done:
                out[k] = done.value
                del asked[k]
    return out


def spread_over_seeds(df: DataFrame, samples: int = 5, label: str = "target", hidden: int = 8) -> DataFrame:
    """Mean and spread of the probability of class 1 over networks of different seeds, with the prediction and its confidence."""
    train = df.where("is_train")
    width = _width(df, "features")
    scaler = StandardScaler(inputCol="features", outputCol="__x", withMean=True).fit(train)
    scaled = lambda rows: scaler.transform(rows).withColumn("__x", vector_to_array("__x"))
    # Dealt by place, so that equal tables give equal sums whatever their partitions.
    tasks = df.sparkSession.sparkContext.defaultParallelism
    known = scaled(train).select("__x", F.col(label).cast("double").alias("__y"), "symbol", "ts").repartition(tasks, "symbol", "ts").sortWithinPartitions("symbol", "ts").select("__x", "__y").cache()
    try:
        weights = fitted(known, _first_weights([width, hidden, 2], samples), width, hidden)
    finally:
        known.unpersist()

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = _Nets(weights, width, hidden)
        for batch in batches:
            x = _inputs(batch.column(3), width)
            p = [1 / (1 + np.exp(-np.clip(nets.run(x[k : k + 512])[1], -700, 700))) for k in range(0, len(x), 512)]
            p = np.concatenate([np.zeros((0, samples)), *p])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p.mean(axis=1)), pa.array(p.std(axis=1))], names=[*names[:3], "probability", "uncertainty"])

    asked = scaled(df.where("not is_train")).select("symbol", "ts", label, "__x")
    names = asked.columns
    out = asked.mapInArrow(say, ", ".join(f"`{c}` {t}" for c, t in asked.dtypes[:3]) + ", probability double, uncertainty double")
    return out.withColumns({"prediction": (F.col("probability") > 0.5).cast("int"), "confidence": F.greatest(F.col("probability"), 1 - F.col("probability"))})


def next_bar(df: DataFrame, samples: int = 100, label: str = "target") -> DataFrame:
    """For the last row of each symbol: class, probability, uncertainty and confidence of the next bar, from networks fitted on the training rows."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))) == 1
    marked = df.withColumn("__last", last).where("is_train or __last")
    return spread_over_seeds(marked.withColumn("is_train", F.col("is_train") & ~F.col("__last")), samples, label)


def confusion(predicted: DataFrame, label: str = "target") -> DataFrame:
    return predicted.groupBy(F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def _one_against_rest(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    w = np.zeros((x.shape[1], 3))
    hot = np.eye(3)[y]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += rate * (x.T @ (hot - p) / len(x) - decay * w)
    return w


def walk_forward(samples: DataFrame, train: int = 20, step: int = 5, kind: str = "linear") -> DataFrame:
    """One prediction a fold: a one-against-rest model on ``train`` sequences, tested on the next one.

    ``linear`` is a logistic model of the sequence, ``kernels`` a sum of a linear, a periodic and a smooth part (``additive``).

    Folds are independent: each row is sent to the folds it belongs to, and a fold is a group of ``train`` + 1 rows.
    """
    rows = samples.withColumn("__rn", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    first = F.greatest(F.ceil((F.col("__rn") - train) / step), F.lit(0))
    folds = rows.withColumn("fold", F.explode(F.sequence(first, F.floor(F.col("__rn") / step))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        if len(pdf) < train + 1:
            return pd.DataFrame(columns=["symbol", "fold", "ts", "label", "prediction"])
        x, y = np.stack(pdf["sequence"].to_numpy()), pdf["label"].to_numpy().astype(int)
        mean, spread = x[:train].mean(axis=0), x[:train].std(axis=0)
        x = (x - mean) / np.where(spread > 0, spread, 1)
        if kind == "kernels":
            said = int(additive.one_against_rest(x[: train + 1], y, train)[0])
        else:
            x = np.column_stack([x, np.ones(len(x))])
            said = int((x[train] @ _one_against_rest(x[:train], y[:train])).argmax())
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "fold": [int(pdf["fold"].iloc[0])], "ts": [pdf["ts"].iloc[train]], "label": [y[train]], "prediction": [said]})

    return folds.groupBy("symbol", "fold").applyInPandas(run, "symbol string, fold long, ts timestamp_ntz, label int, prediction int")
