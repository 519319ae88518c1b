"""Registered queries against their SQL twins, on the smallest tables."""

import duckdb
import pytest

from barloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf, name):
    ours = catalog.queries()[name](spark, sf).toPandas()
    theirs = duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = [c for c in ("symbol", "ts", "entry_ts", "signal", "class") if c in ours.columns]
    ours, theirs = (d[sorted(d.columns)].sort_values(key, ignore_index=True) for d in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in ours.columns:
        if ours[c].dtype == object or ours[c].dtype.kind == "M":
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c
        else:
            a, b = ours[c].astype(float), theirs[c].astype(float)
            assert ((a - b).abs().fillna(0) <= 2e-6 * (1 + b.abs().fillna(0))).all() and (a.isna() == b.isna()).all(), c


@pytest.mark.parametrize("name", ["bt4_account", "bt4_costed", "bt4_performance"])
def test_accounts_match_sql_on_larger_tables(spark, name):
    """To the last of the six decimals, on tables where the remainders of an account are small."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    key = ["symbol", "ts"] if name != "bt4_performance" else ["symbol"]
    ours, theirs = (d[sorted(d.columns)].sort_values(key, ignore_index=True) for d in (catalog.queries()[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()))
    for c in ours.columns:
        if ours[c].dtype.kind == "f":
            assert ((ours[c] - theirs[c]).abs().fillna(0) <= 1.1e-6 + 1e-9 * theirs[c].abs().fillna(0)).all(), c


SLOW = {"ml4_forest", "ml6_spread_over_seeds"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE) - SLOW))
def test_runs(spark, sf, name):
    catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()  # all columns, as a count would not


def test_searches_and_spreads_in_small(spark, sf):
    from barloom.operators import learning

    table = catalog._learnable(spark, sf).cache()
    forest, setting = learning.forest_search(table, trials=2)
    assert forest.getNumTrees() == setting["numTrees"]
    rows = learning.spread_over_seeds(table, samples=3).collect()
    assert len(rows) == table.where("not is_train").count()
    assert all(0 <= r.probability <= 1 and r.uncertainty >= 0 and 0.5 <= r.confidence <= 1 and r.prediction == int(r.probability > 0.5) for r in rows)
    last = learning.next_bar(table, samples=2).collect()
    assert len(last) == table.select("symbol").distinct().count()


def test_searches_and_spreads_are_registered_in_full(spark, sf, monkeypatch):
    from barloom.plans import catalog

    asked = {}

    def note(df, **given):
        asked.update(given)
        raise InterruptedError

    monkeypatch.setattr(catalog.learning, "forest_search", note)
    monkeypatch.setattr(catalog.learning, "spread_over_seeds", note)
    for name in ("ml4_forest", "ml6_spread_over_seeds"):
        try:
            catalog.queries()[name](spark, sf)
        except InterruptedError:
            pass
    assert asked == {"trials": 50, "samples": 100}


def test_networks_side_by_side_are_those_of_spark(spark):
    """All descend in the same passes, far fewer than fits one by one take, and end where Spark's perceptron does."""
    import numpy as np
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.sql import functions as F

    from barloom.operators import learning

    rng = np.random.default_rng(3)
    x = rng.normal(size=(256, 3))
    y = ((x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=256)) > 0).astype(float)
    rows = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double").coalesce(1)
    known = rows.select(F.array("a", "b", "c").alias("x"), "y").cache()
    start = learning._first_weights([3, 4, 2], 6)
    spark.sparkContext.setJobGroup("side by side", "")
    got = learning.fitted(known, start, 3, 4)
    passes = len(spark.sparkContext.statusTracker().getJobIdsForGroup("side by side"))
    spark.sparkContext.setJobGroup("", "")
    assert passes < 150
    given = learning.assembled(rows, ["a", "b", "c"]).cache()
    for seed in range(6):
        theirs = MultilayerPerceptronClassifier(layers=[3, 4, 2], labelCol="y", seed=seed, maxIter=50, tol=1e-3).fit(given)
        assert np.allclose(got[seed], theirs.weights.toArray(), atol=1e-4), seed
    many = learning.fitted(known.repartition(3), start, 3, 4)
    assert np.median(np.abs(got - many)) < 1e-4  # a rounded sum may send one of them another way


def test_forests_keep_places_and_grow_the_same_trees(spark, sf):
    from barloom.operators import learning

    table = catalog._learnable(spark, sf).cache()
    forest, _ = learning.forest_search(table, trials=1)
    assert forest.getCacheNodeIds()
    train = table.where("is_train").cache()
    kept, walked = (forest.copy({forest.cacheNodeIds: keep}).fit(train).toDebugString.split("\n")[1:] for keep in (True, False))
    assert kept == walked


def test_a_search_makes_no_trees_in_python(spark, sf, monkeypatch):
    """Wrapping the trees of its forests takes time on one core of the driver; predictions are those of ``fit`` and ``transform``."""
    from barloom.operators import learning

    table = catalog._learnable(spark, sf).cache()
    forest, _ = learning.forest_search(table, trials=1)
    train, asked = table.where("is_train"), table.where("not is_train")
    theirs = [r.probability for r in forest.fit(train).transform(asked).orderBy("symbol", "ts").collect()]
    monkeypatch.setattr(type(forest), "_create_model", lambda *_: 1 / 0)
    learning.forest_search(table, trials=2)
    assert [r.probability for r in learning.predicted(forest, train, asked).orderBy("symbol", "ts").collect()] == theirs


def test_rows_of_a_search_are_dealt_by_their_number(spark, sf, monkeypatch):
    """Not by the partitions that they come in, each of which was a task of each of some hundred jobs; nor do forests depend on these."""
    from barloom.operators import learning

    table = catalog._learnable(spark, sf).cache()
    many = table.repartition(23)
    assert learning.forest_search(many, trials=2)[1] == learning.forest_search(table, trials=2)[1]
    grown = [learning.predicted(learning.RandomForestClassifier(labelCol="target", seed=1), learning.dealt(t.where("is_train")), t.where("not is_train")).orderBy("symbol", "ts").collect() for t in (table, many)]
    assert grown[0] == grown[1]
    known = learning.dealt(many.where("is_train"))
    assert known.rdd.getNumPartitions() == 1 and known.schema["features"].metadata == many.schema["features"].metadata
    monkeypatch.setattr(learning, "ROWS", 100)
    few = learning.dealt(many.where("is_train"))
    rows = lambda d: sorted(map(str, d.collect()))
    assert few.rdd.getNumPartitions() == -(-known.count() // 100) > 1 and rows(few) == rows(known) == rows(many.where("is_train"))
