"""Learning that fits: splits, purge, guards, the booster's cuts, and metrics against SQL over stored predictions."""

import datetime as d

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import config
from tideline.functions.boosting import Trees, boost
from tideline.functions.ranking import medians, quantiles, running
from tideline.operators import ml

CFG = config.load({"horizon": 5, "ml": {"max_iter": 30, "min_train": 60, "step": 20, "every": 2}})


def made(spark, days: int = 150, names: int = 24):
    """A panel whose forward return follows clenow, in two markets; one feature has gaps on the first days."""
    rng = np.random.default_rng(2)
    rows = []
    for market in ("a", "b"):
        for k in range(days):
            for i in range(names):
                x = rng.normal()
                fwd = None if k >= days - 5 else 0.02 * x + 0.01 * rng.normal()
                rows.append((market, f"t{i:02d}", d.date(2024, 1, 1) + d.timedelta(k), float(x), float(rng.normal()) if k > 3 else None, fwd, ["RISK_ON", "CRISIS"][k % 2]))
    return spark.createDataFrame(rows, "market string, ticker string, date date, clenow double, rsi14 double, fwd_ret double, regime string").repartition(6)


@pytest.fixture(scope="module")
def panel(spark):
    return made(spark).cache()


@pytest.fixture(scope="module")
def predicted(panel):
    return ml.walk_forward(panel, CFG, features=["clenow", "rsi14"])


def test_models_learn_and_score_one_date_a_split(panel, predicted):
    got = predicted.toPandas()
    assert set(got["test_day"]) == {60, 80, 100, 120, 140} and len(got) == 2 * 5 * 24
    assert got["prob"].between(0, 1).all()
    m = ml.metrics(predicted).toPandas().set_index("market")
    assert (m["auc"] > 0.85).all() and (m["n_refits"] == 5).all() and (m["top_precision"] > m["base_rate"] + 0.3).all()


def test_training_ends_before_the_purge(panel):
    rows = ml.learning_rows(panel, CFG, ["clenow", "rsi14"])
    tests = ml.splits(panel, CFG["horizon"], 20, 60).select("market", F.col("test_day").cast("long").alias("test_day"), "train_end")
    got = {(r["market"], r["test_day"]): r["n_train"] for r in ml.fitted(rows, tests, CFG, least_rows=1).collect()}
    # every 2nd day from 4 (rsi14 begins there) to test_day - 6, 24 names each
    assert got == {(m, t): 24 * len([k for k in range(0, t - 5, 2) if k >= 4]) for m in "ab" for t in (60, 80, 100, 120, 140)}
    few = {(r["market"], r["test_day"]) for r in ml.fitted(rows, tests, CFG, least_rows=700).collect()}
    assert few == {(m, t) for (m, t), n in got.items() if n >= 700} and few and len(few) < len(got)


def test_a_bound_on_training_rows_deals_a_share(panel):
    rows = ml.learning_rows(panel, CFG, ["clenow", "rsi14"])
    ends = ml.splits(panel, CFG["horizon"], 20, 60).select("market", F.col("test_day").cast("long").alias("test_day"), "train_end")
    models = ml.fitted(rows, ends, CFG, least_rows=500, most_rows=400)
    assert models.count() == 10
    got = ml.metrics(ml.probabilities(rows.withColumn("test_day", F.col("day").cast("long")).join(models.select("market", "test_day"), ["market", "test_day"], "left_semi"), models, CFG)).toPandas()
    assert (got["auc"] > 0.8).all()


def test_metrics_equal_sql_over_stored_predictions(spark, predicted, tmp_path):
    path = str(tmp_path / "predictions")
    predicted.withColumn("prob", F.round("prob", 2)).write.parquet(path)  # ties
    sql = f"""WITH p AS (SELECT * FROM read_parquet('{path}/*.parquet') WHERE label IS NOT NULL AND fwd_ret IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY market ORDER BY prob) + (count(*) OVER (PARTITION BY market, prob) - 1) / 2.0 AS r FROM p),
     q AS (SELECT market, quantile_cont(prob, 0.9) AS q90 FROM p GROUP BY 1)
     SELECT market, round((sum(label * r) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS auc, round(avg(label), 9) AS base_rate, round(avg(CASE WHEN prob >= q90 - 1e-9 THEN label END), 9) AS top_precision, count(*) AS n FROM r JOIN q USING (market) GROUP BY 1 ORDER BY 1"""
    got = ml.metrics(spark.read.parquet(path)).orderBy("market").select("market", *(F.round(c, 9).alias(c) for c in ("auc", "base_rate", "top_precision")), "n").collect()
    assert [tuple(r) for r in got] == duckdb.sql(sql).fetchall()


def test_metrics_need_rows_and_both_labels(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 0.1, k / 200) for k in range(150)] + [("b", 1, float(k % 2), 0.1, k / 200) for k in range(100)], "market string, test_day long, label double, fwd_ret double, prob double")
    got = {r["market"]: (r["n_refits"], r["auc"], r["n"]) for r in ml.metrics(rows).collect()}
    assert got == {"a": (1, None, None), "b": (1, None, None)}


def test_latest_probability(panel):
    got = ml.latest_probability(panel, CFG, ["clenow", "rsi14"]).toPandas()
    assert len(got) == 48 and got["ml_prob"].between(0, 1).all()
    assert ml.latest_probability(panel, CFG, ["clenow", "rsi14"], least_rows=10_000).count() == 0


def test_first_cut_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = ((x[:, 1] > 0.35) ^ (rng.random(300) < 0.1)).astype(float)
    trees = boost(x, y, rounds=1, depth=1, least=40)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(((part(x[:, f] <= c) + part(x[:, f] > c), f, c) for f in range(3) for c in np.unique(x[:, f])[:-1] if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= 40))
    assert trees.feature[0, 0] == best[1] and best[2] < trees.cut[0, 0] < best[2] + 0.11
    low = x[:, best[1]] <= best[2]
    assert np.allclose(trees.value[0, 1:], [-0.05 * g[low].sum() / (h[low].sum() + 1), -0.05 * g[~low].sum() / (h[~low].sum() + 1)])


def test_trees_without_cuts_give_the_base_rate():
    trees = boost(np.zeros((60, 2)), np.r_[np.ones(15), np.zeros(45)], rounds=5)
    assert isinstance(trees, Trees) and np.allclose(trees.probability(np.zeros((3, 2))), 0.25)


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(7)
    rows = [(["a", "b", None][int(k)], float(x) if x > -1.5 else None) for k, x in zip(rng.choice(3, 4000, p=[0.8, 0.1, 0.1]), rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    for k in ("a", "b", None):
        own = np.array([x for kk, x in rows if kk == k and x is not None])
        same = F.col("k").eqNullSafe(F.lit(k))
        assert np.isclose(medians(df, ["k"], "x").where(same).first()["median"], np.median(own))
        assert np.isclose(quantiles(df, ["k"], "x", 0.9, "q").where(same).first()["q"], np.quantile(own, 0.9))
    got = running(df.where("x is not null").withColumn("u", F.monotonically_increasing_id()), ["k"], [F.col("x"), F.col("u")], s=F.col("x"), n=F.lit(1)).where("k = 'a'").orderBy("x", "u").toPandas()
    assert got["n"].tolist() == list(range(len(got))) and np.allclose(got["s"], got["x"].cumsum() - got["x"]) and np.allclose(got["s_all"], got["x"].sum())
    assert running(df.limit(0), ["k"], [F.col("x")], n=F.lit(1)).count() == 0
