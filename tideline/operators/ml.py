"""Walk-forward classification of the best forward returns with gradient-boosted trees.

Features are ranked by date once and stored. All fits run side by side, a task
each: a fit's training set is what a join of days and splits deals to it, at most
about `most_rows` rows of it by a hash, so that no task's memory grows with the
market. Models then meet the rows they score in groups of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boosting import Trees, boost
from ..functions.kernels import pct_rank
from ..functions.ranking import quantiles, running
from ..storage import stored

DAY = ("market", "date")
# The features, ranked by date, and the codes of the regimes.
FEATURES = ["g_trend", "g_momentum", "g_timing", "g_volatility", "g_volume", "rsi14", "dist21_atr", "atr_pct", "bb_bw_pct", "pct_52w_high", "mom_1m", "mom_3m", "rv20", "adx", "updown_vol", "cmf20", "clenow", "close_range3", "rvol", "squeeze_on"]
CODES = {"CRISIS": 0.0, "RISK_OFF": 1.0, "NEUTRAL": 2.0, "RISK_ON": 3.0}
MODEL = "market string, test_day long, n_train long, base double, feature array<int>, cut array<double>, value array<double>"
SCORED = 50_000


def feature_frame(scored: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Percent ranks by date (f_ columns) and the regime's code."""
    names = [f for f in (features or FEATURES) if f in scored.columns]
    code = F.lit(None).cast("double")
    for r, c in CODES.items():
        code = F.when(F.col("regime") == r, c).otherwise(code)
    return scored.select("market", "ticker", "date", "fwd_ret", *(pct_rank(F.col(f), *DAY).alias(f"f_{f}") for f in names), code.alias("f_regime"))


def labels(scored: DataFrame, top: float = 0.7) -> DataFrame:
    """label: 1 where a forward return ranks above `top` on its date; null stays null."""
    rank = pct_rank(F.col("fwd_ret"), *DAY)
    return scored.withColumn("label", F.when(rank.isNotNull(), (rank > top).cast("double")))


def day_numbers(rows: DataFrame) -> DataFrame:
    """Numbers the dates of each market from 0, by joining the list of dates."""
    dates = rows.select(*DAY).distinct().withColumn("day", F.row_number().over(W.partitionBy("market").orderBy("date")) - 1)
    return rows.join(dates, list(DAY))


def splits(dates: DataFrame, horizon: int = 15, step: int = 20, first: int = 250) -> DataFrame:
    """(market, test_day, test_end, train_end): training stops horizon+1 dates before the test begins."""
    n = dates.select(*DAY).distinct().groupBy("market").agg(F.count("*").alias("n"))
    return n.where(F.col("n") > first).select("market", "n", F.explode(F.sequence(F.lit(first), F.col("n") - 1, F.lit(step))).alias("test_day")).select("market", "test_day", F.least(F.col("test_day") + step, F.col("n")).alias("test_end"), (F.col("test_day") - horizon - 1).alias("train_end"))


def learning_rows(scored: DataFrame, cfg: dict, features: list[str] | None = None) -> DataFrame:
    """Features, label and day number of every row whose features are all there; stored, as fits and scores both read it."""
    # days count all dates of a market, so they are numbered before rows with gaps go
    rows = day_numbers(labels(feature_frame(scored, features), cfg["ml"]["top_q"]))
    return stored(rows.dropna(subset=[c for c in rows.columns if c.startswith("f_")]), "learning")


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return frame[[c for c in frame.columns if c.startswith("f_")]].to_numpy(float)


def fitted(rows: DataFrame, wanted: DataFrame, cfg: dict, least_rows: int = 500, most_rows: int = 100_000) -> DataFrame:
    """A model of each (market, test_day, train_end) wanted that has at least least_rows labelled rows of every few days up to train_end.

    A split with more than most_rows takes a share of them, by a hash of ticker and date.
    """
    ml = cfg["ml"]
    train = rows.where(F.col("label").isNotNull() & (F.col("day") % ml["every"] == 0))
    days = train.groupBy("market", "day").agg(F.count("*").alias("n")).withColumnRenamed("market", "m")
    due = wanted.join(days, (F.col("market") == F.col("m")) & (F.col("day") <= F.col("train_end"))).groupBy("market", "test_day", "train_end").agg(F.sum("n").alias("n_train"))
    due = stored(due.where(F.col("n_train") >= least_rows), "splits").withColumnRenamed("market", "m")
    part = F.pmod(F.xxhash64("ticker", "date"), F.lit(1 << 30)) / float(1 << 30)
    dealt = train.join(due, (F.col("market") == F.col("m")) & (F.col("day") <= F.col("train_end")) & (part < F.lit(float(most_rows)) / F.col("n_train")))
    rounds, depth = ml["max_iter"], 4

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["date", "ticker"])  # sums in one order, whatever the shuffle
        trees = boost(_matrix(frame), frame["label"].to_numpy(float), rounds, depth=depth)
        return pd.DataFrame({"market": [key[0]], "test_day": [key[1]], "n_train": [frame["n_train"].iloc[0]], "base": [trees.base], **{c: [getattr(trees, c).ravel()] for c in ("feature", "cut", "value")}})

    return dealt.drop("m", "fwd_ret").groupBy("market", "test_day").applyInPandas(fit, MODEL)


def probabilities(rows: DataFrame, models: DataFrame, cfg: dict) -> DataFrame:
    """rows (with test_day, naming their model) with prob; a model's rows are dealt to groups of about SCORED."""
    sizes = rows.groupBy("market", "test_day").agg(F.ceil(F.count("*") / SCORED).alias("groups"))
    salted = rows.join(sizes, ["market", "test_day"]).withColumn("group", F.pmod(F.xxhash64("ticker", "date"), F.col("groups"))).drop("groups")
    copies = models.join(sizes, ["market", "test_day"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    shown, rounds = ["market", "ticker", "date", "test_day", "label", "fwd_ret"], cfg["ml"]["max_iter"]

    def score(frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or model.empty:
            return pd.DataFrame({c: [] for c in [*shown, "prob"]})
        m = model.iloc[0]
        trees = Trees(m["base"], *(np.asarray(m[c]).reshape(rounds, -1) for c in ("feature", "cut", "value")))
        return frame[shown].assign(prob=trees.probability(_matrix(frame)))

    keys = ["market", "test_day", "group"]
    return salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(score, "market string, ticker string, date date, test_day long, label double, fwd_ret double, prob double")


def walk_forward(scored: DataFrame, cfg: dict, least_rows: int = 500, features: list[str] | None = None, most_rows: int = 100_000) -> DataFrame:
    """(market, ticker, date, test_day, label, fwd_ret, prob): every `step` dates a model of all dates up to horizon+1 before scores one date."""
    ml = cfg["ml"]
    rows = learning_rows(scored, cfg, features)
    tests = splits(scored, cfg["horizon"], ml["step"], ml["min_train"]).select("market", F.col("test_day").cast("long").alias("test_day"), "train_end")
    models = stored(fitted(rows, tests, cfg, least_rows, most_rows), "models")
    due = rows.withColumn("test_day", F.col("day").cast("long")).join(models.select("market", "test_day"), ["market", "test_day"], "left_semi")
    return stored(probabilities(due, models, cfg), "predictions")


def metrics(predicted: DataFrame, least_rows: int = 100) -> DataFrame:
    """By market: refits, AUC, base rate, precision and forward return of the top tenth; null without more than least_rows labelled rows of both labels.

    AUC counts, for each probability, the negatives below it (half of those at it),
    from running sums over distinct probabilities.
    """
    refits = predicted.groupBy("market").agg(F.countDistinct("test_day").alias("n_refits"))
    known = predicted.dropna(subset=["label", "fwd_ret", "prob"])
    steps = known.groupBy("market", "prob").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = running(steps, ["market"], [F.col("prob")], n_pos=F.col("pos"), n_neg=F.col("neg"))
    wins = below.groupBy("market").agg(F.sum(F.col("pos") * (F.col("n_neg") + F.col("neg") / 2)).alias("won"), F.first("n_pos_all").alias("p"), F.first("n_neg_all").alias("q"))
    cut = quantiles(known, ["market"], "prob", 0.9, "q90")
    best = F.col("prob") >= F.col("q90")
    sums = known.join(cut, "market").groupBy("market").agg(
        F.avg("label").alias("base_rate"), F.avg(F.when(best, F.col("label"))).alias("top_precision"), (100 * F.avg(F.when(best, F.col("fwd_ret")))).alias("top_fwd_pct"),
        (100 * F.avg("fwd_ret")).alias("all_fwd_pct"), F.count("*").alias("n"),
    )
    ok = (F.col("p") + F.col("q") > least_rows) & (F.col("p") > 0) & (F.col("q") > 0)
    both = wins.join(sums, "market").withColumn("auc", F.try_divide(F.col("won"), F.col("p") * F.col("q")))
    shown = ["auc", "base_rate", "top_precision", "top_fwd_pct", "all_fwd_pct", "n"]
    return refits.join(both.select("market", *(F.when(ok, F.col(c)).alias(c) for c in shown)), "market", "left")


def latest_probability(scored: DataFrame, cfg: dict, features: list[str] | None = None, least_rows: int = 500, most_rows: int = 100_000) -> DataFrame:
    """(market, ticker, ml_prob) of each market's last date, by a model of all labelled dates (every few of them); none where they are too few."""
    rows = learning_rows(scored, cfg, features)
    ends = day_numbers(scored.select(*DAY).distinct()).groupBy("market").agg(F.max("day").cast("long").alias("test_day")).withColumn("train_end", F.col("test_day"))
    models = stored(fitted(rows, ends, cfg, least_rows, most_rows), "models")
    due = rows.withColumn("test_day", F.col("day").cast("long")).join(models.select("market", "test_day"), ["market", "test_day"], "left_semi")
    return probabilities(due, models, cfg).select("market", "ticker", F.col("prob").alias("ml_prob"))
