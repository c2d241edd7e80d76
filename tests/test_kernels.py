import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import kernels as K
from tideline.operators import indicators as I

CLOSE = [10, 11, 12, 11, 10, 10, 13, 12, 14, 14, 13, 15]
HIGH = [10.5, 11.5, 12.5, 12, 11, 10.5, 13.5, 13, 14.5, 14.5, 14, 15.5]
LOW = [9.5, 10.5, 11, 10.5, 9.5, 9.5, 10, 11.5, 12, 13.5, 12.5, 13]


@pytest.fixture(scope="module")
def bars(spark):
    import datetime as d

    rows = [("m", "t", d.date(2024, 1, 1) + d.timedelta(i), float(c), float(h), float(lo), float(c), 1.0) for i, (c, h, lo) in enumerate(zip(CLOSE, HIGH, LOW))]
    return spark.createDataFrame(rows, "market string, ticker string, date date, open double, high double, low double, close double, volume double")


def values(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def close_to(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-5), (found, wanted)


def test_recursive_means(bars):
    N = None
    own = {"atr3": ("tr", 1 / 3, 3), "ema3": ("close", 0.5, 3), "up2": ("gain", 0.5, 2), "down2": ("loss", 0.5, 2)}
    out = I.recursive_means(I.inputs(bars), own, adx=False, macd=False).withColumn("rsi2", I.rsi(2))
    close_to(values(out, "tr"), [1, 1.5, 1.5, 1.5, 1.5, 1, 3.5, 1.5, 2.5, 1, 1.5, 2.5])
    close_to(values(out, "atr3"), [N, N, 1.277778, 1.351852, 1.401235, 1.26749, 2.01166, 1.841107, 2.060738, 1.707158, 1.638106, 1.925404])
    close_to(values(out, "ema3"), [N, N, 11.25, 11.125, 10.5625, 10.28125, 11.640625, 11.820312, 12.910156, 13.455078, 13.227539, 14.11377])
    close_to(values(out, "rsi2"), [N, N, 100, 50, 25, 25, 89.285714, 56.818182, 82.407407, 82.407407, 37.711864, 80.347594])


def test_sliding(bars):
    N = None
    w = I.by_date()
    out = I.inputs(bars).withColumns({
        "sd": K.rolling(F.stddev_pop, F.col("close"), w, 4), "hi": I.donchian(3)[0], "rank": K.window_rank_pct(F.col("close"), w, 5, 3), "slope": I.slope(F.col("close"), 4), "r2": I.r2(F.col("close"), 4),
    })
    close_to(values(out, "sd"), [N, N, N, 0.707107, 0.707107, 0.829156, 1.224745, 1.299038, 1.47902, 0.829156, 0.829156, 0.707107])
    close_to(values(out, "hi"), [N, N, N, 12.5, 12.5, 12.5, 12, 13.5, 13.5, 14.5, 14.5, 14.5])
    close_to(values(out, "rank"), [N, N, 1, 0.625, 0.3, 0.3, 1, 0.8, 1, 0.9, 0.5, 1])
    close_to(values(out, "slope"), [N, N, N, 0.4, -0.4, -0.7, 0.6, 0.9, 1.1, 0.5, 0.3, 0.2])
    close_to(values(out, "r2"), [N, N, N, 0.4, 0.4, 0.890909, 0.3, 0.6, 0.691429, 0.454545, 0.163636, 0.1])


def test_cross_section_and_null_rules(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([3.0, 1.0, 3.0, None, 2.0])], "i int, x double").withColumn("g", F.lit(1))
    out = rows.withColumns({"r": K.pct_rank(F.col("x"), "g"), "c": K.clip(F.col("x"), -2, 2), "z": K.zscore(F.lit(1.0) + 0 * F.col("x"), "g")}).orderBy("i").collect()
    assert [r["r"] for r in out] == [0.875, 0.25, 0.875, None, 0.5]
    assert [r["c"] for r in out] == [2.0, 1.0, 2.0, None, 2.0]
    assert [r["z"] for r in out] == [None] * 5  # a constant has no z-score
    mean = spark.createDataFrame([(1.0, None), (None, None), (1.0, 4.0)], "a double, b double").select(K.weighted_mean([("a", 1.0), ("b", 2.0)]).alias("m")).collect()
    assert [r["m"] for r in mean] == [1.0, None, 3.0]


def test_causal(spark, bars):
    """Later bars change nothing that came before, but for the forward return."""
    cut = bars.where("date <= '2024-01-08'").withColumn("ppy", F.lit(252.0))
    names = ["obv", "close_range3", "swing_low10", "ret1", "tr"]
    a, b = (I.sliding(I.inputs(x)).where("date <= '2024-01-08'").orderBy("date").select(*names).collect() for x in (cut, bars.withColumn("ppy", F.lit(252.0))))
    assert a == b


def test_conviction_and_decile_fixtures(spark):
    from tideline.operators import crosssection as X

    row = spark.range(1).select(X.adjusted_conviction(X.conviction(F.lit(1.1596787)), F.lit(False), F.lit(""), F.lit(False)).alias("c")).first()
    assert abs(row["c"] - 68.4770) < 1e-3 and not math.isnan(row["c"])
    rows = spark.createDataFrame([(i / 10, float(i)) for i in range(1, 11)], "comp_rank double, fwd_ret double").withColumn("market", F.lit("m"))
    assert {r["decile"]: r["n"] for r in X.deciles(rows, 10).collect()} == {**{i: 1 for i in range(2, 10)}, 10: 2}
