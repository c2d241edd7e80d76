"""Market regimes from a benchmark, breadth, a volatility index and a credit ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import ratio, rolling, window_rank_pct



def by_date() -> WindowSpec:
    """Rows of one series, by date; a function, as a window needs a session."""
    return W.partitionBy("market").orderBy("date")


def statistics(bench: DataFrame) -> DataFrame:
    """Dates without a close are no dates of the benchmark."""
    c = F.col("close")
    out = bench.where("close is not null").withColumns({
        "sma200": rolling(F.avg, c, by_date(), 200, 120), "sma50": rolling(F.avg, c, by_date(), 50, 30),
        "log_ret": F.when(ratio(c, F.lag("close").over(by_date())) > 0, F.ln(ratio(c, F.lag("close").over(by_date())))),
    })
    out = out.withColumn("rv", rolling(F.stddev_samp, F.col("log_ret"), by_date(), 20, 15) * F.sqrt("ppy"))
    return out.withColumn("rv_pct", window_rank_pct(F.col("rv"), by_date(), 252, 60))


def components(bench: DataFrame, breadth: DataFrame | None = None, vix: DataFrame | None = None, credit: DataFrame | None = None) -> DataFrame:
    """One vote a column. Side inputs are (date, value), breadth (market, date, breadth); the last value before a date counts."""
    out = statistics(bench)
    past = by_date().rowsBetween(W.unboundedPreceding, 0)
    if breadth is not None:
        out = out.join(breadth.withColumnRenamed("breadth", "breadth_raw"), ["market", "date"], "left").withColumn("breadth_val", F.last("breadth_raw", True).over(past)).drop("breadth_raw")
    for name, side in (("vix_val", vix), ("credit_val", credit)):
        if side is not None:
            out = out.join(side.select("date", F.col("value").alias("side_raw")), "date", "left").withColumn(name, F.last("side_raw", True).over(past)).drop("side_raw")
    c, s50 = F.col("close"), F.col("sma50")
    yes = lambda cond, a, b: F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)
    votes = {
        "trend200": yes(c > F.col("sma200"), 1.0, -1.0), "slope50": yes(s50 > F.lag("sma50", 10).over(by_date()), 0.5, -0.5), "above50": yes(c > s50, 0.5, -0.5),
        "vol": F.when(F.col("rv_pct") > 0.85, -1.0).when(F.col("rv_pct") < 0.5, 0.5).otherwise(0.0),
    }
    if breadth is not None:
        votes["breadth"] = F.when(F.col("breadth_val") > 0.6, 1.0).when(F.col("breadth_val") < 0.4, -1.0).otherwise(0.0)
    if vix is not None:
        v = F.col("vix_val")
        votes["vix"] = F.when(v > 30, -1.5).when(v > 22, -0.5).when(v < 16, 0.5).otherwise(0.0)
    if credit is not None:
        out = out.withColumn("credit_mom", ratio(F.col("credit_val"), F.lag("credit_val", 20).over(by_date())) - 1)
        votes["credit"] = yes(F.col("credit_mom") > 0, 0.5, -0.5)
    return out.withColumns(votes).withColumn("raw_score", sum((F.coalesce(v, F.lit(0.0)) for v in map(F.col, votes)), F.lit(0.0)))


def labelled(votes: DataFrame) -> DataFrame:
    score = F.when(F.col("sma200").isNotNull(), rolling(F.avg, F.col("raw_score"), by_date(), 3, 1)).otherwise(0.0)
    out = votes.withColumn("score", score)
    panic = F.col("vix_val") > 35 if "vix_val" in votes.columns else F.lit(False)
    label = F.when(F.coalesce((F.col("score") <= -3.5) | panic, F.lit(False)), "CRISIS").when(F.col("score") <= -1, "RISK_OFF").when(F.col("score") >= 2, "RISK_ON").otherwise("NEUTRAL")
    return out.withColumn("regime", label)


def compute(bench: DataFrame, breadth: DataFrame | None = None, vix: DataFrame | None = None, credit: DataFrame | None = None) -> DataFrame:
    return labelled(components(bench, breadth, vix, credit))


def age(regimes: DataFrame) -> DataFrame:
    """Each market's last row and for how many rows its label has stood."""
    last = regimes.groupBy("market").agg(F.max_by("regime", "date").alias("regime"), F.max("date").alias("date"), F.max_by("score", "date").alias("score"))
    other = regimes.join(last.select("market", F.col("regime").alias("now")), "market").groupBy("market").agg(F.max(F.when(F.col("regime") != F.col("now"), F.col("date"))).alias("changed"))
    counted = regimes.join(other, "market").groupBy("market").agg(F.sum(F.when(F.col("changed").isNull() | (F.col("date") > F.col("changed")), 1).otherwise(0)).alias("age"))
    return last.join(counted, "market")


def mix(regimes: DataFrame) -> DataFrame:
    n = regimes.groupBy("market", "regime").agg(F.count("*").alias("n"))
    return n.select("market", "regime", F.round(F.col("n") / F.sum("n").over(W.partitionBy("market")), 2).alias("share"))


def credit_ratio(high_yield: DataFrame, treasuries: DataFrame) -> DataFrame:
    """(date, value): the ratio of two closes on the dates both have."""
    return high_yield.select("date", F.col("close").alias("a")).join(treasuries.select("date", F.col("close").alias("b")), "date").select("date", ratio(F.col("a"), F.col("b")).alias("value"))
