"""Cross-sections: scores of instruments against their peers on a date, and what the ranking is worth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FUNDAMENTAL, GROUPS, SENTIMENT, TECHNICAL
from ..functions.kernels import clip, guarded_corr, pct_rank, ratio, weighted_mean, zscore
from ..functions.ranking import medians
from ..storage import stored

DAY = ("market", "date")


def zscores(panel: DataFrame, columns: list[str], keys: tuple[str, ...] = DAY) -> DataFrame:
    """z_ columns; columns that are absent are skipped."""
    return panel.withColumns({f"z_{c}": zscore(F.col(c), *keys) for c in columns if c in panel.columns})


def group_scores(panel: DataFrame, groups: dict[str, dict[str, float]]) -> DataFrame:
    """g_ columns: weighted means of the z_ columns that are there."""
    out = {}
    for name, weights in groups.items():
        own = [(f"z_{f}", w) for f, w in weights.items() if f"z_{f}" in panel.columns]
        out[f"g_{name}"] = weighted_mean(own) if own else F.lit(None).cast("double")
    return panel.withColumns(out)


def composite(panel: DataFrame, weights: dict[str, list[float]], regime: Column) -> Column:
    """Mean of the group scores by the regime's weights; an unknown regime counts as NEUTRAL."""
    def weight(i: int) -> Column:
        out = F.lit(float(weights["NEUTRAL"][i]))
        for name, row in weights.items():
            out = F.when(regime == name, float(row[i])).otherwise(out)
        return out

    return weighted_mean([(f"g_{g}", weight(i)) for i, g in enumerate(GROUPS) if f"g_{g}" in panel.columns])


def aligned_regime(panel: DataFrame, regimes: DataFrame) -> DataFrame:
    """(market, date, regime) for the panel's dates: the last label before, else the first after, else NEUTRAL."""
    dates = panel.select("market", "date").distinct().join(regimes.select("market", "date", "regime"), ["market", "date"], "left")
    past, later = W.partitionBy("market").orderBy("date").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("market").orderBy("date").rowsBetween(0, W.unboundedFollowing)
    return dates.select("market", "date", F.coalesce(F.last("regime", True).over(past), F.first("regime", True).over(later), F.lit("NEUTRAL")).alias("regime"))


def score_panel(panel: DataFrame, regimes: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """z_, g_, regime, composite and comp_rank of a feature panel."""
    scored = group_scores(zscores(panel, [f for g in TECHNICAL.values() for f in g]), TECHNICAL)
    scored = scored.join(aligned_regime(panel, regimes), ["market", "date"])
    scored = scored.withColumn("composite", composite(scored, weights, F.col("regime")))
    return scored.withColumn("comp_rank", pct_rank(F.col("composite"), *DAY))


def breadth(panel: DataFrame) -> DataFrame:
    """Share of instruments above their 50-bar mean, by date."""
    above = F.when(F.col("sma50").isNotNull(), (F.col("close") > F.col("sma50")).cast("double"))
    return panel.groupBy(*DAY).agg(F.avg(above).alias("breadth"))


def latest(panel: DataFrame, stale_days: int = 7) -> DataFrame:
    """Each instrument's last row, unless it is staler than so many days before its market's last date."""
    own = W.partitionBy("market", "ticker").orderBy(F.col("date").desc())
    last = panel.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")
    return last.withColumn("newest", F.max("date").over(W.partitionBy("market"))).where(F.datediff("newest", "date") <= stale_days).drop("newest")


def top(rows: DataFrame, n: int, by: str = "composite") -> DataFrame:
    w = W.partitionBy("market").orderBy(F.col(by).desc_nulls_last(), "ticker")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def fundamental_factors(f: DataFrame) -> DataFrame:
    """The eleven factors of a fundamentals table joined with close."""
    above = lambda x: F.when(F.col(x) > 0, 1 / F.col(x))
    return f.withColumns({
        "roe": clip(F.col("returnOnEquity"), -1, 1), "gross_margin": clip(F.col("grossMargins"), -1, 1),
        "low_leverage": F.when(F.col("debtToEquity").isNotNull(), -F.log1p(F.greatest(F.col("debtToEquity"), F.lit(0.0)) / 100)),
        "fcf_yield": clip(ratio(F.col("freeCashflow"), F.col("marketCap")), -0.3, 0.3),
        "rev_growth": clip(F.col("revenueGrowth"), -1, 2), "eps_growth": clip(F.col("earningsGrowth"), -1, 3),
        "earnings_yield": clip(above("forwardPE"), None, 0.5), "ev_ebitda_inv": clip(above("enterpriseToEbitda"), None, 1),
        "analyst_score": -F.col("recommendationMean"), "target_upside": clip(ratio(F.col("targetMeanPrice"), F.col("close")) - 1, -0.5, 1),
        "eps_revision": clip(F.col("epsRevision30d"), -0.5, 0.5),
    })


def enriched(rows: DataFrame) -> DataFrame:
    """g_fundamentals and g_sentiment of a snapshot that carries those factors (z over the market)."""
    both = FUNDAMENTAL | SENTIMENT
    return group_scores(zscores(rows, [f for g in both.values() for f in g], ("market",)), both)


def with_sector(rows: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Sector, name and short interest from fundamentals; funds have the sector ETF."""
    f = fundamentals.select("ticker", F.when(F.upper("quoteType") == "ETF", "ETF").otherwise(F.col("sector")).alias("sector"), "shortName", "shortPercentOfFloat")
    return rows.drop("sector", "shortName", "shortPercentOfFloat").join(f, "ticker", "left")


def conviction(score: Column) -> Column:
    return 100 / (1 + F.exp(-1.6 * score))


def adjusted_conviction(base: Column, setup_allows: Column, earnings_flag: Column, liquid: Column) -> Column:
    """Less 10 for a setup that is not to be traded, 10 for near earnings, 8 for thin trading."""
    off = F.when(~setup_allows, 10).otherwise(0) + F.when(F.coalesce(earnings_flag, F.lit("")) != "", 10).otherwise(0) + F.when(~liquid, 8).otherwise(0)
    return clip(base - off, 1, 99)


def blended(base: Column, prob: Column, share: float = 0.30) -> Column:
    return F.when(prob.isNotNull(), (1 - share) * base + share * 100 * prob).otherwise(base)


def deciles(scored: DataFrame, least: int = 200) -> DataFrame:
    """Forward returns by decile of comp_rank; no rows with fewer than `least` labelled ones."""
    both = scored.where("comp_rank is not null and fwd_ret is not null").select("market", "fwd_ret", (F.floor(F.least(F.col("comp_rank") * 10, F.lit(9.999))) + 1).cast("int").alias("decile"))
    both = stored(both, "deciles")  # three columns, read by the means and by the medians
    out = both.groupBy("market", "decile").agg((F.avg("fwd_ret") * 100).alias("mean_pct"), F.avg((F.col("fwd_ret") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n"))
    middle = medians(both, ["market", "decile"], "fwd_ret").select("market", "decile", (100 * F.col("median")).alias("median_pct"))
    out = out.join(middle, ["market", "decile"])
    return out.withColumn("all_rows", F.sum("n").over(W.partitionBy("market"))).where(F.col("all_rows") >= least).drop("all_rows")


def rank_ic(scored: DataFrame, horizon: int = 15, names: int = 8, rows: int = 200, dates: int = 20) -> DataFrame:
    """Mean, deviation, t and share above zero of the dates' rank correlations of composite and forward return."""
    both = scored.where("composite is not null and fwd_ret is not null").select(*DAY, "composite", "fwd_ret")
    ranked = both.withColumns({"rc": pct_rank(F.col("composite"), *DAY), "rf": pct_rank(F.col("fwd_ret"), *DAY)})
    daily = ranked.groupBy(*DAY).agg(guarded_corr("rc", "rf").alias("ic"), F.count("*").alias("n"))
    out = daily.groupBy("market").agg(F.sum("n").alias("all_rows"), *(f(F.when((F.col("n") >= names), F.col("ic"))).alias(a) for a, f in (("ic_mean", F.avg), ("ic_sd", F.stddev_samp), ("n_dates", F.count))), F.avg(F.when((F.col("n") >= names) & F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("share_positive"))
    out = out.where((F.col("all_rows") >= rows) & (F.col("n_dates") >= dates)).drop("all_rows")
    return out.withColumn("ic_t", ratio(F.col("ic_mean"), F.col("ic_sd")) * F.sqrt(F.col("n_dates") / horizon))


def last_returns(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """(market, ticker, date, ret) of each instrument's last returns."""
    own = W.partitionBy("market", "ticker").orderBy("date")
    back = W.partitionBy("market", "ticker").orderBy(F.col("date").desc())
    rets = bars.select(*("market", "ticker", "date"), (ratio(F.col("close"), F.lag("close").over(own)) - 1).alias("ret"))
    return rets.withColumn("back", F.row_number().over(back)).where(F.col("back") <= lookback).drop("back")


def correlations(returns: DataFrame, block: int = 128) -> DataFrame:
    """Pearson correlation of each pair of a market's instruments over the dates they share (a before b), and the number of those dates.

    Instruments are dealt to blocks; a pair of blocks is one task, which lays both out
    over their dates and takes sums, squares, products and counts as matrix products, gaps being
    zeros with zero weight. A row travels once for each block of its market.
    """
    counts = returns.groupBy("market").agg(F.ceil(F.approx_count_distinct("ticker") / block).cast("int").alias("blocks"))
    own = returns.join(counts, "market").withColumn("own", F.pmod(F.xxhash64("ticker"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = own.select("market", "ticker", "date", "ret", "own", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def gram(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ticker", "date"])
        names, at = np.unique(rows["ticker"].to_numpy(str), return_inverse=True)
        dates, when = np.unique(rows["date"].to_numpy(), return_inverse=True)
        home = np.zeros(len(names), np.int64)
        home[at] = rows["own"]
        ret = rows["ret"].to_numpy(float)
        there, seen, x = (np.zeros((len(names), len(dates))) for _ in range(3))
        there[at, when], seen[at, when] = 1, ~np.isnan(ret)
        mean = np.nanmean(ret) if seen.any() else 0.0  # a shift changes no correlation, and keeps digits
        x[at, when] = np.where(np.isnan(ret), 0.0, ret - mean)
        a, b = np.flatnonzero(home == key[1]), np.flatnonzero(home == key[2])
        of = lambda m, n: m[a] @ n[b].T
        n, sx, sy = of(seen, seen), of(x, seen), of(seen, x)
        low, sxx, syy, sxy = np.maximum(n, 1), of(x * x, seen), of(seen, x * x), of(x, x)
        vx, vy, cov = sxx - sx * sx / low, syy - sy * sy / low, sxy - sx * sy / low
        flat = (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy) | (n < 2)
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.where(flat, np.nan, cov / np.sqrt(vx * vy))
        p, q = np.nonzero((of(there, there) > 0) & (names[a][:, None] < names[b][None, :] if key[1] == key[2] else np.ones((len(a), len(b)), bool)))
        one, two = names[a][p], names[b][q]
        return pd.DataFrame({"market": key[0], "a": np.minimum(one.astype(object), two.astype(object)), "b": np.maximum(one.astype(object), two.astype(object)), "corr": corr[p, q], "n": n[p, q].astype(np.int64)})

    return pairs.groupBy("market", "i", "j").applyInPandas(gram, "market string, a string, b string, corr double, n long")


def correlations_with(returns: DataFrame, names: DataFrame) -> DataFrame:
    """(market, ticker, other, corr) of every instrument with each of the few names (market, other): linear in instruments."""
    theirs = returns.join(names.withColumnRenamed("other", "ticker"), ["market", "ticker"]).select("market", "date", F.col("ticker").alias("other"), F.col("ret").alias("rb"))
    both = returns.withColumnRenamed("ret", "ra").join(theirs, ["market", "date"]).where("ticker <> other")
    return both.groupBy("market", "ticker", "other").agg(guarded_corr("ra", "rb").alias("corr"))
