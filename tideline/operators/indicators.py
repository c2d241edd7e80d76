"""Per-instrument indicators: frames over (market, ticker) by date, and recursive means.

All sliding measures are Spark windows over one partitioning. The recursive
means (exponential, Wilder's) and the rolling rank run in one grouped pass over
the few columns that they read; windows and plain expressions follow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import flag, ratio, rolling, rolling_rank



def by_date() -> WindowSpec:
    """Rows of one series, by date; a function, as a window needs a session."""
    return W.partitionBy("market", "ticker").orderBy("date")
#: Recursive means: name -> (input, alpha, least observations).
MEANS = {
    **{f"ema{n}": ("close", 2 / (n + 1), n) for n in (8, 12, 20, 21, 26, 50, 200)},
    **{f"atr{n}": ("tr", 1 / n, n) for n in (5, 14, 20)},
    **{f"up{n}": ("gain", 1 / n, n) for n in (14, 2)},
    **{f"down{n}": ("loss", 1 / n, n) for n in (14, 2)},
    "plus": ("plus_dm", 1 / 14, 14), "minus": ("minus_dm", 1 / 14, 14),
}


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg, x, by_date(), n)


def inputs(bars: DataFrame) -> DataFrame:
    """True range, gains and losses, directional movement, width of the bands, bar number: all that the grouped pass reads."""
    mid, sd = sma(F.col("close"), 20), rolling(F.stddev_pop, F.col("close"), by_date(), 20)
    before = F.lag("close").over(by_date())
    up, down = F.col("high") - F.lag("high").over(by_date()), F.lag("low").over(by_date()) - F.col("low")
    change = F.col("close") - before
    return bars.withColumns({
        "idx": F.row_number().over(by_date()).cast("double"),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        "ret1": ratio(F.col("close"), before) - 1,
        "gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "bb_mid": mid, "bb_sd": sd, "bb_bw": ratio((mid + 2 * sd) - (mid - 2 * sd), mid),
    })


def recursive_means(rows: DataFrame, wanted: dict | None = None, adx: bool = True, macd: bool = True, rank: bool = True) -> DataFrame:
    """rows with the recursive means of each instrument, ADX and MACD made of them, and the rolling rank of the bands' width.

    It reads inputs() and nothing that sliding() adds, so that few columns pass through Python.
    """
    wanted = MEANS if wanted is None else wanted
    more = [*wanted, *(["pdi", "mdi", "adx"] if adx else []), *(["macd", "macd_signal", "macd_hist"] if macd else []), *(["bb_bw_pct"] if rank else [])]

    def mean(x: pd.Series, alpha: float, least: int) -> pd.Series:
        return x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        for name, (x, alpha, least) in wanted.items():
            frame[name] = mean(frame[x].astype(float), alpha, least)
        if adx:
            base = frame["atr14"].replace(0, np.nan)
            frame["pdi"], frame["mdi"] = 100 * frame["plus"] / base, 100 * frame["minus"] / base
            dx = 100 * (frame["pdi"] - frame["mdi"]).abs() / (frame["pdi"] + frame["mdi"]).replace(0, np.nan)
            frame["adx"] = mean(dx, 1 / 14, 14)
        if macd:
            frame["macd"] = frame["ema12"] - frame["ema26"]
            frame["macd_signal"] = mean(frame["macd"], 0.2, 9)
            frame["macd_hist"] = frame["macd"] - frame["macd_signal"]
        if rank:
            frame["bb_bw_pct"] = rolling_rank(frame["bb_bw"].to_numpy(float), 252, 63)
        return frame

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in more)])
    return rows.groupBy("market", "ticker").applyInPandas(run, schema)


def rsi(n: int) -> Column:
    """100 where there were no losses, also on a flat price."""
    up, down = F.col(f"up{n}"), F.col(f"down{n}")
    return F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down)))


def slope(y: Column, n: int) -> Column:
    frame = by_date().rowsBetween(-(n - 1), 0)
    pair = F.when(y.isNotNull(), F.col("idx"))
    return F.when(F.count(y).over(frame) >= n, F.regr_slope(y, pair).over(frame))


def r2(y: Column, n: int) -> Column:
    """Squared correlation with the bar number; null for a constant."""
    frame = by_date().rowsBetween(-(n - 1), 0)
    spread = F.max(y).over(frame) > F.min(y).over(frame)
    return F.when((F.count(y).over(frame) >= n) & spread, F.regr_r2(y, F.when(y.isNotNull(), F.col("idx"))).over(frame))


def donchian(n: int) -> tuple[Column, Column]:
    """Highest high and lowest low of the n bars before."""
    frame = by_date().rowsBetween(-n, -1)
    full = F.count("high").over(frame) >= n
    return F.when(full, F.max("high").over(frame)), F.when(F.count("low").over(frame) >= n, F.min("low").over(frame))


def sliding(rows: DataFrame, horizon: int = 15) -> DataFrame:
    """Every measure that a frame gives; needs inputs(). ppy (periods a year) is a column."""
    c, v = F.col("close"), F.coalesce("volume", F.lit(0.0))  # a missing volume counts as none
    change = c - F.lag("close").over(by_date())
    rows = rows.withColumns({
        "sma50": sma(c, 50), "sma200": sma(c, 200),
        "obv": F.sum(F.coalesce(F.signum(change), F.lit(0.0)) * v).over(by_date().rowsBetween(W.unboundedPreceding, 0)),
        "donch20_hi": donchian(20)[0], "donch20_lo": donchian(20)[1], "donch55_hi": donchian(55)[0],
        "swing_low10": rolling(F.min, F.col("low"), by_date(), 10, 5),
        "log_close": F.when(c > 0, F.ln(c)),
        "log_ret": F.when(F.try_divide(c, F.lag("close").over(by_date())) > 0, F.ln(F.try_divide(c, F.lag("close").over(by_date())))),
        "mfv": F.coalesce(ratio((c - F.col("low")) - (F.col("high") - c), F.col("high") - F.col("low")) * v, F.lit(0.0)),
        "up_volume": F.when(change > 0, v).otherwise(0.0), "down_volume": F.when(change < 0, v).otherwise(0.0),
        "close_range": ratio(c - F.col("low"), F.col("high") - F.col("low")), "turnover": c * v,
    })
    back = lambda n: F.lag("close", n).over(by_date())
    rows = rows.withColumns({
        "bb_up": F.col("bb_mid") + 2 * F.col("bb_sd"), "bb_lo": F.col("bb_mid") - 2 * F.col("bb_sd"),
        "obv_slope": ratio(slope(F.col("obv"), 20), sma(v, 20)),
        "cmf20": ratio(rolling(F.sum, F.col("mfv"), by_date(), 20), rolling(F.sum, v, by_date(), 20)),
        "updown_vol": F.ln(ratio(rolling(F.sum, F.col("up_volume"), by_date(), 20) + 1, rolling(F.sum, F.col("down_volume"), by_date(), 20) + 1)),
        "rvol": ratio(sma(v, 5), rolling(F.avg, v, by_date(), 50, 20)),
        "clenow_slope": slope(F.col("log_close"), 90), "clenow_r2": r2(F.col("log_close"), 90),
        "rv20": rolling(F.stddev_samp, F.col("log_ret"), by_date(), 20) * F.sqrt("ppy"),
        "mom_12_1": ratio(back(21), back(252)) - 1, "mom_6m": ratio(c, back(126)) - 1, "mom_3m": ratio(c, back(63)) - 1, "mom_1m": ratio(c, back(21)) - 1,
        "pct_52w_high": ratio(c, rolling(F.max, F.col("high"), by_date(), 252, 120)),
        "adv20": rolling(F.avg, F.col("turnover"), by_date(), 20, 10),
        "close_range3": rolling(F.avg, F.col("close_range"), by_date(), 3, 1),
        "dist200": ratio(c, F.col("sma200")) - 1,
        "breakout20": flag(c > F.col("donch20_hi")), "breakout55": flag(c > F.col("donch55_hi")),
        "fwd_ret": ratio(F.lead("close", horizon).over(by_date()), c) - 1,
    })
    return rows.withColumns({
        "bb_pctb": ratio(c - F.col("bb_lo"), F.col("bb_up") - F.col("bb_lo")),
        "clenow": (F.exp(F.col("clenow_slope") * F.col("ppy")) - 1) * F.col("clenow_r2"),
    })


def relative_strength(rows: DataFrame, bench: DataFrame | None) -> DataFrame:
    """rs_3m: mom_3m less the benchmark's 63-bar return on the instrument's own dates; without benchmark mom_3m."""
    if bench is None:
        return rows.withColumn("rs_3m", F.col("mom_3m"))
    joined = rows.join(bench.select("market", "date", F.col("close").alias("bench_raw")), ["market", "date"], "left")
    joined = joined.withColumn("bench_close", F.last("bench_raw", ignorenulls=True).over(by_date().rowsBetween(W.unboundedPreceding, 0)))
    return joined.withColumn("rs_3m", F.col("mom_3m") - (ratio(F.col("bench_close"), F.lag("bench_close", 63).over(by_date())) - 1)).drop("bench_raw", "bench_close")


def derived(rows: DataFrame) -> DataFrame:
    """What follows from the measures of one row; atr_ideal is a column."""
    c = F.col("close")
    rows = rows.withColumns({
        "atr": F.col("atr14"), "atr_pct": 100 * ratio(F.col("atr14"), c), "rsi14": rsi(14), "rsi2": rsi(2),
        "kc_up": F.col("ema20") + 1.5 * F.col("atr20"), "kc_lo": F.col("ema20") - 1.5 * F.col("atr20"),
        "dist21_atr": ratio(c - F.col("ema21"), F.col("atr14")),
    })
    align = flag(c > F.col("ema21")) + flag(F.col("ema21") > F.col("ema50")) + flag(F.col("ema50") > F.col("ema200"))
    rows = rows.withColumns({
        "squeeze_on": flag((F.col("bb_up") < F.col("kc_up")) & (F.col("bb_lo") > F.col("kc_lo"))),
        "ema_align": F.when(F.col("ema200").isNotNull(), align),
        "above200": F.when(F.col("sma200").isNotNull(), flag(c > F.col("sma200"))),
        "uptrend": F.when(F.col("sma200").isNotNull(), flag((c > F.col("sma200")) & (F.col("ema21") > F.col("ema50")))),
        "adx_dir": F.when((F.col("adx") * F.signum(F.col("pdi") - F.col("mdi"))).isNotNull(), F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("adx") * F.signum(F.col("pdi") - F.col("mdi"))))),
        "rsi_zone": -F.abs(F.col("rsi14") - 48), "ema21_fit": -F.abs(F.col("dist21_atr") - 0.3), "rsi2_inv": 100 - F.col("rsi2"),
        "bw_compression": -F.col("bb_bw_pct"), "atr_fit": -F.abs(F.when(ratio(F.col("atr_pct"), F.col("atr_ideal")) > 0, F.ln(ratio(F.col("atr_pct"), F.col("atr_ideal"))))),
        "vol_contraction": -ratio(F.col("atr5"), F.col("atr20")),
    })
    return rows


def features(bars: DataFrame, bench: DataFrame | None = None, horizon: int = 15) -> DataFrame:
    """The whole feature frame; bars carry ppy and atr_ideal (see with_market)."""
    return derived(relative_strength(sliding(recursive_means(inputs(bars)), horizon), bench))


def with_market(bars: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """Periods a year and ideal ATR percent by market; an unknown market gets 252 and 2.5."""
    ppy, ideal = F.lit(252.0), F.lit(2.5)
    for name, s in settings.items():
        ppy = F.when(F.col("market") == name, float(s["ppy"])).otherwise(ppy)
        ideal = F.when(F.col("market") == name, float(s["atr_ideal"])).otherwise(ideal)
    return bars.withColumns({"ppy": ppy, "atr_ideal": ideal})
