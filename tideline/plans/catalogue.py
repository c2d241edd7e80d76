"""Registered queries over the driver's tables, each beside DuckDB SQL where SQL can say it.

Bars are weekly bars of part brands, made of line items. Floats are rounded in
both, as sums in another order differ in their last places.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import backtest, crosssection, indicators, macro, ml, plan, regime, rules
from ..sources import bars as source
from ..storage import once, stored
from ..streaming import bars as ticks
from ..streaming import live
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CFG = config.load({"markets": {"brand": {"currency": "USD", "atr_ideal": 2.5, "ppy": 52, "adv_floor": 2e6, "min_price": 5.0, "base": 1.0}}})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def rounded(df: DataFrame, keys: list[str], **places: int) -> DataFrame:
    return df.select(*keys, *(F.round(c, n).alias(c) for c, n in places.items()))


# -- shared inputs


def kept(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made of line items and parts, stored until these or the settings change."""
    return once(spark, (name, sf), make, [f"{sf}/lineitem.parquet", f"{sf}/part.parquet"], CFG)


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars; made once for all queries that go on from there."""
    return kept(spark, sf, "bars", lambda: source.brand_bars(spark, sf))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.with_market(weekly(spark, sf), CFG["markets"])


def slid(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.sliding(indicators.inputs(bars(spark, sf)))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The feature panel; made once for all queries that read it."""
    return kept(spark, sf, "panel", lambda: indicators.features(bars(spark, sf), bench(spark, sf)))


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's last sixty returns, stored."""
    return kept(spark, sf, "returns", lambda: crosssection.last_returns(weekly(spark, sf)))


def bench(spark: SparkSession, sf: str) -> DataFrame:
    """One brand stands for the market."""
    return weekly(spark, sf).where("ticker = 'Brand#11'").drop("ticker")


def regimes(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf)
    wide = own.withColumn("sma50", indicators.sma(F.col("close"), 50))
    return regime.compute(indicators.with_market(bench(spark, sf), CFG["markets"]), crosssection.breadth(wide))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The scored panel with all factors; made once for all queries that read it."""
    return kept(spark, sf, "scored", lambda: crosssection.score_panel(panel(spark, sf), regimes(spark, sf), CFG["weights"]))


# -- shared SQL

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _bars_sql(unit: str = "week") -> str:
    return f"""bars AS (SELECT p_brand AS ticker, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date,
 first(l_extendedprice ORDER BY {_ORDER}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
 last(l_extendedprice ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


BARS = _bars_sql()
O = "PARTITION BY ticker ORDER BY date"  # noqa: E741


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    f = f"({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} >= {least or n} THEN {agg}({x}) OVER {f} END"


STEP = f"""{BARS}, steps AS (SELECT *, row_number() OVER w AS idx, lag(close) OVER w AS before, close - lag(close) OVER w AS change,
 high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM bars WINDOW w AS ({O})),
inp AS (SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS tr, greatest(change, 0) AS gain, greatest(-change, 0) AS loss,
 CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus_dm FROM steps)"""
# greatest() in DuckDB skips nulls; a first bar has no change, so gain and loss are set to null there
STEP = STEP.replace("greatest(change, 0) AS gain, greatest(-change, 0) AS loss", "CASE WHEN change IS NOT NULL THEN greatest(change, 0) END AS gain, CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END AS loss")


def means_sql(wanted: dict, source_table: str = "inp", name: str = "ew", prior: str = STEP) -> str:
    """A recursive CTE: every mean one row further at a time (inputs have no gaps after their first value)."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, (x, _, _) in wanted.items())
    more = ", ".join(f"CASE WHEN e.{k} IS NULL THEN i.{x} WHEN i.{x} IS NULL THEN e.{k} ELSE (1 - {a!r}) * e.{k} + {a!r} * i.{x} END" for k, (x, a, _) in wanted.items())
    return f"""{prior}, {name} AS (SELECT ticker, idx, {first} FROM {source_table} WHERE idx = 1
 UNION ALL SELECT i.ticker, i.idx, {more} FROM {name} e JOIN {source_table} i ON i.ticker = e.ticker AND i.idx = e.idx + 1)"""


def _shown(k: str) -> str:
    """A mean from its least observations on; those of changes begin one bar later."""
    x, _, n = indicators.MEANS[k]
    return f"CASE WHEN e.idx >= {n + (x in ('gain', 'loss'))} THEN e.{k} END"


ALL_MEANS = "WITH RECURSIVE " + means_sql(indicators.MEANS)
FULL = f"""{ALL_MEANS}, m AS (SELECT i.*, {', '.join(f'{_shown(k)} AS {k}' for k in indicators.MEANS)} FROM inp i JOIN ew e USING (ticker, idx))"""


# -- sources

for _unit, _name in (("week", "bars_weekly"), ("day", "bars_daily")):
    query(_name, f"WITH {_bars_sql(_unit)} SELECT * FROM bars")(lambda s, d, u=_unit: source.brand_bars(s, d, u).drop("market"))


@query("bars_hourly_events", "SELECT event_type AS ticker, date_trunc('hour', ts) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2")
def _(s, d):
    return source.event_bars(source.table(s, d, "events")).drop("market")


@query("bars_normalised", "SELECT ticker, date, open, high, low, close, volume FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low, l_extendedprice AS close, l_quantity AS volume, row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE n = 1")
def _(s, d):
    t = source.ticks(s, d).select("market", F.col("ticker").alias("Ticker"), F.col("l_shipdate").alias("Date"), F.col("price").cast("string").alias("Close"), F.col("qty").cast("string").alias("Volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    return source.normalise(t).drop("market")


@query("wide_to_long", f"WITH {BARS} SELECT ticker, date, close, volume FROM bars WHERE ticker IN ('Brand#11', 'Brand#12') AND close IS NOT NULL")
def _(s, d):
    b = source.brand_bars(s, d).where(F.col("ticker").isin("Brand#11", "Brand#12"))
    wide = b.groupBy("date").pivot("ticker", ["Brand#11", "Brand#12"]).agg(F.first("close").alias("Close"), F.first("volume").alias("Volume"))
    wide = wide.select("date", *(F.col(f"`{t}_{f}`").alias(f"{f}_{t}") for t in ("Brand#11", "Brand#12") for f in ("Close", "Volume")))
    return source.from_wide(wide, ("Close", "Volume")).where("close is not null").select("ticker", "date", "close", "volume")


@query("wide_to_long_all_tickers", f"WITH {BARS} SELECT ticker, date, close, volume FROM bars WHERE close IS NOT NULL")
def _(s, d):
    b = source.brand_bars(s, d)
    tickers = [r["ticker"] for r in b.select("ticker").distinct().orderBy("ticker").collect()]
    wide = b.groupBy("date").pivot("ticker", tickers).agg(F.first("close").alias("Close"), F.first("volume").alias("Volume"))
    wide = wide.select("date", *(F.col(f"`{t}_{f}`").alias(f"{f}_{t}") for t in tickers for f in ("Close", "Volume")))
    return source.from_wide(wide, ("Close", "Volume")).where("close is not null").select("ticker", "date", "close", "volume")


@query("min_bars_filter", f"WITH {BARS} SELECT ticker, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 355")
def _(s, d):
    return source.with_enough(source.brand_bars(s, d), 355).groupBy("ticker").agg(F.count("*").alias("n"))


@query("universe_missing", "SELECT DISTINCT p_brand AS ticker FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_discount >= 0.09 AND l_tax >= 0.07)")
def _(s, d):
    listed = source.table(s, d, "part").select(F.col("p_brand").alias("ticker"), F.col("p_partkey").alias("pos"))
    part, items = source.table(s, d, "part"), source.table(s, d, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09 and l_tax >= 0.07")
    have = items.join(part, items["l_partkey"] == part["p_partkey"]).select(F.col("p_brand").alias("ticker"))
    return source.missing(source.universe(listed).select("ticker"), have)


@query("universe_order", "SELECT trim(p_brand) AS ticker, min(p_partkey) AS pos FROM part WHERE trim(p_brand) <> '' GROUP BY 1")
def _(s, d):
    return source.universe(source.table(s, d, "part").select(F.col("p_brand").alias("ticker"), F.col("p_partkey").alias("pos")))


@query("drop_partial_bar", f"WITH {_bars_sql('day')}, l AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM bars) SELECT ticker, count(*) AS n, max(date) AS latest FROM l WHERE NOT (date = last AND date >= DATE '2001-10-31') GROUP BY 1")
def _(s, d):
    b = source.brand_bars(s, d, "day").withColumn("market", F.lit("us"))
    return source.drop_partial(b, datetime(2001, 10, 31, 15, 0)).groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("latest"))


INDEX = f"""{BARS}, r AS (SELECT date, close / nullif(lag(close) OVER ({O}), 0) - 1 AS ret FROM bars),
 dly AS (SELECT date, coalesce(avg(ret), 0) AS ret FROM r GROUP BY 1), idx0 AS (SELECT 'brand' AS ticker, date, 100 * exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS close FROM dly)"""


@query("equal_weight_index", f"WITH {INDEX} SELECT date, round(log10(close), 8) AS log_close FROM idx0")
def _(s, d):
    index = source.equal_weight_index(source.brand_bars(s, d))
    return index.select("date", F.round(F.log10("close"), 8).alias("log_close"))


@query("latest_quotes", "SELECT event_type AS ticker, last(value ORDER BY ts, event_id) AS price, max(ts) AS ts FROM events GROUP BY 1")
def _(s, d):
    e = source.table(s, d, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))
    return source.latest_quotes(e.withColumnRenamed("event_type", "ticker")).select("ticker", "price", "ts")


# -- sliding indicators


def sliding_query(name: str, sql: dict[str, tuple[str, int]], prior: str = STEP, table: str = "inp") -> None:
    """A query of columns of the sliding frame; sql: column -> (expression, places)."""
    shown = ", ".join(f"round({x}, {n}) AS {c}" for c, (x, n) in sql.items())
    query(name, f"WITH {prior} SELECT ticker, date, {shown} FROM {table}")(lambda s, d: rounded(slid(s, d), ["ticker", "date"], **{c: n for c, (_, n) in sql.items()}))


def _lag(n: int) -> str:
    return f"lag(close, {n}) OVER ({O})"


_B = "CASE WHEN count({x}) OVER w >= {n} THEN {e} END"
sliding_query("sma_50_200", {"sma50": (roll("avg", "close", 50), 6), "sma200": (roll("avg", "close", 200), 6)})
sliding_query("true_range", {"tr": ("tr", 4)})
_mid, _sd = roll("avg", "close", 20), roll("stddev_pop", "close", 20)
sliding_query("bollinger", {"bb_up": (f"({_mid}) + 2 * ({_sd})", 4), "bb_lo": (f"({_mid}) - 2 * ({_sd})", 4), "bb_bw": (f"4 * ({_sd}) / nullif({_mid}, 0)", 6), "bb_pctb": (f"(close - ({_mid}) + 2 * ({_sd})) / nullif(4 * ({_sd}), 0)", 6)})


def _prior(agg: str, x: str, n: int) -> str:
    f = f"({O} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} >= {n} THEN {agg}({x}) OVER {f} END"


sliding_query("donchian", {"donch20_hi": (_prior("max", "high", 20), 4), "donch20_lo": (_prior("min", "low", 20), 4), "donch55_hi": (_prior("max", "high", 55), 4)})
sliding_query("breakouts", {"breakout20": (f"CASE WHEN close > {_prior('max', 'high', 20)} THEN 1.0 ELSE 0.0 END", 1), "breakout55": (f"CASE WHEN close > {_prior('max', 'high', 55)} THEN 1.0 ELSE 0.0 END", 1)})
sliding_query("swing_low", {"swing_low10": (roll("min", "low", 10, 5), 4)})
_obv = STEP + f", ob AS (SELECT *, sum(coalesce(sign(change), 0) * volume) OVER ({O}) AS obv FROM inp)"
sliding_query("obv", {"obv": ("obv", 2), "obv_slope": (f"(CASE WHEN count(obv) OVER ({O} ROWS 19 PRECEDING) >= 20 THEN regr_slope(obv, idx) OVER ({O} ROWS 19 PRECEDING) END) / nullif({roll('avg', 'volume', 20)}, 0)", 6)}, _obv, "ob")
_mfv = STEP + ", mf AS (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0) AS mfv, CASE WHEN change > 0 THEN volume ELSE 0 END AS upv, CASE WHEN change < 0 THEN volume ELSE 0 END AS downv, (close - low) / nullif(high - low, 0) AS cr FROM inp)"
sliding_query("cmf20", {"cmf20": (f"({roll('sum', 'mfv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0)", 6)}, _mfv, "mf")
sliding_query("updown_vol", {"updown_vol": (f"ln((({roll('sum', 'upv', 20)}) + 1) / (({roll('sum', 'downv', 20)}) + 1))", 6)}, _mfv, "mf")
sliding_query("rvol", {"rvol": (f"({roll('avg', 'volume', 5)}) / nullif({roll('avg', 'volume', 50, 20)}, 0)", 6)})
sliding_query("adv20", {"adv20": (roll("avg", "close * volume", 20, 10), 4)})
sliding_query("close_range", {"close_range": ("cr", 6), "close_range3": (roll("avg", "cr", 3, 1), 6)}, _mfv, "mf")
_lc = STEP + ", lc AS (SELECT *, ln(close) AS lc, ln(close / before) AS lr FROM inp)"
_w90 = f"({O} ROWS 89 PRECEDING)"
sliding_query("clenow", {"clenow_slope": (f"CASE WHEN count(lc) OVER {_w90} >= 90 THEN regr_slope(lc, idx) OVER {_w90} END", 8), "clenow_r2": (f"CASE WHEN count(lc) OVER {_w90} >= 90 AND max(lc) OVER {_w90} > min(lc) OVER {_w90} THEN regr_r2(lc, idx) OVER {_w90} END", 6)}, _lc, "lc")
sliding_query("realized_vol", {"rv20": (f"({roll('stddev_samp', 'lr', 20)}) * sqrt(52)", 6)}, _lc, "lc")
sliding_query("momentum_lags", {"ret1": ("close / before - 1", 6), "mom_12_1": (f"{_lag(21)} / {_lag(252)} - 1", 6), "mom_6m": (f"close / {_lag(126)} - 1", 6), "mom_3m": (f"close / {_lag(63)} - 1", 6), "mom_1m": (f"close / {_lag(21)} - 1", 6)})
sliding_query("high_52w", {"pct_52w_high": (f"close / ({roll('max', 'high', 252, 120)})", 6)})
sliding_query("fwd_ret", {"fwd_ret": (f"lead(close, 15) OVER ({O}) / close - 1", 6)})
sliding_query("dist200", {"dist200": (f"close / ({roll('avg', 'close', 200)}) - 1", 6)})
RANKED = STEP + f", bw0 AS (SELECT ticker, date, idx, 4 * ({_sd}) / nullif({_mid}, 0) AS bb_bw FROM inp), bw AS (SELECT a.ticker, a.date, CASE WHEN count(b.bb_bw) >= 63 THEN (count(CASE WHEN b.bb_bw < a.bb_bw THEN 1 END) + (count(CASE WHEN b.bb_bw = a.bb_bw THEN 1 END) + 1) / 2.0) / count(b.bb_bw) END AS bb_bw_pct FROM bw0 a JOIN bw0 b ON a.ticker = b.ticker AND b.idx BETWEEN a.idx - 251 AND a.idx GROUP BY a.ticker, a.date, a.bb_bw HAVING a.bb_bw IS NOT NULL)"


@query("rolling_rank_bw", f"WITH {RANKED} SELECT ticker, date, round(bb_bw_pct, 6) AS bb_bw_pct FROM bw WHERE bb_bw_pct IS NOT NULL")
def _(s, d):
    rows = indicators.recursive_means(indicators.inputs(bars(s, d)), {}, adx=False, macd=False)
    return rounded(rows.where("bb_bw_pct is not null"), ["ticker", "date"], bb_bw_pct=6)


@query("rel_strength", f"WITH {BARS}, j AS (SELECT b.*, last_value(i.close IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date) AS bc FROM bars b LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'Brand#11') i USING (date)) SELECT ticker, date, round(close / {_lag(63)} - 1 - (bc / lag(bc, 63) OVER ({O}) - 1), 6) AS rs_3m FROM j")
def _(s, d):
    return rounded(indicators.relative_strength(slid(s, d), bench(s, d)), ["ticker", "date"], rs_3m=6)


# -- recursive indicators


def featured(s: SparkSession, d: str) -> DataFrame:
    return indicators.derived(indicators.sliding(indicators.recursive_means(indicators.inputs(bars(s, d)))))


def recursive_query(name: str, sql: dict[str, tuple[str, int]], prior: str = FULL, table: str = "m") -> None:
    shown = ", ".join(f"round({x}, {n}) AS {c}" for c, (x, n) in sql.items())
    query(name, f"{prior} SELECT ticker, date, {shown} FROM {table}")(lambda s, d: rounded(featured(s, d), ["ticker", "date"], **{c: n for c, (_, n) in sql.items()}))


recursive_query("ema_stack", {f"ema{n}": (f"ema{n}", 4) for n in (8, 21, 50, 200)})
recursive_query("atr", {"atr5": ("atr5", 4), "atr14": ("atr14", 4), "atr20": ("atr20", 4), "atr_pct": ("100 * atr14 / close", 6)})
_RSI14, _RSI2 = (f"CASE WHEN down{n} = 0 THEN 100 ELSE 100 - 100 / (1 + up{n} / down{n}) END" for n in (14, 2))
recursive_query("rsi", {"rsi14": (_RSI14, 4), "rsi2": (_RSI2, 4)})
DX = FULL + ", dx0 AS (SELECT ticker, date, idx - 13 AS idx, 100 * plus / nullif(atr14, 0) AS pdi, 100 * minus / nullif(atr14, 0) AS mdi FROM m WHERE idx >= 14), dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM dx0)"
_ADX = means_sql({"adx": ("dx", 1 / 14, 14)}, "dx", "ad", DX)
ADX = _ADX + ", am AS (SELECT m.*, dx.pdi, dx.mdi, CASE WHEN ad.idx >= 14 THEN ad.adx END AS adx FROM m LEFT JOIN dx USING (ticker, date) LEFT JOIN ad ON ad.ticker = dx.ticker AND ad.idx = dx.idx)"
recursive_query("adx", {"pdi": ("pdi", 4), "mdi": ("mdi", 4), "adx": ("adx", 4)}, ADX, "am")
MACD = means_sql({"sig": ("line", 0.2, 9)}, "ml", "sg", FULL + ", ml AS (SELECT ticker, date, idx - 25 AS idx, ema12 - ema26 AS line FROM m WHERE idx >= 26)") + ", mm AS (SELECT m.ticker, m.date, line AS macd, CASE WHEN sg.idx >= 9 THEN sig END AS macd_signal FROM m LEFT JOIN ml USING (ticker, date) LEFT JOIN sg ON sg.ticker = ml.ticker AND sg.idx = ml.idx)"
recursive_query("macd", {"macd": ("macd", 4), "macd_signal": ("macd_signal", 4), "macd_hist": ("macd - macd_signal", 4)}, MACD, "mm")
KELT = FULL + f", kc AS (SELECT *, ema20 + 1.5 * atr20 AS kc_up, ema20 - 1.5 * atr20 AS kc_lo, ({_mid}) + 2 * ({_sd}) AS bb_up, ({_mid}) - 2 * ({_sd}) AS bb_lo, {roll('avg', 'close', 200)} AS sma200 FROM m)"
recursive_query("keltner_squeeze", {"kc_up": ("kc_up", 4), "kc_lo": ("kc_lo", 4), "squeeze_on": ("CASE WHEN bb_up < kc_up AND bb_lo > kc_lo THEN 1.0 ELSE 0.0 END", 1)}, KELT, "kc")
_f = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
recursive_query("trend_flags", {"ema_align": (f"CASE WHEN ema200 IS NOT NULL THEN {_f('close > ema21')} + {_f('ema21 > ema50')} + {_f('ema50 > ema200')} END", 1), "above200": (f"CASE WHEN sma200 IS NOT NULL THEN {_f('close > sma200')} END", 1), "uptrend": (f"CASE WHEN sma200 IS NOT NULL THEN {_f('close > sma200 AND ema21 > ema50')} END", 1)}, KELT, "kc")
recursive_query("scoring_transforms", {"adx_dir": ("greatest(-60, least(60, adx * sign(pdi - mdi))) + 0 * adx", 4), "rsi_zone": (f"-abs(({_RSI14}) - 48)", 4), "ema21_fit": ("-abs((close - ema21) / nullif(atr14, 0) - 0.3)", 6), "rsi2_inv": (f"100 - ({_RSI2})", 4), "atr_fit": ("-abs(ln(100 * atr14 / close / 2.5))", 6), "vol_contraction": ("-atr5 / nullif(atr20, 0)", 6)}, ADX, "am")


# -- cross-sections, on the factors that need no recursive mean (absent factors are skipped)

LITE_FACTORS = {"trend": ["clenow", "dist200"], "momentum": ["mom_12_1", "mom_6m", "rs_3m", "pct_52w_high"], "timing": ["close_range3"], "volume": ["obv_slope", "cmf20", "updown_vol"]}
_ALL = [f for g in LITE_FACTORS.values() for f in g]


def lite(s: SparkSession, d: str) -> DataFrame:
    rows = indicators.relative_strength(slid(s, d), bench(s, d))
    return rows.select("market", "ticker", "date", "close", "sma50", "fwd_ret", "adv20", *_ALL)


def lite_scored(s: SparkSession, d: str) -> DataFrame:
    return crosssection.score_panel(lite(s, d), regimes(s, d), CFG["weights"])


def both(name: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers f over the light factors and, as name_all_factors, over all 18, each beside its SQL."""
    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        query(name, sql)(lambda s, d: f(lite_scored(s, d)))
        query(f"{name}_all_factors", sql.replace(f"WITH {COMP}", f"WITH RECURSIVE {COMP_ALL}"))(lambda s, d: f(scored(s, d)))
        return f

    return put


_FEATURES = f"""{_mfv}, ob AS (SELECT *, ln(close) AS lc, sum(coalesce(sign(change), 0) * volume) OVER ({O}) AS obv FROM mf),
 bn AS (SELECT o.*, last_value(b.close IGNORE NULLS) OVER (PARTITION BY o.ticker ORDER BY o.date) AS bc FROM ob o LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'Brand#11') b USING (date)),
 feat AS (SELECT ticker, date, idx, close, {roll('avg', 'close', 50)} AS sma50, lead(close, 15) OVER ({O}) / close - 1 AS fwd_ret, {roll('avg', 'close * volume', 20, 10)} AS adv20,
 CASE WHEN count(lc) OVER {_w90} >= 90 THEN (exp(52 * regr_slope(lc, idx) OVER {_w90}) - 1) * CASE WHEN max(lc) OVER {_w90} > min(lc) OVER {_w90} THEN regr_r2(lc, idx) OVER {_w90} END END AS clenow,
 close / ({roll('avg', 'close', 200)}) - 1 AS dist200, {_lag(21)} / {_lag(252)} - 1 AS mom_12_1, close / {_lag(126)} - 1 AS mom_6m, close / {_lag(63)} - 1 - (bc / lag(bc, 63) OVER ({O}) - 1) AS rs_3m,
 close / ({roll('max', 'high', 252, 120)}) AS pct_52w_high, {roll('avg', 'cr', 3, 1)} AS close_range3,
 (CASE WHEN count(obv) OVER ({O} ROWS 19 PRECEDING) >= 20 THEN regr_slope(obv, idx) OVER ({O} ROWS 19 PRECEDING) END) / nullif({roll('avg', 'volume', 20)}, 0) AS obv_slope,
 ({roll('sum', 'mfv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS cmf20, ln((({roll('sum', 'upv', 20)}) + 1) / (({roll('sum', 'downv', 20)}) + 1)) AS updown_vol FROM bn)"""
_Z = lambda x: f"CASE WHEN {x} IS NOT NULL AND stddev_samp({x}) OVER d > 0 THEN greatest(-3, least(3, ({x} - avg({x}) OVER d) / stddev_samp({x}) OVER d)) END"


def _mean_sql(pairs: list[tuple[str, str]]) -> str:
    top, bottom = (" + ".join(f(x, w) for x, w in pairs) for f in (lambda x, w: f"coalesce({x} * {w}, 0)", lambda x, w: f"CASE WHEN {x} IS NOT NULL THEN {w} ELSE 0 END"))
    return f"({top}) / nullif({bottom}, 0)"


def _weight(f: str) -> float:
    return next(float(g[f]) for g in config.TECHNICAL.values() if f in g)


def _zed_sql(features: str, groups: dict[str, list[str]]) -> str:
    """z-scores of the factors by date and the group scores, behind the CTEs that end in feat."""
    zs = ", ".join(f"{_Z(f)} AS z_{f}" for fs in groups.values() for f in fs)
    gs = ", ".join(_mean_sql([(f"z_{f}", str(_weight(f))) for f in fs]) + f" AS g_{g}" for g, fs in groups.items())
    return f"{features}, zed AS (SELECT *, {zs} FROM feat WINDOW d AS (PARTITION BY date)), grp AS (SELECT *, {gs} FROM zed)"


ZED = _zed_sql(_FEATURES, LITE_FACTORS)
ALL_FACTORS = {g: list(fs) for g, fs in config.TECHNICAL.items()}
#: All 18 factors: the recursive means beside the sliding measures.
_FEATURES_ALL = ADX.removeprefix("WITH RECURSIVE ") + f""", fa AS (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0) AS mfv, CASE WHEN change > 0 THEN volume ELSE 0 END AS upv, CASE WHEN change < 0 THEN volume ELSE 0 END AS downv,
 (close - low) / nullif(high - low, 0) AS cr, 4 * ({_sd}) / nullif({_mid}, 0) AS bb_bw, ln(close) AS lc, sum(coalesce(sign(change), 0) * volume) OVER ({O}) AS obv,
 coalesce(({_mid}) + 2 * ({_sd}) < ema20 + 1.5 * atr20 AND ({_mid}) - 2 * ({_sd}) > ema20 - 1.5 * atr20, false) AS squeezed, coalesce(close > {_prior('max', 'high', 55)}, false) AS broke55 FROM am),
 fb AS (SELECT o.*, last_value(b.close IGNORE NULLS) OVER (PARTITION BY o.ticker ORDER BY o.date) AS bc FROM fa o LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'Brand#11') b USING (date)),
 fr AS (SELECT a.ticker, a.date, CASE WHEN count(b.bb_bw) >= 63 THEN (count(CASE WHEN b.bb_bw < a.bb_bw THEN 1 END) + (count(CASE WHEN b.bb_bw = a.bb_bw THEN 1 END) + 1) / 2.0) / count(b.bb_bw) END AS bb_bw_pct FROM fa a JOIN fa b ON a.ticker = b.ticker AND b.idx BETWEEN a.idx - 251 AND a.idx GROUP BY a.ticker, a.date, a.bb_bw HAVING a.bb_bw IS NOT NULL),
 feat AS (SELECT ticker, date, idx, close, squeezed, broke55, {roll('avg', 'close', 50)} AS sma50, lead(close, 15) OVER ({O}) / close - 1 AS fwd_ret, {roll('avg', 'close * volume', 20, 10)} AS adv20,
 CASE WHEN ema200 IS NOT NULL THEN {_f('close > ema21')} + {_f('ema21 > ema50')} + {_f('ema50 > ema200')} END AS ema_align, CASE WHEN adx IS NOT NULL AND pdi IS NOT NULL AND mdi IS NOT NULL THEN greatest(-60, least(60, adx * sign(pdi - mdi))) END AS adx_dir,
 CASE WHEN count(lc) OVER {_w90} >= 90 THEN (exp(52 * regr_slope(lc, idx) OVER {_w90}) - 1) * CASE WHEN max(lc) OVER {_w90} > min(lc) OVER {_w90} THEN regr_r2(lc, idx) OVER {_w90} END END AS clenow,
 close / ({roll('avg', 'close', 200)}) - 1 AS dist200, {_lag(21)} / {_lag(252)} - 1 AS mom_12_1, close / {_lag(126)} - 1 AS mom_6m, close / {_lag(63)} - 1 - (bc / lag(bc, 63) OVER ({O}) - 1) AS rs_3m,
 close / ({roll('max', 'high', 252, 120)}) AS pct_52w_high, -abs(({_RSI14}) - 48) AS rsi_zone, -abs((close - ema21) / nullif(atr14, 0) - 0.3) AS ema21_fit, 100 - ({_RSI2}) AS rsi2_inv, {roll('avg', 'cr', 3, 1)} AS close_range3,
 -bb_bw_pct AS bw_compression, CASE WHEN atr14 > 0 THEN -abs(ln(100 * atr14 / close / 2.5)) END AS atr_fit, -atr5 / nullif(atr20, 0) AS vol_contraction,
 (CASE WHEN count(obv) OVER ({O} ROWS 19 PRECEDING) >= 20 THEN regr_slope(obv, idx) OVER ({O} ROWS 19 PRECEDING) END) / nullif({roll('avg', 'volume', 20)}, 0) AS obv_slope,
 ({roll('sum', 'mfv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS cmf20, ln((({roll('sum', 'upv', 20)}) + 1) / (({roll('sum', 'downv', 20)}) + 1)) AS updown_vol FROM fb LEFT JOIN fr USING (ticker, date))"""
ZED_ALL = _zed_sql(_FEATURES_ALL, ALL_FACTORS)
_BN = "PARTITION BY 1 ORDER BY date"
_rb = lambda agg, x, n, least: f"CASE WHEN count({x}) OVER (ORDER BY date ROWS {n - 1} PRECEDING) >= {least} THEN {agg}({x}) OVER (ORDER BY date ROWS {n - 1} PRECEDING) END"
REGIME = f"""br AS (SELECT date, avg(CASE WHEN s IS NOT NULL THEN CASE WHEN close > s THEN 1.0 ELSE 0.0 END END) AS breadth FROM (SELECT date, close, {roll('avg', 'close', 50)} AS s FROM bars) GROUP BY 1),
 b0 AS (SELECT date, close, row_number() OVER (ORDER BY date) AS i, {_rb('avg', 'close', 200, 120)} AS sma200, {_rb('avg', 'close', 50, 30)} AS sma50, ln(close / lag(close) OVER (ORDER BY date)) AS lr FROM bars WHERE ticker = 'Brand#11'),
 b1 AS (SELECT *, ({_rb('stddev_samp', 'lr', 20, 15)}) * sqrt(52) AS rv FROM b0),
 rp AS (SELECT a.date, CASE WHEN count(b.rv) >= 60 AND a.rv IS NOT NULL THEN (count(CASE WHEN b.rv < a.rv THEN 1 END) + (count(CASE WHEN b.rv = a.rv THEN 1 END) + 1) / 2.0) / count(b.rv) END AS rv_pct FROM b1 a JOIN b1 b ON b.i BETWEEN a.i - 251 AND a.i GROUP BY a.date, a.rv),
 b2 AS (SELECT b1.*, rv_pct, breadth AS breadth_val, CASE WHEN close > sma200 THEN 1.0 ELSE -1.0 END AS trend200, CASE WHEN sma50 > lag(sma50, 10) OVER (ORDER BY b1.date) THEN 0.5 ELSE -0.5 END AS slope50,
 CASE WHEN close > sma50 THEN 0.5 ELSE -0.5 END AS above50, CASE WHEN rv_pct > 0.85 THEN -1.0 WHEN rv_pct < 0.5 THEN 0.5 ELSE 0.0 END AS vol, CASE WHEN breadth > 0.6 THEN 1.0 WHEN breadth < 0.4 THEN -1.0 ELSE 0.0 END AS breadth FROM b1 JOIN rp USING (date) LEFT JOIN br USING (date)),
 b3 AS (SELECT *, CASE WHEN sma200 IS NOT NULL THEN avg(trend200 + slope50 + above50 + vol + b2.breadth) OVER (ORDER BY date ROWS 2 PRECEDING) ELSE 0 END AS score FROM (SELECT date, close, sma200, sma50, rv, rv_pct, breadth_val, trend200, slope50, above50, vol, breadth FROM b2) b2),
 reg AS (SELECT *, CASE WHEN score <= -3.5 THEN 'CRISIS' WHEN score <= -1 THEN 'RISK_OFF' WHEN score >= 2 THEN 'RISK_ON' ELSE 'NEUTRAL' END AS regime FROM b3)"""
REGIME = REGIME.replace("breadth AS breadth_val", "br.breadth AS breadth_val").replace("WHEN breadth > 0.6 THEN 1.0 WHEN breadth < 0.4", "WHEN br.breadth > 0.6 THEN 1.0 WHEN br.breadth < 0.4")


@query("breadth", f"WITH {BARS} SELECT date, round(avg(CASE WHEN s IS NOT NULL THEN CASE WHEN close > s THEN 1.0 ELSE 0.0 END END), 6) AS breadth FROM (SELECT date, close, {roll('avg', 'close', 50)} AS s FROM bars) GROUP BY 1")
def _(s, d):
    return rounded(crosssection.breadth(bars(s, d).withColumn("sma50", indicators.sma(F.col("close"), 50))), ["date"], breadth=6)


@query("regime_components", f"WITH {BARS}, {REGIME} SELECT date, round(close / sma200, 6) AS over200, round(rv, 6) AS rv, round(rv_pct, 6) AS rv_pct, trend200, slope50, above50, vol, breadth FROM reg")
def _(s, d):
    return regimes(s, d).select("date", F.round(F.col("close") / F.col("sma200"), 6).alias("over200"), F.round("rv", 6).alias("rv"), F.round("rv_pct", 6).alias("rv_pct"), "trend200", "slope50", "above50", "vol", "breadth")


@query("regime_label", f"WITH {BARS}, {REGIME} SELECT date, round(score, 6) AS score, regime FROM reg")
def _(s, d):
    return regimes(s, d).select("date", F.round("score", 6).alias("score"), "regime")


@query("regime_age", f"WITH {BARS}, {REGIME}, l AS (SELECT arg_max(regime, date) AS regime, max(date) AS date FROM reg) SELECT l.regime, l.date, (SELECT count(*) FROM reg r WHERE r.date > coalesce((SELECT max(date) FROM reg q WHERE q.regime <> l.regime), DATE '1900-01-01')) AS age FROM l")
def _(s, d):
    return regime.age(regimes(s, d)).select("regime", "date", "age")


@query("regime_mix", f"WITH {BARS}, {REGIME} SELECT regime, round(count(*) / (SELECT count(*) FROM reg), 2) AS share FROM reg GROUP BY 1")
def _(s, d):
    return regime.mix(regimes(s, d)).drop("market")


@query("zscore_cs", f"WITH {ZED} SELECT ticker, date, {', '.join(f'round(z_{f}, 5) AS z_{f}' for f in _ALL)} FROM zed")
def _(s, d):
    return rounded(crosssection.zscores(lite(s, d), _ALL), ["ticker", "date"], **{f"z_{f}": 5 for f in _ALL})


@query("group_scores", f"WITH {ZED} SELECT ticker, date, {', '.join(f'round(g_{g}, 5) AS g_{g}' for g in LITE_FACTORS)} FROM grp")
def _(s, d):
    return rounded(crosssection.group_scores(crosssection.zscores(lite(s, d), _ALL), config.TECHNICAL), ["ticker", "date"], **{f"g_{g}": 5 for g in LITE_FACTORS})


@query("zscore_cs_all_factors", f"WITH RECURSIVE {ZED_ALL} SELECT ticker, date, {', '.join(f'round(z_{f}, 5) AS z_{f}' for fs in ALL_FACTORS.values() for f in fs)} FROM zed")
def _(s, d):
    return rounded(scored(s, d), ["ticker", "date"], **{f"z_{f}": 5 for g in config.TECHNICAL.values() for f in g})


@query("group_scores_all_factors", f"WITH RECURSIVE {ZED_ALL} SELECT ticker, date, {', '.join(f'round(g_{g}, 5) AS g_{g}' for g in ALL_FACTORS)} FROM grp")
def _(s, d):
    return rounded(scored(s, d), ["ticker", "date"], **{f"g_{g}": 5 for g in config.TECHNICAL})


def _w(g: str) -> str:
    i = config.GROUPS.index(g)
    return "CASE regime " + " ".join(f"WHEN '{r}' THEN {float(w[i])}" for r, w in CFG["weights"].items()) + " END"


def _comp_sql(zed: str, groups: dict[str, list[str]]) -> str:
    comp = f"{zed}, {REGIME}, rd AS (SELECT date, coalesce(last_value(regime IGNORE NULLS) OVER (ORDER BY date), first_value(regime IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'NEUTRAL') AS regime FROM (SELECT DISTINCT date FROM bars) LEFT JOIN (SELECT date, regime FROM reg) USING (date)), cmp AS (SELECT grp.*, coalesce(regime, 'NEUTRAL') AS regime, {_mean_sql([(f'g_{g}', '(' + _w(g) + ')') for g in groups])} AS composite FROM grp LEFT JOIN rd USING (date))"
    return comp + ", crk AS (SELECT *, CASE WHEN composite IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY composite NULLS LAST) + (count(*) OVER (PARTITION BY date, composite) - 1) / 2.0) / count(composite) OVER (PARTITION BY date) END AS comp_rank FROM cmp)"


COMP, COMP_ALL = _comp_sql(ZED, LITE_FACTORS), _comp_sql(ZED_ALL, ALL_FACTORS)


@both("composite", f"WITH {COMP} SELECT ticker, date, regime, round(composite, 5) AS composite FROM crk")
def _(rows):
    return rounded(rows, ["ticker", "date", "regime"], composite=5)


@both("comp_rank", f"WITH {COMP} SELECT ticker, date, round(comp_rank, 6) AS comp_rank FROM crk")
def _(rows):
    return rounded(rows, ["ticker", "date"], comp_rank=6)


@both("latest_cross_section", f"WITH {COMP} SELECT ticker, date, round(composite, 5) AS composite, regime FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n, max(date) OVER () AS newest FROM crk) WHERE n = 1 AND newest - date <= 7")
def _(rows):
    return rounded(crosssection.latest(rows), ["ticker", "date", "regime"], composite=5)


@both("top_ten", f"WITH {COMP} SELECT ticker, date, round(composite, 5) AS composite, row_number() OVER (ORDER BY composite DESC NULLS LAST, ticker) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n, max(date) OVER () AS newest FROM crk) WHERE n = 1 AND newest - date <= 7 QUALIFY place <= 10")
def _(rows):
    return rounded(crosssection.top(crosssection.latest(rows), 10), ["ticker", "date", "place"], composite=5)


@both("conviction", f"WITH {COMP} SELECT ticker, date, round(100 / (1 + exp(-1.6 * composite)), 4) AS conviction, round(greatest(1, least(99, 100 / (1 + exp(-1.6 * composite)) - CASE WHEN g_trend <= 0 THEN 10 ELSE 0 END - CASE WHEN adv20 >= 2000000 THEN 0 ELSE 8 END)) + 0 * composite, 4) AS adjusted FROM crk")
def _(rows):
    c = crosssection.conviction(F.col("composite"))
    liquid = F.coalesce(F.col("adv20") >= 2_000_000, F.lit(False))
    return rows.select("ticker", "date", F.round(c, 4).alias("conviction"), F.round(crosssection.adjusted_conviction(c, F.col("g_trend") > 0, F.lit(""), liquid), 4).alias("adjusted"))


@both("deciles", f"WITH {COMP} SELECT CAST(floor(least(comp_rank * 10, 9.999)) + 1 AS INT) AS decile, round(avg(fwd_ret) * 100, 5) AS mean_pct, round(median(fwd_ret) * 100, 5) AS median_pct, round(avg(CASE WHEN fwd_ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM crk WHERE comp_rank IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY 1")
def _(rows):
    return rounded(crosssection.deciles(rows), ["decile", "n"], mean_pct=5, median_pct=5, hit_rate=6)


_RK = lambda x: f"rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"


@both("rank_ic", f"WITH {COMP}, r AS (SELECT date, {_RK('composite')} AS a, {_RK('fwd_ret')} AS b FROM crk WHERE composite IS NOT NULL AND fwd_ret IS NOT NULL), ic AS (SELECT date, count(*) AS n, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM r GROUP BY 1) SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_sd, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic) / 15), 5) AS ic_t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive, count(ic) AS n_dates FROM ic WHERE n >= 8")
def _(rows):
    return rounded(crosssection.rank_ic(rows), ["n_dates"], ic_mean=6, ic_sd=6, ic_t=5, share_positive=6)


RETURNS = f"{BARS}, rt AS (SELECT ticker, date, close / nullif(lag(close) OVER ({O}), 0) - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars), l60 AS (SELECT * FROM rt WHERE back <= 60)"


@query("returns_corr", f"WITH {RETURNS} SELECT x.ticker AS a, y.ticker AS b, round(covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0), 6) AS corr, count(*) AS n FROM l60 x JOIN l60 y USING (date) WHERE x.ticker < y.ticker AND x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return rounded(crosssection.correlations(returns(s, d)), ["a", "b", "n"], corr=6)


# -- setups and plans

STATE = f"""{KELT}, s0 AS (SELECT *, {roll('avg', 'close', 50)} AS sma50, {_prior('max', 'high', 20)} AS donch20_hi, {_prior('max', 'high', 55)} AS donch55_hi, {roll('min', 'low', 10, 5)} AS swing_low10,
 ({roll('avg', 'volume', 5)}) / nullif({roll('avg', 'volume', 50, 20)}, 0) AS rvol, (close - low) / nullif(high - low, 0) AS cr, close / ({roll('max', 'high', 252, 120)}) AS pct_52w_high, close / {_lag(126)} - 1 AS mom_6m, {roll('avg', 'close * volume', 20, 10)} AS adv20,
 (close - ema21) / nullif(atr14, 0) AS d21, {_RSI14} AS rsi14, {_RSI2} AS rsi2 FROM kc),
 s1 AS (SELECT *, {roll('avg', 'cr', 3, 1)} AS cr3, sma200 IS NOT NULL AND close > sma200 AND coalesce(ema21 > ema50, false) AS is_up, sma200 IS NOT NULL AND close > sma200 AS above FROM s0),
 st AS (SELECT *, CASE WHEN is_up AND close > donch20_hi AND coalesce(rvol, 1) >= 1.2 AND coalesce(cr, 0) >= 0.5 THEN 'Breakout' WHEN is_up AND bb_up < kc_up AND bb_lo > kc_lo AND abs(d21) <= 1 THEN 'Squeeze (pre-breakout)'
 WHEN is_up AND d21 BETWEEN -1.5 AND 0.75 AND rsi14 BETWEEN 35 AND 60 THEN 'Pullback in uptrend' WHEN above AND rsi2 <= 10 AND close >= 0.97 * sma50 THEN 'Mean-reversion bounce'
 WHEN is_up AND pct_52w_high >= 0.93 AND mom_6m > 0.10 THEN CASE WHEN d21 <= 2 THEN 'Momentum continuation' ELSE 'Extended (wait)' END WHEN is_up AND d21 > 2 THEN 'Extended (wait)'
 WHEN NOT above AND rsi14 <= 30 AND coalesce(cr3, 0) >= 0.6 THEN 'Counter-trend bounce' ELSE 'No clean setup' END AS setup FROM s1)"""


@query("setup_labels", f"{STATE} SELECT ticker, date, setup FROM st")
def _(s, d):
    return featured(s, d).select("ticker", "date", rules.setup_label().alias("setup"))


@query("setup_info", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', {b}, {c})" for k, (a, b, c) in rules.SETUPS.items()) + ") t(setup, kind, hold_days, setup_eligible)")
def _(s, d):
    return rules.setup_table(s).withColumnsRenamed({"_1": "setup"})


@query("explain_bits", f"""WITH {ZED}, bits AS (SELECT ticker, date, concat_ws('; ', CASE WHEN g_momentum > 0.8 THEN 'momentum leader' WHEN g_momentum < -0.8 THEN 'weak momentum' END, CASE WHEN g_trend > 0.8 THEN 'strong trend structure' END,
 CASE WHEN g_timing > 0.5 THEN 'favourable entry timing' END, CASE WHEN g_volume > 0.5 THEN 'volume accumulation' WHEN g_volume < -0.8 THEN 'distribution in volume' END) AS why FROM grp) SELECT ticker, date, CASE WHEN why = '' THEN 'no dominant factor' ELSE why END AS why FROM bits""")
def _(s, d):
    rows = crosssection.group_scores(crosssection.zscores(lite(s, d), _ALL), config.TECHNICAL)
    return rows.select("ticker", "date", rules.explained(rows.columns).alias("why"))


@query("explain_bits_all_factors", f"""WITH RECURSIVE {ZED_ALL}, bits AS (SELECT ticker, date, concat_ws('; ', CASE WHEN g_momentum > 0.8 THEN 'momentum leader' WHEN g_momentum < -0.8 THEN 'weak momentum' END, CASE WHEN g_trend > 0.8 THEN 'strong trend structure' END,
 CASE WHEN g_timing > 0.5 THEN 'favourable entry timing' END, CASE WHEN g_volatility > 0.5 THEN 'volatility compression' END, CASE WHEN g_volume > 0.5 THEN 'volume accumulation' WHEN g_volume < -0.8 THEN 'distribution in volume' END,
 CASE WHEN squeezed THEN 'Bollinger/Keltner squeeze on' END, CASE WHEN broke55 THEN 'new 55-day high' END) AS why FROM grp) SELECT ticker, date, CASE WHEN why = '' THEN 'no dominant factor' ELSE why END AS why FROM bits""")
def _(s, d):
    rows = scored(s, d)
    return rows.select("ticker", "date", rules.explained(rows.columns).alias("why"))


def planned(s: SparkSession, d: str) -> DataFrame:
    rows = featured(s, d).withColumns({"setup": rules.setup_label(), "regime": F.lit("RISK_ON"), "size_mult": F.lit(1.0)})
    out = plan.planned(rows, CFG)
    return out.withColumn("eligible", plan.eligible(CFG))


_KIND = "CASE setup " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in rules.SETUPS.items()) + " END"
PLAN = f"""{STATE}, p0 AS (SELECT *, {_KIND} AS kind FROM st), p1 AS (SELECT *, CASE WHEN atr14 > 0 THEN CASE WHEN kind = 'squeeze' AND donch20_hi IS NOT NULL THEN greatest(close, donch20_hi + 0.1 * atr14) WHEN kind = 'pullback' THEN least(close, greatest(ema21, close - 0.5 * atr14)) ELSE close END END AS entry FROM p0),
 p2 AS (SELECT *, CASE WHEN entry IS NOT NULL THEN greatest(least(entry - 2 * atr14, swing_low10 - 0.25 * atr14), entry - 3.5 * atr14) END AS stop FROM p1), p3 AS (SELECT *, CASE WHEN entry - stop > 0 THEN entry - stop END AS r FROM p2),
 p4 AS (SELECT *, 20000 * 1.0 / 100 / 3.6725 / r AS raw FROM p3), p5 AS (SELECT *, floor(CASE WHEN raw * entry * 3.6725 > 5000 THEN 5000 / (entry * 3.6725) ELSE raw END * 10000) / 10000 AS units FROM p4)"""


@query("trade_plan", f"{PLAN} SELECT ticker, date, setup, round(entry, 4) AS entry, round(stop, 4) AS stop, round(entry + 1.5 * r, 4) AS t1, round(entry + 3 * r, 4) AS t2, round(units, 4) AS units, round(units * r * 3.6725, 2) AS risk_aed, round(units * entry * 3.6725 * 2 * 0.15 / 100, 3) AS cost_aed FROM p5 WHERE r IS NOT NULL")
def _(s, d):
    return rounded(planned(s, d).where("r is not null"), ["ticker", "date", "setup"], entry=4, stop=4, t1=4, t2=4, units=4, risk_aed=2, cost_aed=3)


@query("plan_flags", f"{PLAN} SELECT ticker, date, CASE WHEN raw * entry * 3.6725 > 5000 THEN 1 ELSE 0 END + CASE WHEN units <= 0 THEN 1 ELSE 0 END + CASE WHEN units * entry * 3.6725 * 2 * 0.15 / 100 / nullif(units * r * 3.6725, 0) > 0.15 THEN 1 ELSE 0 END + CASE WHEN donch55_hi > entry AND donch55_hi < entry + 1.5 * r THEN 1 ELSE 0 END AS n_flags FROM p5 WHERE r IS NOT NULL")
def _(s, d):
    return planned(s, d).where("r is not null").select("ticker", "date", F.size("plan_flags").alias("n_flags"))


@query("eligibility", f"{PLAN} SELECT ticker, date, kind IN ('breakout', 'squeeze', 'pullback', 'bounce', 'momentum') AND coalesce(adv20 >= 2000000, false) AND close >= 5 AND r IS NOT NULL AS eligible FROM p5")
def _(s, d):
    return planned(s, d).select("ticker", "date", "eligible")


# -- portfolio

STATES = [("us", "RISK_ON", 1.8), ("uae", "NEUTRAL", 0.5), ("crypto", "RISK_OFF", None)]


@query("sleeves", """WITH s(market, regime, base, rm, im, mm) AS (VALUES ('us', 'RISK_ON', 0.5, 1.0, 1.0, 1.0), ('uae', 'NEUTRAL', 0.2, 0.7, 0.6, 0.85), ('crypto', 'RISK_OFF', 0.3, 0.35, 0.4, 0.9))
 SELECT market, round(CAST(20000 * base * rm * im * mm AS DOUBLE), 4) AS budget FROM s""")
def _(s, d):
    states = s.createDataFrame(STATES, "market string, regime string, ic_t double")
    return rounded(plan.market_sleeves(states, CFG, oil_bull=False, dollar_strong=True), ["market"], budget=4)


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Each brand's last row as a candidate: conviction by its place in the alphabet, sector by its last digit."""
    rows = crosssection.latest(planned(s, d)).where("r is not null")
    number = F.regexp_extract("ticker", "([0-9]+)", 1).cast("int")
    return rows.withColumns({"conviction": (number * 7 % 50 + 40).cast("double"), "sector": F.concat(F.lit("s"), (number % 3).cast("string")), "veto": F.lit(False), "earnings_flag": F.lit(""), "eligible": number % 4 != 0, "free": F.lit(9000.0), "live": F.lit(None).cast("double")})


CANDS = PLAN.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + """, c0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS nn, max(date) OVER () AS newest FROM p5),
 c1 AS (SELECT *, CAST(regexp_extract(ticker, '([0-9]+)', 1) AS INT) AS num FROM c0 WHERE nn = 1 AND newest - date <= 7 AND r IS NOT NULL), c2 AS (SELECT *, CAST(num * 7 % 50 + 40 AS DOUBLE) AS conviction, 100 * atr14 / close AS atr_pct FROM c1),
 w0 AS (SELECT *, 1 / greatest(atr_pct, 0.5) * pow(greatest(0.5, least(2.0, conviction / 50)), 0.5) AS w FROM c2), w1 AS (SELECT *, 9000 * w / sum(w) OVER () AS aed, least(5000, 20000 * 1.0 / 100 / ((entry - stop) / entry)) AS cap FROM w0),
 w2 AS (SELECT *, sum(greatest(aed - cap, 0)) OVER () AS spill, greatest(cap - aed, 0) AS room FROM w1), w3 AS (SELECT *, least(aed, cap) + CASE WHEN room > 0 AND spill > 0 THEN least(room, spill * room / sum(room) OVER ()) ELSE 0 END AS aed2 FROM w2)"""


@query("sleeve_weights", f"{CANDS} SELECT ticker, round(aed, 4) AS aed FROM w1")
def _(s, d):
    return rounded(plan.sleeve_weights(candidates(s, d), CFG), ["ticker"], aed=4)


@query("spill_caps", f"{CANDS} SELECT ticker, round(aed2, 4) AS aed FROM w3")
def _(s, d):
    return rounded(plan.capped(plan.sleeve_weights(candidates(s, d), CFG), CFG), ["ticker"], aed=4)


ACCOUNT = f"""{CANDS}, x0 AS (SELECT *, floor(aed2 / 3.6725 / entry * 10000) / 10000 AS u FROM w3), x1 AS (SELECT *, u * (entry - stop) * 3.6725 AS risk, row_number() OVER (ORDER BY conviction DESC, ticker) AS place FROM x0 WHERE u > 0),
 x2 AS (SELECT *, sum(risk) OVER () AS heat FROM x1 WHERE place <= 8), x3 AS (SELECT *, CASE WHEN heat > 1000 THEN floor(u * (1000 / heat) * 10000) / 10000 ELSE u END AS u2 FROM x2)"""


def account(s: SparkSession, d: str) -> DataFrame:
    return plan.account_limits(plan.positions(plan.capped(plan.sleeve_weights(candidates(s, d), CFG), CFG), CFG), CFG)


@query("account_limits", f"{ACCOUNT} SELECT ticker, round(u2, 4) AS units, round(u2 * entry * 3.6725, 2) AS aed, round(u2 * (entry - stop) * 3.6725, 2) AS risk_aed FROM x3 WHERE u2 > 0")
def _(s, d):
    return rounded(account(s, d), ["ticker"], units=4, aed=2, risk_aed=2)


@query("portfolio_sigma", f"""{ACCOUNT}, h AS (SELECT ticker, u2 * entry * 3.6725 AS aed, u2 * (entry - stop) * 3.6725 AS risk FROM x3 WHERE u2 > 0),
 rt AS (SELECT ticker, date, close / nullif(lag(close) OVER ({O}), 0) - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars), j AS (SELECT * FROM rt JOIN h USING (ticker) WHERE back <= 60),
 pn AS (SELECT date, sum(aed * ret) AS pnl FROM j WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM j))
 SELECT (SELECT count(*) FROM h) AS n_positions, round((SELECT sum(aed) FROM h), 2) AS deployed_aed, round((SELECT sum(risk) FROM h), 2) AS heat_aed, round(stddev_samp(pnl), 3) AS one_day_sigma_aed FROM pn""")
def _(s, d):
    return rounded(plan.portfolio_risk(account(s, d), returns(s, d), CFG), ["n_positions"], deployed_aed=2, heat_aed=2, one_day_sigma_aed=3)


def _greedy_sql(places: int, risk: str, pos: str, where: str, heat: float, exposure: float) -> str:
    """One candidate further at a time: what is taken so far decides on the next."""
    reason = f"""CASE WHEN len(taken) >= {places} THEN 'max {places} positions in RISK_ON' WHEN NOT elig THEN 'not actionable today' WHEN NOT coalesce(c.units > 0, false) THEN 'position too small for minimum lot'
 WHEN len(list_filter(taken, lambda x: list_contains(c.others, x))) > 0 THEN 'correlated with ' || list_filter(taken, lambda x: list_contains(c.others, x))[1] || printf(' (%.2f)', c.corrs[list_position(c.others, list_filter(taken, lambda x: list_contains(c.others, x))[1])])
 WHEN len(list_filter(sectors, lambda x: x = c.sector)) >= 2 THEN 'sector cap (' || c.sector || ')' WHEN heat + {risk} > {heat} + 1e-9 THEN 'portfolio heat cap' WHEN expo + {pos} > {exposure} + 1e-9 THEN 'capital fully deployed' ELSE '' END"""
    return f"""{CANDS}, {RETURNS.removeprefix(BARS + ', ')}, cr AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0) AS corr FROM l60 x JOIN l60 y USING (date) WHERE x.ticker <> y.ticker AND x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2),
 nr AS (SELECT a, list(b ORDER BY b) AS others, list(corr ORDER BY b) AS corrs FROM cr WHERE corr > 0.7 GROUP BY 1),
 ca AS (SELECT row_number() OVER (ORDER BY conviction DESC, c2.ticker) AS i, c2.ticker, conviction, num % 4 <> 0 AS elig, 's' || num % 3 AS sector, units, units * r * 3.6725 AS risk, units * entry * 3.6725 AS pos, coalesce(others, []) AS others, coalesce(corrs, []) AS corrs FROM c2 LEFT JOIN nr ON nr.a = c2.ticker {where}),
 gr AS (SELECT CAST(0 AS BIGINT) AS i, '' AS ticker, CAST(NULL AS DOUBLE) AS conviction, 'start' AS reason, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS sectors, CAST(0 AS DOUBLE) AS heat, CAST(0 AS DOUBLE) AS expo
  UNION ALL SELECT i, ticker, conviction, reason, CASE WHEN reason = '' THEN list_append(taken, ticker) ELSE taken END, CASE WHEN reason = '' THEN list_append(sectors, sector) ELSE sectors END, CASE WHEN reason = '' THEN heat + risk ELSE heat END, CASE WHEN reason = '' THEN expo + pos ELSE expo END
  FROM (SELECT c.*, gr.taken, gr.sectors, gr.heat, gr.expo, {reason} AS reason FROM gr JOIN ca c ON c.i = gr.i + 1))"""


@query("portfolio_greedy", f"{_greedy_sql(6, 'c.risk', 'c.pos', '', 1000.0, 20000.0)} SELECT ticker, conviction, reason = '' AS selected, reason AS skip_reason FROM gr WHERE i > 0")
def _(s, d):
    return plan.select_portfolio(candidates(s, d), None, CFG, returns(s, d)).select("ticker", "conviction", "selected", "skip_reason")


@query("sleeve_picks", f"{_greedy_sql(6, '0', '0', 'WHERE num % 4 <> 0 AND units > 0', 1e12, 1e12)} SELECT ticker, conviction, CAST(9000 AS DOUBLE) AS free FROM gr WHERE i > 0 AND reason = ''")
def _(s, d):
    budgets = s.createDataFrame([("brand", 9000.0)], "market string, free double")
    return plan.sleeve_picks(candidates(s, d).drop("free"), budgets, None, CFG, returns(s, d)).select("ticker", "conviction", "free")


_LIVE = f"""{CANDS}, lq AS (SELECT 'Brand#' || (user_id % 25 + 1) AS ticker, arg_max(500 * value - 2000, (ts, event_id)) AS live, max(ts) AS quoted FROM events GROUP BY 1),
 ls AS (SELECT *, row_number() OVER (ORDER BY conviction DESC, ticker) AS place FROM c2 WHERE num % 4 <> 0 QUALIFY place <= 12),
 lm AS (SELECT ls.*, live, CASE WHEN live > 0 AND kind IN ('breakout', 'momentum', 'bounce') THEN live - entry ELSE 0 END AS sh FROM ls LEFT JOIN lq USING (ticker)),
 lv AS (SELECT ticker, place, live, entry + sh AS entry, stop + sh AS stop, entry + 1.5 * r + sh AS t1 FROM lm)"""


@query("live_shortlist", f"{_LIVE} SELECT ticker, place, round(live, 6) AS live, round(entry, 4) AS entry, round(stop, 4) AS stop, round(t1, 4) AS t1, CASE WHEN live > 0 THEN round(100 * (entry / live - 1), 6) END AS to_entry_pct, CASE WHEN NOT coalesce(live > 0, false) THEN 'no quote' WHEN live <= stop THEN 'below stop' WHEN live >= t1 THEN 'beyond target' WHEN live >= entry THEN 'at entry' ELSE 'waiting' END AS state FROM lv")
def _(s, d):
    """Events as a stream of quotes, followed against the stored shortlist; the state at their end."""
    listed = stored(live.shortlist(candidates(s, d)), "shortlist")
    events = ticks.read_events(s, f"{d}/events.parquet")
    quotes = events.select(F.lit("brand").alias("market"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("ticker"), (500 * F.col("value") - 2000).alias("price"), "ts", F.col("event_id").alias("seq"))
    return rounded(live.run(quotes, listed), ["ticker", "place", "state"], live=6, entry=4, stop=4, t1=4, to_entry_pct=6)


@query("holdings_review", f"""{CANDS}, h(ticker, units, entry0, stop0) AS (VALUES ('Brand#11', 2.0, 20000.0, NULL), ('Brand#12', 1.0, 90000.0, 95000.0), ('Brand#13', 3.0, 30000.0, 100.0), ('nothing', 1.0, 5.0, NULL)),
 k AS (SELECT h.ticker, units0, entry0, c2.close AS price, coalesce(stop0, entry0 - 2 * atr14) AS st, CASE WHEN sma200 IS NOT NULL THEN sma200 < close AND coalesce(ema21 > ema50, false) END AS up1, num, conviction FROM (SELECT ticker, units AS units0, entry0, stop0 FROM h) h LEFT JOIN c2 ON c2.ticker = h.ticker)
 SELECT ticker, CASE WHEN price IS NULL THEN 'REVIEW' WHEN coalesce(price <= st, false) THEN 'EXIT' WHEN NOT coalesce(up1, true) THEN 'EXIT' WHEN num % 4 <> 0 AND conviction >= 60 THEN 'HOLD / ADD' ELSE 'HOLD' END AS action, round(coalesce(units0 * price * 3.6725, 0), 2) AS value_aed, round(100 * (price / entry0 - 1), 4) AS pnl_pct FROM k""")
def _(s, d):
    held = s.createDataFrame([("brand", "Brand#11", 2.0, 20000.0, None), ("brand", "Brand#12", 1.0, 90000.0, 95000.0), ("brand", "Brand#13", 3.0, 30000.0, 100.0), ("brand", "nothing", 1.0, 5.0, None)], "market string, ticker string, units double, entry double, stop double")
    return rounded(plan.holdings_review(held, candidates(s, d), CFG), ["ticker", "action"], value_aed=2, pnl_pct=4)


@query("kelly", "SELECT l_linenumber AS k, s AS sign, round(CASE WHEN p > 0 AND p < 1 AND w > 0 AND l < 0 THEN greatest(0, p - (1 - p) / (w / abs(l))) END, 6) AS f FROM (SELECT l_linenumber, s, avg(CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0.0 END) AS p, avg(l_tax) AS w, s * avg(l_discount) AS l FROM lineitem, (VALUES (-1), (1)) v(s) GROUP BY 1, 2)")
def _(s, d):
    rows = source.table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg((F.col("l_discount") > 0.04).cast("double")).alias("p"), F.avg("l_tax").alias("w"), F.avg("l_discount").alias("l"))
    rows = rows.withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1))))
    return rows.select("k", "sign", F.round(plan.kelly(F.col("p"), F.col("w"), F.col("sign") * F.col("l")), 6).alias("f"))


# -- simulation


def simulated(s: SparkSession, d: str) -> DataFrame:
    """What is simulated: the scored panel with all factors, under the market's liquidity floor."""
    return scored(s, d)


FLOORS = {m: float(x["adv_floor"]) for m, x in CFG["markets"].items()}


@query("backtest_trades")
def _(s, d):
    return backtest.trades(simulated(s, d), CFG, FLOORS)


@query("backtest_equity")
def _(s, d):
    return backtest.equity(simulated(s, d), CFG, FLOORS)


@query("backtest_metrics")
def _(s, d):
    trades, equity = backtest.simulate(simulated(s, d), CFG, FLOORS)
    return backtest.metrics(trades, equity, bench(s, d), 52)


@query("curve_metrics", f"""WITH {BARS}, c AS (SELECT date, close, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS ret, close / max(close) OVER (ORDER BY date) - 1 AS dd FROM bars WHERE ticker = 'Brand#11'), a AS (SELECT min(date) AS b, max(date) AS e, last(close ORDER BY date) / first(close ORDER BY date) AS g, min(dd) AS dd, avg(ret) / stddev_samp(ret) * sqrt(52) AS sharpe, avg(CASE WHEN ret <> 0 THEN 1.0 WHEN ret = 0 THEN 0.0 END) AS tim FROM c)
 SELECT round(100 * (g - 1), 4) AS total_return_pct, round(100 * (pow(g, 365.25 / (e - b)) - 1), 4) AS cagr_pct, round(100 * dd, 4) AS max_dd_pct, round(sharpe, 6) AS sharpe, round(100 * tim, 4) AS time_in_market_pct FROM a""")
def _(s, d):
    return rounded(backtest.curve_metrics(bench(s, d), "close", 52), [], total_return_pct=4, cagr_pct=4, max_dd_pct=4, sharpe=6, time_in_market_pct=4)


# -- text, events, social

_HITS = " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{p}') THEN {float(w)} ELSE 0 END" for p, w in rules.PHRASES.items())
_SCORE = f"greatest(-1.0, least(1.0, ({_HITS}) / 5))"


@query("lexicon_hits", f"SELECT doc_id, CAST({_SCORE} AS DOUBLE) AS score FROM documents WHERE {_SCORE} <> 0")
def _(s, d):
    return source.table(s, d, "documents").select("doc_id", rules.text_score(F.col("text")).alias("score")).where("score <> 0")


@query("headline_sentiment", f"WITH n AS (SELECT source AS ticker, {_SCORE} AS score, CAST(doc_id % 30 AS DOUBLE) AS age FROM documents) SELECT ticker, round(sum(score * pow(0.5, age / 3)) / sum(pow(0.5, age / 3)), 6) AS news_sent, CAST(sum(CASE WHEN age <= 7 THEN 1 ELSE 0 END) AS BIGINT) AS news_attention, count(*) AS n FROM n GROUP BY 1")
def _(s, d):
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp")
    news = source.table(s, d, "documents").select(F.col("source").alias("ticker"), F.col("text").alias("title"), (now - F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias("published"))
    return rounded(rules.headline_scores(news, now), ["ticker", "news_attention", "n"], news_sent=6)


@query("fear_greed", "SELECT o_orderkey, CASE WHEN v >= 85 THEN 0.75 WHEN v >= 70 THEN 0.9 WHEN v <= 15 AND o_orderstatus <> 'O' THEN 0.75 ELSE 1.0 END::DOUBLE AS mult FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 101 AS v FROM orders)")
def _(s, d):
    o = source.table(s, d, "orders")
    return o.select("o_orderkey", rules.fear_greed_mult(F.col("o_orderkey") % 101, F.when(F.col("o_orderstatus") == "O", "RISK_ON").otherwise("CRISIS")).alias("mult"))


@query("earnings_flags", "SELECT o_custkey AS ticker, min(CAST(o_orderdate AS DATE)) - DATE '1997-06-01' AS days, CASE WHEN min(CAST(o_orderdate AS DATE)) - DATE '1997-06-01' <= 21 THEN 'Earnings in ' || (min(CAST(o_orderdate AS DATE)) - DATE '1997-06-01') || 'd (half size)' ELSE '' END AS flag FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01' GROUP BY 1")
def _(s, d):
    today = F.lit("1997-06-01").cast("date")
    dates = source.table(s, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"))
    return rules.earnings(rules.next_dates(dates, today), today, policy="halve").select("ticker", F.col("days_to_earnings").alias("days"), F.col("earnings_flag").alias("flag"))


@query("macro_warnings", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'Orders in ' || (CAST(o_orderdate AS DATE) - DATE '1997-06-01') || 'd (' || CAST(o_orderdate AS DATE) || ')' AS warning FROM orders WHERE CAST(o_orderdate AS DATE) - DATE '1997-06-01' BETWEEN 0 AND 10")
def _(s, d):
    dates = source.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.lit("Orders").alias("name")).distinct()
    return rules.macro_warnings(dates, F.lit("1997-06-01").cast("date"), 10)


@query("message_counts", "WITH e AS (SELECT *, max(ts) OVER () AS now FROM events) SELECT event_type AS ticker, count(CASE WHEN now - ts <= INTERVAL 24 HOUR THEN 1 END) AS messages_24h, count(CASE WHEN now - ts <= INTERVAL 168 HOUR THEN 1 END) AS messages_7d, count(CASE WHEN value > 60 THEN 1 END) AS bull, count(CASE WHEN value < 30 THEN 1 END) AS bear, round(count(CASE WHEN value > 60 THEN 1 END) / count(CASE WHEN value > 60 OR value < 30 THEN 1 END), 6) AS bull_share, round(count(*) * 24 / nullif(epoch(max(now) - min(ts)) / 3600, 0), 6) AS msgs_per_day FROM e GROUP BY 1")
def _(s, d):
    e = source.table(s, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    rows = e.join(F.broadcast(now), F.lit(True)).select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("now").cast("timestamp").alias("now"), F.when(F.col("value") > 60, "bullish").when(F.col("value") < 30, "bearish").alias("tag"))
    return rounded(rules.message_counts(rows, F.col("now")), ["ticker", "messages_24h", "messages_7d", "bull", "bear"], bull_share=6, msgs_per_day=6)


@query("fundamental_factors", "SELECT p_partkey AS ticker, round(greatest(-1, least(1, p_size / 25.0 - 1)), 6) AS roe, round(-ln(1 + greatest(p_size - 10, 0) / 100.0), 6) AS low_leverage, round(least(1.0 / nullif(p_size, 0), 0.5), 6) AS earnings_yield, round(greatest(-0.3, least(0.3, p_size / p_retailprice)), 6) AS fcf_yield, round(greatest(-0.5, least(1, 1000 / p_retailprice - 1)), 6) AS target_upside FROM part")
def _(s, d):
    p = source.table(s, d, "part").withColumns({"ticker": F.col("p_partkey"), "returnOnEquity": F.col("p_size") / 25 - 1, "debtToEquity": (F.col("p_size") - 10).cast("double"), "forwardPE": F.col("p_size").cast("double"), "freeCashflow": F.col("p_size").cast("double"), "marketCap": F.col("p_retailprice"), "targetMeanPrice": F.lit(1000.0), "close": F.col("p_retailprice")})
    for c in ("grossMargins", "revenueGrowth", "earningsGrowth", "enterpriseToEbitda", "recommendationMean", "epsRevision30d"):
        p = p.withColumn(c, F.lit(None).cast("double"))
    return rounded(crosssection.fundamental_factors(p), ["ticker"], roe=6, low_leverage=6, earnings_yield=6, fcf_yield=6, target_upside=6)


@query("shortest_id", "SELECT upper(p_brand) AS symbol, arg_min(p_name, (length(p_name), p_name)) AS id FROM part GROUP BY 1")
def _(s, d):
    return rules.shortest_id(source.table(s, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("id")))


# -- macro, learning

_last = f"row_number() OVER (PARTITION BY ticker ORDER BY date DESC)"


@query("macro_dashboard", f"WITH {BARS}, x AS (SELECT *, {_last} AS back, count(*) OVER ({O}) AS n, {', '.join(f'100 * (close / nullif({_lag(k)}, 0) - 1) AS {c}' for c, k in (('chg_1d', 1), ('chg_1w', 5), ('chg_1m', 21), ('chg_3m', 63)))}, {roll('avg', 'close', 200, 120)} AS s200, {_mid} AS s20, max(close) OVER ({O} ROWS 251 PRECEDING) AS hi, min(close) OVER ({O} ROWS 251 PRECEDING) AS lo FROM bars), y AS (SELECT *, lag(s20, 5) OVER ({O}) AS s20b FROM x) SELECT ticker, round(chg_1d, 5) AS chg_1d, round(chg_1w, 5) AS chg_1w, round(chg_1m, 5) AS chg_1m, round(chg_3m, 5) AS chg_3m, round(100 * (close / s200 - 1), 5) AS vs_200d, CASE WHEN s20 > s20b THEN 'up' ELSE 'down' END AS trend_20d, round(100 * (close - lo) / nullif(hi - lo, 0), 5) AS pct_52w_range FROM y WHERE back = 1 AND n >= 30")
def _(s, d):
    return rounded(macro.dashboard(source.brand_bars(s, d)), ["ticker", "trend_20d"], chg_1d=5, chg_1w=5, chg_1m=5, chg_3m=5, vs_200d=5, pct_52w_range=5)


@query("sector_rotation", f"WITH {BARS}, x AS (SELECT *, {_last} AS back, count(*) OVER ({O}) AS n, {', '.join(f'100 * (close / nullif({_lag(k)}, 0) - 1) AS {c}' for c, k in (('w', 5), ('m', 21), ('q', 63)))} FROM bars), l AS (SELECT * FROM x WHERE back = 1), r AS (SELECT a.ticker, a.w - b.w AS w, a.m - b.m AS m, a.q - b.q AS q FROM l a, (SELECT * FROM l WHERE ticker = 'Brand#11') b WHERE a.n >= 70 AND a.ticker <> 'Brand#11') SELECT ticker, round(w, 5) AS rel_1w, round(m, 5) AS rel_1m, round(q, 5) AS rel_3m, row_number() OVER (ORDER BY rank() OVER (ORDER BY w) + 2 * rank() OVER (ORDER BY m) + rank() OVER (ORDER BY q) DESC, ticker) AS place FROM r".replace("row_number() OVER (ORDER BY rank()", "row_number() OVER (ORDER BY sc DESC, ticker) AS place FROM (SELECT *, rank()").replace(" DESC, ticker) AS place FROM r", " AS sc FROM r)"))
def _(s, d):
    b = source.brand_bars(s, d)
    return rounded(macro.rotation(b.where("ticker <> 'Brand#11'"), b.where("ticker = 'Brand#11'")), ["ticker", "place"], rel_1w=5, rel_1m=5, rel_3m=5)


@query("positioning", f"WITH {BARS}, x AS (SELECT ticker AS label, date, 100 * (high - low) / nullif(close, 0) AS net FROM bars WHERE ticker LIKE 'Brand#1%'), y AS (SELECT *, lag(net) OVER (PARTITION BY label ORDER BY date) AS before FROM x), l AS (SELECT label, max(date) AS as_of, arg_max(net, date) AS cur, arg_max(net - before, date) AS wk FROM y GROUP BY 1) SELECT l.label, l.as_of, round(l.cur, 5) AS net_spec_pct_oi, round(l.wk, 5) AS wk_change, round(100 * avg(CASE WHEN net <= cur THEN 1.0 ELSE 0.0 END), 5) AS pct_3y FROM y JOIN l USING (label) GROUP BY ALL")
def _(s, d):
    cot = source.brand_bars(s, d).where("ticker like 'Brand#1%'").select(F.concat("ticker", F.lit(" -")).alias("market"), "date", F.col("ticker").alias("code"), F.col("close").alias("oi"), F.col("high").alias("nc_long"), F.col("low").alias("nc_short"))
    markets = cot.select(F.col("code").alias("label"), F.lower("market").alias("prefix")).distinct()
    return rounded(macro.positioning(cot, markets), ["label", "as_of"], net_spec_pct_oi=5, wk_change=5, pct_3y=5)


@query("positioning_all_tickers", f"WITH {BARS}, x AS (SELECT ticker AS label, date, 100 * (high - low) / nullif(close, 0) AS net FROM bars), y AS (SELECT *, lag(net) OVER (PARTITION BY label ORDER BY date) AS before FROM x), l AS (SELECT label, max(date) AS as_of, arg_max(net, date) AS cur, arg_max(net - before, date) AS wk FROM y GROUP BY 1) SELECT l.label, l.as_of, round(l.cur, 5) AS net_spec_pct_oi, round(l.wk, 5) AS wk_change, round(100 * avg(CASE WHEN net <= cur THEN 1.0 ELSE 0.0 END), 5) AS pct_3y FROM y JOIN l USING (label) GROUP BY ALL")
def _(s, d):
    # closed by a dash, as no name may be the start of another
    cot = source.brand_bars(s, d).select(F.concat("ticker", F.lit(" -")).alias("market"), "date", F.col("ticker").alias("code"), F.col("close").alias("oi"), F.col("high").alias("nc_long"), F.col("low").alias("nc_short"))
    markets = cot.select(F.col("code").alias("label"), F.lower("market").alias("prefix")).distinct()
    return rounded(macro.positioning(cot, markets), ["label", "as_of"], net_spec_pct_oi=5, wk_change=5, pct_3y=5)


@query("ml_labels", f"WITH {_FEATURES}, f AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY fwd_ret NULLS LAST) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0) / count(fwd_ret) OVER (PARTITION BY date) AS r FROM feat) SELECT ticker, date, CASE WHEN fwd_ret IS NOT NULL THEN CASE WHEN r > 0.7 THEN 1.0 ELSE 0.0 END END AS label FROM f")
def _(s, d):
    return ml.labels(lite(s, d)).select("ticker", "date", "label")


@query("ml_splits", f"WITH {BARS}, n AS (SELECT count(DISTINCT date) AS n FROM bars) SELECT CAST(t AS INT) AS test_day, CAST(least(t + 20, n) AS INT) AS test_end, CAST(t - 16 AS INT) AS train_end FROM n, generate_series(250, 1000, 20) g(t) WHERE t < n")
def _(s, d):
    return ml.splits(source.brand_bars(s, d)).select(F.col("test_day").cast("int").alias("test_day"), F.col("test_end").cast("int").alias("test_end"), F.col("train_end").cast("int").alias("train_end"))


LEARNING = config.load({"ml": {"max_iter": 150}})


@query("ml_walk_forward")
def _(s, d):
    """All features, the computed regime, a refit each 20 dates, 150 rounds."""
    return ml.metrics(ml.walk_forward(scored(s, d), LEARNING))


@query("ml_latest_probability")
def _(s, d):
    return ml.latest_probability(scored(s, d), LEARNING)


_PRED = "SELECT l_returnflag AS market, CAST(l_linenumber AS BIGINT) AS test_day, CASE WHEN l_discount > 0.07 THEN 1.0 ELSE 0.0 END AS label, l_tax AS fwd_ret, floor(l_extendedprice / 100) / 1000 AS prob FROM lineitem"


@query("ml_metrics", f"""WITH p AS ({_PRED}), r AS (SELECT *, rank() OVER (PARTITION BY market ORDER BY prob) + (count(*) OVER (PARTITION BY market, prob) - 1) / 2.0 AS r FROM p), q AS (SELECT market, quantile_cont(prob, 0.9) AS q90 FROM p GROUP BY 1)
 SELECT market, count(DISTINCT test_day) AS n_refits, round((sum(label * r) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc, round(avg(label), 6) AS base_rate, round(avg(CASE WHEN prob >= q90 - 1e-9 THEN label END), 6) AS top_precision,
 round(100 * avg(CASE WHEN prob >= q90 - 1e-9 THEN fwd_ret END), 6) AS top_fwd_pct, round(100 * avg(fwd_ret), 6) AS all_fwd_pct, count(*) AS n FROM r JOIN q USING (market) GROUP BY 1""")
def _(s, d):
    """The metrics over line items as predictions: a rounded price is the probability, so there are many ties."""
    rows = source.table(s, d, "lineitem").select(F.col("l_returnflag").alias("market"), F.col("l_linenumber").cast("long").alias("test_day"), (F.col("l_discount") > 0.07).cast("double").alias("label"), F.col("l_tax").alias("fwd_ret"), (F.floor(F.col("l_extendedprice") / 100) / 1000).alias("prob"))
    return rounded(ml.metrics(rows), ["market", "n_refits", "n"], auc=6, base_rate=6, top_precision=6, top_fwd_pct=6, all_fwd_pct=6)


# -- reports


@query("report_summary", f"WITH {BARS} SELECT ticker, list(close ORDER BY date)[-60:] AS closes FROM bars GROUP BY 1".replace("list(close ORDER BY date)[-60:] AS closes", "round(list_sum(list(close ORDER BY date)[-60:]), 2) AS total, len(list(close ORDER BY date)[-60:]) AS n"))
def _(s, d):
    rows = reports.sparkline_values(source.brand_bars(s, d))
    return rows.select("ticker", F.round(F.aggregate("closes", F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.size("closes").alias("n"))
