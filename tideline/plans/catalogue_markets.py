"""Registered queries over several markets at once: brands are dealt to three markets by number, and market is data throughout.

Beside them the regime's side inputs: a volatility index made of orders, a credit ratio of two brands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import crosssection, indicators, plan, regime
from ..sources import bars as source
from .catalogue import BARS, CFG, COMP_ALL, O, REGIME, ZED_ALL, bench, kept, query, roll, rounded, weekly
from .engine import Engine

MARKETS = {"us": (1, 10), "uae": (11, 18), "crypto": (19, 99)}
LEADERS = [f"Brand#{a}" for a, _ in MARKETS.values()]
SETTINGS = config.DEFAULTS["markets"]
MACRO = {"oil_bull": False, "dollar_strong": True}


def market_bars(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("ticker", "([0-9]+)", 1).cast("int")
    name = F.coalesce(*(F.when(number.between(a, b), m) for m, (a, b) in MARKETS.items()))
    return weekly(spark, sf).withColumn("market", name)


def engine(spark: SparkSession) -> Engine:
    return Engine(spark)


def market_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each market's equal-weight index, the benchmark of its regime."""
    return kept(spark, sf, "market_index", lambda: source.equal_weight_index(engine(spark).loaded(market_bars(spark, sf))))


def market_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """A brand a market for relative strength: on these random prices the indices grow beyond what a difference of returns can hold."""
    return market_bars(spark, sf).where(F.col("ticker").isin(LEADERS)).drop("ticker")


def market_panel(spark: SparkSession, sf: str) -> DataFrame:
    own = engine(spark)
    return kept(spark, sf, "market_panel", lambda: own.panel(own.loaded(market_bars(spark, sf)), market_leaders(spark, sf)))


def market_regimes(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "market_regimes", lambda: engine(spark).regimes(market_index(spark, sf), market_panel(spark, sf)))


def market_scored(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "market_scored", lambda: engine(spark).scored(market_panel(spark, sf), market_regimes(spark, sf)))


# -- SQL: the texts of one market with the market put into every key


def _put(text: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if old not in text:
            raise ValueError(f"no such part: {old}")
        text = text.replace(old, new)
    return text


_NUMBER = "CAST(regexp_extract(ticker, '([0-9]+)', 1) AS INT)"
_MARKET = "CASE " + " ".join(f"WHEN {_NUMBER} BETWEEN {a} AND {b} THEN '{m}'" for m, (a, b) in MARKETS.items()) + " END"
_BY_MARKET = lambda field: "CASE market " + " ".join(f"WHEN '{m}' THEN {float(s[field])}" for m, s in SETTINGS.items()) + " END"
ALL_BARS = _put(BARS, ("bars AS (SELECT", f"every AS (SELECT {_MARKET} AS market, * FROM (SELECT"), ("GROUP BY 1, 2)", "GROUP BY 1, 2)), long AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_bars FROM every QUALIFY n_bars >= 120), bars AS (SELECT * EXCLUDE (n_bars) FROM long WHERE (SELECT count(DISTINCT ticker) FROM long l WHERE l.market = long.market) >= 5)"))
INDEX = f"""rets AS (SELECT market, date, close / nullif(lag(close) OVER ({O}), 0) - 1 AS ret FROM bars), dly AS (SELECT market, date, coalesce(avg(ret), 0) AS ret FROM rets GROUP BY 1, 2),
 idx0 AS (SELECT market, date, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY market ORDER BY date)) AS close FROM dly)"""
_REGIME = _put(
    REGIME, ("SELECT date, avg(CASE", "SELECT market, date, avg(CASE"), ("(SELECT date, close, " + roll("avg", "close", 50), "(SELECT market, date, close, " + roll("avg", "close", 50)), ("GROUP BY 1)", "GROUP BY 1, 2)"),
    ("b0 AS (SELECT date,", "b0 AS (SELECT market, date,"), ("FROM bars WHERE ticker = 'Brand#11')", "FROM idx0)"), ("(ORDER BY date", "(PARTITION BY market ORDER BY date"), ("(ORDER BY b1.date)", "(PARTITION BY b1.market ORDER BY b1.date)"),
    ("rp AS (SELECT a.date,", "rp AS (SELECT a.market, a.date,"), ("FROM b1 a JOIN b1 b ON b.i", "FROM b1 a JOIN b1 b ON b.market = a.market AND b.i"), ("GROUP BY a.date, a.rv)", "GROUP BY a.market, a.date, a.rv)"),
    ("JOIN rp USING (date) LEFT JOIN br USING (date)", "JOIN rp USING (market, date) LEFT JOIN br USING (market, date)"), ("FROM (SELECT date, close, sma200", "FROM (SELECT market, date, close, sma200"),
)
MARKET_REGIME = f"{ALL_BARS}, {INDEX}, {_REGIME}"
_ZED = _put(
    ZED_ALL, (BARS, ALL_BARS), ("fb AS (SELECT o.*,", f"{INDEX}, fb AS (SELECT o.*, {_BY_MARKET('ppy').replace('market', 'o.market', 1)} AS ppy, {_BY_MARKET('atr_ideal').replace('market', 'o.market', 1)} AS ideal,"),
    ("LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'Brand#11') b USING (date))", f"LEFT JOIN (SELECT market, date, close FROM bars WHERE ticker IN ({', '.join(map(repr, LEADERS))})) b ON b.market = o.market AND b.date = o.date)"), ("feat AS (SELECT ticker,", "feat AS (SELECT market, ticker,"),
    ("exp(52 *", "exp(ppy *"), ("/ close / 2.5))", "/ close / ideal))"), ("(PARTITION BY date)", "(PARTITION BY market, date)"),
)
_AFTER = COMP_ALL.removeprefix(f"{ZED_ALL}, {REGIME}")
SCORED = f"{_ZED}, {_REGIME}" + _put(
    _AFTER, ("rd AS (SELECT date,", "rd AS (SELECT market, date,"), ("(ORDER BY date", "(PARTITION BY market ORDER BY date"), ("(SELECT DISTINCT date FROM bars) LEFT JOIN (SELECT date, regime FROM reg) USING (date))", "(SELECT DISTINCT market, date FROM bars) LEFT JOIN (SELECT market, date, regime FROM reg) USING (market, date))"),
    ("LEFT JOIN rd USING (date))", "LEFT JOIN rd USING (market, date))"), ("PARTITION BY date", "PARTITION BY market, date"),
)
_RK = lambda x: f"rank() OVER (PARTITION BY market, date ORDER BY {x}) + (count(*) OVER (PARTITION BY market, date, {x}) - 1) / 2.0"
SLEEVES = f"""{SCORED}, rk AS (SELECT market, date, {_RK('composite')} AS a, {_RK('fwd_ret')} AS b FROM crk WHERE composite IS NOT NULL AND fwd_ret IS NOT NULL), di AS (SELECT market, date, count(*) AS n, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM rk GROUP BY 1, 2),
 ic AS (SELECT market, avg(ic) / stddev_samp(ic) * sqrt(count(ic) / 15) AS ic_t FROM (SELECT market, CASE WHEN n >= 8 THEN ic END AS ic, sum(n) OVER (PARTITION BY market) AS rows FROM di) WHERE rows >= 200 GROUP BY 1 HAVING count(ic) >= 20),
 now AS (SELECT market, arg_max(regime, date) AS regime FROM reg GROUP BY 1),
 sl AS (SELECT market, regime, coalesce(ic_t, 0) AS t, {_BY_MARKET('base')} AS base, CASE regime WHEN 'RISK_ON' THEN 1.0 WHEN 'NEUTRAL' THEN 0.7 WHEN 'RISK_OFF' THEN 0.35 ELSE 0.0 END AS rm, CASE WHEN coalesce(ic_t, 0) >= 1.5 THEN 1.0 WHEN coalesce(ic_t, 0) > 0 THEN 0.6 ELSE 0.4 END AS im,
  CASE market WHEN 'uae' THEN 0.85 WHEN 'crypto' THEN 0.9 ELSE 1.0 END AS mm, CASE market WHEN 'uae' THEN 'oil downtrend' WHEN 'crypto' THEN 'strong dollar' END AS why FROM now LEFT JOIN ic USING (market)),
 sb AS (SELECT *, base * rm * im * mm AS share, greatest(sum(base * rm * im * mm) OVER (), 1) AS over FROM sl)"""


# -- queries


@query("markets_index", f"WITH {ALL_BARS}, {INDEX} SELECT market, date, round(log10(close), 8) AS log_close FROM idx0")
def _(s, d):
    return market_index(s, d).select("market", "date", F.round(F.log10("close"), 8).alias("log_close"))


@query("markets_validate", f"WITH {ALL_BARS}, listed AS (SELECT DISTINCT {_MARKET} AS market, ticker FROM (SELECT p_brand AS ticker FROM part)), h AS (SELECT ticker, max(date) AS last FROM bars GROUP BY 1) SELECT market, count(*) AS listed, count(last) AS loaded, count(*) - count(last) AS missing, max(last) AS latest_bar FROM listed LEFT JOIN h USING (ticker) GROUP BY 1")
def _(s, d):
    number = F.regexp_extract("ticker", "([0-9]+)", 1).cast("int")
    listed = source.table(s, d, "part").select(F.col("p_brand").alias("ticker")).distinct().withColumn("market", F.coalesce(*(F.when(number.between(a, b), m) for m, (a, b) in MARKETS.items())))
    return engine(s).validate(listed, engine(s).loaded(market_bars(s, d)))


@query("markets_regime", f"WITH {MARKET_REGIME} SELECT market, date, round(score, 6) AS score, regime FROM reg")
def _(s, d):
    return rounded(market_regimes(s, d), ["market", "date", "regime"], score=6)


@query("markets_regime_now", f"WITH {MARKET_REGIME}, l AS (SELECT market, arg_max(regime, date) AS regime, max(date) AS date FROM reg GROUP BY 1) SELECT l.market, l.regime, l.date, (SELECT count(*) FROM reg r WHERE r.market = l.market AND r.date > coalesce((SELECT max(date) FROM reg q WHERE q.market = l.market AND q.regime <> l.regime), DATE '1900-01-01')) AS age FROM l")
def _(s, d):
    return regime.age(market_regimes(s, d)).select("market", "regime", "date", "age")


@query("markets_scan", f"WITH RECURSIVE {SCORED} SELECT market, ticker, date, regime, round(composite, 5) AS composite, round(comp_rank, 6) AS comp_rank FROM crk")
def _(s, d):
    return rounded(market_scored(s, d), ["market", "ticker", "date", "regime"], composite=5, comp_rank=6)


@query("markets_top", f"WITH RECURSIVE {SCORED} SELECT market, ticker, date, round(composite, 5) AS composite, row_number() OVER (PARTITION BY market ORDER BY composite DESC NULLS LAST, ticker) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n, max(date) OVER (PARTITION BY market) AS newest FROM crk) WHERE n = 1 AND newest - date <= 7 QUALIFY place <= 5")
def _(s, d):
    return rounded(crosssection.top(crosssection.latest(market_scored(s, d)), 5), ["market", "ticker", "date", "place"], composite=5)


@query("markets_sleeves", f"""WITH RECURSIVE {SLEEVES} SELECT market, regime, round(t, 5) AS ic_t, round(20000 * share / over, 4) AS budget, CASE WHEN nt <> '' THEN market || ': budget trimmed — ' || nt END AS note FROM (SELECT *, concat_ws(', ',
 CASE WHEN rm < 1 THEN replace(lower(regime), '_', ' ') || printf(' regime ×%.2f', rm) END, CASE WHEN im < 1 THEN printf('weak signal history (IC t=%.1f) ×%.2f', round(t, 2), im) END, CASE WHEN mm < 1 THEN why || printf(' ×%.2f', mm) END) AS nt FROM sb)""")
def _(s, d):
    """Budgets from each market's own regime and signal history, with the notes on what trims them."""
    ic = crosssection.rank_ic(market_scored(s, d))
    now = regime.age(market_regimes(s, d)).select("market", "regime")
    sleeves = plan.market_sleeves(now.join(ic.select("market", "ic_t"), "market", "left"), config.load(), **MACRO)
    return plan.sleeve_notes(sleeves).select("market", "regime", F.round(F.coalesce("ic_t", F.lit(0.0)), 5).alias("ic_t"), F.round("budget", 4).alias("budget"), "note")


# -- side inputs of the regime

_VIX = "vx AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, 10 + avg(o_totalprice) % 2000 / 60 AS v FROM orders GROUP BY 1)"
SIDE = _put(
    f"{BARS}, {_VIX}, cd AS (SELECT a.date, a.close / nullif(b.close, 0) AS c FROM (SELECT * FROM bars WHERE ticker = 'Brand#12') a JOIN (SELECT * FROM bars WHERE ticker = 'Brand#13') b USING (date)), {REGIME}",
    ("b1 AS (SELECT *,", "bv AS (SELECT b0.*, last_value(v IGNORE NULLS) OVER (ORDER BY b0.date) AS vix_val, last_value(c IGNORE NULLS) OVER (ORDER BY b0.date) AS credit_val FROM b0 LEFT JOIN vx USING (date) LEFT JOIN cd USING (date)), bw AS (SELECT *, credit_val / nullif(lag(credit_val, 20) OVER (ORDER BY date), 0) - 1 AS credit_mom FROM bv), b1 AS (SELECT *,"),
    ("AS rv FROM b0)", "AS rv FROM bw)"), ("b2 AS (SELECT b1.*,", "b2 AS (SELECT b1.*, CASE WHEN vix_val > 30 THEN -1.5 WHEN vix_val > 22 THEN -0.5 WHEN vix_val < 16 THEN 0.5 ELSE 0.0 END AS vix, CASE WHEN credit_mom > 0 THEN 0.5 ELSE -0.5 END AS credit,"),
    ("above50 + vol + b2.breadth)", "above50 + vol + b2.breadth + vix + credit)"), ("above50, vol, breadth FROM b2) b2)", "above50, vol, breadth, vix, credit, vix_val, credit_mom FROM b2) b2)"), ("WHEN score <= -3.5", "WHEN score <= -3.5 OR vix_val > 35"),
)


@query("regime_side_votes", f"WITH {SIDE} SELECT date, round(vix_val, 6) AS vix_val, vix, round(credit_mom, 6) AS credit_mom, credit, round(score, 6) AS score, regime FROM reg")
def _(s, d):
    """Votes of a volatility index (weekly means of orders) and of a credit ratio (two brands), panic above 35."""
    orders = source.table(s, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date"))
    vix = orders.agg((10 + F.avg("o_totalprice") % 2000 / 60).alias("value"))
    own = weekly(s, d)
    credit = regime.credit_ratio(own.where("ticker = 'Brand#12'"), own.where("ticker = 'Brand#13'"))
    wide = indicators.with_market(own, CFG["markets"]).withColumn("sma50", indicators.sma(F.col("close"), 50))
    found = regime.compute(indicators.with_market(bench(s, d), CFG["markets"]), crosssection.breadth(wide), vix, credit)
    return rounded(found, ["date", "vix", "credit", "regime"], vix_val=6, credit_mom=6, score=6)
