"""Registered queries of side inputs and small rules: gauges, coins, snapshots, sizes, flags of assets, learning features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import crosssection, macro, ml, plan, rules
from ..sources import bars as source
from ..sources import files
from .catalogue import BARS, CFG, COMP_ALL, ORACLE, STATE, featured, query, rounded, scored, weekly

# -- gauges and coins

_GAUGE = """g0 AS (SELECT o_orderpriority AS gauge, o_orderkey % 101 AS v, o_orderstatus AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
 g1 AS (SELECT gauge, arg_min(v, n) AS value, arg_min(label, n) AS label, list(v ORDER BY n) AS history FROM g0 WHERE n <= 8 GROUP BY 1)"""


@query("gauges", f"WITH {_GAUGE} SELECT gauge, CAST(value AS INT) AS value, label, array_to_string(history, ',') AS history, CASE WHEN value >= 85 THEN 'extreme greed' WHEN value >= 70 THEN 'greed' WHEN value <= 15 THEN 'extreme fear' WHEN value <= 30 THEN 'fear' ELSE label END AS zone FROM g1")
def _(s, d):
    """Each priority's last eight orders as a JSON gauge, parsed as one from a service would be."""
    o = source.table(s, d, "orders")
    newest = W.partitionBy("o_orderpriority").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    reading = F.struct("n", (F.col("o_orderkey") % 101).cast("string").alias("value"), F.col("o_orderstatus").alias("value_classification"))
    last = o.withColumn("n", F.row_number().over(newest)).where("n <= 8").groupBy(F.col("o_orderpriority").alias("gauge")).agg(F.array_sort(F.collect_list(reading)).alias("data"))
    found = files.parse_gauges(last.select("gauge", F.to_json(F.struct("data")).alias("value")), "gauge")
    return found.select("gauge", "value", "label", F.array_join(F.transform("history", lambda v: v.cast("string")), ",").alias("history"), files.fear_greed_zone(F.col("value"), F.col("label")).alias("zone"))


_COINS = """e AS (SELECT 'C' || user_id % 40 || '/USD' AS ticker, 'C' || user_id % 40 AS symbol, ts, value FROM events), v AS (SELECT symbol, 100 * avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS up, CASE WHEN count(*) % 3 <> 0 THEN count(*) END AS posts FROM e GROUP BY 1 HAVING count(*) % 11 <> 0),
 h AS (SELECT symbol FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 24 HOUR GROUP BY 1), f AS (SELECT ticker, avg(value) / 1000 - 0.04 AS rate FROM e GROUP BY 1 HAVING count(*) % 2 = 0),
 c AS (SELECT t.ticker, up / 100 AS bull, ln(1 + coalesce(posts, 0)) + CASE WHEN h.symbol IS NOT NULL THEN 1 ELSE 0 END AS buzz, h.symbol IS NOT NULL AS hot, -rate AS contra FROM (SELECT DISTINCT ticker, symbol FROM e) t JOIN v USING (symbol) LEFT JOIN h USING (symbol) LEFT JOIN f USING (ticker))"""


@query("coin_sentiment", f"WITH {_COINS} SELECT ticker, round(buzz, 6) AS social_buzz, round(bull, 6) AS social_bull, round(contra, 8) AS funding_contrarian, concat_ws('; ', CASE WHEN bull >= 0.9 AND buzz >= 3.5 THEN 'crowd euphoric on social (contrarian caution)' WHEN bull <= 0.3 THEN 'crowd bearish on social' END, CASE WHEN hot THEN 'trending on CoinGecko' END) AS flags FROM c")
def _(s, d):
    """Events as coins: payloads of votes and posts, what trended on the last day, funding of every second coin, each with gaps."""
    e = source.table(s, d, "events").select(F.concat(F.lit("C"), (F.col("user_id") % 40).cast("string")).alias("symbol"), "ts", "value").withColumn("ticker", F.concat("symbol", F.lit("/USD")))
    n = F.count("*")
    sums = e.groupBy("symbol").agg((100 * F.avg((F.col("value") > 40).cast("double"))).alias("up"), n.alias("n")).where("n % 11 <> 0")
    payload = F.to_json(F.struct(F.col("up").alias("sentiment_votes_up_percentage"), F.struct(F.when(F.col("n") % 3 != 0, F.col("n")).alias("reddit_average_posts_48h")).alias("community_data")))
    votes = files.coin_votes(sums.select(F.lower("symbol").alias("id"), payload.alias("payload")))
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))  # one row
    hot = e.join(newest, F.col("ts") >= F.col("newest") - F.expr("INTERVAL 24 HOURS")).select("symbol").distinct()
    trend = hot.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.lower("symbol").alias("symbol")).alias("item"))).alias("coins"))).alias("payload"))
    funding = e.groupBy("ticker").agg((F.avg("value") / 1000 - 0.04).alias("rate"), n.alias("n")).where("n % 2 = 0").select("ticker", "rate")
    ids = rules.shortest_id(sums.select("symbol", F.lower("symbol").alias("id")))
    found = rules.social(files.coin_sentiment(e.select("ticker").distinct(), ids, votes, files.trending_symbols(trend), funding), "crypto")
    return rounded(found.withColumn("flags", F.array_join(rules.social_flags(), "; ")), ["ticker", "flags"], social_buzz=6, social_bull=6, funding_contrarian=8)


@query("ex_dividend", "SELECT o_custkey AS ticker, CASE WHEN min(CAST(o_orderdate AS DATE)) - DATE '1997-06-01' BETWEEN 0 AND 21 THEN 'Ex-dividend ' || CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) ELSE '' END AS flag FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-05-20' GROUP BY 1")
def _(s, d):
    dates = source.table(s, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"))
    found = rules.next_dates(dates, F.lit("1997-05-20").cast("date"))
    return found.select("ticker", rules.ex_dividend_flag(F.col("next_date"), F.lit("1997-06-01").cast("date"), 21).alias("flag"))


# -- snapshots

_Z = lambda x: f"CASE WHEN {x} IS NOT NULL AND stddev_samp({x}) OVER w > 0 THEN greatest(-3, least(3, ({x} - avg({x}) OVER w) / stddev_samp({x}) OVER w)) END"
_SNAP = f"""p AS (SELECT p_partkey AS ticker, p_type AS market, CASE WHEN p_size % 5 <> 0 THEN p_size / 25.0 - 1 END AS roe, CAST(1000 / p_retailprice - 1 AS DOUBLE) AS rev_growth, CASE WHEN p_partkey % 3 = 0 THEN (p_size % 7) / 7.0 END AS news_sent, (p_partkey % 11) / 11.0 AS social_bull FROM part),
 z AS (SELECT ticker, {', '.join(f'{_Z(c)} AS {c}' for c in ('roe', 'rev_growth', 'news_sent', 'social_bull'))} FROM p WINDOW w AS (PARTITION BY market))"""


@query("snapshot_groups", f"WITH {_SNAP} SELECT ticker, round((coalesce(roe * 1, 0) + coalesce(rev_growth * 1, 0)) / nullif(CASE WHEN roe IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN rev_growth IS NOT NULL THEN 1 ELSE 0 END, 0), 6) AS g_fundamentals, round((coalesce(news_sent * 1, 0) + coalesce(social_bull * 0.5, 0)) / nullif(CASE WHEN news_sent IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN social_bull IS NOT NULL THEN 0.5 ELSE 0 END, 0), 6) AS g_sentiment FROM z")
def _(s, d):
    p = source.table(s, d, "part")
    rows = p.select(F.col("p_partkey").alias("ticker"), F.col("p_type").alias("market"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 25 - 1).alias("roe"), (1000 / F.col("p_retailprice") - 1).alias("rev_growth"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") % 7 / 7).alias("news_sent"), (F.col("p_partkey") % 11 / 11).alias("social_bull"))
    return rounded(crosssection.enriched(rows), ["ticker"], g_fundamentals=6, g_sentiment=6)


@query("snapshot_sector", "SELECT p_partkey AS ticker, CASE WHEN p_size % 4 = 0 THEN 'ETF' ELSE p_type END AS sector, p_name AS name FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 5 = 0")
def _(s, d):
    p = source.table(s, d, "part")
    known = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("ticker"), F.when(F.col("p_size") % 4 == 0, "etf").otherwise("EQUITY").alias("quoteType"), F.col("p_type").alias("sector"), F.col("p_name").alias("shortName"), F.lit(None).cast("double").alias("shortPercentOfFloat"))
    return crosssection.with_sector(p.select(F.col("p_partkey").alias("ticker")), known).select("ticker", "sector", F.col("shortName").alias("name"))


@query("blended_conviction", "SELECT o_orderkey AS ticker, round(CASE WHEN p IS NULL THEN b ELSE 0.7 * b + 0.3 * 100 * p END, 6) AS conviction FROM (SELECT o_orderkey, CAST(o_orderkey % 100 AS DOUBLE) AS b, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 97) / 97.0 END AS p FROM orders)")
def _(s, d):
    o = source.table(s, d, "orders").select(F.col("o_orderkey").alias("ticker"), (F.col("o_orderkey") % 100).cast("double").alias("b"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 97 / 97).alias("p"))
    return o.select("ticker", F.round(crosssection.blended(F.col("b"), F.col("p")), 6).alias("conviction"))


@query("setup_usage", f"{STATE} SELECT setup, kind, hold_days, setup_eligible, count(ticker) AS n FROM (VALUES " + ", ".join(f"('{k}', '{a}', {b}, {c})" for k, (a, b, c) in rules.SETUPS.items()) + ") t(setup, kind, hold_days, setup_eligible) LEFT JOIN st USING (setup) GROUP BY ALL")
def _(s, d):
    """How often each setup occurs, beside what it stands for."""
    seen = featured(s, d).select(rules.setup_label().alias("setup")).groupBy("setup").agg(F.count("*").alias("n"))
    return rules.setup_table(s).withColumnsRenamed({"_1": "setup"}).join(seen, "setup", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# -- sizes and budgets

_SIZE = "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'uae' WHEN 1 THEN 'us' ELSE 'crypto' END AS market, o_totalprice / 100 AS entry, o_totalprice / 100 * (0.9 + o_orderkey % 13 / 100.0) AS stop, CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'P' THEN 0.75 ELSE 0.5 END AS risk_pct, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 3.6725 END AS unit FROM orders"


@query("position_size", f"WITH o AS ({_SIZE}), r AS (SELECT *, least(20000.0 * risk_pct / 100 / unit / nullif(entry - stop, 0), 5000 / (entry * unit)) AS raw FROM o) SELECT k, round(CASE WHEN market = 'uae' THEN floor(raw) ELSE raw END, 6) AS units FROM r WHERE entry > stop")
def _(s, d):
    o = source.table(s, d, "orders")
    k, entry = F.col("o_orderkey"), F.col("o_totalprice") / 100
    rows = o.select(k.alias("k"), F.when(k % 3 == 0, "uae").when(k % 3 == 1, "us").otherwise("crypto").alias("market"), entry.alias("entry"), (entry * (0.9 + k % 13 / 100)).alias("stop"), F.when(F.col("o_orderstatus") == "O", 1.0).when(F.col("o_orderstatus") == "P", 0.75).otherwise(0.5).alias("risk_pct"))
    return rounded(plan.sized(rows.where("entry > stop"), CFG), ["k"], units=6)


@query("free_budget", "WITH b AS (SELECT o_orderpriority AS market, sum(o_totalprice) / 3 AS budget FROM orders GROUP BY 1), k AS (SELECT o_orderpriority AS market, sum(o_totalprice) AS held FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 1) SELECT market, round(coalesce(held, 0), 2) AS held_aed, round(greatest(0, budget - coalesce(held, 0)), 2) AS free FROM b LEFT JOIN k USING (market)")
def _(s, d):
    o = source.table(s, d, "orders").withColumnRenamed("o_orderpriority", "market")
    review = o.select("market", F.when(F.col("o_orderstatus") == "F", "EXIT").when(F.col("o_orderstatus") == "P", "REVIEW").otherwise("HOLD").alias("action"), F.col("o_totalprice").alias("value_aed"))
    return rounded(plan.free_budget(o.groupBy("market").agg((F.sum("o_totalprice") / 3).alias("budget")), review), ["market"], held_aed=2, free=2)


# -- assets, learning

ASSETS = {"Brand#1": "WTI crude", "Brand#2": "Gold", "Brand#3": "US 10y yield", "Brand#4": "Dollar index", "Brand#5": "High-yield credit", "Brand#6": "US 20y Treasuries", "Brand#7": "Emerging markets", "Brand#8": "S&P 500", "Brand#9": "Silver", "Brand#10": "Copper"}
_of = lambda asset, c: f"max(CASE WHEN ticker = '{next(k for k, v in ASSETS.items() if v == asset)}' THEN {c} END)"
_DASH = f"""dash AS ({ORACLE['macro_dashboard']}), yl AS (SELECT close - lag(close, 21) OVER (ORDER BY date) AS y1m FROM (SELECT p_brand, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#3' GROUP BY 1, 2) QUALIFY row_number() OVER (ORDER BY date DESC) = 1),
 a AS (SELECT {_of('WTI crude', 'vs_200d')} AS oil, {_of('WTI crude', 'trend_20d')} AS ot, {_of('Gold', 'chg_1m')} AS gold, {_of('Dollar index', 'chg_1m')} AS dx, {_of('Dollar index', 'vs_200d')} AS d2, {_of('High-yield credit', 'chg_1m')} AS hy, {_of('US 20y Treasuries', 'chg_1m')} AS tl, {_of('Emerging markets', 'chg_1m')} AS em, {_of('S&P 500', 'chg_1m')} AS sp, {_of('Silver', 'chg_1m')} AS si, {_of('Copper', 'chg_1m')} AS cu FROM dash)"""
_READ = """concat_ws('; ', CASE WHEN oil > 0 AND ot = 'up' THEN 'oil uptrend' WHEN oil < -5 AND ot = 'down' THEN 'oil weak' WHEN oil IS NOT NULL THEN 'oil range' END, CASE WHEN gold > 3 AND coalesce(y1m <= 0, true) THEN 'gold haven' WHEN gold > 3 THEN 'gold inflation' WHEN gold < -3 THEN 'gold sold' END,
 CASE WHEN si - gold > 4 THEN 'silver_gold rising' END, CASE WHEN cu - gold > 4 THEN 'copper_gold rising' WHEN gold - cu > 4 THEN 'copper_gold falling' END, CASE WHEN dx > 2 OR coalesce(d2 > 2 AND dx > 0, false) THEN 'dollar strong' WHEN dx < -2 THEN 'dollar weak' END,
 CASE WHEN y1m > 0.3 THEN 'yields up' WHEN y1m < -0.3 THEN 'yields down' END, CASE WHEN hy > tl THEN 'credit risk_on' WHEN hy IS NOT NULL AND tl IS NOT NULL THEN 'credit risk_off' END, CASE WHEN em > sp THEN 'emerging leading' WHEN em IS NOT NULL AND sp IS NOT NULL THEN 'emerging lagging' END)"""


@query("cross_asset", f"WITH {_DASH} SELECT CASE WHEN oil > 0 AND ot = 'up' THEN true WHEN oil < -5 AND ot = 'down' THEN false END AS oil_bull, CASE WHEN dx IS NOT NULL THEN dx > 2 OR coalesce(d2 > 2 AND dx > 0, false) END AS dollar_strong, y1m > 0.3 AS yields_spiking, hy > tl AS risk_appetite, {_READ} AS readings FROM a LEFT JOIN yl ON true")
def _(s, d):
    """Ten brands as assets."""
    names = F.create_map(*(F.lit(x) for pair in ASSETS.items() for x in pair))
    rows = weekly(s, d).where(F.col("ticker").isin(*ASSETS)).withColumn("asset", F.element_at(names, F.col("ticker")))
    dash = macro.dashboard(rows.withColumn("ticker", F.col("asset"))).withColumn("asset", F.col("ticker"))
    return macro.cross_asset(dash).withColumn("readings", F.array_join(F.transform("readings", lambda r: F.concat_ws(" ", r["topic"], r["reading"])), "; "))


@query("positioning_reads", f"WITH q AS ({ORACLE['positioning_all_tickers']}) SELECT label, CASE WHEN pct_3y >= 85 THEN 'crowded long' WHEN pct_3y <= 15 THEN 'crowded short' ELSE 'neutral' END AS read, pct_3y FROM q")
def _(s, d):
    cot = weekly(s, d).select(F.concat("ticker", F.lit(" -")).alias("market"), "date", F.col("ticker").alias("code"), F.col("close").alias("oi"), F.col("high").alias("nc_long"), F.col("low").alias("nc_short"))
    markets = cot.select(F.col("code").alias("label"), F.lower("market").alias("prefix")).distinct()
    return rounded(macro.positioning(cot, markets), ["label", "read"], pct_3y=5)


_SHOWN = ["g_trend", "g_momentum", "g_timing", "g_volatility", "g_volume", "pct_52w_high", "updown_vol", "cmf20", "clenow", "close_range3"]
_PCT = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"


@query("ml_features", f"WITH RECURSIVE {COMP_ALL} SELECT ticker, date, {', '.join(f'round({_PCT(c)}, 6) AS f_{c}' for c in _SHOWN)}, CAST(CASE regime WHEN 'CRISIS' THEN 0 WHEN 'RISK_OFF' THEN 1 WHEN 'NEUTRAL' THEN 2 ELSE 3 END AS DOUBLE) AS f_regime FROM crk")
def _(s, d):
    return rounded(ml.feature_frame(scored(s, d), _SHOWN), ["ticker", "date", "f_regime"], **{f"f_{c}": 6 for c in _SHOWN})


@query("bars_enough", f"WITH {BARS}, n AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_bars FROM bars) SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n FROM n WHERE n_bars >= 120 GROUP BY 1")
def _(s, d):
    return source.with_enough(weekly(s, d)).groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))
