"""Setups and their explanation, text scores, events and social signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Setup -> (kind, bars to hold, may be traded).
SETUPS = {
    "Breakout": ("breakout", 15, True), "Squeeze (pre-breakout)": ("squeeze", 15, True), "Pullback in uptrend": ("pullback", 15, True),
    "Mean-reversion bounce": ("bounce", 7, True), "Momentum continuation": ("momentum", 15, True), "Extended (wait)": ("extended", 15, False),
    "Counter-trend bounce": ("counter", 5, False), "No clean setup": ("none", 0, False),
}
# Phrases of headlines and their weights.
PHRASES = {
    "beats": 2, "beat estimates": 2.5, "tops estimates": 2.5, "raises guidance": 3, "raised guidance": 3, "upgrade": 2.5, "upgraded": 2.5, "outperform": 2, "overweight": 1.5,
    "record revenue": 2, "record profit": 2, "buyback": 1.5, "dividend increase": 1.5, "all-time high": 1.5, "surge": 1.5, "soars": 2, "rally": 1, "partnership": 1, "contract win": 2,
    "approval": 1.5, "etf approval": 2.5, "etf inflows": 2,
    "downgrade": -2.5, "downgraded": -2.5, "underperform": -2, "misses": -2.5, "missed estimates": -2.5, "cuts guidance": -3, "lowers guidance": -3, "lowered guidance": -3,
    "profit warning": -3, "probe": -2, "investigation": -2, "lawsuit": -2, "recall": -2, "plunge": -2, "plunges": -2.5, "slump": -2, "sell-off": -2, "selloff": -2, "layoffs": -1,
    "bankruptcy": -3.5, "default": -2.5, "fraud": -3.5, "short seller": -2, "delisting": -3, "hack": -3, "exploit": -2.5, "liquidation": -2, "liquidations": -2, "outage": -1.5,
    "sec charges": -3, "fine": -1, "tariff": -1, "sanction": -1.5,
}


def setup_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SETUPS.items()], "setup string, kind string, hold_days int, setup_eligible boolean")


def setup_label() -> Column:
    """The first rule that holds; an undefined comparison doesn't."""
    c, d21, rsi = F.col("close"), F.col("dist21_atr"), F.col("rsi14")
    up, above = F.coalesce(F.col("uptrend") == 1, F.lit(False)), F.coalesce(F.col("above200") == 1, F.lit(False))
    rvol, reach = F.coalesce("rvol", F.lit(1.0)), F.coalesce("close_range", F.lit(0.0))
    is_ = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(is_(up & (F.col("breakout20") == 1) & (rvol >= 1.2) & (reach >= 0.5)), "Breakout")
        .when(is_(up & (F.col("squeeze_on") == 1) & (F.abs(d21) <= 1)), "Squeeze (pre-breakout)")
        .when(is_(up & d21.between(-1.5, 0.75) & rsi.between(35, 60)), "Pullback in uptrend")
        .when(is_(above & (F.col("rsi2") <= 10) & (c >= 0.97 * F.col("sma50"))), "Mean-reversion bounce")
        .when(is_(up & (F.col("pct_52w_high") >= 0.93) & (F.col("mom_6m") > 0.10)), F.when(is_(d21 <= 2), "Momentum continuation").otherwise("Extended (wait)"))
        .when(is_(up & (d21 > 2)), "Extended (wait)")
        .when(is_(~above & (rsi <= 30) & (F.coalesce("close_range3", F.lit(0.0)) >= 0.6)), "Counter-trend bounce")
        .otherwise("No clean setup")
    )


def explained(columns: list[str]) -> Column:
    """Why a candidate ranks as it does; columns that are absent say nothing."""
    has = lambda c: F.col(c) if c in columns else F.lit(None).cast("double")
    over = lambda c, x, said: F.when(has(c) > x, said)
    news = has("news_sent")
    bits = [
        over("g_momentum", 0.8, "momentum leader").when(has("g_momentum") < -0.8, "weak momentum"), over("g_trend", 0.8, "strong trend structure"),
        over("g_timing", 0.5, "favourable entry timing"), over("g_volatility", 0.5, "volatility compression"),
        over("g_volume", 0.5, "volume accumulation").when(has("g_volume") < -0.8, "distribution in volume"),
        over("g_fundamentals", 0.5, "quality/growth fundamentals").when(has("g_fundamentals") < -0.8, "weak fundamentals"),
        F.when(news > 0.15, "positive news flow").when(news < -0.15, "negative news flow").when(news.isNotNull(), "neutral news"),
        F.when(has("squeeze_on") == 1, "Bollinger/Keltner squeeze on"), F.when(has("breakout55") == 1, "new 55-day high"),
        F.when(has("ml_prob") >= 0.6, F.format_string("ML p=%.2f", has("ml_prob"))),
    ]
    said = F.concat_ws("; ", F.array_compact(F.array(*bits)))
    return F.when(said == "", "no dominant factor").otherwise(said)


def text_score(text: Column, phrases: dict[str, float] | None = None) -> Column:
    """Sum of the weights of the phrases that a text holds, over 5, within -1..1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for phrase, weight in (PHRASES if phrases is None else phrases).items():
        total = total + F.when(F.contains(low, F.lit(phrase)), float(weight)).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / 5))


def headline_scores(news: DataFrame, as_of: Column, half_life: float = 3.0) -> DataFrame:
    """By ticker: mean score by recency, headlines of the last week, the five latest. An unknown time counts as a week ago."""
    age = F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("published")) / 86_400e6), F.lit(7.0))
    rows = news.select("ticker", "title", text_score(F.col("title")).alias("score"), age.alias("age")).withColumn("w", F.pow(F.lit(0.5), F.col("age") / half_life))
    item = F.struct(F.col("age").alias("age"), "title", F.round("score", 2).alias("score"))
    return rows.groupBy("ticker").agg(
        F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w")).alias("news_sent"), F.sum((F.col("age") <= 7).cast("int")).alias("news_attention"), F.count("*").alias("n"),
        F.slice(F.array_sort(F.collect_list(item)), 1, 5).alias("items"),
    )


def fear_greed_mult(value: Column, regime: Column) -> Column:
    return F.when(value >= 85, 0.75).when(value >= 70, 0.9).when((value <= 15) & ~F.coalesce(regime.isin("RISK_ON", "NEUTRAL"), F.lit(False)), 0.75).otherwise(1.0)


def earnings(rows: DataFrame, as_of: Column, window: int = 21, policy: str = "flag") -> DataFrame:
    """days_to_earnings, earnings_flag, earnings_mult and veto from next_date."""
    days = F.datediff("next_date", as_of)
    near = F.coalesce(days.between(0, window), F.lit(False))
    tail = {"halve": " (half size)", "veto": " (vetoed)"}.get(policy, " — binary gap risk")
    return rows.withColumns({
        "days_to_earnings": days, "earnings_flag": F.when(near, F.concat(F.lit("Earnings in "), days.cast("string"), F.lit("d" + tail))).otherwise(""),
        "earnings_mult": F.when(near & F.lit(policy == "halve"), 0.5).otherwise(1.0), "veto": near & F.lit(policy == "veto"),
    })


def next_dates(dates: DataFrame, as_of: Column) -> DataFrame:
    return dates.where(F.col("date") >= as_of).groupBy("ticker").agg(F.min("date").alias("next_date"))


def macro_warnings(events: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    days = F.datediff("date", as_of)
    return events.where(days.between(0, horizon)).select("date", F.concat(F.coalesce("name", F.lit("Macro event")), F.lit(" in "), days.cast("string"), F.lit("d ("), F.col("date").cast("string"), F.lit(")")).alias("warning"))


def ex_dividend_flag(next_date: Column, as_of: Column, window: int) -> Column:
    near = F.datediff(next_date, as_of).between(0, window)
    return F.when(near, F.concat(F.lit("Ex-dividend "), next_date.cast("date").cast("string"))).otherwise("")


def message_counts(messages: DataFrame, as_of: Column) -> DataFrame:
    """By ticker: messages of a day and a week, a day's rate since the oldest, bullish share of at least three tagged."""
    hours = (F.unix_micros(as_of) - F.unix_micros("ts")) / 3600e6
    tagged = F.count(F.when(F.col("tag").isin("bullish", "bearish"), 1))
    span = F.max(hours)
    bull = F.count(F.when(F.col("tag") == "bullish", 1))
    return messages.groupBy("ticker").agg(
        F.count(F.when(hours <= 24, 1)).alias("messages_24h"), F.count(F.when(hours <= 168, 1)).alias("messages_7d"), bull.alias("bull"), (tagged - bull).alias("bear"),
        F.when(span > 0, F.count("*") / span * 24).alias("msgs_per_day"), F.when(tagged >= 3, bull / tagged).alias("bull_share"),
    )


def shortest_id(coins: DataFrame, preferred: dict[str, str] | None = None) -> DataFrame:
    """symbol -> id: the preferred one, else the shortest (then the first by name)."""
    out = coins.groupBy(F.upper("symbol").alias("symbol")).agg(F.min_by("id", F.struct(F.length("id").alias("n"), "id")).alias("id"))
    choice = F.lit(None).cast("string")
    for symbol, own in (preferred or {}).items():
        choice = F.when(F.col("symbol") == symbol, own).otherwise(choice)
    return out.withColumn("id", F.coalesce(choice, "id"))


def social(rows: DataFrame, kind: str) -> DataFrame:
    """social_buzz and social_bull, of message streams (us) or coin votes (crypto)."""
    if kind == "us":
        return rows.withColumns({"social_buzz": F.when(F.col("msgs_per_day") > 0, F.log1p("msgs_per_day")), "social_bull": F.col("bull_share")})
    return rows.withColumns({"social_buzz": F.log1p(F.coalesce("reddit_posts", F.lit(0.0))) + F.when(F.col("trending"), 1.0).otherwise(0.0), "social_bull": F.col("up_pct") / 100})


def social_flags() -> Column:
    bull, buzz = F.col("social_bull"), F.col("social_buzz")
    crowd = F.when((bull >= 0.9) & (buzz >= 3.5), "crowd euphoric on social (contrarian caution)").when(bull <= 0.3, "crowd bearish on social")
    return F.array_compact(F.array(crowd, F.when(F.col("trending"), "trending on CoinGecko")))


def funding_contrarian(rates: DataFrame) -> DataFrame:
    return rates.select("ticker", (-F.col("rate")).alias("funding_contrarian"))


def eps_revision(estimates: DataFrame) -> DataFrame:
    """By ticker the 30-day change of the estimate, of the first of periods +1y, 0y, +1q that has one."""
    change = F.try_divide(F.col("current"), F.col("ago_30d")) - 1
    of = lambda p: F.max(F.when(F.col("period") == p, change))
    return estimates.groupBy("ticker").agg(F.coalesce(of("+1y"), of("0y"), of("+1q")).alias("epsRevision30d"))


def news_items(payloads: DataFrame, most: int = 25) -> DataFrame:
    """(ticker, title, published, provider, summary) of JSON payloads, nested under `content` or flat; the first `most` by pos."""
    p = F.col("payload")
    get = lambda path: F.get_json_object(p, path)
    out = payloads.where(F.col("pos") < most).select(
        "ticker", F.coalesce(get("$.content.title"), get("$.title")).alias("title"),
        F.coalesce(F.try_to_timestamp(get("$.content.pubDate")), F.timestamp_seconds(get("$.providerPublishTime").cast("long"))).alias("published"),
        F.coalesce(get("$.content.provider.displayName"), get("$.publisher")).alias("provider"), F.coalesce(get("$.content.summary"), get("$.summary")).alias("summary"),
    )
    return out.where("title is not null")
