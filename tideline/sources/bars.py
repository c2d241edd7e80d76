"""Bars: market, ticker, date, open, high, low, close, volume; one row for an instrument and a date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["market", "ticker", "date"]
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Trading hours in UTC by market, Monday to Friday; a market without hours never closes.
SESSIONS = {"us": ("13:30", "21:00"), "uae": ("06:00", "11:00")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their part's brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    items = table(spark, sf_dir, "lineitem").select(*ORDER, "l_extendedprice", "l_quantity")
    return items.join(part, items["l_partkey"] == part["p_partkey"]).select(F.lit("brand").alias("market"), F.col("p_brand").alias("ticker"), F.col("p_type").alias("sector"), *ORDER, F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))


def bars_from_ticks(rows: DataFrame, unit: str = "week") -> DataFrame:
    """The first and last price of a bar follow the full order of trades, so they are determined."""
    order = F.struct(*ORDER)
    date = F.date_trunc(unit, F.col("l_shipdate")).cast("date")
    return rows.withColumn("date", date).groupBy(*KEYS).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume")
    )


def brand_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), unit)


def event_bars(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of event values by event type; here date holds the hour."""
    order = F.struct("ts", "event_id")
    return events.withColumn("date", F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")).groupBy(F.lit("event").alias("market"), F.col("event_type").alias("ticker"), "date").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def normalise(raw: DataFrame) -> DataFrame:
    """Raw rows (any case of Open, High, ...; text numbers; repeated dates) as clean bars: the last row of a date counts.

    `pos` orders repeated dates where it is there.
    """
    names = {c.lower(): c for c in raw.columns}
    number = lambda c: F.col(names[c]).try_cast("double") if c in names else F.lit(None).cast("double")
    usable = lambda x: F.when(~F.isnan(x), x)
    out = raw.select(
        F.col(names["market"]).alias("market") if "market" in names else F.lit("us").alias("market"), F.col(names["ticker"]).alias("ticker"), F.to_date(F.col(names["date"])).alias("date"),
        *(usable(number(c)).alias(c) for c in ("open", "high", "low", "close", "volume")), (F.col(names["pos"]) if "pos" in names else F.monotonically_increasing_id()).alias("pos"),
    )
    last = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.col("pos").desc()))
    out = out.withColumn("nth", last).where("nth = 1 and close is not null")
    return out.select(*KEYS, *(F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def from_wide(wide: DataFrame, fields: tuple[str, ...] = ("Open", "High", "Low", "Close", "Volume"), separator: str = "_") -> DataFrame:
    """One column for each field and ticker (Close_ABC) as long rows with a column for each field."""
    tickers = sorted({c.split(separator, 1)[1] for c in wide.columns if separator in c and c.split(separator, 1)[0] in fields})
    each = [F.struct(F.lit(t).alias("ticker"), *((F.col(f"{f}{separator}{t}") if f"{f}{separator}{t}" in wide.columns else F.lit(None)).cast("double").alias(f.lower()) for f in fields)) for t in tickers]
    return wide.select("date", F.inline(F.array(*each)))


def with_enough(bars: DataFrame, least: int = 120) -> DataFrame:
    """Instruments with at least so many bars."""
    n = bars.groupBy("market", "ticker").agg(F.count("*").alias("n_bars")).where(F.col("n_bars") >= least)
    return bars.join(n.select("market", "ticker"), ["market", "ticker"], "left_semi").select(*bars.columns)


def first_available(*candidates: DataFrame) -> DataFrame:
    """The first of several sources that holds any row."""
    for rows in candidates[:-1]:
        if not rows.isEmpty():
            return rows
    return candidates[-1]


def missing(universe: DataFrame, bars: DataFrame) -> DataFrame:
    return universe.join(bars.select("ticker").distinct(), "ticker", "left_anti")


def universe(listed: DataFrame) -> DataFrame:
    """Trimmed, without blanks, each ticker once at its first place."""
    clean = listed.withColumn("ticker", F.trim("ticker")).where("ticker <> ''")
    return clean.groupBy("ticker").agg(F.min("pos").alias("pos"))


def session_open(market: Column, now: datetime) -> Column:
    """Whether a market trades at `now` (UTC)."""
    day, time = now.weekday() < 5, now.strftime("%H:%M")
    out = F.lit(True)
    for name, (begin, end) in SESSIONS.items():
        out = F.when(market == name, F.lit(day and begin <= time < end)).otherwise(out)
    return out


def drop_partial(bars: DataFrame, now: datetime) -> DataFrame:
    """Without an instrument's last bar where that is of today (or later) and its market still trades."""
    last = F.max("date").over(W.partitionBy("market", "ticker"))
    partial = (F.col("date") == last) & (F.col("date") >= F.lit(now.date())) & session_open(F.col("market"), now)
    return bars.withColumn("partial", partial).where("not partial").drop("partial")


def equal_weight_index(bars: DataFrame, base: float = 100.0) -> DataFrame:
    """date, close: the mean return of all instruments on a date, chained. One row a date."""
    own = W.partitionBy("market", "ticker").orderBy("date")
    change = F.try_divide(F.col("close"), F.lag("close").over(own)) - 1
    daily = bars.withColumn("ret", change).groupBy("market", "date").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    chain = F.exp(F.sum(F.log1p("ret")).over(W.partitionBy("market").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    return daily.select("market", "date", (base * chain).alias("close"))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The last price of each ticker."""
    return quotes.groupBy("ticker").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts"))
