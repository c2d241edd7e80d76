"""Files that users or services bring: positioning reports, gauges, holdings, settings, coin payloads. What cannot be used is told, not lost."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import checked

HOLDING = {"market": "string", "ticker": "string", "units": "double", "entry": "double", "stop": "double"}
BAD = "_bad"


def read_positions(spark: SparkSession, path: str, columns: int = 17) -> DataFrame:
    """A report without a header as text columns c0, c1, ... and _bad, the whole line where its number of fields is not `columns`.

    Numbers may stand in quotes and hold commas. A header line, if a file has one, is no row.
    """
    schema = ", ".join(f"c{i} string" for i in range(columns)) + f", {BAD} string"
    rows = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("quote", '"').csv(path)
    return rows.where(~F.coalesce(F.startswith(F.lower(F.trim("c0")), F.lit("market")), F.lit(False)))


def good_and_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that parse, and the lines that don't; the latter are read from a stored copy, as Spark asks for corrupt records."""
    from ..storage import stored

    kept = stored(rows, "positions")
    return kept.where(F.col(BAD).isNull()).drop(BAD), kept.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def parse_gauges(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep, source, value, label, history, week_ago) of each JSON gauge (column value): a list of readings, newest first, or one score with its rating. Others give no row."""
    listed = F.from_json("value", "struct<data:array<struct<value:string,value_classification:string>>>")
    scored = F.from_json("value", "struct<fear_and_greed:struct<score:double,rating:string,previous_1_week:double>>")
    rows = texts.select(*keep, listed["data"].alias("data"), scored["fear_and_greed"].alias("one"))
    history = F.transform("data", lambda d: d["value"].try_cast("int"))
    out = rows.select(
        *keep, F.when(F.get("data", F.lit(0)).isNotNull(), "readings").when(F.col("one.score").isNotNull(), "score").alias("source"),
        F.coalesce(F.get(history, F.lit(0)), F.bround("one.score").cast("int")).alias("value"), F.coalesce(F.get("data", F.lit(0))["value_classification"], F.initcap("one.rating")).alias("label"), history.alias("history"), F.col("one.previous_1_week").alias("week_ago"),
    )
    return out.where("source is not null and value is not null")


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """The gauges of a folder of JSON files."""
    return parse_gauges(_texts(spark, path))


def gauge_history(gauges: DataFrame) -> DataFrame:
    """(source, back, value): the readings of a gauge, 0 being the newest."""
    return gauges.select("source", F.posexplode("history").alias("back", "value")).where("value is not null")


def fear_greed_zone(value: Column, label: Column) -> Column:
    """What a gauge says: an extreme, a side, or the gauge's own label."""
    return F.when(value >= 85, "extreme greed").when(value >= 70, "greed").when(value <= 15, "extreme fear").when(value <= 30, "fear").otherwise(F.coalesce(label, F.lit("neutral")))


def _data(text: str):
    """JSON, or YAML where its package is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def read_settings(spark: SparkSession, path: str) -> dict:
    """The defaults under the settings of a file; a key that no default knows is an error that names it."""
    text = _texts(spark, path).first()
    return checked(_data(text[0]) if text else {})


def read_holdings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(holdings, rejected): a list, or {"holdings": [...]}, of market, ticker, units, entry and, if any, stop.

    Rejected are rows with keys of other names, without a ticker or market, or whose numbers are none, each with its reason.
    A holdings file is a person's positions; it is parsed where it is read.
    """
    text = _texts(spark, path).first()
    data = (_data(text[0]) if text else None) or []
    rows = data.get("holdings") or [] if isinstance(data, dict) else data
    good, bad = [], []
    for row in rows:
        own, why = row if isinstance(row, dict) else {}, None
        if not isinstance(row, dict):
            why = "not a mapping"
        elif unknown := sorted(map(str, set(own) - set(HOLDING))):
            why = f"unknown: {', '.join(unknown)}"
        elif missing := [k for k in ("market", "ticker", "units", "entry") if own.get(k) in (None, "")]:
            why = f"missing: {', '.join(missing)}"
        else:
            try:
                good.append(tuple(None if own.get(k) is None else str(own[k]) if t == "string" else float(own[k]) for k, t in HOLDING.items()))
            except (TypeError, ValueError):
                why = "not a number"
        if why:
            bad.append((json.dumps(row, default=str), why))
    return spark.createDataFrame(good, ", ".join(f"{k} {t}" for k, t in HOLDING.items())), spark.createDataFrame(bad, "row string, reason string")


def coin_votes(payloads: DataFrame) -> DataFrame:
    """(id, up_pct, reddit_posts, watchers) of the JSON of each coin; what a payload lacks is null."""
    p = F.col("payload")
    number = lambda path: F.get_json_object(p, path).try_cast("double")
    return payloads.select("id", number("$.sentiment_votes_up_percentage").alias("up_pct"), number("$.community_data.reddit_average_posts_48h").alias("reddit_posts"), F.get_json_object(p, "$.watchlist_portfolio_users").try_cast("long").alias("watchers"))


def trending_symbols(payloads: DataFrame) -> DataFrame:
    """(symbol) of the coins of a list of what trends, upper case, each once."""
    coins = F.from_json("payload", "struct<coins:array<struct<item:struct<symbol:string>>>>")["coins"]
    return payloads.select(F.explode(coins).alias("c")).select(F.upper("c.item.symbol").alias("symbol")).where("symbol is not null").distinct()


def coin_sentiment(tickers: DataFrame, ids: DataFrame, votes: DataFrame, trending: DataFrame, funding: DataFrame) -> DataFrame:
    """(ticker, symbol, up_pct, reddit_posts, watchers, trending, funding_contrarian): every ticker whose coin has a payload; a pair's first part is its symbol.

    Without a list of what trends nothing does; without a rate the contrarian factor is null.
    """
    symbol = F.upper(F.element_at(F.split("ticker", "/"), 1))
    rows = tickers.withColumn("symbol", symbol).join(ids, "symbol").join(votes, "id")
    rows = rows.join(trending.select("symbol", F.lit(True).alias("hot")), "symbol", "left").join(funding.select("ticker", (-F.col("rate")).alias("funding_contrarian")), "ticker", "left")
    return rows.select("ticker", "symbol", "up_pct", "reddit_posts", "watchers", F.coalesce("hot", F.lit(False)).alias("trending"), "funding_contrarian")
