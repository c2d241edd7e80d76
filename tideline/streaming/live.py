"""A stream of quotes against the stored shortlist: keyed state holds each ticker's last quote, every update moves the levels of its candidate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.plan import with_live
from ..storage import shared_folder

KEYS = ["market", "ticker"]


def shortlist(candidates: DataFrame, most: int = 12) -> DataFrame:
    """Of each market the `most` eligible candidates of highest conviction, with their place; ties go by ticker."""
    order = W.partitionBy("market").orderBy(F.col("conviction").desc_nulls_last(), "ticker")
    return candidates.where("coalesce(eligible, false)").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def latest_quotes(quotes: DataFrame, late: str = "1 hour") -> DataFrame:
    """The last quote (market, ticker, price, ts, seq) of each ticker: over a stream the state is a row a ticker, whatever the number of quotes.

    Of equal times the higher seq counts. A null price is a quote too: it withdraws the one before.
    """
    last = F.max_by(F.struct("price", "ts"), F.struct("ts", "seq"))
    rows = quotes.withWatermark("ts", late) if quotes.isStreaming else quotes
    return rows.groupBy(*KEYS).agg(last.alias("q")).select(*KEYS, F.col("q.price").alias("live"), F.col("q.ts").alias("quoted"))


def moved(listed: DataFrame, quotes: DataFrame) -> DataFrame:
    """Candidates beside their quotes: levels of setups bought at market are moved, the distance to entry and stop is in percent of the quote."""
    both = with_live(listed.drop("live", "quoted").join(quotes, KEYS, "left"))
    good = (F.col("live") > 0) & (F.col("live") < float("inf"))
    away = lambda level: F.when(good, 100 * (F.col(level) / F.col("live") - 1))
    state = F.when(~F.coalesce(good, F.lit(False)), "no quote").when(F.col("live") <= F.col("stop"), "below stop").when(F.col("live") >= F.col("t1"), "beyond target").when(F.col("live") >= F.col("entry"), "at entry").otherwise("waiting")
    return both.withColumns({"to_entry_pct": away("entry"), "to_stop_pct": away("stop"), "state": state})


def follow(quotes: DataFrame, listed: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Start the stream: each micro-batch writes the changed candidates to folder/batch=<number>, so a batch that is run again replaces its own rows.

    listed is stored and small (so many candidates a market); only changed tickers meet it.
    """
    def put(changed: DataFrame, number: int) -> None:
        moved(listed.join(changed.select(*KEYS), KEYS, "left_semi"), changed).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = latest_quotes(quotes).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def final_state(listed: DataFrame, folder: str) -> DataFrame:
    """What the stream has made of every listed candidate: its row of the last batch that changed it, or the stored one, without a quote."""
    spark = listed.sparkSession
    changed = spark.read.parquet(folder)
    shown = [c for c in changed.columns if c != "batch"]
    last = changed.groupBy(*KEYS).agg(F.max_by(F.struct(*shown), "batch").alias("row")).select("row.*")
    never = moved(listed.join(last, KEYS, "left_anti"), last.select(*KEYS, "live", "quoted").limit(0))
    return last.unionByName(never)


def run(quotes: DataFrame, listed: DataFrame) -> DataFrame:
    """All quotes that are there now, followed to their end in the shared folder; the state they leave."""
    base = f"{shared_folder(listed.sparkSession)}/tideline-live-{uuid.uuid4().hex}"
    stream = follow(quotes, listed, f"{base}/rows", f"{base}/checkpoint")
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    return final_state(listed, f"{base}/rows")
