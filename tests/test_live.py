"""The live shortlist: a stream in several batches leaves what all quotes together would."""

import datetime as d

import pytest
from pyspark.sql import functions as F

from tideline.streaming import live

T0 = d.datetime(2024, 1, 2, 9, 0)
QUOTES = "market string, ticker string, price double, ts timestamp, seq long"


@pytest.fixture(scope="module")
def listed(spark):
    rows = [("us", f"T{i:02d}", 90.0 - i // 2, i != 3, ["breakout", "pullback", "momentum"][i % 3], 100.0, 90.0, 115.0, 130.0) for i in range(20)] + [("uae", "A", 10.0, True, "bounce", 10.0, 9.0, 11.5, 13.0), ("uae", "B", None, True, "bounce", 10.0, 9.0, 11.5, 13.0)]
    return live.shortlist(spark.createDataFrame(rows, "market string, ticker string, conviction double, eligible boolean, kind string, entry double, stop double, t1 double, t2 double"))


def test_twelve_eligible_by_conviction(listed):
    got = [(r["market"], r["ticker"], r["place"]) for r in listed.orderBy("market", "place").collect()]
    assert got == [("uae", "A", 1), ("uae", "B", 2)] + [("us", f"T{i:02d}", n + 1) for n, i in enumerate(i for i in range(13) if i != 3)]


def quotes():
    out = []
    for k in range(90):
        out.append(("us", f"T{k % 7:02d}", 95.0 + k % 23, T0 + d.timedelta(minutes=k), k))
    out += [("us", "T00", 200.0, T0 + d.timedelta(minutes=84), 1000), ("us", "T01", 0.0, T0 + d.timedelta(hours=5), 1), ("us", "T02", float("nan"), T0 + d.timedelta(hours=5), 2), ("us", "T04", None, T0 + d.timedelta(hours=5), 3), ("us", "none", 5.0, T0, 4), ("uae", "A", float("inf"), T0, 5)]
    return out


def test_stream_leaves_the_state_of_all_quotes(spark, listed, tmp_path):
    folder = str(tmp_path / "quotes")
    all_ = quotes()
    for i in range(0, len(all_), 30):  # one file a batch
        spark.createDataFrame(all_[i : i + 30], QUOTES).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r["market"], r["ticker"]): r for r in live.run(stream, listed).collect()}
    last = {}
    for m, t, p, ts, seq in all_:
        if (m, t) not in last or (ts, seq) > last[m, t][:2]:
            last[m, t] = (ts, seq, p)
    assert len(got) == listed.count()
    for r in listed.collect():
        now, quote = got[r["market"], r["ticker"]], last.get((r["market"], r["ticker"]), (None, None, None))[2]
        good = quote is not None and 0 < quote < float("inf")
        shift = quote - r["entry"] if good and r["kind"] != "pullback" else 0.0
        assert [now[c] for c in ("entry", "stop", "t1", "t2")] == [r[c] + shift for c in ("entry", "stop", "t1", "t2")]
        assert (now["state"] == "no quote") == (not good) and (now["to_entry_pct"] is None) == (not good)
    assert ("us", "none") not in got


def test_a_batch_that_runs_again_replaces_its_rows(spark, listed, tmp_path):
    folder = str(tmp_path / "q")
    spark.createDataFrame(quotes()[:10], QUOTES).write.parquet(folder)
    source = spark.readStream.schema(QUOTES).parquet(folder)
    for _ in range(2):  # the second start finds the checkpoint and nothing new
        live.follow(source, listed, str(tmp_path / "rows"), str(tmp_path / "ck")).awaitTermination()
    again = live.final_state(listed, str(tmp_path / "rows"))
    assert again.count() == listed.count() and again.where(F.col("live").isNotNull()).count() == 6
