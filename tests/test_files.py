"""Files that users bring: what is good is read, what is not is told; settings and holdings go round."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import config
from tideline.operators import crosssection, macro, rules
from tideline.plans.engine import Engine
from tideline.sources import files


def _line(market, date, oi, long="1,000", short="500", code="001"):
    fields = [market, "240102", date, code, "x", "y", "z", oi, long, short, "1", "2", "3", "4", "5", "6", "7"]
    return ",".join(f'"{f}"' if "," in f else f for f in fields)


def test_positions_report(spark, tmp_path):
    path = tmp_path / "report.txt"
    lines = [_line("Market and Exchange", "As of", "Open Interest"), _line("GOLD - CME ", "2024-01-02", '10,000'), _line("GOLD - CME", "2024-01-09", "12,000", "9,000"), _line("GOLD - CME", "no date", "1"), _line("GOLD - CME", "2024-01-16", ""), "a,b,c", _line("OIL - ICE", "2024-01-02", "5,5") + ",more"]
    path.write_text("\n".join(lines))
    good, bad = files.good_and_bad(files.read_positions(spark, str(path)))
    assert bad.count() == 2 and {r["line"].split(",")[0] for r in bad.collect()} == {"a", "OIL - ICE"}
    rows = macro.parse_cot(good).orderBy("date").collect()
    assert [(r["market"], str(r["date"]), r["oi"], r["nc_long"]) for r in rows] == [("GOLD - CME", "2024-01-02", 10000.0, 1000.0), ("GOLD - CME", "2024-01-09", 12000.0, 9000.0)]
    found = macro.positioning(macro.parse_cot(good), spark.createDataFrame([("Gold", "gold")], "label string, prefix string")).first()
    assert found["read"] == "crowded long" and found["net_spec_pct_oi"] == pytest.approx(100 * 8500 / 12000)


def test_gauges(spark, tmp_path):
    for name, text in {"a": {"data": [{"value": "12", "value_classification": "Extreme Fear"}, {"value": "40", "value_classification": "Fear"}, {"value": "x"}]}, "b": {"fear_and_greed": {"score": 70.5, "rating": "greed", "previous_1_week": 61.0}}, "c": {"error": 1}, "d": {"data": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(text))
    (tmp_path / "e.json").write_text("no json")
    rows = {r["source"]: r for r in files.read_gauges(spark, str(tmp_path)).collect()}
    assert set(rows) == {"readings", "score"}
    assert (rows["readings"]["value"], rows["readings"]["label"], rows["readings"]["history"]) == (12, "Extreme Fear", [12, 40, None])
    assert (rows["score"]["value"], rows["score"]["label"], rows["score"]["week_ago"]) == (70, "Greed", 61.0)
    past = files.gauge_history(files.read_gauges(spark, str(tmp_path))).collect()
    assert [(r["back"], r["value"]) for r in past] == [(0, 12), (1, 40)]
    zones = spark.range(1).select(*(files.fear_greed_zone(F.lit(v), F.lit("calm")).alias(str(v)) for v in (90, 75, 10, 25, 50))).first()
    assert list(zones) == ["extreme greed", "greed", "extreme fear", "fear", "calm"]


def test_holdings(spark, tmp_path):
    path = tmp_path / "held.json"
    rows = [{"market": "us", "ticker": "A", "units": 2, "entry": 10.5, "stop": 9}, {"market": "us", "ticker": "B", "units": "3", "entry": "7"}, {"market": "us", "units": 1, "entry": 1}, {"market": "us", "ticker": "", "units": 1, "entry": 1}, {"market": "us", "ticker": "C", "units": "many", "entry": 1}, {"market": "us", "ticker": "D", "units": 1, "entry": 1, "colour": "red"}, "text"]
    path.write_text(json.dumps({"holdings": rows}))
    good, bad = Engine(spark).holdings(str(path))
    assert [tuple(r) for r in good.orderBy("ticker").collect()] == [("us", "A", 2.0, 10.5, 9.0), ("us", "B", 3.0, 7.0, None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["missing: ticker", "missing: ticker", "not a mapping", "not a number", "unknown: colour"]
    path.write_text(json.dumps([r.asDict() for r in good.collect()]))
    again, none = files.read_holdings(spark, str(path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, good.collect())) and none.count() == 0
    path.write_text("{}")
    assert [x.count() for x in files.read_holdings(spark, str(path))] == [0, 0]


def test_settings(spark, tmp_path):
    path = tmp_path / "settings.json"
    own = {"capital_aed": 5000.0, "risk": {"sector_cap": 3}, "markets": {"mine": {"currency": "AED", "base": 0.1}}, "weights": {"CALM": [1, 0, 0, 0, 0, 0, 0]}}
    path.write_text(json.dumps(own))
    eng = Engine(spark, settings=str(path))
    assert eng.cfg == config.load(own) and eng.cfg["risk"]["heat_pct"] == config.DEFAULTS["risk"]["heat_pct"]
    assert Engine(spark, {"capital_aed": 1.0}, str(path)).cfg["capital_aed"] == 1.0
    path.write_text(json.dumps(eng.cfg))
    assert files.read_settings(spark, str(path)) == eng.cfg
    for wrong, said in (({"risk": {"sector_caps": 3}}, "risk.sector_caps"), ({"risk": 3}, "risk"), ({"markets": {"x": {"colour": 1}}}, "markets.x.colour"), ([1], "mapping")):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError, match=said):
            files.read_settings(spark, str(path))


def test_coins_with_gaps(spark):
    payloads = spark.createDataFrame([("bitcoin", '{"sentiment_votes_up_percentage": 95.0, "community_data": {"reddit_average_posts_48h": 60}}'), ("ether", '{"community_data": null}'), ("bad", "no json")], "id string, payload string")
    ids = spark.createDataFrame([("BTC", "bitcoin"), ("ETH", "ether"), ("ADA", "cardano"), ("BAD", "bad")], "symbol string, id string")
    tickers = spark.createDataFrame([("btc/USDT",), ("ETH/USDT",), ("ADA/USDT",), ("BAD",), ("XXX",)], "ticker string")
    trend = files.trending_symbols(spark.createDataFrame([('{"coins": [{"item": {"symbol": "btc"}}, {"item": {"symbol": "BTC"}}, {}]}',), ("{}",), (None,)], "payload string"))
    funding = spark.createDataFrame([("ETH/USDT", 0.01)], "ticker string, rate double")
    found = rules.social(files.coin_sentiment(tickers, ids, files.coin_votes(payloads), trend, funding), "crypto").withColumn("flags", rules.social_flags())
    got = {r["ticker"]: r for r in found.collect()}
    assert set(got) == {"btc/USDT", "ETH/USDT", "BAD"}
    assert got["btc/USDT"]["social_buzz"] == pytest.approx(np.log1p(60) + 1) and len(got["btc/USDT"]["flags"]) == 2
    assert (got["ETH/USDT"]["social_buzz"], got["ETH/USDT"]["social_bull"], got["ETH/USDT"]["funding_contrarian"], got["ETH/USDT"]["flags"]) == (0.0, None, -0.01, [])


def test_gram_blocks_equal_all_pairs(spark):
    """Gaps, nulls, constants and several blocks, against numpy pair by pair."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        for k in range(60):
            if (i * 7 + k) % 11 and (i != 3 or k < 4) and (i != 4 or k >= 50):
                rows.append(("m", f"t{i:02d}", k, None if (i + k) % 13 == 0 else 0.01 if i == 5 else float(rng.normal(0.001, 0.02))))
    got = {(r["a"], r["b"]): (r["corr"], r["n"]) for r in crosssection.correlations(spark.createDataFrame(rows, "market string, ticker string, date int, ret double").repartition(5), block=8).collect()}
    series = {}
    for _, t, k, v in rows:
        series.setdefault(t, {})[k] = v
    want = {}
    names = sorted(series)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if not (shared := series[a].keys() & series[b].keys()):
                continue
            xy = np.array([(series[a][k], series[b][k]) for k in sorted(shared) if series[a][k] is not None and series[b][k] is not None], float).reshape(-1, 2)
            c = None if len(xy) < 2 or np.ptp(xy[:, 0]) == 0 or np.ptp(xy[:, 1]) == 0 else np.corrcoef(xy.T)[0, 1]
            want[a, b] = (c, len(xy))
    assert got.keys() == want.keys()
    for pair, (c, n) in want.items():
        assert got[pair][1] == n and ((c is None and got[pair][0] is None) or got[pair][0] == pytest.approx(c, abs=1e-9)), pair
