"""One engine over several markets: each is scored, planned and reported on its own."""

import datetime as d

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import config
from tideline.operators import plan
from tideline.plans.engine import Engine


@pytest.fixture(scope="module")
def scan(spark):
    rng = np.random.default_rng(5)
    rows = []
    for market, names, base in (("us", 8, 100.0), ("uae", 7, 4000.0), ("crypto", 3, 50.0)):
        for i in range(names):
            price = base * np.exp(np.cumsum(rng.normal(0.003, 0.02, 300)))
            for k in range(300 if i else 60):  # the first of each is too short
                rows.append((market, f"{market}{i}", d.date(2023, 1, 1) + d.timedelta(k), float(price[k] * 0.99), float(price[k] * 1.01), float(price[k] * 0.98), float(price[k]), 1e7))
    bars = spark.createDataFrame(rows, "market string, ticker string, date date, open double, high double, low double, close double, volume double")
    eng = Engine(spark)
    return eng, bars, eng.scan(bars)


def test_short_series_and_small_markets_are_left_out(scan):
    _, _, s = scan
    got = {(r["market"], r["n"]) for r in s.candidates.groupBy("market").agg(F.countDistinct("ticker").alias("n")).collect()}
    assert got == {("us", 7), ("uae", 6)}
    assert {r["market"] for r in s.regimes.select("market").distinct().collect()} == {"us", "uae"}


def test_ranks_are_within_a_market(scan):
    _, _, s = scan
    last = s.scored.where("date = '2023-10-27' and comp_rank is not null").groupBy("market").agg(F.max("comp_rank").alias("top"), F.count("*").alias("n")).collect()
    assert {r["market"]: (r["top"], r["n"]) for r in last} == {"us": (1.0, 7), "uae": (1.0, 6)}


def test_account_plan_totals(spark, scan):
    eng, _, s = scan
    ic = spark.createDataFrame([("us", 2.0), ("uae", 0.5)], "market string, ic_t double")
    out = eng.account_plan(s, ic, oil_bull=False)
    sleeves = {r["market"]: r for r in out["sleeves"].collect()}
    held = {m: sum(r["aed"] for r in out["positions"].collect() if r["market"] == m) for m in sleeves}
    assert {m: pytest.approx(v) for m, v in held.items()} == {m: r["new_aed"] for m, r in sleeves.items()}
    assert "weak signal history (IC t=0.5) ×0.60, oil downtrend ×0.85" in sleeves["uae"]["note"]
    cash = out["cash"].first()
    assert cash["cash_aed"] == pytest.approx(eng.cfg["capital_aed"] - sum(held.values())) and cash["much_cash"] == (cash["cash_aed"] > 0.4 * eng.cfg["capital_aed"])


def test_validate_by_market(spark, scan):
    eng, bars, _ = scan
    listed = spark.createDataFrame([("us", f"us{i}") for i in range(9)] + [("uae", "uae1")], "market string, ticker string")
    got = {r["market"]: (r["listed"], r["loaded"], r["missing"]) for r in eng.validate(listed, eng.loaded(bars)).collect()}
    assert got == {"us": (9, 7, 2), "uae": (1, 1, 0)}


def test_notes_only_where_something_trims(spark):
    states = spark.createDataFrame([("us", "RISK_ON", 2.0), ("uae", "RISK_OFF", None)], "market string, regime string, ic_t double")
    got = {r["market"]: r["note"] for r in plan.sleeve_notes(plan.market_sleeves(states, config.load())).collect()}
    assert got == {"us": None, "uae": "uae: budget trimmed — risk off regime ×0.35, weak signal history (IC t=0.0) ×0.40"}
