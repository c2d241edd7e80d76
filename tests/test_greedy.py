"""Greedy selection in rounds against a plain loop, over thousands of candidates."""

import datetime as d
import random

import numpy as np
import pytest

from tideline import config
from tideline.operators import crosssection, plan

FIELDS = "market string, regime string, ticker string, conviction double, eligible boolean, veto boolean, earnings_flag string, units double, risk_aed double, pos_aed double, sector string"


def loop(rows, corr, cfg):
    """One candidate after the other, as the rule says."""
    rk, capital, out = cfg["risk"], cfg["capital_aed"], {}
    for market in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == market), key=lambda r: (-(r[3] if r[3] is not None else -1e9), r[2]))
        most, taken, heat, expo, sectors = rk["max_positions"][own[0][1]], [], 0.0, 0.0, {}
        for _, regime, t, _, ok, veto, flag, units, risk, pos, sector in own:
            near = [(o, corr[market, t, o]) for o in taken if corr.get((market, t, o), 0) > rk["corr"]]
            if len(taken) >= most:
                why = f"max {most} positions in {regime}"
            elif not ok:
                why = "not actionable today"
            elif veto:
                why = flag or "vetoed"
            elif not (units or 0) > 0:
                why = "position too small for minimum lot"
            elif near:
                why = f"correlated with {near[0][0]} ({near[0][1]:.2f})"
            elif sector and sectors.get(sector, 0) >= rk["sector_cap"]:
                why = f"sector cap ({sector})"
            elif heat + (risk or 0) > capital * rk["heat_pct"] / 100 + 1e-9:
                why = "portfolio heat cap"
            elif expo + (pos or 0) > capital * rk["exposure_pct"] / 100 + 1e-9:
                why = "capital fully deployed"
            else:
                why = ""
                taken.append(t)
                heat, expo = heat + (risk or 0), expo + (pos or 0)
                if sector:
                    sectors[sector] = sectors.get(sector, 0) + 1
            out[market, t] = why
    return out


def drawn(n: int, seed: int):
    rng = random.Random(seed)
    rows, corr = [], {}
    for i in range(n):
        market = ["us", "uae", "crypto"][min(2, i * 5 // n // 2)]
        rows.append((market, {"us": "RISK_ON", "uae": "NEUTRAL", "crypto": "RISK_OFF"}[market], f"t{i:05d}", None if i % 50 == 49 else float(rng.randint(0, 99)), rng.random() < 0.7, rng.random() < 0.1, rng.choice(["", "Earnings in 3d", None]), rng.choice([None, 0.0, 1.0, 2.0]), float(rng.randint(50, 300)), float(rng.randint(500, 6000)), rng.choice(["x", "y", "z", "", None])))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[2])
    for market, names in by.items():
        for _ in range(20 * len(names)):
            a, b = sorted(rng.sample(names, 2))
            corr[market, a, b] = corr[market, b, a] = round(rng.uniform(0.5, 0.99), 2)
    return rows, corr


@pytest.mark.parametrize("n, seed", [(10_000, 1), (60, 2)])
def test_equals_a_plain_loop(spark, n, seed):
    cfg = config.load({"capital_aed": 20000.0, "risk": {"heat_pct": 6.0, "exposure_pct": 90.0}})
    rows, corr = drawn(n, seed)
    pairs = spark.createDataFrame([(m, a, b, c) for (m, a, b), c in corr.items() if a < b], "market string, a string, b string, corr double")
    got = plan.select_portfolio(spark.createDataFrame(rows, FIELDS).repartition(7), pairs, cfg).toPandas()
    assert len(got) == n and (got["selected"] == (got["skip_reason"] == "")).all()
    assert {(r.market, r.ticker): r.skip_reason for r in got.itertuples()} == loop(rows, corr, cfg)
    assert got["selected"].sum() >= 4


def test_correlations_only_with_names_taken(spark):
    """From returns the outcome is that of the table of all pairs."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 60))
    rows, rets = [], []
    for i in range(24):
        rows.append(("us", "RISK_ON", f"n{i:02d}", float(90 - i), True, False, "", 1.0, 10.0, 100.0, None))
        x = base[i % 4] + rng.normal(size=60) * (0.2 if i % 3 else 3.0)
        rets += [("us", f"n{i:02d}", d.date(2024, 1, 1) + d.timedelta(k), float(v)) for k, v in enumerate(x) if (i + k) % 17]
    returns = spark.createDataFrame(rets, "market string, ticker string, date date, ret double")
    c, cfg = spark.createDataFrame(rows, FIELDS), config.load()
    a, b = (plan.select_portfolio(c, corr, cfg, more).orderBy("ticker").collect() for corr, more in ((crosssection.correlations(returns), None), (None, returns)))
    assert a == b and any("correlated" in r["skip_reason"] for r in a)


def test_no_candidates_and_no_places(spark):
    empty = spark.createDataFrame([], FIELDS)
    corr = spark.createDataFrame([], "market string, a string, b string, corr double")
    assert plan.select_portfolio(empty, corr, config.load()).count() == 0
    crisis = spark.createDataFrame([("us", "CRISIS", "A", 90.0, True, False, "", 1.0, 1.0, 1.0, "x")], FIELDS)
    assert plan.select_portfolio(crisis, corr, config.load()).first()["skip_reason"] == "max 0 positions in CRISIS"


@pytest.mark.parametrize("name", ["trade_plan", "plan_flags", "eligibility", "account_limits"])
def test_plans_compile(spark, name):
    """Without Spark's fall-back to interpretation a plan whose code grows beyond what the JVM takes is an error."""
    from tideline.plans import catalogue

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")
