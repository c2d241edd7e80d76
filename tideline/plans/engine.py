"""The engine: from bars to candidates, plans, simulations and reports, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import backtest, crosssection, indicators, ml, plan, regime, rules
from ..sources import bars as source
from ..sources import files
from ..storage import stored


@dataclass
class Scan:
    scored: DataFrame
    regimes: DataFrame
    candidates: DataFrame
    returns: DataFrame


class Engine:
    """One set of settings over one session; every method is lazy unless its operator says otherwise."""

    def __init__(self, spark: SparkSession, overrides: dict | None = None, settings: str | None = None):
        """overrides go over the settings of a file (JSON or YAML), if one is named, and these over the defaults."""
        self.spark = spark
        self.cfg = config.load(overrides, None if settings is None else files.read_settings(spark, settings))

    def holdings(self, path: str) -> tuple[DataFrame, DataFrame]:
        """What is held, for account_plan(), and the rows of the file that cannot be used."""
        return files.read_holdings(self.spark, path)

    def loaded(self, bars: DataFrame) -> DataFrame:
        """Instruments with enough bars, of markets with enough instruments: what a scan works on."""
        enough = source.with_enough(bars, self.cfg["least_bars"])
        names = enough.select("market", "ticker").distinct().groupBy("market").agg(F.count("*").alias("n")).where(F.col("n") >= self.cfg["least_names"])
        return enough.join(names.select("market"), "market", "left_semi")

    def panel(self, bars: DataFrame, bench: DataFrame | None = None) -> DataFrame:
        return indicators.features(indicators.with_market(bars, self.cfg["markets"]), bench, self.cfg["horizon"])

    def regimes(self, bench: DataFrame, panel: DataFrame | None = None, vix: DataFrame | None = None, credit: DataFrame | None = None) -> DataFrame:
        bench = indicators.with_market(bench, self.cfg["markets"])
        return regime.compute(bench, None if panel is None else crosssection.breadth(panel), vix, credit)

    def scored(self, panel: DataFrame, regimes: DataFrame) -> DataFrame:
        return crosssection.score_panel(panel, regimes, self.cfg["weights"])

    def candidates(self, scored: DataFrame, regimes: DataFrame, snapshot: DataFrame | None = None, earnings: DataFrame | None = None, fear_greed: float | None = None, probabilities: DataFrame | None = None) -> DataFrame:
        """The latest cross-section with setup, conviction, plan, flags and reasons.

        snapshot: fundamentals, sentiment and sector by ticker; today's regime weighs all rows.
        """
        now = regimes.groupBy("market").agg(F.max_by("regime", "date").alias("now"))
        rows = crosssection.latest(scored).where("composite is not null").join(now, "market", "left").withColumn("regime", F.coalesce("now", F.lit("NEUTRAL"))).drop("now")
        if snapshot is not None:
            rows = rows.join(snapshot, "ticker", "left")
            if "returnOnEquity" in snapshot.columns:
                rows = crosssection.fundamental_factors(rows)
            rows = crosssection.enriched(rows)
        for c, kind in (("sector", "string"), ("next_date", "date"), ("ml_prob", "double")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        rows = rows.withColumn("composite_final", crosssection.composite(rows, self.cfg["weights"], F.col("regime")))
        if earnings is not None:
            rows = rows.drop("next_date").join(earnings, "ticker", "left")
        if probabilities is not None:
            rows = rows.drop("ml_prob").join(probabilities, ["market", "ticker"], "left")
        rows = rules.earnings(rows, F.col("date")).withColumn("setup", rules.setup_label())
        kind = plan.by_key(F.col("setup"), {k: v[0] for k, v in rules.SETUPS.items()}, "none")
        mult = rules.fear_greed_mult(F.lit(fear_greed).cast("double"), F.col("regime")) * F.col("earnings_mult") * F.when(kind == "momentum", 0.5).otherwise(1.0)
        rows = plan.planned(rows.withColumn("size_mult", mult), self.cfg).withColumn("eligible", plan.eligible(self.cfg))
        floor = plan.by_key(F.col("market"), {m: float(s["adv_floor"]) for m, s in self.cfg["markets"].items()}, 0.0)
        base = crosssection.blended(crosssection.conviction(F.col("composite_final")), F.col("ml_prob"), self.cfg["ml"]["blend"])
        liquid = F.coalesce(F.col("adv20") >= floor, F.lit(False))
        return rows.withColumns({"liquid": liquid, "conviction": crosssection.adjusted_conviction(base, plan.setup_allows(), F.col("earnings_flag"), liquid), "why": rules.explained(rows.columns)})

    def scan(self, bars: DataFrame, bench: DataFrame | None = None, **side) -> Scan:
        """All markets of the bars at once. Without a benchmark each market's equal-weight index stands in. What is read several times is stored."""
        bars = stored(self.loaded(bars), "bars")
        bench = stored(source.equal_weight_index(bars), "index") if bench is None else bench
        panel = stored(self.panel(bars, bench), "panel")
        regimes = stored(self.regimes(bench, panel, side.pop("vix", None), side.pop("credit", None)), "regimes")
        scored = stored(self.scored(panel, regimes), "scored")
        returns = stored(crosssection.last_returns(bars), "returns")
        rows = self.candidates(scored, regimes, **side)
        return Scan(scored, regimes, stored(plan.select_portfolio(rows, None, self.cfg, returns), "candidates"), returns)

    def backtest(self, scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        floors = {m: float(s["adv_floor"]) for m, s in self.cfg["markets"].items()}
        trades, equity = backtest.simulate(scored, self.cfg, floors)
        return trades, equity, backtest.metrics(trades, equity)

    def validate(self, universe: DataFrame, bars: DataFrame) -> DataFrame:
        """Coverage by market: listed, loaded, missing, latest bar."""
        have = bars.groupBy("market", "ticker").agg(F.max("date").alias("last"))
        return universe.join(have, ["market", "ticker"], "left").groupBy("market").agg(F.count("*").alias("listed"), F.count("last").alias("loaded"), F.sum(F.col("last").isNull().cast("int")).alias("missing"), F.max("last").alias("latest_bar"))

    def ml(self, scored: DataFrame) -> DataFrame:
        return ml.metrics(ml.walk_forward(scored, self.cfg))

    def size(self, market: str, entry: float, stop: float, risk_pct: float) -> DataFrame:
        row = self.spark.createDataFrame([(market, entry, stop, risk_pct)], "market string, entry double, stop double, risk_pct double")
        return plan.sized(row, self.cfg)

    def account_plan(self, scan: Scan, ic: DataFrame, holdings: DataFrame | None = None, live: DataFrame | None = None, **macro) -> dict[str, DataFrame]:
        """Sleeves with notes and what was bought in each, review of holdings, positions, their joint risk, cash. live: (market, ticker, live)."""
        c = scan.candidates.drop("live")
        c = c.withColumn("live", F.lit(None).cast("double")) if live is None else c.join(live, ["market", "ticker"], "left")
        states = c.groupBy("market").agg(F.first("regime").alias("regime")).join(ic.select("market", "ic_t"), "market", "left")
        sleeves = plan.market_sleeves(states, self.cfg, **macro)
        if holdings is None:
            holdings = self.spark.createDataFrame([], "market string, ticker string, units double, entry double, stop double")
        review = plan.holdings_review(holdings, c, self.cfg)
        budgets = plan.free_budget(sleeves, review)
        picks = plan.sleeve_picks(c.join(holdings.select("market", "ticker"), ["market", "ticker"], "left_anti").drop("selected", "skip_reason"), budgets, None, self.cfg, scan.returns)
        rows = stored(plan.account_limits(plan.positions(plan.capped(plan.sleeve_weights(plan.with_live(picks), self.cfg), self.cfg), self.cfg), self.cfg), "positions")
        kept = review.where(~F.col("action").isin("EXIT", "REVIEW")).agg(F.coalesce(F.sum("value_aed"), F.lit(0.0)).alias("held_aed"))
        cash = rows.agg(F.coalesce(F.sum("aed"), F.lit(0.0)).alias("new_aed")).join(F.broadcast(kept), F.lit(True)).withColumn("cash_aed", F.lit(float(self.cfg["capital_aed"])) - F.col("new_aed") - F.col("held_aed"))
        share = F.col("cash_aed") / float(self.cfg["capital_aed"])
        cash = cash.withColumns({"cash_pct": 100 * share, "much_cash": share > 0.4})
        return {"sleeves": plan.retotalled(plan.sleeve_notes(budgets), rows), "holdings": review, "positions": rows, "risk": plan.portfolio_risk(rows, scan.returns, self.cfg), "cash": cash}
