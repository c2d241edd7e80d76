"""Trade plans, sizes and the account's allocation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import unit_aed
from ..functions.kernels import ratio
from ..storage import stored
from .crosssection import correlations_with
from .rules import SETUPS

# How a setup is bought.
ORDERS = {
    "breakout": "Buy at market on the open", "squeeze": "Buy-stop {entry} (triggers only if price breaks out)", "pullback": "Limit buy {entry} (or market if it reclaims the 21-EMA)",
    "bounce": "Buy at market; 5–7 day hold", "momentum": "Buy at market, half size; add after a 2–3 day pause",
}


def by_key(key: Column, values: dict, default) -> Column:
    """The value of a key in a small table, else the default."""
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def units_of(x: Column, market: Column, cfg: dict) -> Column:
    """Whole units where a market has no fractions, else to 4 or (crypto) 6 places, always down."""
    whole = (market == "uae") | ((market == "us") & F.lit(not cfg["risk"]["fractional_us"]))
    return F.when(whole, F.floor(x).cast("double")).when(market == "crypto", F.floor(x * 1e6) / 1e6).otherwise(F.floor(x * 1e4) / 1e4)


def unit_value(market: Column, cfg: dict) -> Column:
    return by_key(market, {m: unit_aed(cfg, m) for m in cfg["markets"]}, cfg["usd_aed"])


def bound(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with the values as columns that are worked out once: a generator of one row stands between them and what reads them, so no expression is written out again in each that uses it."""
    kept = [c for c in rows.columns if c not in values]
    return rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))


def planned(rows: DataFrame, cfg: dict) -> DataFrame:
    """Entry, stop, targets, size, cost and flags of candidates (setup, regime, size_mult); all null where there is no valid plan."""
    rk, capital = cfg["risk"], float(cfg["capital_aed"])
    c, atr = F.col("close"), F.col("atr")
    kind, market = by_key(F.col("setup"), {k: v[0] for k, v in SETUPS.items()}, "none"), F.col("market")
    entry = F.when((kind == "squeeze") & F.col("donch20_hi").isNotNull(), F.greatest(c, F.col("donch20_hi") + 0.1 * atr)).when((kind == "pullback") & F.col("ema21").isNotNull(), F.least(c, F.greatest(F.col("ema21"), c - 0.5 * atr))).otherwise(c)
    out = bound(rows, setup=F.col("setup"), atr=atr, size_mult=F.col("size_mult"), ema21=F.col("ema21"), donch20_hi=F.col("donch20_hi"))
    out = bound(out, kind=kind, hold_days=by_key(F.col("setup"), {k: v[1] for k, v in SETUPS.items()}, 0), unit=unit_value(market, cfg), entry=F.when((c > 0) & (atr > 0), entry))
    low = F.least(F.col("entry") - rk["stop_atr"] * atr, F.col("swing_low10") - 0.25 * atr)  # least() skips a null swing low
    out = bound(out, stop=F.when(F.col("entry").isNotNull(), F.greatest(low, F.col("entry") - rk["max_stop_atr"] * atr)))
    out = out.withColumn("r", F.when(F.col("entry") - F.col("stop") > 0, F.col("entry") - F.col("stop")))
    out = out.withColumn("risk_pct", by_key(F.col("regime"), rk["per_trade_pct"], 0.0) * F.col("size_mult"))
    raw = ratio(capital * F.col("risk_pct") / 100 / F.col("unit"), F.col("r"))
    cap = capital * rk["max_position_pct"] / 100
    out = bound(out, r=F.col("r"), risk_pct=F.col("risk_pct"), raw_units=raw)
    out = out.withColumn("capped", F.col("raw_units") * F.col("entry") * F.col("unit") > cap)
    out = bound(out, capped=F.col("capped"), units=units_of(F.when(F.col("capped"), cap / (F.col("entry") * F.col("unit"))).otherwise(F.col("raw_units")), market, cfg))
    ok = F.col("r").isNotNull()
    out = out.withColumns({
        "pos_native": F.col("units") * F.col("entry"), "pos_aed": F.col("units") * F.col("entry") * F.col("unit"), "risk_aed": F.col("units") * F.col("r") * F.col("unit"),
        "stop_pct": 100 * ratio(F.col("r"), F.col("entry")), "t1": F.col("entry") + rk["target1_r"] * F.col("r"), "t2": F.col("entry") + rk["target2_r"] * F.col("r"),
    })
    out = out.withColumn("cost_aed", F.col("pos_aed") * 2 * (rk["commission_pct"] + rk["slippage_pct"]) / 100)
    flags = F.array(
        F.when(F.col("capped"), f"size capped at {rk['max_position_pct']:g}% of capital"), F.when(F.col("units") <= 0, "too small: 1-share minimum exceeds risk budget"),
        F.when(ratio(F.col("cost_aed"), F.col("risk_aed")) > 0.15, "costs > 15% of risk budget"),
        F.when((F.col("donch55_hi") > F.col("entry")) & (F.col("donch55_hi") < F.col("t1")), "55-day high sits before T1 (resistance)"),
    )
    out = out.withColumn("plan_flags", F.when(ok, F.array_compact(flags)))
    plan = ["entry", "stop", "units", "pos_native", "pos_aed", "risk_aed", "stop_pct", "t1", "t2", "cost_aed"]
    return out.withColumns({p: F.when(ok, F.col(p)) for p in plan}).drop("raw_units", "capped")


def setup_allows() -> Column:
    """Whether the setup itself may be traded, whatever the instrument."""
    return by_key(F.col("setup"), {k: v[2] for k, v in SETUPS.items()}, False)


def eligible(cfg: dict) -> Column:
    """Setup may be traded, the instrument is liquid and dear enough, and there is a plan."""
    floor = by_key(F.col("market"), {m: float(s["adv_floor"]) for m, s in cfg["markets"].items()}, 0.0)
    price = by_key(F.col("market"), {m: float(s["min_price"]) for m, s in cfg["markets"].items()}, 0.0)
    return F.coalesce(setup_allows() & (F.col("adv20") >= floor) & (F.col("close") >= price) & F.col("r").isNotNull(), F.lit(False))


def kelly(win_rate: Column, avg_win: Column, avg_loss: Column) -> Column:
    """Full Kelly share; null unless some trades win, some lose, wins are gains and losses are losses."""
    b = ratio(avg_win, F.abs(avg_loss))
    return F.when((win_rate > 0) & (win_rate < 1) & (avg_win > 0) & (avg_loss < 0), F.greatest(F.lit(0.0), win_rate - (1 - win_rate) / b))


def sized(rows: DataFrame, cfg: dict) -> DataFrame:
    """Units for a given entry and stop at a given risk percent, capped by the largest position."""
    capital, cap = float(cfg["capital_aed"]), cfg["capital_aed"] * cfg["risk"]["max_position_pct"] / 100
    unit = unit_value(F.col("market"), cfg)
    raw = F.least(ratio(capital * F.col("risk_pct") / 100 / unit, F.col("entry") - F.col("stop")), cap / (F.col("entry") * unit))
    return rows.withColumn("units", F.when(F.col("market") == "uae", F.floor(raw).cast("double")).otherwise(raw))


# Why a candidate is not taken.
SKIPS = {
    "count": "max {n} positions in {regime}", "setup": "not actionable today", "veto": "vetoed", "lot": "position too small for minimum lot",
    "corr": "correlated with {other} (%.2f)", "sector": "sector cap ({sector})", "heat": "portfolio heat cap", "exposure": "capital fully deployed",
}
TAKEN = "array<struct<key:double,ticker:string,sector:string,risk_aed:double,pos_aed:double>>"


def _before(x: Column, r: Column) -> Column:
    """Does a stand before b in the order of choice: higher conviction, then ticker?"""
    return (x["key"] < r["key"]) | ((x["key"] == r["key"]) & (x["ticker"] < r["ticker"]))


def _room(taken: Column, sector: Column, risk: Column, pos: Column, cfg: dict) -> dict[str, Column]:
    """Whether sector, heat and exposure still allow a name beside those taken."""
    rk, capital = cfg["risk"], float(cfg["capital_aed"])
    total = lambda name: F.aggregate(taken, F.lit(0.0), lambda a, t: a + t[name])
    same = F.size(F.filter(taken, lambda t: F.coalesce(t["sector"] == sector, F.lit(False))))
    return {
        "sector": sector.isNull() | (same < rk["sector_cap"]), "heat": total("risk_aed") + risk <= capital * rk["heat_pct"] / 100 + 1e-9,
        "exposure": total("pos_aed") + pos <= capital * rk["exposure_pct"] / 100 + 1e-9,
    }


Near = Callable[[DataFrame], DataFrame]


def near_by(correlations: DataFrame | None, returns: DataFrame | None, most: float) -> Near:
    """Of names (market, other), the pairs (market, ticker, other, corr) above a correlation: looked up in a table of pairs, or worked out for these names alone from returns."""
    if correlations is None:
        return lambda names: correlations_with(returns, names).where(F.col("corr") > most)
    pairs = correlations.where(F.col("corr") > most)
    both = stored(pairs.select("market", F.col("a").alias("ticker"), F.col("b").alias("other"), "corr").unionByName(pairs.select("market", F.col("b").alias("ticker"), F.col("a").alias("other"), "corr")), "conflicts")
    return lambda names: both.join(names, ["market", "other"])


def chosen_names(candidates: DataFrame, near: Near, cfg: dict, places: Column, most: int) -> DataFrame:
    """(market, taken, places): the names that a greedy pass by conviction takes, in order, at most `places` (never beyond `most`).

    What a pass does between two choices changes nothing, so a round finds each
    market's next choice at once: of all candidates behind the last one, the first
    that every limit allows, a minimum over partial aggregates. There are as many
    rounds as places; a market's names never meet in one task, but for those taken.
    """
    usable = candidates.where("coalesce(eligible, false) and not coalesce(veto, false) and coalesce(units, 0D) > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    item = F.struct("key", "ticker", F.when(F.col("sector") != "", F.col("sector")).alias("sector"), zero("risk_aed"), zero("pos_aed"))
    rows = stored(usable.withColumn("key", -F.coalesce("conviction", F.lit(-1e9))).select("market", "ticker", item.alias("r")), "usable")
    state = stored(candidates.groupBy("market").agg(F.first("regime", ignorenulls=True).alias("regime")).select("market", "regime", places.alias("places"), F.expr(f"cast(array() as {TAKEN})").alias("taken")), "taken")
    for _ in range(most):
        last = F.get("taken", F.size("taken") - 1)
        open_ = rows.join(state.where(F.size("taken") < F.col("places")), "market")
        open_ = open_.where(last.isNull() | _before(last, F.col("r")))
        names = state.select("market", F.explode("taken").alias("t")).select("market", F.col("t.ticker").alias("other"))
        allowed = _room(F.col("taken"), F.col("r.sector"), F.col("r.risk_aed"), F.col("r.pos_aed"), cfg)
        open_ = open_.join(near(names).select("market", "ticker"), ["market", "ticker"], "left_anti").where(allowed["sector"] & allowed["heat"] & allowed["exposure"])
        found = open_.groupBy("market").agg(F.min_by("r", F.struct("r.key", "r.ticker")).alias("next"))
        state = stored(state.join(found, "market", "left").select("market", "regime", "places", F.when(F.col("next").isNull(), F.col("taken")).otherwise(F.array_append("taken", F.col("next"))).alias("taken")), "taken")
    return state


def select_portfolio(candidates: DataFrame, correlations: DataFrame | None, cfg: dict, returns: DataFrame | None = None) -> DataFrame:
    """Greedy choice by conviction within each market: selected and skip_reason.

    The names taken are found first (see chosen_names; as many rounds as the largest
    number of positions); every other candidate's reason follows from those before it.
    Without a table of correlations, those with the names taken come from returns.
    """
    candidates = stored(candidates, "candidates")  # read by each step below
    limits = cfg["risk"]["max_positions"]
    near = near_by(correlations, returns, cfg["risk"]["corr"])
    state = chosen_names(candidates, near, cfg, by_key(F.col("regime"), limits, 0), max(limits.values(), default=0))
    key = -F.coalesce("conviction", F.lit(-1e9))
    order = state.select("market", F.posexplode("taken").alias("nth", "t")).select("market", "nth", F.col("t.key").alias("key_other"), F.col("t.ticker").alias("other"))
    first = near(order.select("market", "other")).join(order, ["market", "other"]).join(candidates.select("market", "ticker", key.alias("key")), ["market", "ticker"])
    first = first.where((F.col("key_other") < F.col("key")) | ((F.col("key_other") == F.col("key")) & (F.col("other") < F.col("ticker"))))
    hit = first.groupBy("market", "ticker").agg(F.min(F.struct("nth", "other", "corr")).alias("hit"))
    own = F.struct(key.alias("key"), F.col("ticker").alias("ticker"))
    rows = candidates.join(hit, ["market", "ticker"], "left").join(state.select("market", F.col("regime").alias("regime_now"), "places", "taken"), "market")
    rows = rows.withColumn("ahead", F.filter("taken", lambda t: _before(t, own)))
    sector, zero = F.when(F.col("sector") != "", F.col("sector")), lambda c: F.coalesce(F.col(c), F.lit(0.0))
    allowed = _room(F.col("ahead"), sector, zero("risk_aed"), zero("pos_aed"), cfg)
    text = lambda kind, **put: F.concat(*(put.get(x, F.lit(x)) for x in re.split("[{}]", SKIPS[kind])))
    reason = (
        F.when(F.size("ahead") >= F.col("places"), text("count", n=F.col("places").cast("string"), regime=F.coalesce("regime_now", F.lit(""))))
        .when(~F.coalesce("eligible", F.lit(False)), SKIPS["setup"])
        .when(F.coalesce("veto", F.lit(False)), F.when(F.coalesce("earnings_flag", F.lit("")) == "", SKIPS["veto"]).otherwise(F.col("earnings_flag")))
        .when(~(zero("units") > 0), SKIPS["lot"])
        .when(F.col("hit").isNotNull(), F.format_string(SKIPS["corr"].replace("{other}", "%s"), F.col("hit.other"), F.col("hit.corr")))
        .when(~allowed["sector"], text("sector", sector=sector)).when(~allowed["heat"], SKIPS["heat"]).when(~allowed["exposure"], SKIPS["exposure"])
    )
    return rows.select(*candidates.columns, F.coalesce(reason, F.lit("")).alias("skip_reason")).withColumn("selected", F.col("skip_reason") == "")


def market_sleeves(states: DataFrame, cfg: dict, oil_bull: bool | None = None, dollar_strong: bool | None = None, yields_spiking: bool | None = None, risk_appetite: bool | None = None) -> DataFrame:
    """Budget of each market (market, regime, ic_t) from its base share, regime, signal history and the macro picture."""
    al, capital = cfg["allocation"], float(cfg["capital_aed"])
    macro = {"uae": 0.85 if oil_bull is False else 1.0, "crypto": 0.9 if dollar_strong else 1.0, "us": 0.9 if yields_spiking and risk_appetite is False else 1.0}
    t = F.coalesce("ic_t", F.lit(0.0))
    out = states.withColumns({
        "base": by_key(F.col("market"), {m: float(s["base"]) for m, s in cfg["markets"].items()}, 0.0), "regime_mult": by_key(F.col("regime"), al["regime"], al["regime"]["NEUTRAL"]),
        "ic_mult": F.when(t >= al["ic_t_full"], 1.0).when(t > 0, al["ic_low"]).otherwise(al["ic_none"]), "macro_mult": by_key(F.col("market"), macro, 1.0),
    })
    out = out.withColumn("share", F.col("base") * F.col("regime_mult") * F.col("ic_mult") * F.col("macro_mult"))
    total, most = F.sum("share").over(W.partitionBy(F.lit(1))), al["deploy_pct"] / 100  # three markets
    return out.withColumn("budget", capital * F.col("share") * F.when((total > most) & F.lit(most > 0), most / total).otherwise(1.0))


# What trims a sleeve's budget.
TRIMS = {"regime": "%s regime ×%.2f", "ic": "weak signal history (IC t=%.1f) ×%.2f", "macro": "%s ×%.2f", "note": "%s: budget trimmed — %s"}
MACRO_TRIMS = {"uae": "oil downtrend", "crypto": "strong dollar", "us": "yields spiking with credit risk-off"}


def sleeve_notes(sleeves: DataFrame) -> DataFrame:
    """sleeves with `note`: why a market's budget is smaller than its base share, null where nothing trims it."""
    t = F.round(F.coalesce("ic_t", F.lit(0.0)), 2)
    bits = F.array(
        F.when(F.col("regime_mult") < 1, F.format_string(TRIMS["regime"], F.replace(F.lower("regime"), F.lit("_"), F.lit(" ")), F.col("regime_mult"))),
        F.when(F.col("ic_mult") < 1, F.format_string(TRIMS["ic"], t, F.col("ic_mult"))),
        F.when(F.col("macro_mult") < 1, F.format_string(TRIMS["macro"], by_key(F.col("market"), MACRO_TRIMS, ""), F.col("macro_mult"))),
    )
    why = F.array_join(F.array_compact(bits), ", ")
    return sleeves.withColumn("note", F.when(why != "", F.format_string(TRIMS["note"], F.col("market"), why)))


def retotalled(sleeves: DataFrame, positions: DataFrame) -> DataFrame:
    """sleeves with new_aed: what the account's limits left of each market's positions."""
    new = positions.groupBy("market").agg(F.sum("aed").alias("new_aed"))
    return sleeves.drop("new_aed").join(new, "market", "left").withColumn("new_aed", F.coalesce("new_aed", F.lit(0.0)))


def holdings_review(holdings: DataFrame, candidates: DataFrame, cfg: dict) -> DataFrame:
    """Action, reason and suggested stop of what is held; candidates carry regime and live (nullable)."""
    rk = cfg["risk"]
    c = candidates.select("market", "ticker", "close", "atr", "uptrend", "eligible", "conviction", "live", F.lit(True).alias("known"))
    regimes = candidates.groupBy("market").agg(F.first("regime").alias("regime"))
    out = holdings.join(regimes, "market").join(c, ["market", "ticker"], "left")
    out = out.withColumn("price", F.coalesce("live", "close")).withColumn("stop", F.coalesce("stop", F.col("entry") - rk["stop_atr"] * F.col("atr")))
    price = F.col("price")
    known, case = F.coalesce("known", F.lit(False)), F.coalesce
    action = (
        F.when(price.isNull(), "REVIEW").when(case(price <= F.col("stop"), F.lit(False)), "EXIT").when(known & (F.coalesce("uptrend", F.lit(1.0)) != 1), "EXIT")
        .when(F.col("regime") == "CRISIS", "EXIT").when(known & case("eligible", F.lit(False)) & (case("conviction", F.lit(0.0)) >= 60), "HOLD / ADD").otherwise("HOLD")
    )
    reason = (
        F.when(price.isNull(), "no data for this ticker today").when(case(price <= F.col("stop"), F.lit(False)), F.concat(F.lit("stop "), F.format_string("%.4g", F.col("stop")), F.lit(" hit")))
        .when(known & (F.coalesce("uptrend", F.lit(1.0)) != 1), "trend broken (below 200-day or 21<50 EMA)").when(F.col("regime") == "CRISIS", "market in CRISIS regime")
        .when(known & case("eligible", F.lit(False)) & (case("conviction", F.lit(0.0)) >= 60), "still ranks as a top setup").otherwise("trend intact")
    )
    gain = ratio(price - F.col("entry"), F.col("entry") - F.col("stop"))
    trail = F.when(gain >= rk["trail_after_r"], F.greatest(F.col("stop"), price - rk["trail_atr"] * F.col("atr"))).when(gain >= rk["breakeven_r"], F.greatest("stop", "entry"))
    return out.select("market", "ticker", "units", "entry", "price", F.coalesce(F.col("units") * price * unit_value(F.col("market"), cfg), F.lit(0.0)).alias("value_aed"), (100 * (ratio(price, F.when(F.col("entry") > 0, F.col("entry"))) - 1)).alias("pnl_pct"), "stop", F.coalesce(trail, "stop").alias("suggested_stop"), action.alias("action"), reason.alias("reason"))


def free_budget(sleeves: DataFrame, review: DataFrame) -> DataFrame:
    """Budgets less what is kept; what is sold or unknown doesn't count."""
    kept = review.where(~F.col("action").isin("EXIT", "REVIEW")).groupBy("market").agg(F.sum("value_aed").alias("held_aed"))
    return sleeves.join(kept, "market", "left").withColumn("held_aed", F.coalesce("held_aed", F.lit(0.0))).withColumn("free", F.greatest(F.lit(0.0), F.col("budget") - F.col("held_aed")))


def with_live(rows: DataFrame) -> DataFrame:
    """Levels moved to a finite live price above 0, for setups that are bought at market."""
    good = (F.col("live") > 0) & (F.col("live") < float("inf"))
    shift = F.when(F.col("kind").isin("breakout", "momentum", "bounce") & good & F.col("entry").isNotNull(), F.col("live") - F.col("entry")).otherwise(0.0)
    return rows.withColumns({c: F.col(c) + shift for c in ("entry", "stop", "t1", "t2")})


def sleeve_picks(candidates: DataFrame, budgets: DataFrame, correlations: DataFrame | None, cfg: dict, returns: DataFrame | None = None) -> DataFrame:
    """Each market's names for its budget, by conviction, at most so many, within correlation and sector limits."""
    rk, smallest = cfg["risk"], cfg["capital_aed"] * cfg["allocation"]["min_position_pct"] / 100
    open_ = candidates.drop("free").join(budgets.select("market", "free").where("free > 0"), "market")
    open_ = stored(open_.where("eligible and not coalesce(veto, false) and units > 0"), "open")
    loose = {**cfg, "risk": {**rk, "heat_pct": 1e12, "exposure_pct": 1e12}}
    n = F.greatest(F.lit(1), by_key(F.col("regime"), rk["max_positions"], 0))
    state = chosen_names(open_, near_by(correlations, returns, rk["corr"]), loose, n, max([1, *rk["max_positions"].values()]))
    names = state.select("market", F.posexplode("taken").alias("place", "t")).select("market", "place", F.col("t.ticker").alias("ticker"))
    # a greedy pass takes names in order, so one that ends earlier takes the first of them
    affordable = F.greatest(F.lit(1), F.floor(F.col("free") / smallest)) if smallest > 0 else F.col("place") + 1
    return open_.join(names, ["market", "ticker"]).where(F.col("place") < affordable).drop("place")


def sleeve_weights(picks: DataFrame, cfg: dict) -> DataFrame:
    """aed: the budget by inverse volatility, tilted by conviction."""
    w = ratio(F.lit(1.0), F.greatest(F.col("atr_pct"), F.lit(0.5))) * F.pow(F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("conviction") / 50)), F.lit(cfg["allocation"]["tilt"]))
    return picks.withColumn("w", w).withColumn("aed", F.col("free") * ratio(F.col("w"), F.sum("w").over(W.partitionBy("market"))))


def capped(picks: DataFrame, cfg: dict) -> DataFrame:
    """aed held to each name's cap; what spills goes once, pro rata, to those with room."""
    capital = float(cfg["capital_aed"])
    most = F.lit(capital * cfg["risk"]["max_position_pct"] / 100)
    own = W.partitionBy("market")
    frac = F.when((F.col("entry") > 0) & (F.col("entry") > F.col("stop")), (F.col("entry") - F.col("stop")) / F.col("entry"))
    out = picks.withColumn("cap", F.least(most, ratio(capital * F.coalesce("risk_pct", F.lit(0.0)) / 100, frac)))
    spill, room = F.sum(F.greatest(F.col("aed") - F.col("cap"), F.lit(0.0))).over(own), F.greatest(F.col("cap") - F.col("aed"), F.lit(0.0))
    out = out.withColumns({"spill": spill, "room": room})
    out = out.withColumn("all_room", F.sum("room").over(own))
    extra = F.when((F.col("room") > 0) & (F.col("spill") > 0), F.least(F.col("room"), ratio(F.col("spill") * F.col("room"), F.col("all_room")))).otherwise(0.0)
    return out.withColumn("aed", F.least("aed", "cap") + extra).drop("spill", "room", "all_room", "cap")


def positions(picks: DataFrame, cfg: dict) -> DataFrame:
    """Units bought for aed, rounded down; names of which none can be bought go."""
    out = picks.withColumn("unit", unit_value(F.col("market"), cfg))
    out = out.withColumn("units", units_of(ratio(F.col("aed"), F.col("unit") * F.col("entry")), F.col("market"), cfg)).where("units > 0")
    out = out.withColumns({"aed": F.col("units") * F.col("entry") * F.col("unit"), "risk_aed": F.col("units") * (F.col("entry") - F.col("stop")) * F.col("unit")})
    order = by_key(F.col("kind"), ORDERS, "Buy at market")
    order = F.when(F.col("kind").isin("squeeze", "pullback"), F.replace(order, F.lit("{entry}"), F.format_string("%.4g", "entry"))).otherwise(order)
    return out.withColumns({"pct_capital": 100 * F.col("aed") / cfg["capital_aed"], "order": order})


def account_limits(rows: DataFrame, cfg: dict) -> DataFrame:
    """The best names by conviction up to the total, then scaled down together if stops would cost too much."""
    one = W.partitionBy(F.lit(1))  # a few dozen positions at most: those of all sleeves
    out = rows.withColumn("place", F.row_number().over(one.orderBy(F.col("conviction").desc(), "market", "ticker"))).where(F.col("place") <= cfg["allocation"]["max_total"])
    cap = cfg["capital_aed"] * cfg["risk"]["heat_pct"] / 100
    out = out.withColumn("heat", F.sum("risk_aed").over(one)).withColumn("f", F.when(F.col("heat") > cap, cap / F.col("heat")))
    out = out.withColumn("units", F.when(F.col("f").isNull(), F.col("units")).otherwise(units_of(F.col("units") * F.col("f"), F.col("market"), cfg))).where("units > 0")
    return out.withColumns({"aed": F.col("units") * F.col("entry") * F.col("unit"), "risk_aed": F.col("units") * (F.col("entry") - F.col("stop")) * F.col("unit")}).withColumn("pct_capital", 100 * F.col("aed") / cfg["capital_aed"]).drop("place", "heat", "f")


def portfolio_risk(rows: DataFrame, returns: DataFrame, cfg: dict) -> DataFrame:
    """One row: heat, deployed, one-day deviation of the positions' joint profit over the dates that all share."""
    capital = float(cfg["capital_aed"])
    held = rows.groupBy("market", "ticker").agg(F.sum("aed").alias("aed"), F.sum("risk_aed").alias("risk"))
    own = returns.join(held, ["market", "ticker"])
    total = held.agg(F.count("*").alias("n_positions"), F.sum("aed").alias("deployed_aed"), F.sum("risk").alias("heat_aed"))
    seen = own.where("ret is not null").groupBy("date").agg(F.count("*").alias("n"), F.sum(F.col("aed") * F.col("ret")).alias("pnl"))
    names = own.select("market", "ticker").distinct().agg(F.count("*").alias("names"))
    whole = seen.join(names, F.col("n") == F.col("names")).select("date", "pnl")  # one row of names
    sigma = whole.agg(F.count("*").alias("dates"), F.stddev_samp("pnl").alias("sigma"))
    alone = own.join(whole.select("date"), "date").groupBy("market", "ticker").agg(F.first("aed").alias("aed"), F.stddev_samp("ret").alias("sd")).agg(F.sum(F.col("aed") * F.col("sd")).alias("alone"))
    out = total.join(sigma, F.lit(True)).join(alone, F.lit(True))  # one row each
    sig = F.when(F.col("dates") >= 20, F.col("sigma"))
    return out.select("n_positions", "deployed_aed", (100 * F.col("deployed_aed") / capital).alias("deployed_pct"), "heat_aed", (100 * F.col("heat_aed") / capital).alias("heat_pct"), sig.alias("one_day_sigma_aed"), (100 * sig * F.sqrt(F.lit(252.0)) / capital).alias("annual_vol_pct"), ratio(F.col("alone"), sig).alias("diversification_ratio"))
