"""Settings with defaults: markets, regimes, risk and allocation."""

from __future__ import annotations

import copy

# Weights of factors in groups, of groups by regime, and the tables of markets, setups and risk.
TECHNICAL = {
    "trend": {"ema_align": 1, "clenow": 1, "adx_dir": 1, "dist200": 0.5},
    "momentum": {"mom_12_1": 1, "mom_6m": 1, "rs_3m": 1, "pct_52w_high": 1},
    "timing": {"rsi_zone": 1, "ema21_fit": 1, "rsi2_inv": 0.75, "close_range3": 0.5},
    "volatility": {"bw_compression": 1, "atr_fit": 1, "vol_contraction": 0.75},
    "volume": {"obv_slope": 1, "cmf20": 1, "updown_vol": 1},
}
FUNDAMENTAL = {"fundamentals": {"roe": 1, "gross_margin": 0.75, "low_leverage": 0.5, "fcf_yield": 1, "rev_growth": 1, "eps_growth": 0.75, "earnings_yield": 0.75, "ev_ebitda_inv": 0.5, "analyst_score": 0.5, "target_upside": 0.5, "eps_revision": 1}}
SENTIMENT = {"sentiment": {"news_sent": 1, "news_attention": 0.25, "funding_contrarian": 1, "social_bull": 0.5, "social_buzz": 0.25}}
GROUPS = ["trend", "momentum", "timing", "volatility", "volume", "fundamentals", "sentiment"]
DEFAULTS = {
    "capital_aed": 20000.0, "usd_aed": 3.6725, "horizon": 15, "rebalance": 5, "least_bars": 120, "least_names": 5,
    "weights": {
        "RISK_ON": [0.20, 0.25, 0.15, 0.10, 0.10, 0.10, 0.10],
        "NEUTRAL": [0.20, 0.15, 0.25, 0.10, 0.10, 0.15, 0.05],
        "RISK_OFF": [0.15, 0.05, 0.30, 0.10, 0.10, 0.30, 0.0],
        "CRISIS": [0.15, 0.05, 0.30, 0.10, 0.10, 0.30, 0.0],
    },
    "markets": {
        "us": {"currency": "USD", "atr_ideal": 2.5, "ppy": 252, "adv_floor": 20e6, "min_price": 5.0, "base": 0.5},
        "uae": {"currency": "AED", "atr_ideal": 1.8, "ppy": 252, "adv_floor": 3e6, "min_price": 0.0, "base": 0.2},
        "crypto": {"currency": "USD", "atr_ideal": 5.0, "ppy": 365, "adv_floor": 30e6, "min_price": 0.0, "base": 0.3},
    },
    "risk": {
        "per_trade_pct": {"RISK_ON": 1.0, "NEUTRAL": 0.75, "RISK_OFF": 0.5, "CRISIS": 0.0}, "max_positions": {"RISK_ON": 6, "NEUTRAL": 4, "RISK_OFF": 2, "CRISIS": 0},
        "max_position_pct": 25.0, "heat_pct": 5.0, "exposure_pct": 100.0, "stop_atr": 2.0, "max_stop_atr": 3.5, "breakeven_r": 1.0, "trail_after_r": 1.0, "trail_atr": 2.5,
        "target1_r": 1.5, "target2_r": 3.0, "time_stop": 15, "max_hold": 25, "corr": 0.70, "sector_cap": 2, "commission_pct": 0.10, "slippage_pct": 0.05, "fractional_us": True,
    },
    "allocation": {"deploy_pct": 100.0, "min_position_pct": 7.0, "max_total": 8, "tilt": 0.5, "ic_t_full": 1.5, "ic_low": 0.6, "ic_none": 0.4, "regime": {"RISK_ON": 1.0, "NEUTRAL": 0.7, "RISK_OFF": 0.35, "CRISIS": 0.0}},
    "ml": {"blend": 0.30, "step": 20, "min_train": 250, "every": 5, "top_q": 0.7, "max_iter": 20},
}


def load(overrides: dict | None = None, base: dict | None = None) -> dict:
    """The defaults (or another base) with nested overrides put over them; missing keys keep their default."""
    out = copy.deepcopy(DEFAULTS if base is None else base)

    def put(into: dict, new: dict) -> None:
        for k, v in new.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                put(into[k], v)
            else:
                into[k] = v

    put(out, overrides or {})
    return out


#: Below these keys users add names of their own, shaped as the ones that are there.
NAMED = ("markets", "weights")


def unknown_keys(own: dict, template: dict | None = None, prefix: str = "") -> list[str]:
    """Keys of own that the template lacks, or that are no mapping where it has one, as dotted paths."""
    template, found = DEFAULTS if template is None else template, []
    for k, v in own.items():
        path = f"{prefix}{k}"
        like = next(iter(template.values()), None) if prefix.rstrip(".") in NAMED and k not in template else template.get(k)
        if like is None or isinstance(like, dict) != isinstance(v, dict):
            found.append(path)
        elif isinstance(v, dict):
            found += unknown_keys(v, like, f"{path}.")
    return found


def checked(overrides: dict | None) -> dict:
    """load(), for settings that come from outside: an unknown key or a value of another shape is an error."""
    if overrides is not None and not isinstance(overrides, dict):
        raise ValueError("settings must be a mapping")
    if wrong := unknown_keys(overrides or {}):
        raise ValueError(f"unknown settings: {', '.join(wrong)}")
    return load(overrides)


def missing_keys(own: dict, template: dict, prefix: str = "") -> list[str]:
    """Keys of template that own lacks, as dotted paths."""
    found = []
    for k, v in template.items():
        path = f"{prefix}{k}"
        if k not in own:
            found.append(path)
        elif isinstance(v, dict) and isinstance(own[k], dict):
            found += missing_keys(own[k], v, f"{path}.")
    return found


def unit_aed(cfg: dict, market: str) -> float:
    return 1.0 if cfg["markets"].get(market, {}).get("currency") == "AED" else cfg["usd_aed"]
