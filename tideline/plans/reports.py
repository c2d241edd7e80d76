"""Sinks: CSV, JSON and a self-contained HTML page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flat(rows: DataFrame) -> DataFrame:
    """Arrays of text joined by "; ", other nested columns as JSON, for files without nesting."""
    out = {}
    for f in rows.schema:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out[f.name] = F.concat_ws("; ", f.name)
        elif kind.startswith(("array", "struct", "map")):
            out[f.name] = F.to_json(f.name)
    return rows.withColumns(out)


def write_csv(rows: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    flat(rows.drop(*drop)).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Undefined numbers become null."""
    clean = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in rows.schema if f.dataType.simpleString() in ("double", "float")}
    rows.withColumns(clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def summary(candidates: DataFrame, n: int = 25) -> DataFrame:
    place = F.row_number().over(W.partitionBy("market").orderBy(F.col("conviction").desc_nulls_last(), "ticker"))
    return candidates.withColumn("place", place).where(F.col("place") <= n)


def sparkline_values(bars: DataFrame, n: int = 60) -> DataFrame:
    """(market, ticker, closes): the last n closes in order."""
    back = F.row_number().over(W.partitionBy("market", "ticker").orderBy(F.col("date").desc()))
    last = bars.withColumn("back", back).where(F.col("back") <= n)
    return last.groupBy("market", "ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda s: s["close"]).alias("closes"))


def sparkline(values: list[float], width: int = 96, height: int = 28) -> str:
    """A line through the values as SVG."""
    if len(values) < 2:
        return ""
    low, span = min(values), (max(values) - min(values)) or 1.0
    points = " ".join(f"{width * i / (len(values) - 1):.1f},{height - 1 - (height - 2) * (v - low) / span:.1f}" for i, v in enumerate(values))
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def number(x, places: int = 2) -> str:
    if x is None or x != x:
        return "–"
    if isinstance(x, float):
        return f"{x:,.0f}" if abs(x) >= 1000 else f"{x:.{places}f}"
    return str(x)


def regime_sentence(bench: str, close: float, above_200: bool | None, breadth_pct: float | None = None, vix: float | None = None, vol_pct: float | None = None) -> str:
    parts = [f"{bench} {close:,}"]
    if above_200 is not None:
        parts.append(f"{'above' if above_200 else 'below'} its 200-day")
    for value, said in ((breadth_pct, "{:.0f}% of names above the 50-day"), (vix, "VIX {}"), (vol_pct, "realised vol at percentile {:.0f}")):
        if value is not None:
            parts.append(said.format(value))
    return ", ".join(parts)


def page(candidates: DataFrame, bars: DataFrame, title: str, n: int = 15) -> str:
    """One HTML page of the best candidates; only n rows a market come to the driver."""
    columns = ["market", "ticker", "setup", "conviction", "entry", "stop", "t1", "t2", "units", "why"]
    rows = summary(candidates, n).select(*columns).join(sparkline_values(bars), ["market", "ticker"], "left").orderBy("market", F.col("conviction").desc()).collect()
    body = "".join("<tr>" + "".join(f"<td>{html.escape(number(r[c]))}</td>" for c in columns) + f"<td>{sparkline(list(r['closes'] or []))}</td></tr>" for r in rows)
    head = "".join(f"<th>{c}</th>" for c in [*columns, "60 bars"])
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
