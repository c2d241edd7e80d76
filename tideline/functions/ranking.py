"""Places, running sums and exact quantiles over sorted ranges: no task holds a whole group, however large.

Rows are sorted over ranges of (keys, order) and written; each range sums on its
own, and the sums of the ranges before it (a row a range and key) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def running(rows: DataFrame, keys: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """rows with, for each named column, its sum over the rows before in (keys, order) and, as name_all, over its keys.

    Rows of one key and equal order come in any sequence, so order must tell rows apart
    wherever a sum between them matters. Null keys are keys.
    """
    names = {f"_k{i}": F.col(k) for i, k in enumerate(keys)} | {f"_o{i}": o for i, o in enumerate(order)} | {f"_s{n}": c for n, c in sums.items()}
    own_keys, own_order = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    laid = rows.withColumns(names).repartitionByRange(*own_keys, *own_order).sortWithinPartitions(*own_keys, *own_order)
    laid = stored(laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "laid")
    parts = laid.groupBy("_part", *own_keys).agg(*(F.sum(f"_s{n}").alias(f"_t{n}") for n in sums))
    by_key = W.partitionBy(*own_keys)
    before = by_key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.col(k).alias(f"{k}_") for k in own_keys), *(F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_b{n}") for n in sums), *(F.sum(f"_t{n}").over(by_key).alias(f"{n}_all") for n in sums))
    here = W.partitionBy("_part", *own_keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = laid.withColumns({f"_w{n}": F.coalesce(F.sum(f"_s{n}").over(here), F.lit(0)) for n in sums})
    parts = stored(parts, "parts").withColumnRenamed("_part", "_part_")
    same = summed["_part"] == parts["_part_"]
    for k in own_keys:
        same &= summed[k].eqNullSafe(parts[f"{k}_"])
    out = summed.join(parts, same)
    return out.select(*rows.columns, *((F.col(f"_b{n}") + F.col(f"_w{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) of the values that are not null: the mean of the two in the middle."""
    placed = running(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)], place=F.lit(1))
    middle = (2 * F.col("place") >= F.col("place_all") - 2) & (2 * F.col("place") <= F.col("place_all"))
    return placed.where(middle).groupBy(*keys).agg(F.avg(value).alias("median"))


def quantiles(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): the value at share * (n - 1) among the n that are not null, between neighbours by proportion."""
    placed = running(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)], place=F.lit(1))
    at = F.lit(share) * (F.col("place_all") - 1)
    low = F.floor(at)
    weight = F.when(F.col("place") == low, 1 - (at - low)).when(F.col("place") == low + 1, at - low)
    return placed.where(weight > 0).groupBy(*keys).agg(F.sum(weight * F.col(value)).alias(name))
