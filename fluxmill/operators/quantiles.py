"""Exact percentiles whose tasks hold a small part of the distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the rows on either side of a percentile that are looked at closely, and the accuracy of the first guess.
NEAR, ACCURACY = 0.001, 5000


def _matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b``, by equal keys, where null equals null. ``b`` has some rows a key, and keys are few: labels or kinds."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    b = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys]
    return a.join(F.broadcast(b), on, how).drop(*(f"_of_{k}" for k in keys))


def exact_percentiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """``shares`` (name to share) of ``value`` by ``keys``, linear between values; null values don't count, NaN is the largest.

    Spark's own percentile collects all distinct values of a key in one task.
    Here bounds close to each percentile are guessed by a sketch, all rows are
    counted between and at the bounds, and only the parts that hold the
    percentiles are counted by value. A bad guess makes parts larger, never the
    result wrong. Reads ``rows`` three times.
    """
    rows = rows.select(*keys, value.cast("double").alias("_x"))
    at = sorted({min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-NEAR, NEAR)})
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_x", at, ACCURACY).alias("_b"))
    bound = [F.col("_b")[k] for k in range(len(at))]
    slot = sum(((F.col("_x") > b).cast("int") + (F.col("_x") >= b).cast("int") for b in bound), F.lit(0))
    placed = _matched(rows.filter("_x is not null"), bounds, keys).select(*keys, slot.alias("_slot"), "_x")

    whole = Window.partitionBy(*keys)
    counts = placed.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_slot")) - F.col("_n")).withColumn("_all", F.sum("_n").over(whole))
    place = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in shares.items()}
    ends = [f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)]
    held = lambda e: (e >= F.col("_before")) & (e < F.col("_before") + F.col("_n"))
    wanted = counts.filter(F.exists(F.array(*map(held, ends)), lambda x: x)).drop("_n").withColumnRenamed("_slot", "_in")

    close = _matched(placed, wanted, keys).filter("_slot = _in").groupBy(*keys, "_slot", "_before", "_all", "_x").agg(F.count("*").alias("_n"))
    close = close.withColumn("_before", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_slot").orderBy("_x")) - F.col("_n"))
    value_at = lambda e: F.min(F.when(held(e), F.col("_x")))
    out = []
    for name, x in place.items():
        lo, hi = (value_at(f(x).cast("long")) for f in (F.floor, F.ceil))
        low, high = F.max(F.ceil(x) - x), F.max(x - F.floor(x))
        out.append(F.when(lo == hi, lo).otherwise(low * lo + high * hi).alias(name))
    found = close.groupBy(*keys).agg(*out)
    return _matched(bounds.select(*keys), found, keys, "left") if keys else found
