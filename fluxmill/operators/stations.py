"""Comparison with station observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_id(name: Column) -> Column:
    """Parts of the second ``~`` field of a station file's id."""
    return F.split(F.split(name, "~").getItem(1), "_")


def local_hour(t: Column, offset_hours: Column) -> Column:
    return F.hour(F.timestamp_micros(F.unix_micros(t) + (offset_hours * 3600e6).cast("long")))


def usable(obs: DataFrame) -> DataFrame:
    """Plausible pairs that are flagged good, and taken in flasks or by day."""
    plausible = (F.col("op") > 500) & (F.col("gc") > 500) & (F.col("obs_flag") == 1)
    by_day = local_hour(F.col("time"), F.col("utc_conv")).between(10, 16)
    return obs.filter(plausible & (F.col("platform").contains("flask") | by_day))


def sigma_clip(obs: DataFrame, key: str, value: str, width: float = 3.0) -> DataFrame:
    """Rows within ``width`` sample deviations of their key's mean; keys of one row have no deviation and go."""
    stats = obs.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return obs.join(stats, key).filter(F.abs(F.col(value) - F.col("_m")) < width * F.col("_s")).drop("_m", "_s")


def half_open_bin(x: Column, edges: list[float]) -> Column:
    """Number of the bin (a, b] that holds x, from 0; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[k]) & (x <= edges[k + 1]), k).otherwise(out)
    return out


def rolling_days(df: DataFrame, key: list[str], time: str, value: str, days: int = 30) -> DataFrame:
    """Mean over (t - days / 2, t + days / 2] of a key's rows."""
    half = days * 86400 // 2
    w = Window.partitionBy(*key).orderBy(F.unix_seconds(time)).rangeBetween(-half + 1, half)
    return df.withColumn("rolling", F.avg(value).over(w))


def high_sites(obs: DataFrame, limit: float = 2000.0) -> DataFrame:
    return obs.filter(F.col("gc") > limit).select("site").distinct()


def band_means(obs: DataFrame, place: str, edges: list[float], period: Column) -> DataFrame:
    """(band, period, op, gc, n): means by bands (a, b] of ``place`` and by ``period``, a named column; rows outside the bands go."""
    rows = obs.select(half_open_bin(F.col(place), edges).alias("band"), period, "op", "gc").filter("band is not null")
    return rows.groupBy("band", rows.columns[1]).agg(F.avg("op").alias("op"), F.avg("gc").alias("gc"), F.count("*").alias("n"))


def site_means(obs: DataFrame, period: Column) -> DataFrame:
    """(site, period, op, gc, n)."""
    rows = obs.select("site", period, "op", "gc")
    return rows.groupBy("site", rows.columns[1]).agg(F.avg("op").alias("op"), F.avg("gc").alias("gc"), F.count("*").alias("n"))
