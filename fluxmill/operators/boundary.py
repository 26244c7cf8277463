"""Bias-corrected boundary conditions: daily cell means, spatial and temporal means, and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_means(obs: DataFrame) -> DataFrame:
    """Mean satellite and model columns by day and cell, and their difference."""
    out = obs.groupBy("day", "i", "j").agg(F.avg("sat").alias("sat"), F.avg("model").alias("model"))
    return out.withColumn("bias", F.col("model") - F.col("sat"))


def spatial_mean(daily: DataFrame, value: str = "bias", radius: int = 2, least: int = 13, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean over a square of cells; null with fewer than ``least`` values. Cells lie within ``shape``, columns and rows, if given.

    Each value is sent to its neighbours, so the aggregate's partial sums do the
    work and nothing is joined.
    """
    around = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    spread = daily.filter(F.col(value).isNotNull()).select("day", "i", "j", F.col(value).alias("v")).withColumn("di", around).withColumn("dj", around)
    sums = spread.groupBy("day", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    if shape:
        sums = sums.filter(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1))
    return sums.select("day", "i", "j", F.when(F.col("n") >= least, F.col("mean")).alias(value))


def complete_days(daily: DataFrame, start, end) -> DataFrame:
    """A row for each cell and each day of [start, end]; values of days that lack are null."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    return daily.select("i", "j").distinct().select("i", "j", days).join(daily, ["i", "j", "day"], "left")


def trailing_means(daily: DataFrame, value: str = "bias", short: int = 15, long: int = 30) -> DataFrame:
    """Mean of the last 15 rows of a cell, else of the last 30; ``complete_days`` makes rows days."""
    w = Window.partitionBy("i", "j").orderBy("day")
    mean = lambda n: F.avg(value).over(w.rowsBetween(-(n - 1), 0))
    return daily.withColumn("smooth", F.coalesce(mean(short), mean(long)))


def latitude_fill(daily: DataFrame, value: str = "bias", least: int = 15) -> DataFrame:
    """(day, j, filler): band means of ``least`` cells or more, between them linear in latitude, beyond them the nearest one."""
    bands = daily.groupBy("day", "j").agg(F.when(F.count(value) >= least, F.avg(value)).alias("m"))
    w = Window.partitionBy("day").orderBy("j")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("m").isNotNull(), F.col("j"))
    rows = bands.select(
        "day", "j", F.last("m", True).over(back).alias("m0"), F.last(at, True).over(back).alias("j0"),
        F.first("m", True).over(ahead).alias("m1"), F.first(at, True).over(ahead).alias("j1"),
    )
    share = F.try_divide(F.col("j") - F.col("j0"), F.col("j1") - F.col("j0"))
    between = F.when(F.col("j0") == F.col("j1"), F.col("m0")).otherwise(F.col("m0") + (F.col("m1") - F.col("m0")) * share)
    return rows.select("day", "j", F.coalesce(between, F.col("m1"), F.col("m0")).alias("filler"))


def filled(daily: DataFrame, fillers: DataFrame, value: str = "smooth") -> DataFrame:
    """The value, else its band's filler, else 0."""
    return daily.join(fillers, ["day", "j"], "left").withColumn("filled", F.coalesce(value, "filler", F.lit(0.0)))


def corrected_profile(profiles: DataFrame, bias: DataFrame) -> DataFrame:
    """All levels of a profile scaled so that its air-weighted mean falls by the bias; each profile needs one bias."""
    from ..functions.vertical import air_weighted_mean

    column = air_weighted_mean(F.col("conc"), F.col("air"))
    rows = profiles.join(bias, ["day", "i", "j"], "left").withColumn("column", column)
    known = F.when(F.col("bias").isNotNull(), F.col("bias")).otherwise(F.raise_error(F.lit("a profile without bias")).cast("double"))
    ratio = (F.col("column") - known) / F.col("column")
    return rows.withColumn("ratio", ratio).withColumn("conc", F.transform("conc", lambda x: x * F.col("ratio"))).drop("column", "ratio", "bias")
