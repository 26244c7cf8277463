"""Recursive updates over periods: state is a table of scale factors by period and cell."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.scratch import Saved
from .emissions import SOIL, TOTALS, period_means, tg_per_year


def make_periods(spark: SparkSession, start: date, end: date, days: int) -> DataFrame:
    """(period, start, end) tumbling windows; ends are exclusive and a partial last window is dropped."""
    if days > (end - start).days:
        raise ValueError(f"a period of {days} days doesn't fit between {start} and {end}")
    n = (end - start).days // days
    return spark.createDataFrame([(k + 1, start + timedelta(k * days), start + timedelta((k + 1) * days)) for k in range(n)], "period int, start date, end date")


def unit_factors(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", F.lit(1.0).alias("sf"))


def multiply_posteriors(sf: DataFrame, latest: DataFrame) -> DataFrame:
    return sf.join(latest.withColumnRenamed("sf", "latest"), "cell_id").select("cell_id", (F.col("sf") * F.coalesce("latest", F.lit(1.0))).alias("sf"))


def period_fluxes(emission: DataFrame, periods: DataFrame, soil: bool = False) -> DataFrame:
    """(period, cell_id, flux): each period's own mean emissions, all sectors together, without the soil sink unless ``soil``."""
    rows = emission.filter(~F.col("sector").isin(*TOTALS, *([] if soil else [SOIL])))
    return period_means(rows, periods).groupBy("period", "cell_id").agg(F.sum("flux").alias("flux"))


def nudge(sf: DataFrame, posterior: DataFrame, cells: DataFrame, fraction: float) -> DataFrame:
    """Next period's factors: the posterior, drawn to the original emissions by ``fraction``, with the region's total kept.

    ``cells(cell_id, flux, area_m2, roi)`` with the emissions of the period that
    ends. Negative posteriors count as 0 before nudging; cells out of the region
    go back to one, and so do those without emissions; missing factors are one.
    """
    rows = cells.join(sf, "cell_id", "left").join(posterior.withColumnRenamed("sf", "latest"), "cell_id", "left")
    flux = F.coalesce(F.col("flux"), F.lit(0.0))
    post = flux * F.coalesce("latest", F.lit(1.0)) * F.coalesce("sf", F.lit(1.0))
    rows = rows.select("cell_id", flux.alias("flux"), "area_m2", "roi", post.alias("post"))
    rows = rows.withColumn("nudged", fraction * F.col("flux") + (1 - fraction) * F.greatest("post", F.lit(0.0)))
    roi = lambda c: F.sum(F.when(F.col("roi"), F.col(c) * F.col("area_m2")).otherwise(0.0))
    scale = rows.agg(F.try_divide(roi("post"), roi("nudged")).alias("scale"))
    new = F.when(F.col("roi"), F.coalesce(F.try_divide(F.col("nudged") * F.col("scale"), F.col("flux")), F.lit(1.0))).otherwise(1.0)
    return rows.join(F.broadcast(scale)).select("cell_id", new.alias("sf"))


def in_period(cells: DataFrame, emission: DataFrame, period: int) -> DataFrame:
    """``cells`` with the flux that ``emission(period, cell_id, flux)`` has for them in one period; any flux of their own is left out."""
    return cells.drop("flux").join(emission.filter(F.col("period") == period).select("cell_id", "flux"), "cell_id", "left")


def replay(periods: DataFrame, cells: DataFrame, emission: DataFrame, fraction: float, folder: str | None = None) -> DataFrame:
    """(period, cell_id, sf): factors before each period, from the posterior factors ``periods(period, cell_id, sf)`` of those before it.

    ``emission(period, cell_id, flux)`` has each period's own emissions, as
    ``period_fluxes`` gives them. Each period's factors are written to
    ``folder``, by default below the shared folder, and the next plan starts from
    them: plans have one size however many periods came before, a lost executor
    costs a re-read, and the outcome is one scan of the folder.
    """
    spark = cells.sparkSession
    folder = folder or Saved(spark, "periods").root
    numbers = [r[0] for r in periods.select("period").distinct().orderBy("period").collect()]
    at = lambda p: f"{folder}/period={p}"
    kind = cells.select("cell_id", F.lit(1.0).alias("sf")).schema
    sf = unit_factors(cells)
    for k, p in enumerate(numbers):
        if k:
            before = numbers[k - 1]
            sf = nudge(spark.read.schema(kind).parquet(at(before)), periods.filter(F.col("period") == before).select("cell_id", "sf"), in_period(cells, emission, before), fraction)
        sf.write.mode("overwrite").option("compression", "zstd").parquet(at(p))
    return _periods_of(spark, folder, numbers, kind) if numbers else sf.select(F.lit(1).alias("period"), "cell_id", "sf")


def _periods_of(spark: SparkSession, folder: str, numbers: list[int], kind: StructType) -> DataFrame:
    """The parts of some periods in one scan, with their number."""
    schema = StructType([*kind.fields, StructField("period", IntegerType())])
    return spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/period={p}" for p in numbers)).select("period", *kind.names)


def run_periods(periods: DataFrame, cells: DataFrame, emission: DataFrame, invert: Callable[[int, DataFrame, DataFrame], DataFrame], fraction: float, archive: str, last: int | None = None) -> DataFrame:
    """Runs a filter over ``periods(period, start, end)`` and gives every period's (period, cell_id, prior_sf, posterior_sf).

    For each period, the archive's posteriors and the emissions of the periods
    they belong to give the prior factors, ``invert(period, window, prior)``
    gives (cell_id, sf), and both are written to ``archive`` as the period's
    partition. Periods that the archive holds with their marker are not run
    again, so a stopped run goes on where it was.
    """
    spark = cells.sparkSession
    window = {r["period"]: r for r in periods.orderBy("period").collect()}
    done = finished_periods(spark, archive, sorted(window))
    kind = cells.select("cell_id", F.lit(1.0).alias("prior_sf"), F.lit(1.0).alias("posterior_sf")).schema
    prior = unit_factors(cells)
    found = [p for p in sorted(window) if last is None or p <= last]
    for p in found:
        if p not in done:
            bounds = periods.filter(F.col("period") == p)
            posterior = invert(p, bounds, prior).select("cell_id", F.col("sf").alias("posterior_sf"))
            both = prior.withColumnRenamed("sf", "prior_sf").join(posterior, "cell_id", "left").select("cell_id", "prior_sf", F.coalesce("posterior_sf", F.lit(1.0)).alias("posterior_sf"))
            both.write.mode("overwrite").option("compression", "zstd").parquet(f"{archive}/period={p}")
        rows = spark.read.schema(kind).parquet(f"{archive}/period={p}")
        prior = nudge(rows.select("cell_id", F.col("prior_sf").alias("sf")), rows.select("cell_id", F.col("posterior_sf").alias("sf")), in_period(cells, emission, p), fraction)
    if not found:
        return unit_factors(cells).select(F.lit(None).cast("int").alias("period"), "cell_id", F.col("sf").alias("prior_sf"), F.col("sf").alias("posterior_sf")).limit(0)
    return _periods_of(spark, archive, found, kind)


def finished_periods(spark: SparkSession, archive: str, periods: list[int]) -> set[int]:
    """Periods whose partition was written to its end, up to the first that was not."""
    done = set()
    for p in periods:
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{archive}/period={p}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            break
        done.add(p)
    return done


def resume_period(spark: SparkSession, archive: str, periods: list[int], advance: bool, first: int = 1) -> int:
    """The period to start from: the one after the last finished one if ``advance``, else ``first``."""
    done = finished_periods(spark, archive, periods) if advance else set()
    return max(done) + 1 if done else first


def period_totals(archive: DataFrame, cells: DataFrame, sensitivities: DataFrame | None = None, emission: DataFrame | None = None) -> DataFrame:
    """(period, prior, posterior, smooth[, dofs]) in Tg a year over the region; smooth is the centred mean of four posteriors.

    ``emission(period, cell_id, flux)`` has each period's own emissions; without
    it the cells' flux holds for all periods.
    """
    rows = archive.join(cells.filter("roi"), "cell_id")
    if emission is not None:
        rows = rows.drop("flux").join(emission.select("period", "cell_id", "flux"), ["period", "cell_id"])
    total = lambda c: F.sum(tg_per_year(F.col(c) * F.col("flux"), F.col("area_m2")))
    out = rows.withColumn("scaled", F.col("prior_sf") * F.col("posterior_sf")).groupBy("period").agg(total("prior_sf").alias("prior"), total("scaled").alias("posterior"))
    if sensitivities is not None:
        out = out.join(sensitivities.groupBy("period").agg(F.sum("averaging_kernel").alias("dofs")), "period", "left")
    return centred_mean(out, "period", "posterior")


def centred_mean(df: DataFrame, order: str, value: str, width: int = 4) -> DataFrame:
    """Centred moving mean; an even window reaches one row further back."""
    w = Window.orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("smooth", F.avg(value).over(w))
