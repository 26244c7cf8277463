"""Sector algebra of emission inventories in long form: (date, cell_id, sector, flux)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SECONDS_PER_YEAR, perturbation_factor
from .quantiles import exact_percentiles

#: Totals that are no sectors, and sectors that are reported together.
TOTALS = ("Total", "Total_ExclSoilAbs")
SOIL = "SoilAbsorb"
GROUPS = {"Landfills": "Waste", "Wastewater": "Waste", "Oil": "Oil/Gas", "Gas": "Oil/Gas"}


def tg_per_year(flux: Column, area: Column) -> Column:
    return flux * area * SECONDS_PER_YEAR * 1e-9


def sector_group(sector: Column) -> Column:
    out = sector
    for name, group in GROUPS.items():
        out = F.when(sector == name, group).otherwise(out)
    return out


def mean_emissions(emission: DataFrame, start, end) -> DataFrame:
    """Mean flux by cell and sector over [start, end)."""
    inside = (F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))
    return emission.filter(inside).groupBy("cell_id", "sector").agg(F.avg("flux").alias("flux"))


def period_means(emission: DataFrame, periods: DataFrame) -> DataFrame:
    """Mean flux by period, cell and sector; period ends are exclusive. Periods meet emissions on their days."""
    days = periods.select("period", F.explode(F.sequence("start", F.date_sub("end", 1))).alias("date"))
    return emission.join(days, "date").groupBy("period", "cell_id", "sector").agg(F.avg("flux").alias("flux"))


def sector_totals(emission: DataFrame, positive: bool = True) -> DataFrame:
    """Tg a year by sector; only positive ones, or only non-zero ones."""
    rows = emission.filter(~F.col("sector").isin(*TOTALS))
    out = rows.groupBy("sector").agg(F.sum(tg_per_year(F.col("flux"), F.col("area_m2"))).alias("total"))
    return out.filter(F.col("total") > 0 if positive else F.col("total") != 0)


def by_label(field: DataFrame, n: int, value: str = "value") -> DataFrame:
    """Sums by label 1..n; labels without cells are 0."""
    spark = field.sparkSession
    sums = field.filter(F.col("label").between(1, n)).groupBy(F.col("label").cast("long").alias("label")).agg(F.sum(value).alias(value))
    return spark.range(1, n + 1).withColumnRenamed("id", "label").join(sums, "label", "left").select("label", F.coalesce(value, F.lit(0.0)).alias(value))


def sector_weights(emission: DataFrame) -> DataFrame:
    """Shares of each element in its group's total; groups of total 0 or less are dropped."""
    rows = emission.filter(~F.col("sector").isin(*TOTALS, SOIL)).withColumn("group", sector_group(F.col("sector")))
    sums = rows.groupBy("group", "label").agg(F.sum(F.col("flux") * F.col("area_m2")).alias("x"))
    total = F.sum("x").over(Window.partitionBy("group"))
    return sums.withColumn("t", total).filter("t > 0").select("group", "label", (F.col("x") / F.col("t")).alias("weight"))


def posterior_emissions(prior: DataFrame, scale: DataFrame, optimize_soil: bool = False) -> DataFrame:
    """Prior sectors times their cell's scale factor; the soil sink stays as it was unless it is optimized."""
    sf = F.coalesce("sf", F.lit(1.0))
    factor = sf if optimize_soil else F.when(F.col("sector") == SOIL, 1.0).otherwise(sf)
    return prior.filter(~F.col("sector").isin(*TOTALS)).join(scale.select("cell_id", "sf"), "cell_id", "left").select("cell_id", "sector", (F.col("flux") * factor).alias("flux"))


def with_totals(emission: DataFrame) -> DataFrame:
    """Adds Total, and Total_ExclSoilAbs without the soil sink, by cell."""
    total = emission.groupBy("cell_id").agg(F.sum("flux").alias("t"), F.sum(F.when(F.col("sector") != SOIL, F.col("flux")).otherwise(0.0)).alias("u"))
    both = total.select("cell_id", F.explode(F.create_map(F.lit("Total"), F.col("t"), F.lit("Total_ExclSoilAbs"), F.col("u"))).alias("sector", "flux"))
    return emission.select("cell_id", "sector", "flux").unionByName(both)


def median_by_label(field: DataFrame, value: str = "value") -> DataFrame:
    """Exact medians; NaN is missing."""
    return exact_percentiles(field.filter("label is not null"), ["label"], F.nanvl(F.col(value), F.lit(None).cast("double")), {"median": 0.5})


def perturbations(field: DataFrame, target: float, prior_sf: DataFrame | None = None) -> DataFrame:
    """(label, jacobian_sf, effective_sf): the factor that brings a label's median emission to the target, and that over its median prior factor."""
    sf = field.withColumn("sf", perturbation_factor(F.lit(target), F.col("flux")))
    out = median_by_label(sf.withColumnRenamed("sf", "value")).withColumnRenamed("median", "jacobian_sf")
    if prior_sf is None:
        return out.withColumn("effective_sf", F.col("jacobian_sf"))
    prior = median_by_label(prior_sf.withColumnRenamed("sf", "value")).withColumnRenamed("median", "prior")
    return out.join(prior, "label", "left").select("label", "jacobian_sf", (F.col("jacobian_sf") / F.coalesce("prior", F.lit(1.0))).alias("effective_sf"))


def jacobian_scale_factors(new: DataFrame, reference: DataFrame) -> DataFrame:
    """Factors that turn a reference run's sensitivities into the new run's: (ref_sf / sf) (target / ref_target)."""
    ref = reference.select("elem", F.col("effective_sf").alias("r"), F.col("target").alias("rt"))
    return new.join(ref, "elem").select("elem", ((F.col("r") / F.col("effective_sf")) * (F.col("target") / F.col("rt"))).alias("factor"))


def gridded_factors(cells: DataFrame, factors: DataFrame, fill: float = 1.0) -> DataFrame:
    """Element values on their cells; ``fill`` elsewhere."""
    return cells.join(factors, "label", "left").select("cell_id", F.coalesce("sf", F.lit(fill)).alias("sf"))


def soil_aware_error(cells: DataFrame, sigma: float, sigma_soil: float) -> DataFrame:
    """Relative prior error by label where a soil sink is part of the flux."""
    e, s = F.avg("flux_no_soil"), F.avg("soil")
    error = F.sqrt(F.pow(e * sigma, 2) + F.pow(s * sigma_soil, 2))
    return cells.groupBy("label").agg(F.try_divide(error, F.abs(F.avg("flux"))).alias("error"))
