"""Statistics of a finished run: ensembles, gridded super-observations, degrees of freedom, and the one-row summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .emissions import SOIL, TOTALS, tg_per_year
from .quantiles import exact_percentiles


def gridded_superobs(rows: DataFrame, cell: list[str], values: tuple[str, ...], count: str = "obs_count") -> DataFrame:
    """Observation counts, and count-weighted means of ``values``, by cell."""
    w = F.col(count)
    return rows.groupBy(*cell).agg(F.sum(w).alias(count), *((F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values))


def member_totals(prior: DataFrame, scale: DataFrame) -> DataFrame:
    """(member, sector, total) in Tg a year of ``prior(cell_id, sector, flux, area_m2)`` under each member's factors; the soil sink keeps its prior."""
    factor = F.when(F.col("sector") == SOIL, 1.0).otherwise(F.coalesce("sf", F.lit(1.0)))
    rows = prior.filter(~F.col("sector").isin(*TOTALS)).join(scale.select("member", "cell_id", "sf"), "cell_id")
    return rows.groupBy("member", "sector").agg(F.sum(tg_per_year(F.col("flux") * factor, F.col("area_m2"))).alias("total"))


def _finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sector_ranges(totals: DataFrame) -> DataFrame:
    """Least and greatest total of each sector over the members; non-finite ones don't count, and sectors without any go."""
    x = _finite(F.col("total"))
    return totals.groupBy("sector").agg(F.min(x).alias("ens_min"), F.max(x).alias("ens_max")).filter("ens_min is not null")


def ensemble_statistics(totals: DataFrame) -> DataFrame:
    """Mean, population deviation, least and greatest of the members' totals."""
    whole = totals.groupBy("member").agg(F.sum("total").alias("t"))
    return whole.agg(F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"), F.min("t").alias("least"), F.max("t").alias("greatest"), F.count("*").alias("members"))


def member_means(members: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the members of all other numbers."""
    values = [c for c, t in members.dtypes if t in ("double", "float") and c not in keys]
    return members.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in values))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Exact percentiles, linear between values; NaN is missing. Columns are p5, p50 and so on."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return exact_percentiles(rows, keys, x, {f"p{round(100 * p)}": p for p in shares})


def colour_range(rows: DataFrame, value: str, step: float = 25.0) -> DataFrame:
    """(low, high): a step on either side of the median's nearest multiple of it."""
    middle = F.bround(F.col("median") / step) * step
    return exact_percentiles(rows, [], F.col(value), {"median": 0.5}).select((middle - step).alias("low"), (middle + step).alias("high"))


def degrees_of_freedom(kernel: DataFrame, last: int | None = None) -> DataFrame:
    """Trace of an averaging kernel (i, j, value), over elements 1..last if given."""
    rows = kernel.filter("i = j")
    return (rows.filter(F.col("i") <= last) if last is not None else rows).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("dofs"))


def enough(rows: DataFrame, value: str, least: float, what: str) -> DataFrame:
    """One row with the sum of ``value``; raises if it is below ``least``."""
    total = F.coalesce(F.sum(value).cast("double"), F.lit(0.0))
    return rows.agg(total.alias(value)).withColumn(value, F.when(F.col(value) >= least, F.col(value)).otherwise(F.raise_error(F.lit(f"too little {what}")).cast("double")))


def sector_pairs(prior: DataFrame, posterior: DataFrame) -> DataFrame:
    """(sector, prior, posterior): sectors that are not zero in both, the largest posterior last."""
    p, q = prior.select("sector", F.col("total").alias("prior")), posterior.select("sector", F.col("total").alias("posterior"))
    return p.join(q, "sector").filter("prior <> 0 or posterior <> 0").orderBy("posterior", "sector")


def summary_row(start: str, end: str, totals: DataFrame, fit: DataFrame, dofs: DataFrame, count: DataFrame, sectors: DataFrame, ensemble: DataFrame | None = None) -> DataFrame:
    """The statistics of a run as one row: each argument but ``sectors`` has one, and each sector adds two columns.

    ``sectors(sector, prior, posterior)`` are pivoted; their names come from the
    data, whose number is that of an inventory's sectors.
    """
    wide = sectors.groupBy().pivot("sector").agg(F.first("prior").alias("Prior"), F.first("posterior").alias("Posterior"))
    wide = wide.toDF(*(c.replace("_Prior", "Prior").replace("_Posterior", "Posterior") for c in wide.columns))
    out = totals.select(F.lit(start).alias("StartDate"), F.lit(end).alias("EndDate"), "*")
    for one in (fit, dofs, count, wide, *([ensemble] if ensemble is not None else [])):
        out = out.join(F.broadcast(one))
    return out


def shared_sites(a: DataFrame, b: DataFrame, key: str = "site") -> DataFrame:
    """Sites of both."""
    return a.select(key).intersect(b.select(key))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def on_lattice(rows: DataFrame, step: float = 0.1) -> DataFrame:
    """Every place of the smallest lattice of ``step`` degrees around ``rows(lat, lon)``, with their columns where they have one.

    Places meet on whole numbers of steps; the lattice is made by expansion of
    its two axes, in parallel over rows of latitude.
    """
    n = lambda c: F.bround(F.col(c) / step).cast("long")
    placed = rows.withColumns({"_y": n("lat"), "_x": n("lon")})
    e = placed.agg(F.min("_y").alias("y0"), F.max("_y").alias("y1"), F.min("_x").alias("x0"), F.max("_x").alias("x1"))
    lattice = e.filter("y0 is not null").select(F.explode(F.sequence("y0", "y1")).alias("_y"), "x0", "x1").select("_y", F.explode(F.sequence("x0", "x1")).alias("_x"))
    others = [c for c in rows.columns if c not in ("lat", "lon")]
    return lattice.join(placed.select("_y", "_x", *others), ["_y", "_x"], "left").select((F.col("_y") * step).alias("lat"), (F.col("_x") * step).alias("lon"), *others)


def by_period_number(rows: DataFrame, name: str) -> DataFrame:
    """Rows in order of the number that ends ``name``."""
    return rows.orderBy(F.regexp_extract(name, r"(\d+)$", 1).cast("int"))
