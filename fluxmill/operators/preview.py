"""What an inversion would learn, before it is run: observation counts, prior emissions and expected averaging kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MIXING_RATIO, MOLAR_MASS, lookup, superobs_error
from .emissions import tg_per_year

#: Length in metres of a cell's side by resolution; wind (m/s), pressure (Pa), gravity, molar mass of air, turbulence.
LENGTHS = {"0.125x0.15625": 12_500.0, "0.25x0.3125": 25_000.0, "0.5x0.625": 50_000.0, "2.0x2.5": 200_000.0, "4.0x5.0": 400_000.0}
WIND, PRESSURE, GRAVITY, AIR, TURBULENCE = 5 * (1000 / 3600), 101325.0, 9.8, 0.029, 0.4


def observed(pixels: DataFrame) -> DataFrame:
    """What a preview needs of valid pixels."""
    return pixels.select("lat", "lon", "value", "swir_albedo", "time")


def element_summary(cells: DataFrame, counts: DataFrame, length: Column | float) -> DataFrame:
    """(label, emissions, n_cells, length, n_obs, n_superobs) of ``cells(label, flux, area_m2)`` and ``counts(label, n_obs, n_superobs)``.

    Emissions are in Tg a year; an element's length is that of a cell times its
    number of cells. Labels without observations have 0.
    """
    side = F.lit(length) if isinstance(length, float) else length
    rows = cells.filter("label >= 1").groupBy("label").agg(F.coalesce(F.sum(tg_per_year(F.col("flux"), F.col("area_m2"))), F.lit(0.0)).alias("emissions"), F.count("*").alias("n_cells"), F.sqrt(F.avg("area_m2")).alias("_side"))
    rows = rows.withColumn("length", (F.col("_side") if length == "area" else side) * F.col("n_cells")).drop("_side")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_obs", "n_superobs")]
    return rows.join(counts, "label", "left").select("label", "emissions", "n_cells", "length", *zero)


def expected_kernels(elements: DataFrame, species: str, prior_err: float, obs_err: float, periods: int | None = None) -> DataFrame:
    """``elements`` (as ``element_summary`` gives them) with ``a``, the averaging kernel that their observations let expect.

    With ``periods``, the observations are those of an average inversion period.
    """
    unit = lookup(MIXING_RATIO, species)
    m = F.col("n_superobs").cast("double") / (periods or 1)
    flux = F.col("emissions") * unit / (3600 * 24 * 365) / (F.col("n_cells") * F.col("length") * F.col("length"))
    per_superobs = F.coalesce(F.try_divide(F.col("n_obs").cast("double"), m), F.lit(0.0))
    error = superobs_error(F.lit(float(obs_err)), F.greatest(per_superobs, F.lit(1.0))) / unit
    k = TURBULENCE * (AIR * F.col("length") * GRAVITY / (lookup(MOLAR_MASS, species) * WIND * PRESSURE))
    s2 = F.pow(prior_err * flux, 2)
    return elements.withColumn("a", F.when(m > 0, F.try_divide(s2, s2 + F.pow(error / k, 2) / m)).otherwise(0.0))


def expected_dofs(kernels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(dofs, enough): the sum of the kernels, and whether it reaches the threshold at which a preview lets a run go on."""
    return kernels.agg(F.sum("a").alias("dofs")).withColumn("enough", F.col("dofs") >= threshold)


def kernels_on_cells(cells: DataFrame, kernels: DataFrame) -> DataFrame:
    """Each cell's element value; null outside the region."""
    return cells.join(kernels.select("label", "a"), "label", "left")


def report(summary: DataFrame) -> DataFrame:
    """Lines of text: a name and a value for each column of a one-row table."""
    return summary.select(F.explode(F.array(*(F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in summary.columns))).alias("value"))
