"""Pixel filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees shaved from a regional inversion domain, by resolution.
TRIM = {"0.125x0.15625": (0.125, 0.15625), "0.25x0.3125": (0.25, 0.3125), "0.5x0.625": (0.5, 0.625), "2.0x2.5": (0.0, 0.0), "4.0x5.0": (0.0, 0.0)}


def _inside(xlim: tuple, ylim: tuple) -> Column:
    return (F.col("lon") > xlim[0]) & (F.col("lon") < xlim[1]) & (F.col("lat") > ylim[0]) & (F.col("lat") < ylim[1])


def _common(start, end, xlim, ylim, use_water: bool) -> Column:
    ok = _inside(xlim, ylim) & F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    ok &= (F.col("lat") > -60) & (F.coalesce(F.col("sc_f9"), F.lit(5)) != 184)
    return ok if use_water else ok & (F.coalesce(F.col("sc"), F.lit(5)) != 1)


def no_antimeridian(df: DataFrame) -> DataFrame:
    return df.filter((F.array_max("lon_bounds") - F.array_min("lon_bounds")) < 100) if "lon_bounds" in df.columns else df


def filter_operational(df: DataFrame, start, end, xlim, ylim, use_water: bool = False) -> DataFrame:
    """Quality 0.5 or more, strictly within the domain, in time, not glint-flagged, north of 60 S, land unless water is asked for."""
    return no_antimeridian(df.filter(_common(start, end, xlim, ylim, use_water) & (F.col("qa") >= 0.5)))


def filter_blended(df: DataFrame, start, end, xlim, ylim, use_water: bool = False) -> DataFrame:
    """As the operational filter without quality; class 3 goes, and class 2 with chi squared over 20000."""
    sc = F.coalesce(F.col("sc"), F.lit(5))
    coast = (sc == 2) & (F.coalesce(F.col("chi2_swir"), F.lit(0.0)) > 20000)
    return no_antimeridian(df.filter(_common(start, end, xlim, ylim, use_water) & (sc != 3) & ~coast))


def read_and_filter(df: DataFrame, product: str, *args, **kwargs) -> DataFrame:
    filters = {"Operational": filter_operational, "Blended": filter_blended}
    if product not in filters:
        raise ValueError(f"unknown satellite product {product!r}")
    return filters[product](df, *args, **kwargs)


def inversion_domain(df: DataFrame, lons: tuple, lats: tuple, resolution: str, cells: int = 4) -> DataFrame:
    """Rows within the domain less ``cells`` grid cells on each side; bounds included."""
    dlat, dlon = TRIM[resolution]
    return df.filter(F.col("lon").between(lons[0] + cells * dlon, lons[1] - cells * dlon) & F.col("lat").between(lats[0] + cells * dlat, lats[1] - cells * dlat))


def in_mask(obs: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Observations whose cell is in the mask."""
    return obs.join(mask.filter("mask <> 0").select(*keys).distinct(), keys, "left_semi")


def surface_flags(classes: Column) -> tuple[Column, Column]:
    """The two lowest bits, and the flag without bits 1 and 2; 5 for unknown."""
    return F.coalesce(classes.bitwiseAND(0x03), F.lit(5)), F.coalesce(classes.bitwiseAND(0xF9), F.lit(5))


def in_boxes(df: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Points strictly within one of the boxes (x0, x1, y0, y1); two boxes meet the antimeridian."""
    keep = F.lit(False)
    for x0, x1, y0, y1 in boxes:
        keep |= (F.col("lon") > x0) & (F.col("lon") < x1) & (F.col("lat") > y0) & (F.col("lat") < y1)
    return df.filter(keep)


def assert_one_file_per_orbit(files: DataFrame) -> DataFrame:
    """Counts of files and orbits; fails when an orbit has two files or a name no orbit."""
    orbit = F.regexp_extract("name", r"_(\d{5})_", 1)
    found = files.agg(F.count("*").alias("n_files"), F.countDistinct(orbit).alias("n_orbits"), F.sum((orbit == "").cast("long")).alias("nameless"))
    bad = (F.col("n_files") != F.col("n_orbits")) | (F.col("nameless") > 0)
    return found.select("n_files", F.when(~bad, F.col("n_orbits")).otherwise(F.raise_error(F.lit("orbits and files differ")).cast("long")).alias("n_orbits"))
