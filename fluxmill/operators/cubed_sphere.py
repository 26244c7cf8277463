"""Cubed-sphere grids: cells are met by regridding weights or as the nearest one, never by latitude and longitude axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import spherical_quad_area
from ..functions.scalars import wrap_longitude
from .superobs import superobservations


def touched(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    """Pixels with the cells they touch: ``weights(dst, src, w, dst_area)`` give the area that cell dst shares with pixel src."""
    shares = weights.select(F.col("src").alias("pixel_id"), F.col("dst").alias("cell"), (F.col("w") * F.col("dst_area")).alias("area"))
    return pixels.join(shares.filter("area > 0"), "pixel_id")


def superobservations_on_cube(pixels: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("orbit",), values: tuple[str, ...] = ("lat", "lon", "value"), profiles: tuple[str, ...] = (), levels: int = 0) -> DataFrame:
    """Area-weighted means by cell of a cube; times are weighted too."""
    return superobservations(touched(pixels, weights), [*keys, "cell"], "pixel_id", values=values, profiles=profiles, levels=levels, time_weighted=True)


def daily_counts(nearest: DataFrame) -> DataFrame:
    """(cell_id, n_obs, n_superobs) of ``nearest(cell_id, time)``: observations, and days with any, by nearest cell."""
    daily = nearest.groupBy("cell_id", F.to_date("time").alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy("cell_id").agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_superobs"))


def usable_corners(lons: Column, lats: Column) -> Column:
    """Whether a cell has four corners, none missing and no two alike."""
    whole = F.forall(F.concat(lons, lats), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return F.coalesce(whole & (F.size(F.array_distinct(F.arrays_zip(lons.alias("x"), lats.alias("y")))) == 4), F.lit(False))


def regridding_grid(pixels: DataFrame, valid: Column, fill: float = -9999.0) -> DataFrame:
    """The grid that a regridding tool takes: mask, area on the unit sphere and corners; degenerate cells have no mask and no area."""
    ok = usable_corners(F.col("lon_bounds"), F.col("lat_bounds"))
    corner = lambda c: [F.element_at(c, k).cast("double") for k in (1, 2, 3, 4)]
    area = spherical_quad_area(corner("lon_bounds"), corner("lat_bounds"), 1.0)
    filled = lambda c: F.transform(c, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(fill)))
    return pixels.select("pixel_id", "lat", "lon", (valid & ok).cast("int").alias("imask"), F.when(ok, F.coalesce(area, F.lit(0.0))).otherwise(0.0).alias("area"), filled("lon_bounds").alias("corner_lon"), filled("lat_bounds").alias("corner_lat"))


def from_supergrid(points: DataFrame) -> DataFrame:
    """(tile, i, j, kind, lon, lat) of a grid of twice the resolution: even rows and columns are corners, odd ones centres; longitudes in [0, 360)."""
    y, x = F.col("y"), F.col("x")
    kind = F.when((y % 2 == 0) & (x % 2 == 0), "corner").when((y % 2 == 1) & (x % 2 == 1), "centre")
    rows = points.withColumn("kind", kind).filter("kind is not null")
    return rows.select("tile", F.floor(x / 2).cast("int").alias("i"), F.floor(y / 2).cast("int").alias("j"), "kind", wrap_longitude(F.col("lon"), to_360=True).alias("lon"), "lat")
