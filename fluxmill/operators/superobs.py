"""Super-observations: pixels joined to the grid cells they overlap, then averaged by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import overlap_area
from ..functions.scalars import hour_key, nearest_index

PROFILES = ("p_sat", "dry_air", "apriori", "avkern")


def touched_cells(pixels: DataFrame, lon0: float, dlon: float, nlon: int, lat0: float, dlat: float, nlat: int, wide_east: bool = False) -> DataFrame:
    """Pixels with each cell they share an area with: (pixel columns, i, j, area).

    The corners give candidate cell indices by arithmetic, so no rows are
    compared with all cells; a corner off the grid drops the pixel. With
    ``wide_east`` the last column of cells reaches to 180 degrees.
    """
    index = lambda bounds, origin, step, n: F.array_distinct(F.transform(bounds, lambda x: nearest_index(x, origin, step, n, max(step, 0.5))))
    found = pixels.withColumn("_i", index(F.col("lon_bounds"), lon0, dlon, nlon)).withColumn("_j", index(F.col("lat_bounds"), lat0, dlat, nlat))
    found = found.filter(~F.exists("_i", lambda k: k.isNull()) & ~F.exists("_j", lambda k: k.isNull()))
    found = found.withColumn("i", F.explode("_i")).withColumn("j", F.explode("_j")).drop("_i", "_j")
    x, y = lon0 + F.col("i") * dlon, lat0 + F.col("j") * dlat
    east = F.when(F.col("i") == nlon - 1, F.greatest(x + dlon / 2, F.lit(180.0))).otherwise(x + dlon / 2) if wide_east else x + dlon / 2
    corners = [F.col(c).cast("array<double>") for c in ("lon_bounds", "lat_bounds")]
    return found.withColumn("area", overlap_area(*corners, x - dlon / 2, east, y - dlat / 2, y + dlat / 2)).filter("area > 0")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def superobservations(touched: DataFrame, keys: list[str], pixel: str, area: str = "area", values: tuple[str, ...] = ("lat", "lon", "value"), profiles: tuple[str, ...] = (), levels: int = 0, time_weighted: bool = False, threshold: str | None = None) -> DataFrame:
    """Area-weighted means by ``keys``.

    A pixel's weight in a cell is its share of the pixel's whole overlap;
    obs_count sums the shares. Profiles are averaged level by level. The time is
    the plain mean of epoch seconds, cut to whole ones (weighted for grids given
    by regridding weights), then the nearest hour.
    """
    totals = touched.groupBy(pixel).agg(F.sum(area).alias("_total"))
    w = F.col("_w")
    rows = touched.join(totals, pixel).withColumn("_w", F.col(area) / F.col("_total"))
    seconds = F.unix_micros("time") / F.lit(1e6)
    mean_time = weighted_mean(seconds, w) if time_weighted else F.avg(seconds)
    means = [weighted_mean(F.col(v).cast("double"), w).alias(v) for v in values]
    means += [F.array(*(weighted_mean(F.element_at(p, k + 1).cast("double"), w) for k in range(levels))).alias(p) for p in profiles]
    out = rows.groupBy(*keys).agg(*means, F.sum(w).alias("obs_count"), F.timestamp_seconds(mean_time.cast("long")).alias("mean_time"))
    return out.withColumn("hour_key", hour_key(F.col("mean_time"), threshold)).drop("mean_time")


def daily_counts(pixels: DataFrame, cell: list[str]) -> DataFrame:
    """Pixels, and days with any, by cell."""
    daily = pixels.groupBy(*cell, F.to_date("time").alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy(*cell).agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_superobs"))


def dilated_counts(cells: DataFrame, labels: DataFrame, radius: int = 2) -> DataFrame:
    """Counts around each label: cells within ``radius`` rows and columns of any of its cells, each counted once.

    A label's cells are spread to their neighbours, so the join is on equal indices.
    """
    around = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    near = labels.select("label", "i", "j").withColumn("di", around).withColumn("dj", around)
    near = near.select("label", (F.col("i") + F.col("di")).cast("long").alias("i"), (F.col("j") + F.col("dj")).cast("long").alias("j")).distinct()
    return near.join(cells, ["i", "j"]).groupBy("label").agg(F.sum("n_obs").alias("n_obs"), F.sum("n_superobs").alias("n_superobs"))


def by_weights(field: DataFrame, weights: DataFrame, value: str = "value") -> DataFrame:
    """Regridding by a sparse weight table (src, dst, w): weighted means by dst."""
    return field.join(weights, "src").groupBy("dst").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value), F.sum("w").alias("weight"))
