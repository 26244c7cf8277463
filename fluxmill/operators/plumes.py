"""Point sources on the grid."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AIRCRAFT = ("GAO", "ang", "av3")


def without_aircraft(plumes: DataFrame) -> DataFrame:
    return plumes.filter(~F.col("instrument").isin(*AIRCRAFT))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def gridded(plumes: DataFrame, cell: list[Column], keys: tuple[str, ...] = ("datasource",)) -> DataFrame:
    """Detections, looks without one, and the mean rate by cell and source."""
    seen = F.col("emission_rate").isNotNull() & ~F.isnan("emission_rate")
    rate = F.when(seen, F.col("emission_rate"))
    return plumes.groupBy(*keys, *cell).agg(F.count(rate).alias("plumes"), F.sum((~seen).cast("long")).alias("non_detections"), F.avg(rate).alias("rate"))


def sources_over(grid: DataFrame, cell: list[str], rate: float, count: int = 0) -> DataFrame:
    """Cells over the rate (or, with one, the count) in any source, and their mean over those sources."""
    ok = F.coalesce(F.col("rate") > rate, F.lit(False))
    ok = ok | (F.col("plumes") > count) if count > 0 else ok
    return grid.filter(ok).groupBy(*cell).agg(F.avg("plumes").alias("plumes"), F.avg("rate").alias("rate"))


def _reaches(counts: dict[int, int], first: int, last: int, k: int) -> list[int]:
    """For each band from first to last, how many bands on either side hold k cells, or all if there are fewer; one at least."""
    enough, out = min(k, sum(counts.values())), []
    for b in range(first, last + 1):
        reach, n = 0, counts.get(b, 0)
        while n < enough or reach < 1:
            reach += 1
            n += counts.get(b - reach, 0) + counts.get(b + reach, 0)
        out.append(reach)
    return out


def within_labels(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points(lon, lat)`` strictly within the bounding box of ``cells(lat, lon, label)`` that have a label; none if no cell has.

    A box of over half the globe crosses the antimeridian: it is the two strips
    on either side of it. For other regions see ``polygons.points_within``.
    """
    box = cells.filter("label > 0").agg(F.min("lon").alias("_x0"), F.max("lon").alias("_x1"), F.min("lat").alias("_y0"), F.max("lat").alias("_y1"))
    x, y = F.col("lon"), F.col("lat")
    whole = (x > F.col("_x0")) & (x < F.col("_x1"))
    strips = ((x > F.col("_x1")) & (x < 180)) | ((x > -180) & (x < F.col("_x0")))
    inside = (y > F.col("_y0")) & (y < F.col("_y1")) & F.when(F.col("_x1") - F.col("_x0") > 180, strips).otherwise(whole)
    return points.join(F.broadcast(box)).filter(inside).select(*points.columns)


def nearest_cells(points: DataFrame, cells: DataFrame, k: int, step: float) -> DataFrame:
    """The k nearest cells of each point, on the unit sphere; all where there are fewer.

    Cells are met by an equi-join on latitude bands of ``step`` degrees. A first
    join over as many bands as hold k cells bounds the k-th distance; no cell
    within a distance is further off in latitude, so the second takes the bands
    within that bound. ``id`` names a point; points and cells without a place
    are left out. The driver gets a count for each band.
    """
    from pyspark.sql import Window

    from ..functions.scalars import unit_sphere

    band = lambda lat: F.floor(lat / step)
    left = points.select("id", "lat", "lon").filter("lat is not null and lon is not null")
    right = cells.select("cell_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"), band(F.col("lat")).alias("band")).filter("clat is not null and clon is not null")
    first, last = math.floor(-90 / step), math.floor(90 / step)
    reaches = F.array(*map(F.lit, _reaches({r["band"]: r["count"] for r in right.groupBy("band").count().collect()}, first, last, k)))
    a, b = unit_sphere(F.col("lat"), F.col("lon")), unit_sphere(F.col("clat"), F.col("clon"))
    d2 = sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "cell_id"))

    def met(low: Column, high: Column) -> DataFrame:
        at = left.withColumn("band", F.explode(F.sequence(F.greatest(low, F.lit(first)), F.least(high, F.lit(last)))))
        return at.join(right, "band").select("id", "cell_id", d2.alias("d2")).withColumn("rank", rank).filter(F.col("rank") <= k)

    here = band(F.col("lat"))
    reach = F.get(reaches, (here - first).cast("int"))
    bound = met(here - reach, here + reach).groupBy("id").agg(F.max("d2").alias("most"))
    # the angle of that chord, and more than rounding makes of it
    angle = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt("most") / 2))) + 1e-5
    left = left.join(bound, "id").select("id", "lat", "lon", angle.alias("angle"))
    return met(band(F.col("lat") - F.col("angle")), band(F.col("lat") + F.col("angle")))
