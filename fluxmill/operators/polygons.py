"""Polygons on grids: edges are cut where they cross rows and columns, and sums by cell give areas and insides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import CLARKE_1866, geodesic_strips, zone_area
from .plumes import nearest_cells


@dataclass(frozen=True)
class Lattice:
    """Cells (i, j) of a regular grid, by the centre of the first and the step."""

    x0: float
    dx: float
    nx: int
    y0: float
    dy: float
    ny: int

    def column(self, x: Column) -> Column:
        """Place along the rows in cells, from the first cell's edge."""
        return (x - (self.x0 - self.dx / 2)) / self.dx

    def row(self, y: Column) -> Column:
        return (y - (self.y0 - self.dy / 2)) / self.dy


def ring_edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, x0, y0, x1, y1): edges of ``polygons(poly_id, rings)``, where rings are arrays of (lon, lat) arrays.

    The first ring is the outside and runs against the clock, the others are
    holes and run with it, whatever their order was; a ring may repeat its first
    corner at its end. Several rows of one poly_id are its parts. Null rings,
    and rings of fewer than three corners, have no edges.
    """
    rings = polygons.select("poly_id", F.posexplode("rings").alias("ring", "p")).filter("p is not null")
    after = F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1))
    rings = rings.withColumn("e", F.zip_with("p", after, lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")))).filter(F.size("p") > 2)
    turn = F.aggregate("e", F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"])
    wrong = (turn > 0) != (F.col("ring") == 0)
    edges = rings.select("poly_id", wrong.alias("w"), F.explode("e").alias("e")).select("poly_id", "w", "e.*")
    swap = lambda a, b: F.when(F.col("w"), F.col(b)).otherwise(F.col(a)).cast("double").alias(a)
    return edges.select("poly_id", swap("x0", "x1"), swap("y0", "y1"), swap("x1", "x0"), swap("y1", "y0")).filter("x0 <> x1 OR y0 <> y1")


def _rows_crossed(edges: DataFrame, g: Lattice) -> DataFrame:
    """Edges in units of cells, cut at the grid's rows: (poly_id, j, u0, v0, u1, v1)."""
    e = edges.select("poly_id", *(g.column(F.col(c)).alias(c.replace("x", "u")) for c in ("x0", "x1")), *(g.row(F.col(c)).alias(c.replace("y", "v")) for c in ("y0", "y1"))).filter("v0 <> v1")
    low, high = F.least("v0", "v1"), F.greatest("v0", "v1")
    e = e.filter((high > 0) & (low < g.ny)).withColumn("j", F.explode(F.sequence(F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(g.ny - 1)).cast("int"))))
    u = lambda v: F.col("u0") + (F.col("u1") - F.col("u0")) * (v - F.col("v0")) / (F.col("v1") - F.col("v0"))
    clip = lambda v: F.greatest(F.col("j").cast("double"), F.least(F.col("j") + 1.0, F.col(v)))
    a, b = clip("v0"), clip("v1")
    end = lambda v, own, at: F.when(at == F.col(v), F.col(own)).otherwise(u(at))
    return e.select("poly_id", "j", end("v0", "u0", a).alias("u0"), a.alias("v0"), end("v1", "u1", b).alias("u1"), b.alias("v1")).filter("v0 <> v1")


def cell_overlaps(edges: DataFrame, g: Lattice) -> DataFrame:
    """(poly_id, i, j, share): the share of each cell's area, in degrees, that a polygon covers; cells without any are left out.

    An edge's part within a row and a column adds to its cell the area on its
    right within the cell, and its height to all cells on the right: sums by
    cell and a running sum along each row give every share exactly. Cells
    between two edges have no edge and take the running sum. A polygon's row is
    the largest unit, and its length is bounded by the grid's.
    """
    s = _rows_crossed(edges, g)
    # what lies west of the grid counts at its first column; what lies east of it never counts
    s = s.withColumn("lo", F.least("u0", "u1")).withColumn("hi", F.greatest("u0", "u1"))
    first, last = F.greatest(F.floor("lo"), F.lit(-1)), F.least(F.greatest(F.ceil("hi") - 1, F.floor("lo")), F.lit(g.nx - 1))
    s = s.filter(F.col("lo") < g.nx).withColumn("i", F.explode(F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))))
    west = F.when(F.col("i") == -1, F.lit(float("-inf"))).otherwise(F.col("i").cast("double"))
    a, b = F.greatest(F.col("lo"), west), F.least(F.col("hi"), F.col("i") + 1.0)
    upright = F.col("hi") == F.col("lo")
    part = F.when(upright, 1.0).otherwise((b - a) / F.when(upright, 1.0).otherwise(F.col("hi") - F.col("lo")))
    height = (F.col("v1") - F.col("v0")) * part
    beside = F.when(F.col("i") == -1, 1.0).otherwise(F.col("i") + 1 - (a + b) / 2)
    # an edge that runs up has the inside on its left: it takes away what lies on its right
    cells = s.filter(part >= 0).groupBy("poly_id", "j", "i").agg(F.sum(-height * beside).alias("area"), F.sum(-height).alias("cover"))
    along = Window.partitionBy("poly_id", "j").orderBy("i")
    before = F.coalesce(F.sum("cover").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    runs = cells.select("poly_id", "j", "i", (before + F.when(F.col("i") >= 0, F.col("area")).otherwise(0.0)).alias("share"), F.sum("cover").over(along).alias("after"), F.coalesce(F.lead("i").over(along), F.lit(g.nx)).alias("next"))
    own = runs.filter("i >= 0").select("poly_id", "i", "j", "share")
    gap = F.explode(F.sequence(F.col("i") + 1, F.col("next") - 1))
    between = runs.filter((F.abs("after") > 1e-9) & (F.col("next") > F.col("i") + 1)).select("poly_id", gap.alias("i"), "j", F.col("after").alias("share"))
    return own.unionByName(between).filter("share > 1e-12")


def rasterised(edges: DataFrame, g: Lattice) -> DataFrame:
    """(poly_id, i, j): cells whose centre is within a polygon; a centre on an edge counts for one of the polygons that share it.

    Crossings of a row's middle, in order, are the ends of runs of cells.
    """
    e = edges.select("poly_id", *(g.column(F.col(c)).alias(c.replace("x", "u")) for c in ("x0", "x1")), *((g.row(F.col(c)) - 0.5).alias(c.replace("y", "v")) for c in ("y0", "y1"))).filter("v0 <> v1")
    first, last = F.greatest(F.ceil(F.least("v0", "v1")), F.lit(0)), F.least(F.ceil(F.greatest("v0", "v1")) - 1, F.lit(g.ny - 1))
    e = e.filter(first <= last).withColumn("j", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    u = F.col("u0") + (F.col("u1") - F.col("u0")) * (F.col("j") - F.col("v0")) / (F.col("v1") - F.col("v0"))
    rows = e.groupBy("poly_id", "j").agg(F.array_sort(F.collect_list(u)).alias("x"))
    runs = rows.select("poly_id", "j", "x", F.explode(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1)).alias("k"))
    lo, hi = F.ceil(F.col("x")[F.col("k") * 2] - 0.5), F.ceil(F.col("x")[F.col("k") * 2 + 1] - 0.5) - 1
    runs = runs.select("poly_id", "j", F.greatest(lo, F.lit(0)).cast("int").alias("a"), F.least(hi, F.lit(g.nx - 1)).cast("int").alias("b")).filter("a <= b")
    return runs.select("poly_id", F.explode(F.sequence("a", "b")).alias("i"), "j")


def points_within(points: DataFrame, edges: DataFrame, band: float = 1.0) -> DataFrame:
    """(id, poly_id): ``points(id, lon, lat)`` strictly within a polygon.

    Points meet the edges of their band of latitude by an equi-join; an odd
    number of edges on a point's right means inside. A point on an edge isn't.
    """
    row = lambda c: F.floor(F.col(c) / band)
    e = edges.withColumn("_band", F.explode(F.sequence(F.least(row("y0"), row("y1")), F.greatest(row("y0"), row("y1")))))
    met = points.select("id", "lon", "lat", row("lat").alias("_band")).join(e, "_band")
    met = met.filter((F.greatest("x0", "x1") >= F.col("lon")) & (F.least("y0", "y1") <= F.col("lat")) & (F.greatest("y0", "y1") >= F.col("lat")))
    side = (F.col("x1") - F.col("x0")) * (F.col("lat") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("lon") - F.col("x0"))
    up = F.col("y1") > F.col("y0")
    crosses = ((F.col("y0") > F.col("lat")) != (F.col("y1") > F.col("lat"))) & F.when(up, side > 0).otherwise(side < 0)
    on = (side == 0) & (F.least("x0", "x1") <= F.col("lon"))
    found = met.groupBy("id", "poly_id").agg(F.sum(crosses.cast("int")).alias("n"), F.max(on).alias("on"))
    return found.filter("n % 2 = 1 AND NOT on").select("id", "poly_id")


def centroids(edges: DataFrame) -> DataFrame:
    """(poly_id, lon, lat, area) of polygons in degrees, holes taken out."""
    turn = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    rows = edges.groupBy("poly_id").agg(F.sum(turn).alias("t"), F.sum((F.col("x0") + F.col("x1")) * turn).alias("x"), F.sum((F.col("y0") + F.col("y1")) * turn).alias("y"))
    return rows.select("poly_id", (F.col("x") / (3 * F.col("t"))).alias("lon"), (F.col("y") / (3 * F.col("t"))).alias("lat"), (F.col("t") / 2).alias("area"))


def countries_of(cells: DataFrame, edges: DataFrame, g: Lattice, step: float = 2.0) -> DataFrame:
    """``cells(cell_id, i, j, lat, lon)`` with ``country``, country_lat and country_lon.

    The polygon that covers most of a cell is its country, the least poly_id on
    ties. A cell that none touches has the one with the nearest corner.
    """
    order = F.struct(-F.bround("share", 9), F.col("poly_id"))
    best = cell_overlaps(edges, g).groupBy("i", "j").agg(F.min_by("poly_id", order).alias("country"))
    placed = cells.join(best, ["i", "j"], "left")
    far = placed.filter("country is null").select(F.col("cell_id").alias("id"), "lat", "lon")
    corners = edges.select(F.struct("poly_id", "x0", "y0").alias("c")).distinct().select(F.col("c.poly_id").alias("poly_id"), F.col("c.x0").alias("lon"), F.col("c.y0").alias("lat"))
    corners = corners.withColumn("cell_id", F.struct("poly_id", "lon", "lat"))
    nearest = nearest_cells(far, corners.select("cell_id", "lat", "lon"), 1, step).select(F.col("id").alias("cell_id"), F.col("cell_id.poly_id").alias("_near"))
    middle = centroids(edges).select(F.col("poly_id").alias("country"), F.col("lon").alias("country_lon"), F.col("lat").alias("country_lat"))
    named = placed.join(nearest, "cell_id", "left").withColumn("country", F.coalesce("country", "_near")).drop("_near")
    return named.join(middle, "country", "left")


def ellipsoid_areas(edges: DataFrame, axes: tuple[float, float] = CLARKE_1866) -> DataFrame:
    """(poly_id, area): square metres within geodesic edges on an ellipsoid, holes taken out.

    Each edge adds the strip between it and the equator. A ring around a pole,
    whose edges turn through a whole circle, has the rest of its hemisphere.
    """
    a, b = axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x0, y0, x1, y1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
            turn = (x1 - x0 + 180) % 360 - 180
            yield pa.record_batch([batch.column("poly_id"), pa.array(geodesic_strips(x0, y0, x1, y1, a, b)), pa.array(turn)], names=["poly_id", "strip", "turn"])

    kind = edges.schema["poly_id"].dataType.simpleString()
    sums = edges.select("poly_id", "x0", "y0", "x1", "y1").mapInArrow(run, f"poly_id {kind}, strip double, turn double").groupBy("poly_id").agg(F.sum("strip").alias("s"), F.sum("turn").alias("t"))
    half = float(2 * np.pi * zone_area(np.array(np.pi / 2), a, b))
    return sums.select("poly_id", F.abs(F.when(F.abs("t") > 180, half - F.abs("s")).otherwise(F.col("s"))).alias("area"))
