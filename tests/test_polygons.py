"""Polygons on grids, and regridding weights, against sampling and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmill.functions.geo import CLARKE_1866, WGS84, zone_area
from fluxmill.operators import polygons, regridding
from fluxmill.operators.polygons import Lattice

RINGS = "poly_id string, rings array<array<array<double>>>"
GRID = Lattice(0.5, 1.0, 8, 0.5, 1.0, 6)
SHAPES = [
    ("box", [[[1, 1], [4, 1], [4, 3], [1, 3], [1, 1]]]),
    ("holed", [[[0.3, 0.2], [7.7, 0.4], [6.2, 5.6], [1.1, 5.2]], [[2, 2], [5, 2.2], [4.5, 4.1], [2.4, 3.8]]]),
    ("bent", [[[-2, -1], [9.5, 2.3], [3.2, 2.9], [9, 7], [-1, 4.4], [2.2, 3.1]]]),
    ("clockwise", [[[5.1, 4.1], [5.4, 5.8], [7.3, 4.6]]]),
]


def inside(rings, x, y):
    """Even-odd rule at many places."""
    out = np.zeros(x.shape, bool)
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if b != d:
                out ^= ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a)
    return out


def shapes(spark):
    return polygons.ring_edges(spark.createDataFrame([(n, [[[float(v) for v in p] for p in r] for r in rings]) for n, rings in SHAPES], RINGS))


def test_shares_of_cells_against_sampling(spark):
    got = {(r["poly_id"], r["i"], r["j"]): r["share"] for r in polygons.cell_overlaps(shapes(spark), GRID).collect()}
    m = 400
    at = (np.arange(m) + 0.5) / m
    for name, rings in SHAPES:
        for i in range(8):
            for j in range(6):
                x, y = np.meshgrid(i + at, j + at)
                assert got.get((name, i, j), 0.0) == pytest.approx(inside(rings, x, y).mean(), abs=4e-3)
    assert got["box", 2, 1] == 1.0 and got["holed", 3, 0] == pytest.approx(1 - (0.2 + (3.5 - 0.3) * 0.2 / 7.4))


def test_cells_and_points_inside(spark):
    got = {(r["poly_id"], r["i"], r["j"]) for r in polygons.rasterised(shapes(spark), GRID).collect()}
    i, j = np.meshgrid(np.arange(8), np.arange(6))
    assert got == {(n, int(a), int(b)) for n, rings in SHAPES for a, b in zip(i[inside(rings, i + 0.5, j + 0.5)], j[inside(rings, i + 0.5, j + 0.5)])}
    rng = np.random.default_rng(2)
    at = rng.uniform(-3, 10, (400, 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)] + [(900, 1.0, 2.0), (901, 2.0, 1.0), (902, 1.0, 1.0), (903, 2.0, 2.0)], "id int, lon double, lat double")
    for band in (0.7, 5.0):
        found = {(r["id"], r["poly_id"]) for r in polygons.points_within(points, shapes(spark), band).collect()}
        want = {(k, n) for n, rings in SHAPES for k in np.flatnonzero(inside(rings, at[:, 0], at[:, 1]))}
        assert {f for f in found if f[0] < 900} == want
        assert {f for f in found if f[1] == "box" and f[0] >= 900} == {(903, "box")}  # edges and corners are not within


def test_countries_by_largest_share_else_nearest(spark):
    edges = shapes(spark).filter("poly_id in ('box', 'clockwise')")
    cells = spark.range(48).select("id", (F.col("id") % 8).cast("int").alias("i"), F.floor(F.col("id") / 8).cast("int").alias("j")).select(F.col("id").alias("cell_id"), "i", "j", (F.col("j") + 0.5).alias("lat"), (F.col("i") + 0.5).alias("lon"))
    got = {(r["i"], r["j"]): r for r in polygons.countries_of(cells, edges, GRID).collect()}
    assert len(got) == 48 and got[2, 1]["country"] == "box" and got[6, 4]["country"] == "clockwise"
    assert got[0, 0]["country"] == "box" and got[7, 5]["country"] == "clockwise"
    assert (got[0, 0]["country_lon"], got[0, 0]["country_lat"]) == pytest.approx((2.5, 2.0))
    holed = polygons.centroids(shapes(spark)).filter("poly_id = 'holed'").first()
    m = (np.arange(2000) + 0.5) / 250
    x, y = np.meshgrid(m, m)
    ok = inside(SHAPES[1][1], x, y)
    assert (holed["lon"], holed["lat"], holed["area"]) == pytest.approx((x[ok].mean(), y[ok].mean(), ok.mean() * 64), rel=2e-3)


def test_degenerate_polygons(spark):
    odd = spark.createDataFrame([("a", None), ("b", [None]), ("c", [[[1.0, 1.0], [2.0, 2.0]]]), ("d", [])], RINGS)
    assert polygons.ring_edges(odd).count() == 0 and polygons.cell_overlaps(polygons.ring_edges(odd), GRID).count() == 0


def sphere(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def within(corners, at):
    """Which places lie within convex cells with great-circle edges."""
    p = regridding.against_the_clock(corners[None])[0]
    return np.all([np.cross(a, b) @ at.T >= -1e-15 for a, b in zip(p, np.roll(p, -1, 0)) if not np.allclose(a, b)], axis=0)


def test_weights_against_sampling_and_sums(spark):
    fine = spark.createDataFrame([(i * 100 + j, -10.0 + 2 * j, 170.0 + 2.5 * i) for i in range(9) for j in range(11)], "cell_id long, lat double, lon double")
    source = regridding.lattice_cells(fine, 2.0, 2.5)
    rng = np.random.default_rng(3)
    quads = []
    for k in range(12):
        lat, lon, turn = rng.uniform(-7, 7), rng.uniform(174, 186), rng.uniform(0, 1.5)
        ring = [(lat + 1.7 * np.sin(turn + a), lon + 2.1 * np.cos(turn + a)) for a in (0.2, 1.6, 3.3, 4.9)]
        quads.append((k, [float(a) for a, _ in ring], [float(b) for _, b in ring]))
    target = spark.createDataFrame(quads, "cell_id long, lats array<double>, lons array<double>")
    w = regridding.conservative_weights(source, target, 32).collect()
    total, got = {}, {(r["dst"], r["src"]): r["w"] for r in w}
    for r in w:
        total[r["dst"]] = total.get(r["dst"], 0) + r["w"]
    assert sorted(total) == list(range(12)) and all(v == pytest.approx(1, abs=1e-9) for v in total.values())
    corner = {r["cell_id"]: sphere(np.array(r["lats"]), np.array(r["lons"])) for r in source.collect()}
    for k, lats, lons in quads[:4]:
        c = sphere(np.array(lats), np.array(lons))
        y, x = np.meshgrid(np.linspace(min(lats) - 0.1, max(lats) + 0.1, 500), np.linspace(min(lons) - 0.1, max(lons) + 0.1, 500))
        at = sphere(y.ravel(), x.ravel())
        at, weight = at[within(c, at)], np.cos(np.radians(y.ravel()))[within(c, at)]
        for s, p in corner.items():
            assert got.get((k, s), 0.0) == pytest.approx(weight[within(p, at)].sum() / weight.sum(), abs=6e-3)


def test_weights_at_the_pole_and_partly_covered(spark):
    polar = regridding.lattice_cells(spark.createDataFrame([(k, 88.0, 30.0 * k) for k in range(12)], "cell_id long, lat double, lon double"), 4.0, 30.0)
    cap = spark.createDataFrame([(1, [88.0] * 4, [0.0, 90.0, 180.0, 270.0]), (2, [85.5, 85.5, 87.0, 87.0], [10.0, 20.0, 20.0, 10.0]), (3, [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]), (4, None, None)], "cell_id long, lats array<double>, lons array<double>")
    w = {}
    for r in regridding.conservative_weights(polar, cap, 16).collect():
        w.setdefault(r["dst"], {})[r["src"]] = r["w"]
    assert set(w) == {1, 2} and sum(w[1].values()) == pytest.approx(1, abs=1e-9) and sum(w[2].values()) < 1
    same = {(r["dst"], r["src"]): r["w"] for r in regridding.conservative_weights(polar, polar, 16).collect()}
    assert all(same[k, k] == pytest.approx(1, abs=1e-9) for k in range(12)) and len(same) == 12


def test_areas_on_the_ellipsoid(spark):
    """Closed forms: a parallel around the pole in short edges, an eighth of the ellipsoid, a cell of meridians and near parallels."""
    parallel = [[-180 + 0.05 * k, -70.0] for k in range(7200)]
    shapes = [("pole", [parallel]), ("octant", [[[0.0, 0.0], [90.0, 0.0], [90.0, 90.0]]]), ("holed", [[[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]]), ("hole", [[[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]]), ("whole", [[[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]])]
    edges = polygons.ring_edges(spark.createDataFrame(shapes, RINGS))
    got = {r["poly_id"]: r["area"] for r in polygons.ellipsoid_areas(edges, WGS84).collect()}
    assert got["pole"] == pytest.approx(510065621724088.44 / 2 - 2 * np.pi * zone_area(np.radians(70.0), *WGS84), rel=1e-6)
    assert got["octant"] == pytest.approx(510065621724088.44 / 8, rel=1e-9)  # an eighth of the ellipsoid
    assert got["holed"] == pytest.approx(got["whole"] - got["hole"], rel=1e-12)
    clarke = {r["poly_id"]: r["area"] for r in polygons.ellipsoid_areas(edges.filter("poly_id = 'hole'"), CLARKE_1866).collect()}
    flat = np.radians(1) * (zone_area(np.radians(2.0), *CLARKE_1866) - zone_area(np.radians(1.0), *CLARKE_1866))
    # both edges bulge to the north, by two thirds of their sagitta: the northern one twice as far
    bulge = np.radians(1) ** 2 / 12 * (np.sin(np.radians(4)) - np.sin(np.radians(2))) / 2
    assert clarke["hole"] == pytest.approx(flat * (1 + bulge / np.radians(1)), rel=1e-6)
