from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

import numpy as np
from fluxmill.functions.geo import clipped_areas
from fluxmill.operators import boundary, clustering, emissions, kalman, plumes, quality, statevector, superobs
from fluxmill.plans import config
from fluxmill.sources import catalogue


def clip(x, y, box):
    return clipped_areas(np.array([x], float), np.array([y], float), *(np.array([v], float) for v in box))[0]


def test_clip():
    assert clip([0, 2, 2, 0], [0, 0, 2, 2], (1, 3, 1, 3)) == pytest.approx(1.0)
    assert clip([0, 1, 0], [0, 0, 1], (0, 1, 0, 1)) == pytest.approx(0.5)
    assert clip([0, 1, 1, 0], [0, 0, 1, 1], (2, 3, 2, 3)) == 0.0


def test_superobservations_share_a_pixel_by_area(spark):
    px = spark.createDataFrame([(1, 0, [0.25, 0.75, 0.75, 0.25], [-0.1, -0.1, 0.1, 0.1], 10.0, 0.5, 0.0, "2024-01-01 00:30:00")], "pixel_id int, orbit int, lon_bounds array<double>, lat_bounds array<double>, value double, lon double, lat double, time string").withColumn("time", F.to_timestamp("time"))
    touched = superobs.touched_cells(px, 0.0, 1.0, 4, 0.0, 1.0, 4)
    out = superobs.superobservations(touched, ["orbit", "i", "j"], "pixel_id").orderBy("i").collect()
    assert [(r["i"], r["j"]) for r in out] == [(0, 0), (1, 0)]
    assert [r["obs_count"] for r in out] == pytest.approx([0.5, 0.5])
    assert out[0]["hour_key"] == "20240101_00"


def test_unknown_product_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown satellite product"):
        quality.read_and_filter(spark.range(1), "Other", None, None, (0, 1), (0, 1))


def test_periods_drop_the_rest_and_reject_long_ones(spark):
    got = kalman.make_periods(spark, date(2018, 5, 1), date(2018, 6, 1), 7).collect()
    assert [(r["period"], r["end"]) for r in got][-1] == (4, date(2018, 5, 29))
    with pytest.raises(ValueError, match="doesn't fit"):
        kalman.make_periods(spark, date(2018, 5, 1), date(2018, 5, 3), 7)


def test_nudging_keeps_the_region_total(spark):
    cells = spark.createDataFrame([(k, float(k + 1), 1.0, k < 4) for k in range(6)], "cell_id long, flux double, area_m2 double, roi boolean")
    post = cells.select("cell_id", (F.col("cell_id") * 0.5 + 0.5).alias("sf"))
    sf = kalman.nudge(kalman.unit_factors(cells), post, cells, 0.1)
    total = sf.join(cells, "cell_id").filter("roi").agg(F.sum(F.col("sf") * F.col("flux"))).first()[0]
    assert total == pytest.approx(sum((k + 1) * (k * 0.5 + 0.5) for k in range(4)))
    assert {r["sf"] for r in sf.filter("cell_id >= 4").collect()} == {1.0}


def test_centred_mean_of_four(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(1, 7)], "t int, v double")
    assert [r["smooth"] for r in kalman.centred_mean(df, "t", "v").orderBy("t").collect()] == [1.5, 2, 2.5, 3.5, 4.5, 5]


def test_labels_without_cells_are_zero_and_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (3, float("nan")), (3, 4.0)], "label int, value double")
    assert [r["value"] for r in emissions.by_label(df.filter("value < 100"), 3).orderBy("label").collect()][:2] == [5.0, 0.0]
    assert emissions.median_by_label(df).filter("label = 3").first()["median"] == 4.0


def test_newest_per_orbit(spark):
    rows = [("a", "1", "OFFL", "020400", 9), ("b", "1", "RPRO", "020400", 1), ("c", "1", "RPRO", "020400", 2), ("d", "2", "OFFL", "020300", 5), ("e", "2", "OFFL", "020400", 1)]
    df = spark.createDataFrame(rows, "name string, orbit string, mode string, processor_version string, modification int")
    assert {r["orbit"]: r["name"] for r in catalogue.newest_per_orbit(df).collect()} == {"1": "c", "2": "e"}


def test_spatial_mean_needs_thirteen_values(spark):
    daily = spark.createDataFrame([(0, i, j, 1.0) for i in range(5) for j in range(5)], "day int, i int, j int, bias double")
    got = {(r["i"], r["j"]): r["bias"] for r in boundary.spatial_mean(daily).collect()}
    assert got[2, 2] == 1.0 and got[0, 0] is None


def test_numbering_and_clusters(spark):
    cells = spark.createDataFrame([(j * 3 + i, i, j, float(j), float(i), 0.1 * i) for i in range(3) for j in range(3)], "cell_id long, i int, j int, lat double, lon double, sensitivity double")
    got = {(r["i"], r["j"]): r["label"] for r in statevector.number_cells(cells).collect()}
    assert (got[0, 0], got[2, 2]) == (9, 1)
    assert clustering.cluster(cells, 3).select("cluster").distinct().count() == 3


def test_config():
    c = config.load({"Species": "CH4", "UseWaterObs": "false", "Gamma": [0.1, 1], "CH4": {"PriorError": 0.7}}, {"RUN_Res": "0.5x0.625"})
    assert (c.UseWaterObs, c.Gamma, c.PriorError, c.Res) == (False, (0.1, 1.0), (0.7,), "0.5x0.625")
    for bad in ({"Nope": 1}, {"LonMin": 5, "LonMax": 1}, {"Res": "1x1"}):
        with pytest.raises(ValueError):
            config.load(bad)


def test_nearest_cells_are_exact_at_any_distance(spark):
    rng = np.random.default_rng(3)
    # far from all cells, at the poles, and with nearer cells two bands off than in its own band
    points = [(0, 80.0, 10.0), (1, -89.5, 0.0), (2, 90.0, 0.0), (3, 31.0, -60.0), *((10 + k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40), strict=True)))]
    cells = [(0, 31.0, 100.0), (1, 31.0, 101.0), (2, 30.5, 102.0), (3, 36.0, -60.0), (4, 36.5, -60.0), (5, 26.0, -60.0), *((10 + k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(20, 45, 30), rng.uniform(-180, 180, 30), strict=True)))]
    p, c = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(cells, "cell_id int, lat double, lon double")

    def xyz(rows):
        a, b = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
        return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)

    d2 = ((xyz(points)[:, None] - xyz(cells)[None]) ** 2).sum(2)
    want = {(points[n][0], rank + 1): cells[m][0] for n, row in enumerate(d2) for rank, m in enumerate(np.argsort(row)[:3])}
    assert {(r["id"], r["rank"]): r["cell_id"] for r in plumes.nearest_cells(p, c, 3, 2.0).collect()} == want
    assert plumes.nearest_cells(p, c.limit(2), 3, 2.0).count() == 2 * len(points)
    assert plumes.nearest_cells(p, c.limit(0), 3, 2.0).count() == 0
