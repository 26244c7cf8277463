"""Whole-run operators: observation operator, periods, statistics, state vectors, catalogues, readers and writers."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmill.functions import geo, scalars
from fluxmill.operators import boundary, clustering, emissions, kalman, observation, plumes, preview, statevector, statistics
from fluxmill.plans import config
from fluxmill.sources import catalogue, readers, sinks


def clip_by_hand(x, y, box):
    points = list(zip(x, y, strict=True))
    for axis, limit, sign in ((0, box[0], 1), (0, box[1], -1), (1, box[2], 1), (1, box[3], -1)):
        kept = []
        for k, p in enumerate(points):
            q = points[(k + 1) % len(points)]
            dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
            kept += [p] * int(dp >= 0)
            if dp * dq < 0:
                t = dp / (dp - dq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = kept
        if not points:
            return 0.0
    u, v = np.array(points).T
    return abs(u @ np.roll(v, -1) - v @ np.roll(u, -1)) / 2


def test_clipped_areas_match_one_by_one():
    rng = np.random.default_rng(1)
    centre = rng.uniform(-1, 1, (400, 2))
    angle = np.sort(rng.uniform(0, 2 * np.pi, (400, 4)), axis=1)
    x, y = centre[:, :1] + np.cos(angle), centre[:, 1:] + np.sin(angle) * 0.7
    lo, hi = rng.uniform(-1, 0, (400, 2)), rng.uniform(0, 1, (400, 2))
    got = geo.clipped_areas(x, y, lo[:, 0], hi[:, 0], lo[:, 1], hi[:, 1])
    want = [clip_by_hand(a, b, (p[0], q[0], p[1], q[1])) for a, b, p, q in zip(x, y, lo, hi, strict=True)]
    assert got == pytest.approx(want, abs=1e-12)
    assert geo.clipped_areas(np.empty((0, 4)), np.empty((0, 4)), *[np.empty(0)] * 4).size == 0


def test_an_observation_without_its_model_column_raises(spark):
    obs = spark.createDataFrame([("h1", 1, 1, [1000.0, 500.0], [0.1], [0.5], [1.0])], "hour_key string, i int, j int, p_sat array<double>, apriori array<double>, avkern array<double>, dry_air array<double>")
    model = spark.createDataFrame([("h1", 1, 1, [3.0], [1000.0, 500.0])], "hour_key string, i int, j int, conc array<double>, pedge array<double>")
    assert observation.modelled(obs, model).first()["model"] == pytest.approx(0.1 + 0.5 * (3 - 0.1))
    with pytest.raises(Exception, match="no model column at h1 1 1"):
        observation.modelled(obs, model.withColumn("j", F.lit(2))).collect()
    k = spark.createDataFrame([(1, 1, 0.5)], "obs int, elem int, k double")
    with pytest.raises(Exception, match="without sensitivity"):
        observation.jacobian_rows(k, 2, ["obs"]).collect()


def test_osse_truth_has_mean_one(spark):
    elements = spark.range(20_000).withColumnRenamed("id", "elem")
    for lognormal, sigma in ((False, 0.5), (True, 2.0)):
        sf = np.array([r["sf"] for r in observation.osse_truth(elements, sigma, lognormal).collect()])
        spread = np.log(sf).std() if lognormal else sf.std()
        assert sf.mean() == pytest.approx(1, abs=0.03) and spread == pytest.approx(np.log(2) if lognormal else 0.5, rel=0.03)
        assert (sf > 0).all() or not lognormal
    noisy = observation.with_noise(spark.range(20_000).withColumn("model", F.lit(3.0)), 0.2)
    assert noisy.agg(F.stddev("sat")).first()[0] == pytest.approx(0.2, rel=0.03)


def replayed(fluxes, area, roi, posteriors, fraction):
    """Factors before each period; ``fluxes`` has a row for each period that ends."""
    sf = [np.ones(len(area))]
    for flux, p in zip(fluxes, posteriors):
        post = flux * p * sf[-1]
        nudged = fraction * flux + (1 - fraction) * np.maximum(post, 0)
        scale = (post * area)[roi].sum() / (nudged * area)[roi].sum()
        sf.append(np.where(roi, nudged * scale / flux, 1.0))
    return sf


def test_many_periods_replay_in_linear_plans(spark):
    """Each period draws to its own emissions, which change from one to the next."""
    rng = np.random.default_rng(4)
    fluxes, area, roi = rng.uniform(1, 5, (20, 6)), rng.uniform(1, 2, 6), np.array([True] * 5 + [False])
    posteriors = rng.uniform(-0.2, 1.5, (20, 6))
    cells = spark.createDataFrame([(k, float(area[k]), bool(roi[k])) for k in range(6)], "cell_id int, area_m2 double, roi boolean")
    emission = spark.createDataFrame([(p + 1, k, float(fluxes[p, k])) for p in range(20) for k in range(6)], "period int, cell_id int, flux double").coalesce(1)
    periods = spark.createDataFrame([(p + 1, k, float(posteriors[p, k])) for p in range(20) for k in range(6)], "period int, cell_id int, sf double").coalesce(1)
    out = kalman.replay(periods, cells.coalesce(1), emission, 0.1)
    got = {(r["period"], r["cell_id"]): r["sf"] for r in out.collect()}
    want = replayed(fluxes, area, roi, posteriors[:-1], 0.1)
    assert len(got) == 120 and all(got[p + 1, k] == pytest.approx(want[p][k]) for p in range(20) for k in range(6))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Union") == 0
    one = replayed(np.tile(fluxes[0], (20, 1)), area, roi, posteriors[:-1], 0.1)
    assert not np.allclose(one[-1], want[-1])


def test_period_fluxes_leave_out_soil_and_change(spark):
    rows = [("2020-01-01", 1, "Oil", 2.0), ("2020-01-02", 1, "Oil", 4.0), ("2020-01-01", 1, "SoilAbsorb", -9.0), ("2020-01-01", 1, "Total", 99.0), ("2020-01-03", 1, "Oil", 10.0), ("2020-01-03", 1, "Gas", 1.0)]
    emission = spark.createDataFrame(rows, "date string, cell_id int, sector string, flux double").withColumn("date", F.to_date("date"))
    periods = kalman.make_periods(spark, date(2020, 1, 1), date(2020, 1, 5), 2)
    assert {r["period"]: r["flux"] for r in kalman.period_fluxes(emission, periods).collect()} == {1: 3.0, 2: 11.0}


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    cells = spark.createDataFrame([(k, 2.0, 1.0, True) for k in range(3)], "cell_id int, flux double, area_m2 double, roi boolean")
    periods = kalman.make_periods(spark, date(2020, 1, 1), date(2020, 1, 29), 7)
    fluxes = np.array([[2.0, 1.0, 3.0], [1.0, 1.0, 4.0], [2.0, 5.0, 1.0], [1.0, 1.0, 1.0]])
    emission = spark.createDataFrame([(p + 1, k, float(fluxes[p, k])) for p in range(4) for k in range(3)], "period int, cell_id int, flux double")
    calls = []

    def invert(p, bounds, prior):
        calls.append(p)
        assert bounds.count() == 1
        return prior.select("cell_id", (F.lit(1.0) + F.col("cell_id") / 10).alias("sf"))

    archive = f"file://{tmp_path}/archive"
    kalman.run_periods(periods, cells, emission, invert, 0.1, archive, last=2)
    assert kalman.resume_period(spark, archive, [1, 2, 3, 4], advance=True) == 3
    assert kalman.resume_period(spark, archive, [1, 2, 3, 4], advance=False) == 1
    out = kalman.run_periods(periods, cells, emission, invert, 0.1, archive)
    assert calls == [1, 2, 3, 4] and out.count() == 12
    got = {(r["period"], r["cell_id"]): r["prior_sf"] for r in out.collect()}
    want = replayed(fluxes, np.ones(3), np.ones(3, bool), [np.array([1.0, 1.1, 1.2])] * 3, 0.1)
    assert all(got[p + 1, k] == pytest.approx(want[p][k]) for p in range(4) for k in range(3))


def test_state_vector_helpers(spark):
    cells = spark.createDataFrame([(k, 30 + k * 0.25, -100.0, None if k == 0 else float(k), 1 + k // 3) for k in range(12)], "cell_id int, lat double, lon double, sensitivity double, label int")
    clusters = clustering.cluster(cells, 3).collect()
    assert len(clusters) == 12 and [r["cell_id"] for r in clusters if r["cluster"] is None] == [0]
    statevector.contained((-100, -100, 30, 32), cells)
    with pytest.raises(ValueError, match="reaches beyond"):
        statevector.contained((-101, -100, 30, 32), cells)
    assert statevector.largest_cluster("0.25x0.3125", 640, 10) == 64
    with pytest.raises(ValueError, match="can't hold"):
        statevector.largest_cluster("0.25x0.3125", 641, 10)
    points = spark.createDataFrame([(30.0, -1.0), (31.0, -1.0), (31.0, 5.0), (31.0, 5.0)], "lat double, lon double")
    assert statevector.forced_coordinates(points, 3).count() == 3
    assert [tuple(r) for r in statevector.forced_coordinates(points, 2).collect()] == [(31.0, 5.0)]
    with pytest.raises(Exception, match="lacks a cell"):
        statevector.subset(cells.select("lat", "lon"), cells.filter("cell_id > 0"), "sensitivity").collect()
    buffer = statevector.cluster_buffer(cells, 40).select("label").distinct().collect()
    assert sorted(r[0] for r in buffer) == [41, 42, 43]


def test_statistics_helpers(spark):
    totals = spark.createDataFrame([(0, "a", 1.0), (1, "a", float("nan")), (1, "b", float("inf"))], "member int, sector string, total double")
    assert [tuple(r) for r in statistics.sector_ranges(totals).collect()] == [("a", 1.0, 1.0)]
    with pytest.raises(Exception, match="too little light"):
        statistics.enough(totals.filter("member = 0"), "total", 2.0, "light").collect()
    names = spark.createDataFrame([("run_10",), ("run_9",)], "name string")
    assert [r[0] for r in statistics.by_period_number(names, "name").collect()] == ["run_9", "run_10"]
    assert statistics.on_lattice(spark.createDataFrame([], "lat double, lon double, v int")).count() == 0
    lines = preview.report(spark.createDataFrame([(1.5, "x")], "dofs double, name string"))
    assert sorted(r[0] for r in lines.collect()) == ["dofs: 1.5", "name: x"]


def test_durations_borrow_days():
    assert scalars.run_duration(date(2019, 1, 20), date(2019, 3, 1)) == (0, 1, 9)
    assert scalars.run_duration(date(2018, 5, 1), date(2019, 5, 1)) == (1, 0, 0)
    assert scalars.as_floats(2) == [2.0] and scalars.as_floats([1, 2]) == [1.0, 2.0]


def test_catalogue_helpers(spark):
    files = spark.createDataFrame([("S5P_BLND_20200103_00001_x",), ("S5P_BLND_20200203_00001_y",)], "name string")
    assert catalogue.by_prefix(files, ["S5P_BLND_20200103"]).count() == 1 and catalogue.by_prefix(files, []).count() == 0
    assert tuple(catalogue.orbit_counts(files).first()) == (1, 2, False)
    with pytest.raises(Exception, match="no orbit in nothing"):
        catalogue.orbit_counts(spark.createDataFrame([("nothing",)], "name string")).collect()
    assert catalogue.within_dates(files, F.col("name"), r"_(\d{8})_", "2020-01-01", "2020-02-03").count() == 1
    assert catalogue.within_dates(files, F.col("name"), r"_(\d{8})_", "2020-01-01", "2020-02-03", exclusive=False).count() == 2


def test_satellite_layouts_are_read(spark, tmp_path):
    row = {"orbit": 1, "scanline": 2, "ground_pixel": 3, "lat": 1.0, "lon": 2.0, "value": float("nan"), "qa": 1.0, "lat_bounds": [1.0] * 4, "lon_bounds": [2.0] * 4, "surface_pressure": 100_000.0, "pressure_interval": 10_000.0, "dry_air": [1.0, 2.0, 3.0], "apriori": [4.0, 5.0, 6.0], "avkern": [7.0, 8.0, 9.0], "swir_albedo": 0.5, "nir_albedo": 1.0, "surface_class": 1, "chi2_swir": 5.0}
    schema = spark.createDataFrame([], readers.SATELLITE).schema
    spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema).write.parquet(f"{tmp_path}/p")
    got = readers.read_satellite(spark, f"{tmp_path}/p").first()
    assert got["dry_air"] == [3.0, 2.0, 1.0] and got["pressures"] == [1000.0, 900.0, 800.0, 700.0] and got["value"] is None
    assert got["blended_albedo"] == pytest.approx(2.4 - 1.13 * 0.5)
    spark.sql("SELECT 'r' AS run_id, TIMESTAMP '2020-01-01 01:00:00' AS hour, 1 AS i, 1 AS j, array(1e-6D) AS conc, array(1000D, 900D) AS pedge").write.parquet(f"{tmp_path}/m")
    model = readers.read_model(spark, f"{tmp_path}/m", "CH4", "2020-01-01", "2020-01-02", ["r"]).first()
    assert model["conc"] == [pytest.approx(1000.0)] and model["hour_key"] == "20200101_01"
    with pytest.raises(ValueError, match="unknown species"):
        readers.read_model(spark, f"{tmp_path}/m", "XX")


def test_point_sources_are_read_and_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lat,lon,rate,uncertainty,time\n1,2,3,0.5,2020-01-02T00:00:00\n1,2,4,,\n")
    a = readers.read_plumes(spark, "tonnes_per_hour_csv", str(tmp_path / "a.csv"))
    assert [(r["emission_rate"], r["emission_rate_std"]) for r in a.collect()] == [(3000.0, 500.0)]
    pages = [{"items": [{"plume_id": f"p{k}", "geometry_json": {"coordinates": [5.0, 6.0]}, "emission_auto": 7.0 + k, "emission_uncertainty_auto": 1.0, "scene_timestamp": "2020-01-02T00:00:00Z", "instrument": "GAO" if k else "tan", "first_light": k == 2} for k in range(3)]}]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, pages)))
    b = readers.read_plumes(spark, "paged_json", str(tmp_path / "pages.json"))
    assert sorted((r["id"], r["emission_rate"]) for r in b.collect()) == [("p0", 7.0), ("p1", 8.0)]
    assert plumes.without_aircraft(b).count() == 1
    cache = f"{tmp_path}/cache"
    calls = []

    def fetch():
        calls.append(1)
        return b

    for _ in range(2):
        assert readers.cached(spark, cache, fetch).count() == 2
    assert len(calls) == 1
    feature = json.loads(next((tmp_path / "cache").glob("*.json")).read_text().splitlines()[0])
    assert feature["type"] == "Feature" and feature["geometry"] == {"type": "Point", "coordinates": [5.0, 6.0]}
    (tmp_path / "p.csv").write_text("lat,lon\n1,2\n")
    assert readers.point_coordinates(readers.read_points(spark, str(tmp_path / "p.csv")), b).count() == 2
    (tmp_path / "q.csv").write_text("y,x\n1,2\n")
    with pytest.raises(ValueError, match="needs the columns"):
        readers.read_points(spark, str(tmp_path / "q.csv"))


def test_writers(spark, tmp_path):
    factors = spark.createDataFrame([(2, 1.5), (1, 0.25)], "elem int, factor double")
    sinks.write_lines(sinks.perturbation_lines(factors, "pert {elem} : {factor}"), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").orderBy("value").collect()[0][0] == "pert 1 : 0.25"
    members = spark.createDataFrame([(0, 1, 2.0), (1, 1, 4.0)], "member int, elem int, xhat double")
    sinks.write_ensemble(members, f"{tmp_path}/e", ["elem"])
    assert spark.read.parquet(f"{tmp_path}/e/mean").first()["xhat"] == 3.0
    sinks.write_statistics(members.limit(1), f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").count() == 1
    sinks.write_table(members, f"{tmp_path}/w", ["member"])
    assert spark.read.parquet(f"{tmp_path}/w").count() == 2
    first = sinks.first_time_only(spark.createDataFrame([(1, 0.5), (2, 0.5)], "time int, v double"), "time")
    assert [r["time"] for r in first.orderBy("time").collect()] == [None, 1]


def test_soil_and_periods(spark):
    emission = spark.sql("SELECT to_date('2020-01-01') + d AS date, 1 AS cell_id, 'Oil' AS sector, CAST(d AS DOUBLE) AS flux FROM VALUES (0), (1), (2), (3) t(d)")
    periods = kalman.make_periods(spark, date(2020, 1, 1), date(2020, 1, 6), 2)
    assert {r["period"]: r["flux"] for r in emissions.period_means(emission, periods).collect()} == {1: 0.5, 2: 2.5}
    daily = spark.sql("SELECT DATE '2020-01-02' AS day, 1 AS i, 1 AS j, 4.0D AS bias")
    full = boundary.trailing_means(boundary.complete_days(daily, "2020-01-01", "2020-01-20"))
    got = {r["day"].day: r["smooth"] for r in full.collect()}
    assert got[1] is None and got[2] == 4.0 and got[20] == 4.0


def test_config_problems_are_all_named():
    good = {"StartDate": 20180501, "EndDate": 20180508, "Species": "CH4", "Res": "0.25x0.3125", "isRegional": True, "LonMin": -10, "LonMax": 10, "LatMin": 0, "LatMax": 5, "PriorError": 0.5, "ObsError": 15, "Gamma": 1}
    assert config.problems(good) == []
    bad = {k: v for k, v in good.items() if k != "Gamma"} | {"KalmanMode": "true", "UpdateFreqDays": 7, "LatMin": 5, "LonMax": 190}
    assert config.problems(bad) == ["Gamma is missing", "NudgeFactor is missing, which KalmanMode needs", "LonMin and LonMax must lie within 180 degrees of 0", "LatMin must be below LatMax"]


def test_columns_seen_at_once_match_the_expressions(spark):
    from fluxmill.functions import vertical as v

    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        s, m = (5, 9) if k % 3 else (4, 7)
        sat, model = -np.sort(-rng.uniform(100, 1000, s + 1)), -np.sort(-rng.uniform(150, 980, m + 1))
        rows.append((k, sat.tolist(), model.tolist(), *(rng.uniform(0.1, 2, n).tolist() for n in (m, s, s, s))))
    df = spark.createDataFrame(rows, "id int, p array<double>, e array<double>, c array<double>, a array<double>, k array<double>, d array<double>")
    slow = v.averaging_kernel_column(F.col("a"), F.col("k"), F.col("d"), v.weighted_levels(v.overlap_weights(F.col("p"), F.col("e")), F.col("c")))
    for r in df.select(v.seen_column("p", "e", "c", "a", "k", "d").alias("x"), slow.alias("y")).collect():
        assert r["x"] == pytest.approx(r["y"])


def test_counts_over_a_stream(spark, tmp_path):
    from fluxmill.streaming import counts

    spark.sql("SELECT TIMESTAMP '2020-01-01' + make_interval(0, 0, 0, 0, id * 6) AS time, id % 2 AS i FROM range(24)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("time timestamp, i long").parquet(f"{tmp_path}/in")
    counts.start(counts.daily_cell_counts(stream, ["i"]), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = {(r["day"].day, r["i"]): r["n_obs"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and all(n == 2 for n in got.values()) and (1, 0) in got and (6, 1) not in got


def test_a_filter_run_inverts_each_period(spark, tmp_path):
    """Two elements on three cells; each period's posterior, nudged to its own emissions, is the next one's prior."""
    from fluxmill.operators import inversion as inv
    from fluxmill.plans.kalman_run import run_filter

    rng = np.random.default_rng(9)
    cells = spark.createDataFrame([(1, 1, 1.0, True), (2, 2, 2.0, True), (3, 2, 1.5, True), (4, 3, 1.0, False)], "cell_id int, label int, area_m2 double, roi boolean")
    fluxes = rng.uniform(1, 4, (3, 4))
    emission = spark.createDataFrame([(p + 1, c + 1, float(fluxes[p, c])) for p in range(3) for c in range(4)], "period int, cell_id int, flux double")
    periods = kalman.make_periods(spark, date(2020, 1, 1), date(2020, 1, 22), 7)
    k, y = rng.uniform(0.2, 1, (3, 40, 3)), rng.normal(0, 2, (3, 40))

    def observe(p, window, prior):
        return spark.createDataFrame([(float(v), 0.0, 1.0, row.tolist()) for v, row in zip(y[p - 1], k[p - 1], strict=True)], "sat double, model double, obs_count double, k array<double>")

    out = run_filter(periods, cells, emission, observe, 3, 2.0, {"prior_err": [0.5], "gamma": [1.0]}, 0.1, f"file://{tmp_path}/a")
    got = {(r["period"], r["cell_id"]): (r["prior_sf"], r["posterior_sf"]) for r in out.collect()}
    posts = []
    for p in range(3):
        s = np.linalg.inv(k[p].T @ k[p] / 4 + np.eye(3) / 0.25)
        x = 1 + s @ (k[p].T @ y[p] / 4)
        posts.append(x[[0, 1, 1, 2]])
    want = replayed(fluxes, np.array([1.0, 2.0, 1.5, 1.0]), np.array([True, True, True, False]), posts[:2], 0.1)
    for p in range(3):
        assert [got[p + 1, c][0] for c in (1, 2, 3, 4)] == pytest.approx(want[p]) and [got[p + 1, c][1] for c in (1, 2, 3, 4)] == pytest.approx(posts[p])
    totals = {r["period"]: r["posterior"] for r in kalman.period_totals(out, cells, emission=emission).collect()}
    first = sum(fluxes[0, c] * posts[0][c] * a for c, a in enumerate([1.0, 2.0, 1.5])) * 86400 * 365 * 1e-9
    assert totals[1] == pytest.approx(first) and inv.Elements(3).n == 3
