"""Polygon files, reference orbits, hourly splits and broken files."""

import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from fluxmill.sources import catalogue, hourly, paged, readers, sinks

SQUARE, HOLE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]


@pytest.mark.parametrize("as_lines", [False, True])
def test_polygons_with_holes_and_parts(spark, tmp_path, as_lines):
    features = [
        {"type": "Feature", "properties": {"name": "a", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [HOLE]]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    path = tmp_path / "x.json"
    path.write_text("\n".join(map(json.dumps, features)) if as_lines else json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = sorted((r["poly_id"], r["rings"]) for r in readers.read_polygons(spark, str(path), "name").collect())
    assert got == [("a", [SQUARE, HOLE]), ("b", [SQUARE]), ("b", [HOLE])]
    assert readers.read_polygons(spark, str(path)).select("poly_id").distinct().count() == 2


def test_reference_orbits_are_one_each(spark):
    targets = spark.createDataFrame([("00012", "t1"), ("00013", "t2"), ("00012", "t3")], "orbit string, path string")
    refs = spark.createDataFrame([(12, "r12"), (14, "r14")], "orbit long, path string")
    paired = catalogue.with_reference(targets, refs)
    assert {r["path"]: r["reference"] for r in paired.collect()} == {"t1": "r12", "t2": None, "t3": "r12"}
    assert [r[0] for r in catalogue.unreferenced(paired).collect()] == ["00013"]
    with pytest.raises(Exception, match="more than one reference for orbit 12"):
        catalogue.with_reference(targets, refs.union(refs)).collect()
    assert catalogue.with_reference(targets, refs.union(refs.filter("orbit = 14"))).count() == 3


def test_a_stopped_split_goes_on_and_writes_nothing_twice(spark, tmp_path):
    target = f"file://{tmp_path}/hours"
    model = spark.sql("SELECT timestamp_seconds(1704067200 + id * 1800) AS hour, id FROM range(0, 120)")
    days = [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)]
    assert hourly.split_hours(model, target, days[:2]) == days[:2]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "hours").rglob("*.parquet")}
    (tmp_path / "hours/date=2024-01-02/_SUCCESS").unlink()  # as if the writer had been stopped
    assert hourly.split_hours(model, target, days) == days[1:]
    assert hourly.split_hours(model, target, days) == []
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "hours").rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items() if "2024-01-01" in str(p))
    rows = hourly.read_hours(spark, target)
    assert sorted(r["id"] for r in rows.collect()) == list(range(120))
    some = hourly.read_hours(spark, target, [(date(2024, 1, 1), 3), (date(2024, 1, 3), 0)])
    assert sorted(r["id"] for r in some.collect()) == [6, 7, 96, 97]
    assert some.select(F.input_file_name()).distinct().count() == 2


def test_broken_files_are_named_and_stop_nothing(spark, tmp_path):
    good = [f"{tmp_path}/{k}.parquet" for k in (1, 2)]
    for p in good:
        spark.range(5).coalesce(1).write.parquet(p)
    bad = tmp_path / "3.parquet"
    bad.write_bytes(b"PAR1 not parquet")
    ok, why = readers.readable(spark, [good[0], str(bad), good[1]])
    assert ok == good and list(why) == [str(bad)] and why[str(bad)]


def test_products_are_told_by_their_names(spark, tmp_path):
    rows = spark.sql("SELECT 7 AS orbit, 3 AS scanline, 1 AS ground_pixel, 1000D AS value, 96000F AS surface_pressure, 7900F AS pressure_interval, array(1F, 2F) AS dry_air, array(3F, 4F) AS apriori, array(5F, 6F) AS avkern, 0.1F AS swir_albedo, 0.2F AS nir_albedo, 249 AS surface_class")
    for name in ("S5P_BLND_1.parquet", "S5P_OFFL_1.parquet"):
        rows.write.parquet(f"{tmp_path}/{name}")
    blended = readers.read_satellite(spark, f"{tmp_path}/S5P_BLND_1.parquet", "Blended").first()
    plain = readers.read_satellite(spark, f"{tmp_path}/S5P_OFFL_1.parquet", "Operational").first()
    assert (blended["scanline"], plain["scanline"]) == (0, 3) and list(plain["dry_air"]) == [2, 1] and plain["pressures"] == pytest.approx([960, 881, 802])
    with pytest.raises(Exception, match="not a file of the blended product"):
        readers.read_satellite(spark, f"{tmp_path}/S5P_OFFL_1.parquet", "Blended").collect()
    with pytest.raises(ValueError, match="unknown satellite product"):
        readers.read_satellite(spark, str(tmp_path), "CO2")


def test_periods_of_a_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Starts,Ends,period_number\n20200101,20200108,1\n20200108,20200115,2\n")
    assert [tuple(r) for r in readers.read_periods(spark, str(tmp_path / "p.csv")).collect()] == [(1, date(2020, 1, 1), date(2020, 1, 8)), (2, date(2020, 1, 8), date(2020, 1, 15))]
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="needs the columns"):
        readers.read_periods(spark, str(tmp_path / "q.csv"))


def test_pages_of_a_plume_service(spark):
    plumes = [{"plume_id": f"p{k}", "geometry_json": {"coordinates": [k / 10, -k / 10]}, "emission_auto": None if k == 3 else float(k), "emission_uncertainty_auto": 1.5, "scene_timestamp": "2024-01-02T03:04:05Z", "instrument": "emi", "first_light": k % 5 == 0} for k in range(23)]
    asked, short = [], []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            limit, offset = int(q["limit"][0]), int(q["offset"][0])
            asked.append((offset, limit, q["bbox"]))
            items = plumes[offset : offset + limit - (1 if short and limit > 1 else 0)]
            body = json.dumps({"total_count": len(plumes), "items": items}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/plumes"
        got = paged.read_paged(spark, url, (-1.0, -5.0, 3.0, 1.0), 10)
        rows = {r["id"]: r for r in got.collect()}
        assert set(rows) == {f"p{k}" for k in range(23) if k % 5} and rows["p3"]["emission_rate"] is None and rows["p4"]["lon"] == 0.4
        assert {a[:2] for a in asked if a[1] > 1} == {(0, 10), (10, 10), (20, 10)} and asked[0][2] == ["-1.0", "-5.0", "3.0", "1.0"]
        short.append(1)
        with pytest.raises(Exception, match="instead of"):
            paged.read_paged(spark, url, (-1.0, -5.0, 3.0, 1.0), 10).collect()
    finally:
        server.shutdown()


def test_detected_plumes_and_perturbation_files(spark, tmp_path):
    feature = {"type": "Feature", "geometry": None, "properties": {"lon": 1.5, "lat": 2.5, "ch4_fluxrate": 100.0, "ch4_fluxrate_std": 9.0, "tile_date": "2024-02-03T10:00:00", "satellite": "S2", "other": 1}}
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    row = readers.read_plumes(spark, "detected_geojson", str(tmp_path / "d.geojson")).first()
    assert (row["lon"], row["emission_rate"], row["instrument"], row["time"].isoformat(), row["datasource"]) == (1.5, 100.0, "S2", "2024-02-03T10:00:00", "detected_geojson")
    lines = [("r/Perturbations_0012.txt", 0, "# head"), ("r/Perturbations_0012.txt", 1, "ELEM_0012  12    1.0"), ("r/Perturbations_0012.txt", 2, "ELEM_0012  again"), ("r/Perturbations_0020.txt", 0, "ELEM_0020  20    1.0"), ("r/Perturbations_0003.txt", 0, "ELEM_0003  3     1.0")]
    out = sinks.replaced_perturbations(spark.createDataFrame(lines, "file string, number int, value string"), spark.createDataFrame([(12, 1.5), (20, 9.0)], "elem int, factor double"), 15)
    got = {(r["file"][-8:-4], r["number"]): r["value"] for r in out.collect()}
    assert got == {("0012", 0): "# head", ("0012", 1): "ELEM_0012  12    1.5", ("0012", 2): "ELEM_0012  again", ("0020", 0): "ELEM_0020  20    1.0", ("0003", 0): "ELEM_0003  3     1.0"}
