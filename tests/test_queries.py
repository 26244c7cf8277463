"""Every registered query against its SQL on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxmill import catalog, catalog_more, catalog_runs  # noqa: F401

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v)[:19] if hasattr(v, "isoformat") else v + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    rel = duck.sql(catalog.ORACLES[name])
    names = list(rel.columns)
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(str(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())
    assert sorted(str(tuple(map(plain, r))) for r in rows) == want


def test_interval_overlap_reaches_all_pixels(spark, tmp_path):
    spark.sql("SELECT id AS s_suppkey FROM range(20)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT id AS event_id, id AS user_id, TIMESTAMP '2024-01-05' AS ts, 'x' AS event_type, 1.0D AS value FROM range(1990, 2050)").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["interval_overlap_all"](spark, str(tmp_path)).collect()
    assert sorted((r["elem"], r["pixel_id"]) for r in got) == sorted((k % 20, k) for k in range(1990, 2050))


def test_prior_covariance_has_all_pairs_and_sectors(spark, tmp_path):
    # elements 0 and 39 are over 1000 km apart and share a sector; 0 and 1 are near and share none
    spark.sql("SELECT id AS s_suppkey FROM VALUES (0L), (1L), (39L), (40L) AS t(id)").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = "(0L, 0L), (1L, 1L), (39L, 0L), (39L, 1L), (0L, 7L)"
    spark.sql(f"SELECT s AS l_suppkey, p AS l_partkey, DATE '2024-01-01' AS l_shipdate, 1000.0D AS l_extendedprice FROM VALUES {rows} AS t(s, p)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["i"], r["j"]): r["c"] for r in catalog.QUERIES["prior_cov_pairs_all"](spark, str(tmp_path)).collect()}
    assert len(got) == 16 and all(got[k, k] == 1 for k in (0, 1, 39, 40))
    assert got[0, 1] == 0 and got[0, 40] == 0 and 0 < got[0, 39] < 0.082 and got[0, 39] == got[39, 0]


@pytest.mark.parametrize("name", ["prior_cov_pairs", "prior_cov_pairs_all", "interval_overlap", "interval_overlap_all"])
def test_pairs_are_made_in_many_tasks(spark, name):
    # tables of some KB were joined in one task, however many pairs they have
    df = catalog.QUERIES[name](spark, str(SF))
    assert len({r[0] for r in df.selectExpr("spark_partition_id()").distinct().collect()}) > 4


def test_covariance_of_elements_at_one_place(spark, monkeypatch):
    from fluxmill.operators import covariance

    monkeypatch.setattr(covariance, "GROUP", 3)
    places = spark.sql("SELECT id AS elem, 30D + id % 2 AS lat, -100D AS lon FROM range(20)")
    for reach in (None, 50.0, 500.0):
        got = {(r["i"], r["j"]): r["c"] for r in covariance.covariance_pairs(places, 200.0, reach, blocks=2).collect()}
        assert set(got) == {(i, j) for i in range(20) for j in range(20) if reach != 50.0 or i % 2 == j % 2}
        assert all(c == 1 if i % 2 == j % 2 else math.isclose(c, math.exp(-math.radians(1) * 6371 / 200)) for (i, j), c in got.items())


def test_overlaps_hold_no_product_of_tables():
    # 9 million pairs of one latitude and column were held at once, as generated code keeps what it makes of a row
    script = """
from pyspark.sql import SparkSession
from fluxmill.catalog import _overlaps
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "600m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
place, pixel = spark.range(0, 60000, 20).selectExpr("id AS elem", "30D AS lat"), spark.range(3000).selectExpr("id AS pixel_id", "30D AS lat", "0L AS j")
_overlaps(place, pixel, blocks=1).write.format("noop").mode("overwrite").save()
print("written")
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    run = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=120)
    assert run.stdout.split()[-1:] == ["written"], run.stderr[-2000:]


def test_prior_covariance_reaches_far_places(spark, tmp_path):
    # 0 and 39 are over 1000 km apart; pairs from 500 km on were left out
    spark.sql("SELECT id AS s_suppkey FROM VALUES (0L), (1L), (39L) AS t(id)").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["i"], r["j"]): r["c"] for r in catalog.QUERIES["prior_cov_pairs"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, j) for i in (0, 1, 39) for j in (0, 1, 39)} and all(got[k, k] == 1 for k in (0, 1, 39))
    assert 0 < got[0, 39] == got[39, 0] < math.exp(-1000 / 200) < got[0, 1]


def test_covariances_of_many_shares_are_stored_in_few_bytes(spark, tmp_path):
    # c of a file had as many values as there are pairs, 8 bytes each; a file of a range of places has few
    from fluxmill.operators import covariance

    values = "30D + 5 * (id % 8) AS lat, -100D AS lon, 1 + rand(5) AS x, 1 + rand(7) AS y"
    rows = spark.sql(f"SELECT id AS elem, lat, lon, x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM (SELECT id, {values} FROM range(1600))").collect()
    elements = spark.createDataFrame(rows).select("elem", "lat", "lon", F.struct("x", "y").alias("shares"))
    pairs = covariance.covariance_pairs(elements, 200.0, blocks=4)
    pairs.select("i", "j", catalog.cut("c", 6).alias("c")).write.parquet(f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/c")
    assert got.count() == got.select("i", "j").distinct().count() == 1600 * 1600
    assert sum(f.stat().st_size for f in tmp_path.glob("c/*.parquet")) < 1.8 * 1600 * 1600
    by = {r["elem"]: r for r in rows}
    for r in got.filter("i < 3 AND j < 40").collect():
        a, b = by[r["i"]], by[r["j"]]
        c = math.exp(-math.radians(abs(a["lat"] - b["lat"])) * 6371 / 200) * (a["x"] * b["x"] + a["y"] * b["y"])
        assert math.isclose(r["c"], 1.0 if r["i"] == r["j"] else c, abs_tol=1e-6)


def test_covariance_does_not_depend_on_the_number_of_ranges(spark, monkeypatch):
    from fluxmill.operators import covariance

    places = spark.sql("SELECT id AS elem, 30D + id % 10 AS lat, -100D AS lon FROM range(30)")
    dealt = type(places).repartitionByRange
    monkeypatch.setattr(type(places), "repartitionByRange", lambda df, n, *by: dealt(df, 7, *by))
    got = covariance.covariance_pairs(places, 200.0, blocks=2).collect()
    assert len(got) == len({(r["i"], r["j"]) for r in got}) == 900
