"""Percentiles against Spark's own, and the plan that they don't have."""

import math

import pytest
from pyspark.sql import functions as F

from fluxmill.operators import emissions, quantiles, statistics


@pytest.mark.parametrize("near, accuracy", [(0.001, 5000), (0.0, 1)])
def test_exact_percentiles(spark, monkeypatch, near, accuracy):
    monkeypatch.setattr(quantiles, "NEAR", near)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    x = "CASE id % 4 WHEN 0 THEN pmod(xxhash64(id), 1000003) / 7D WHEN 1 THEN 5D WHEN 2 THEN IF(id % 50 = 2, double('NaN'), -id) WHEN 3 THEN IF(id % 3 = 0, NULL, 1D * id) END"
    rows = spark.sql(f"SELECT IF(id % 5 = 4, NULL, id % 5) AS k, {x} AS x FROM range(4001) UNION ALL SELECT 7L, NULL UNION ALL SELECT 8L, 3D UNION ALL SELECT 9L, id FROM range(2)")
    for keys in ([], ["k"]):
        want = rows.groupBy(*keys).agg(*(F.percentile("x", p).alias(n) for n, p in shares.items()))
        got = quantiles.exact_percentiles(rows, keys, F.col("x"), shares)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_task_collects_all_values(spark):
    rows = spark.sql("SELECT 1 AS label, double(id) AS value FROM range(200000)")
    for df, name, want in (
        (statistics.colour_range(rows, "value"), "low", 99975.0),
        (statistics.percentiles(rows, ["label"], "value"), "p50", 99999.5),
        (emissions.median_by_label(rows), "median", 99999.5),
    ):
        assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString() and "median(" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert math.isclose(df.first()[name], want)
