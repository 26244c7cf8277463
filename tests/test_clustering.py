"""Clusters of state-vector elements: limits, budgets, reproducibility."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmill.operators import clustering, plumes, statevector

CELLS = "cell_id long, lat double, lon double, sensitivity double"


def grid(spark, n=500, seed=1, scale=0.3):
    rng = np.random.default_rng(seed)
    rows = [(k, 30 + 0.25 * (k // 25), -100 + 0.3125 * (k % 25), float(scale * rng.exponential() ** 3)) for k in range(n)]
    return spark.createDataFrame(rows, CELLS), rows


def sizes(out):
    return Counter(r["label"] for r in out)


def native(rows, n_elements, largest, threshold):
    """Cells that the first level keeps: greedy, with labels and cells reserved for the rest."""
    kept, left = [], len(rows)
    for _, _, _, s, k in sorted((-r[3], r[0], 0, r[3], r[0]) for r in rows):
        after, labels = left - len(kept) - 1, n_elements - len(kept) - 1
        if s < threshold or after < labels or -(-after // largest) > labels:
            break
        kept.append(k)
    return kept


@pytest.mark.parametrize(("n_elements", "largest", "threshold"), [(120, 6, None), (90, 6, 0.5), (84, 6, None), (100, 5, 1e9)])
def test_budget_is_exact_and_no_cluster_is_too_large(spark, n_elements, largest, threshold):
    cells, rows = grid(spark)
    out = clustering.aggregate_clusters(cells, n_elements, largest, threshold).collect()
    assert sorted(r["cell_id"] for r in out) == list(range(500))
    assert sorted(sizes(out)) == list(range(1, n_elements + 1)) and max(sizes(out).values()) <= largest
    first = min(1.0, sum(r[3] for r in rows) / n_elements) if threshold is None else threshold
    want = native(rows, n_elements, largest, first)
    got = {r["label"]: r["cell_id"] for r in out}
    assert [got[k + 1] for k in range(len(want))] == want  # the greatest first
    assert all(sizes(out)[k + 1] == 1 for k in range(len(want)))


def test_levels_meet_the_threshold(spark):
    cells, rows = grid(spark, scale=0.05)
    value = {r[0]: r[3] for r in rows}
    out = clustering.aggregate_clusters(cells, 110, 8, 0.4).collect()
    total, size = defaultdict(float), sizes(out)
    for r in out:
        total[r["label"]] += value[r["cell_id"]]
    informed = [k for k in sorted(size) if total[k] >= 0.4]
    assert informed[: len(informed) // 2] == list(range(1, len(informed) // 2 + 1)) and max(size.values()) <= 8 and len(size) == 110


def test_one_dense_spot_is_cut_into_equal_runs(spark):
    """k-means would put 300 cells at one place into one cluster."""
    rows = [(k, 30.0, -100.0, 0.001) if k < 300 else (k, 40.0 + k, -50.0, 0.001) for k in range(320)]
    out = clustering.aggregate_clusters(spark.createDataFrame(rows, CELLS), 40, 8, 1.0).collect()
    assert len(sizes(out)) == 40 and max(sizes(out).values()) <= 8
    with pytest.raises(ValueError, match="can't be"):
        clustering.aggregate_clusters(spark.createDataFrame(rows, CELLS), 39, 8, 1.0)
    none = spark.createDataFrame([(1, 1.0, 1.0, None), (2, 2.0, 2.0, 0.1), (3, 2.0, 2.0, 0.2)], CELLS)
    assert {r["cell_id"]: r["label"] for r in clustering.aggregate_clusters(none, 2, 2).collect()}.keys() == {2, 3}


def test_balanced_sizes(spark):
    cells, _ = grid(spark, 101)
    found = Counter(r["cluster"] for r in clustering.balanced(cells, 7).collect())
    assert sorted(found) == list(range(1, 8)) and set(found.values()) <= {14, 15}


def test_mini_batches_come_near_full_k_means(spark):
    cells, _ = grid(spark, 2000, scale=0.1)
    full = clustering.inertia(clustering.cluster(cells, 20))
    once = clustering.cluster(cells, 20, mini_batch=True)
    again = clustering.cluster(cells.repartition(7), 20, mini_batch=True)
    assert clustering.inertia(once) <= 1.05 * full
    assert {r["cell_id"]: r["cluster"] for r in once.collect()} == {r["cell_id"]: r["cluster"] for r in again.collect()}


def test_countries_part_clusters(spark):
    rows = [(k, 30.0 + 0.01 * k, 0.0, 0.1, 10.0 if k % 2 else 60.0, 5.0) for k in range(40)]
    cells = spark.createDataFrame(rows, CELLS + ", country_lat double, country_lon double")
    for mini in (False, True):
        out = clustering.cluster(cells, 2, mini_batch=mini, countries=True).collect()
        assert len({(r["cluster"], r["cell_id"] % 2) for r in out}) == 2


def test_reduced_state_vector_keeps_its_buffer(spark):
    cells, _ = grid(spark, 100)
    labelled = cells.withColumn("label", F.col("cell_id").cast("int") + 1)
    out = clustering.reduce_state_vector(labelled, 30, 90, 5)
    got = {r["cell_id"]: r["label"] for r in out.collect()}
    assert len(got) == 100 and [got[k] for k in range(90, 100)] == list(range(21, 31)) and set(got[k] for k in range(90)) == set(range(1, 21))


def test_state_vector_of_a_region_and_of_the_globe(spark):
    rows = [(i * 100 + j, i, j, 10.0 + j, 20.0 + i) for i in range(20) for j in range(16)]
    cells = spark.createDataFrame(rows, "cell_id long, i int, j int, lat double, lon double")
    flux = spark.createDataFrame([(r[0], 0.0 if r[1] == 9 else 5.0) for r in rows if r[0] != 1008], "cell_id long, flux double")
    out = statevector.make_state_vector(cells, flux, (27.0, 32.0, 15.0, 20.0), (4.0, 3.0), (1.0, 1.0), 1.0).collect()
    by = {(r["i"], r["j"]): r for r in out}
    assert {(r["i"], r["j"]) for r in out} == {(i, j) for i in range(3, 17) for j in range(2, 14)}
    kind = {k: r["kind"] for k, r in by.items()}
    assert kind[3, 5] == kind[16, 5] == kind[8, 2] == kind[8, 13] == kind[9, 8] == "unused"  # the edge, and low emissions
    assert kind[7, 5] == kind[12, 10] == kind[10, 8] == "roi" and kind[6, 5] == kind[8, 11] == "buffer"
    roi = sorted(((r["j"], r["i"]), r["label"]) for r in out if r["kind"] == "roi")
    assert [n for _, n in roi] == list(range(len(roi), 0, -1))
    buffer = {r["label"] for r in out if r["kind"] == "buffer"}
    n = sum(r["kind"] == "buffer" for r in out)
    assert buffer == set(range(len(roi) + 1, len(roi) + n // 4 + 1)) and all(r["label"] is None for r in out if r["kind"] == "unused")
    with pytest.raises(ValueError, match="reaches beyond"):
        statevector.make_state_vector(cells, flux, (27.0, 60.0, 15.0, 20.0))
    globe = spark.createDataFrame([(k, k, 0, -80.0 + 20 * k, 0.0) for k in range(9)], "cell_id long, i int, j int, lat double, lon double")
    got = statevector.make_state_vector(globe, globe.select("cell_id", F.lit(1.0).alias("flux")), None).collect()
    assert {r["cell_id"]: r["label"] for r in got} == {k: 9 - k for k in range(1, 9)}


def test_points_within_the_labels_box(spark):
    points = spark.createDataFrame([(1, 10.0, 5.0), (2, 0.0, 5.0), (3, 179.0, 5.0), (4, -179.0, 5.0)], "id int, lon double, lat double")
    near = spark.createDataFrame([(0.0, 0.0, 1), (10.0, 20.0, 2), (80.0, 100.0, None)], "lat double, lon double, label int")
    far = spark.createDataFrame([(0.0, -170.0, 1), (10.0, 175.0, 2)], "lat double, lon double, label int")
    found = lambda cells: sorted(r["id"] for r in plumes.within_labels(points, cells).collect())
    assert found(near) == [1] and found(far) == [3, 4] and found(near.filter("label is null")) == []
