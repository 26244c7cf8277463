"""Clustering of state-vector elements: k-means, mini-batch k-means, and aggregation level by level under a budget of elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unit_sphere
from ..sources.scratch import Saved
from .statevector import RADIUS, shift_buffer, split_buffer

#: Weights of place (x, y, z) and sensitivity, and of the country's place.
WEIGHTS, COUNTRY_WEIGHT = (10.0, 10.0, 10.0, 1.0), 10.0
#: Cells of a mini-batch, rounds, and cells that the first centres are drawn from, at least ten a centre; all whatever the number of cells.
BATCH, ROUNDS, FIRST = 4096, 8, 20_000


def with_features(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, countries: bool = False) -> DataFrame:
    """``cells(cell_id, lat, lon, sensitivity)`` with ``_f``: place on the sphere, sensitivity and, with ``countries``, the
    place of (country_lat, country_lon); each less its mean, over its population deviation, times its weight. A feature that doesn't vary is 0."""
    columns = [*unit_sphere(F.col("lat"), F.col("lon"), RADIUS), F.col("sensitivity").cast("double")]
    if countries:
        columns += unit_sphere(F.col("country_lat"), F.col("country_lon"), RADIUS)
        weights = (*weights, *[COUNTRY_WEIGHT] * 3)
    rows = cells.withColumn("_raw", F.array(*columns))
    at = range(len(columns))
    stats = rows.agg(F.array(*(F.avg(F.col("_raw")[k]) for k in at)).alias("_mean"), F.array(*(F.stddev_pop(F.col("_raw")[k]) for k in at)).alias("_dev"))
    scaled = [F.coalesce(F.try_divide(F.col("_raw")[k] - F.col("_mean")[k], F.col("_dev")[k]), F.lit(0.0)) * w for k, w in zip(at, weights, strict=True)]
    return rows.join(F.broadcast(stats)).withColumn("_f", F.array(*scaled)).drop("_raw", "_mean", "_dev")


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre, the first on ties, and the squared distance."""
    at, found = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), 2048):
        d = (x[lo : lo + 2048] ** 2).sum(1)[:, None] - 2 * x[lo : lo + 2048] @ centres.T + (centres**2).sum(1)
        at[lo : lo + 2048] = d.argmin(1)
        found[lo : lo + 2048] = np.maximum(0, d.min(1))
    return at, found


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("_f").flatten(), float).reshape(batch.num_rows, -1)


def first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn by its squared distance from those before it."""
    centres = [x[int(rng.integers(len(x)))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        pick = int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x)))
        centres.append(x[pick])
        far = np.minimum(far, ((x - x[pick]) ** 2).sum(1))
    return np.array(centres)


def settled_centres(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 4, steps: int = 12) -> np.ndarray:
    """The best of some starts, each after a few steps over all of x."""
    best, least = None, np.inf
    for _ in range(starts):
        centres = first_centres(x, k, rng)
        for _ in range(steps):
            at, _ = _nearest(x, centres)
            count = np.bincount(at, minlength=k)
            total = np.zeros_like(centres)
            np.add.at(total, at, x)
            centres = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], centres)
        far = _nearest(x, centres)[1].sum()
        if far < least:
            best, least = centres, far
    return best


def mini_batch_centres(rows: DataFrame, k: int, seed: int, batch: int = BATCH, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of k clusters of ``rows(cell_id, _f)``: each round assigns a batch on the executors and moves centres by its sums.

    A batch is the cells whose hashed id and round are small enough, so it is
    the same however the cells are dealt out, as are the cells that the first
    centres are settled on; both have a bounded expected size. Centres weigh as
    much as the cells they have seen. The driver holds that sample, k centres and
    the sums of k clusters.
    """
    n = max(1, rows.count())
    drawn = lambda salt, most: F.pmod(F.xxhash64("cell_id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, most / n)))
    some = rows.filter(drawn(-1, max(FIRST, 10 * k))).select("cell_id", "_f").toArrow().sort_by("cell_id")
    x = np.array(some.column("_f").to_pylist(), float)
    centres = settled_centres(x, min(k, len(x)), np.random.default_rng(seed))
    seen = np.bincount(_nearest(x, centres)[0], minlength=len(centres)).astype(float)

    def sums(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for b in batches:
                f = _features(b)
                at, _ = _nearest(f, centres)
                np.add.at(total, at, f)
                count += np.bincount(at, minlength=len(centres))
            hit = np.flatnonzero(count)
            yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(count[hit]), pa.array(list(total[hit]), pa.list_(pa.float64()))], names=["c", "n", "sum"])

        return run

    for turn in range(rounds):
        found: dict = {}
        for r in rows.filter(drawn(turn, batch)).select("_f").mapInArrow(sums(centres), "c int, n long, sum array<double>").toLocalIterator():
            n_before, s = found.get(r["c"], (0, 0.0))
            found[r["c"]] = (n_before + r["n"], s + np.array(r["sum"]))
        for c, (m, s) in found.items():
            seen[c] += m
            centres[c] += (s - m * centres[c]) / seen[c]
    return centres


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    @F.arrow_udf("int")
    def nearest(f: pa.Array) -> pa.Array:
        x = np.asarray(f.flatten(), float).reshape(len(f), -1)
        return pa.array((_nearest(x, centres)[0] + 1).astype(np.int32))

    return rows.withColumn("cluster", nearest("_f"))


def cluster(cells: DataFrame, k: int, weights: tuple[float, ...] = WEIGHTS, seed: int = 0, mini_batch: bool = False, countries: bool = False) -> DataFrame:
    """Labels 1..k of k-means over ``with_features``; null where there is no sensitivity (or, with ``countries``, no country)."""
    known = F.col("sensitivity").isNotNull() & (F.col("country_lat").isNotNull() if countries else F.lit(True))
    unknown = cells.filter(~known).withColumn("cluster", F.lit(None).cast("int"))
    if k == 1:
        return cells.filter(known).withColumn("cluster", F.lit(1)).unionByName(unknown)
    rows = with_features(cells.filter(known), weights, countries)
    if mini_batch:
        found = _assigned(rows, mini_batch_centres(rows, k, seed))
    else:
        rows = rows.withColumn("_v", array_to_vector("_f"))
        found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(rows).transform(rows).withColumn("cluster", F.col("_c") + 1).drop("_v", "_c")
    return found.drop("_f").unionByName(unknown)


def inertia(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> float:
    """Sum of squared distances of ``cells(..., cluster)`` from their cluster's mean, over ``with_features``."""
    rows = with_features(cells.filter("cluster is not null"), weights).select("cluster", F.posexplode("_f").alias("k", "x"))
    return rows.groupBy("cluster", "k").agg((F.var_pop("x") * F.count("x")).alias("s")).agg(F.sum("s")).first()[0] or 0.0


def balanced(cells: DataFrame, k: int) -> DataFrame:
    """Exactly k clusters whose sizes differ by one at most: equal runs of cells along a curve that fills the plane.

    Ranks come from the counts of ranges of the curve, so no task sorts all cells.
    """
    edge = cells.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.count("*").alias("_n"))
    unit = lambda v, lo, hi: F.floor(F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * 65535).cast("long")
    bits = lambda v: sum(((F.shiftright(v, b).bitwiseAND(F.lit(1))) * (1 << (2 * b)) for b in range(16)), F.lit(0).cast("long"))
    placed = cells.join(F.broadcast(edge)).withColumn("_z", bits(unit("lat", "a", "b")) * 2 + bits(unit("lon", "c", "d")))
    placed = placed.withColumn("_part", F.shiftright("_z", 20))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # at most 4096 parts
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_z", "cell_id")) - 1
    out = placed.join(starts, "_part").withColumn("cluster", (F.floor(rank * k / F.col("_n")) + 1).cast("int"))
    return out.select(*cells.columns, "cluster")


def _totals(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("sensitivity").alias("t"), F.count("*").alias("size"))


def _filled(left: DataFrame, k: int, largest: int, save: Saved, name: str, **how) -> DataFrame:
    """``left`` in exactly k clusters of at most ``largest`` cells: k-means if it keeps to that, else equal runs along a curve."""
    rows = save(cluster(left, k, **how), name)
    seen = rows.groupBy("cluster").count().agg(F.count("*"), F.max("count")).first()
    return rows if seen[0] == k and seen[1] <= largest else balanced(left, k)


def aggregate_clusters(cells: DataFrame, n_elements: int, largest: int, threshold: float | None = None, mini_batch: bool = False, countries: bool = False, seed: int = 0) -> DataFrame:
    """Exactly ``n_elements`` elements, labels 1.., of at most ``largest`` cells: cells that inform enough stay native, the rest are joined in coarser and coarser clusters.

    ``cells(cell_id, lat, lon, sensitivity)``. Level by level, for clusters of 1,
    2, 3, ... cells, those whose sensitivities sum to the threshold get labels,
    the greatest first, as long as enough labels are left to fill the grid with
    clusters of the largest size, and enough cells for the labels. Then, or at
    the last level, what is left fills the remaining labels. Without a
    ``threshold`` it is the sensitivity that is left over the labels that are
    left, at most 1, anew after each level that gave labels. Cells without a
    sensitivity are no elements.

    A cluster that is accepted has n_elements at most beside it, so their order
    is found in one small table; cells themselves are only joined by id.
    """
    cells = cells.filter("sensitivity is not null")
    save = Saved(cells.sparkSession, "clusters")
    how = {"seed": seed, "mini_batch": mini_batch, "countries": countries}
    n, total = cells.agg(F.count("*"), F.sum("sensitivity")).first()
    if n_elements > n or n_elements * largest < n:
        raise ValueError(f"{n} cells can't be {n_elements} elements of 1 to {largest} cells")
    auto, left, used, parts = threshold is None, cells, 0, []
    if auto:
        threshold = min(1.0, (total or 0.0) / n_elements)
    for level in range(1, largest + 1):
        room, reserved = n_elements - used, -(-n // largest)
        if n == 0 or level == largest or room <= reserved:
            break
        k = round(n / level)
        if k < 1:
            continue
        if level == 1:
            rows, key = left, "cell_id"
        else:
            rows, key = save(cluster(left, k, **how), f"level-{level}"), "cluster"
        best = _totals(rows, key).filter((F.col("t") >= threshold) & (F.col("size") <= largest)).orderBy(F.desc("t"), key).limit(room)
        order = Window.orderBy(F.desc("t"), key)
        ranked = best.select(key, (F.row_number().over(order)).alias("rank"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cells"))
        # what stays must be enough for the labels that stay, and fit into them
        after, labels = n - F.col("cells"), room - F.col("rank")
        fits = (after >= labels) & (F.ceil(after / largest) <= labels)
        ranked = save(ranked.withColumn("fits", fits), f"best-{level}")
        stop = ranked.filter("not fits").agg(F.coalesce(F.min("rank"), F.lit(n_elements + 1))).first()[0]
        numbered = ranked.filter(F.col("rank") < stop).select(key, (F.col("rank") + used).alias("label"))
        taken = rows.join(F.broadcast(numbered), key).select(*cells.columns, "label")
        taken = save(taken, f"taken-{level}")
        got = taken.agg(F.count("*"), F.coalesce(F.max("label"), F.lit(used)), F.sum("sensitivity")).first()
        if got[0]:
            parts.append(taken)
            left = save(left.join(taken.select("cell_id"), "cell_id", "left_anti"), f"left-{level}")
            n, used, total = n - got[0], got[1], total - got[2]
            if auto and n_elements > used:
                threshold = min(1.0, total / (n_elements - used))
    if n:
        rest = _filled(left, n_elements - used, largest, save, "rest", **how)
        order = Window.orderBy(F.desc("t"), "cluster")
        numbered = _totals(rest, "cluster").select("cluster", (F.row_number().over(order) + used).alias("label"))
        parts.append(rest.join(F.broadcast(numbered), "cluster").select(*cells.columns, "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reduce_state_vector(cells: DataFrame, n_elements: int, last_roi: int, largest: int, **how) -> DataFrame:
    """(cell_id, label): a state vector of ``n_elements`` from the native one, whose buffer elements, the labels after ``last_roi``, stay as they are.

    ``cells(cell_id, lat, lon, label, sensitivity)``; ``how`` as for
    ``aggregate_clusters``. Buffer labels follow the new region's without a gap.
    Cells of the region without a sensitivity have no label.
    """
    top = cells.agg(F.max("label")).first()[0]
    n_buffer = top - last_roi
    split = split_buffer(cells, n_buffer)
    roi = aggregate_clusters(split.filter("roi_label > 0").drop("label", "roi_label", "buffer_label"), n_elements - n_buffer, largest, **how)
    buffer = shift_buffer(split.filter("buffer_label > 0"), last_roi - (n_elements - n_buffer))
    return roi.select("cell_id", F.col("label").cast("long").alias("label")).unionByName(buffer.select("cell_id", F.col("buffer_label").cast("long").alias("label")))
