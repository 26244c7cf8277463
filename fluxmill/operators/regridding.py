"""Conservative regridding weights between any two grids of convex cells on the sphere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import unit_sphere

WEIGHT = "dst long, src long, w double"


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[..., 1] * b[..., 2] - a[..., 2] * b[..., 1], a[..., 2] * b[..., 0] - a[..., 0] * b[..., 2], a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]], axis=-1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def against_the_clock(p: np.ndarray) -> np.ndarray:
    """Cells (rows of corners on the unit sphere) turned so that the inside is on the left of every edge."""
    middle = p.mean(axis=1)
    turn = _dot(_cross(p, np.roll(p, -1, axis=1)).sum(axis=1), middle)
    return np.where(turn[:, None, None] < 0, p[:, ::-1], p)


def clipped(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners, and their number, of what cells p share with cells q, row by row: great circles of q's edges, one after another for all rows at once."""
    count = np.full(len(p), p.shape[1])
    for edge in range(q.shape[1]):
        normal = _cross(q[:, edge], q[:, (edge + 1) % q.shape[1]])[:, None, :]
        slot = np.arange(p.shape[1])
        live = slot < count[:, None]
        after = np.where(slot + 1 < count[:, None], slot + 1, 0)
        nxt = np.take_along_axis(p, after[..., None], 1)
        d, e = _dot(p, normal), _dot(nxt, normal)
        flat = _dot(normal, normal) == 0  # a corner that is there twice bounds nothing
        d, e = np.where(flat | (np.abs(d) < 1e-15), 0.0, d), np.where(flat | (np.abs(e) < 1e-15), 0.0, e)
        crosses = live & (((d > 0) & (e < 0)) | ((d < 0) & (e > 0)))
        t = np.where(crosses, d, 0.0) / np.where(crosses, d - e, 1.0)
        cut = p + t[..., None] * (nxt - p)
        cut /= np.maximum(1e-300, np.sqrt(_dot(cut, cut)))[..., None]
        both = np.stack([p, cut], axis=2).reshape(len(p), 2 * p.shape[1], 3)
        kept = np.stack([live & (d >= 0), crosses], axis=2).reshape(len(p), 2 * p.shape[1])
        count = kept.sum(axis=1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, int(count.max(initial=0)))]
        p = np.take_along_axis(both, order[..., None], 1)
    return p, count


def areas(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Areas on the unit sphere of convex polygons of ``count`` corners, as fans of triangles."""
    total, a = np.zeros(len(p)), p[:, 0]
    for k in range(1, p.shape[1] - 1):
        b, c = p[:, k], p[:, k + 1]
        part = 2 * np.arctan2(_dot(a, _cross(b, c)), 1 + _dot(a, b) + _dot(b, c) + _dot(c, a))
        total += np.where(k + 1 < count, part, 0.0)
    return np.where(count > 2, np.maximum(0.0, total), 0.0)


def _hashed(cells: DataFrame, name: str, bins: int) -> DataFrame:
    """(name, corners on the unit sphere, bin): each cell in every bin of a cubic grid that its bounding box meets.

    Edges are great circles, which lie outside the box of their corners by their
    sagitta at most; the box is that much larger.
    """
    at = F.transform(F.arrays_zip("lats", "lons"), lambda c: F.array(*unit_sphere(c["lats"].cast("double"), c["lons"].cast("double"))))
    rows = cells.select(F.col("cell_id").cast("long").alias(name), at.alias(f"p_{name}"))
    span = lambda k: F.transform(F.col(f"p_{name}"), lambda v: v[k])
    sides = F.aggregate(F.sequence(F.lit(0), F.size(f"p_{name}") - 1), F.lit(0.0), lambda m, k: F.greatest(m, _length2(F.col(f"p_{name}"), k)))
    rows = rows.withColumn("_sag", 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - sides / 4)) + 1e-9)
    for k, axis in enumerate("xyz"):
        low, high = (F.floor((edge + 1) / 2 * bins).cast("int") for edge in (F.array_min(span(k)) - F.col("_sag"), F.array_max(span(k)) + F.col("_sag")))
        rows = rows.withColumn(f"_{axis}", F.explode(F.sequence(low, high)))
    return rows.select(name, f"p_{name}", (F.col("_x") * (bins + 2) * (bins + 2) + F.col("_y") * (bins + 2) + F.col("_z")).cast("long").alias("bin"))


def _length2(p, k):
    a, b = F.element_at(p, k + 1), F.element_at(p, F.when(k + 2 > F.size(p), 1).otherwise(k + 2))
    return sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(3)), F.lit(0.0))


def conservative_weights(source: DataFrame, target: DataFrame, bins: int = 64) -> DataFrame:
    """(dst, src, w): the share of a target cell's area that a source cell covers; w sums to one over a target that the source covers.

    Both are ``(cell_id, lats, lons)`` with the corners of convex cells in order,
    whose edges are great circles. Cells meet by an equi-join on the bins of a
    cubic grid around the sphere, of ``bins`` a side; choose them about as wide
    as the larger cells. Clipping and areas are vectorised in Arrow batches. A
    corner may be there twice, as at a pole. Cells with null corners are left
    out.
    """
    whole = lambda df: df.filter("lats is not null AND lons is not null AND NOT exists(lats, x -> x is null) AND NOT exists(lons, x -> x is null)")
    a, b = _hashed(whole(source), "src", bins), _hashed(whole(target), "dst", bins)
    pairs = a.join(b, "bin").groupBy("src", "dst").agg(F.first("p_src").alias("p_src"), F.first("p_dst").alias("p_dst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (_corners(batch.column(c)) for c in ("p_src", "p_dst"))
            p, q = against_the_clock(p), against_the_clock(q)
            shared, whole_area = areas(*clipped(p, q)), areas(q, np.full(len(q), q.shape[1]))
            w = np.divide(shared, whole_area, out=np.zeros(len(q)), where=whole_area > 0)
            some = w > 1e-12
            yield pa.record_batch([batch.column("dst").filter(pa.array(some)), batch.column("src").filter(pa.array(some)), pa.array(w[some])], names=["dst", "src", "w"])

    return pairs.mapInArrow(run, WEIGHT)


def _corners(column: pa.Array) -> np.ndarray:
    """Rows of corners; shorter ones repeat their last corner, which bounds nothing."""
    rows = [np.asarray(r, float) for r in column.to_pylist()]
    most = max((len(r) for r in rows), default=3)
    return np.array([np.concatenate([r, np.repeat(r[-1:], most - len(r), axis=0)]) for r in rows]).reshape(len(rows), most, 3)


def lattice_cells(cells: DataFrame, dlat: float, dlon: float) -> DataFrame:
    """(cell_id, lats, lons) of ``cells(cell_id, lat, lon)`` of a regular grid, cut off at the poles."""
    low, high = F.greatest(F.col("lat") - dlat / 2, F.lit(-90.0)), F.least(F.col("lat") + dlat / 2, F.lit(90.0))
    west, east = F.col("lon") - dlon / 2, F.col("lon") + dlon / 2
    return cells.select("cell_id", F.array(low, low, high, high).alias("lats"), F.array(west, east, east, west).alias("lons"))
