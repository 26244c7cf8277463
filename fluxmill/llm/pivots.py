"""Exact cosine range join by pivots: Voronoi cells, boundary replication, independent cells."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .texts import BATCH_BYTES, bounded_batches

#: Vectors that a cell should hold, and the most pivots: with 64 doubles each they take 0.5 MB.
CELL, MAX_PIVOTS = 4096, 1024
#: Most vectors on one side of a block; a cell of any size is cut into such blocks. A block's products,
#: and the links they give, are made and counted STRIP rows at a time.
BLOCK, STRIP = 4096, 512
_TOLERANCE = 1e-9
#: Salts are below this.
SALT = 1 << 30


#: Rows whose distances to all pivots are held at once.
ROWS = 1024


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column whose lists all have ``dim`` elements, and which rows are usable."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)  # nulls become NaN
    ok = np.isfinite(x).all(axis=1)
    x[~ok] = 0
    top = np.abs(x).max(axis=1, initial=0)
    x /= np.where(top > 0, top, 1)[:, None]  # no overflow in the squares
    norm = np.linalg.norm(x, axis=1)
    ok &= norm > 0
    return x / np.where(norm > 0, norm, 1)[:, None] + 0.0, ok


def _by_length(batch: pa.RecordBatch, name: str, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose lists have one length, of at most ``rows`` rows; null and empty lists are left out."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        for k in range(0, len(at), rows):
            yield dim, batch.take(pa.array(at[k : k + rows]))


def _matrix(column, n: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(n, -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _homes(x: np.ndarray, pivots: np.ndarray, between: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and the lower cells that the triangle inequality can't rule out.

    If w lies in the cell of pivot q and d(v, w) <= reach, then
    d(v, q) <= d(v, p) + 2 reach for the pivot p nearest to v; in Euclidean
    space the plane between p and q bounds it more tightly:
    (d(v, q)^2 - d(v, p)^2) / 2 d(p, q) <= reach. The lower of two cells joins
    their pairs, so each pair has one place.
    """
    d = _distances(x, pivots)
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home][:, None]
    near = (d <= own + 2 * reach + _TOLERANCE) & (d**2 - own**2 <= 2 * reach * between[home] + _TOLERANCE)
    return home, near & (np.arange(len(pivots)) < home[:, None])


@dataclass
class _Grid:
    """The pivots of the vectors of one length, their distances, and the number of the first one's cell."""

    pivots: np.ndarray
    between: np.ndarray
    first: int


def _cells(grids: dict[int, _Grid], reach: float, home_blocks: np.ndarray, guest_blocks: np.ndarray):
    """Deals each vector to the blocks (i, j) of its own cell and of the lower cells it may have partners in.

    A cell's blocks are numbered: first its own vectors', then its guests'.
    Own blocks meet each other, i <= j, and all guests' blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in (p for b in batches for p in _by_length(b, "unit", ROWS)):
            grid = grids[dim]
            raw, salt = batch.column("unit"), batch.column("salt").to_numpy()
            home, guest = _homes(_matrix(raw, batch.num_rows), grid.pivots, grid.between, reach)
            home = home + grid.first
            n = (home_blocks + guest_blocks)[home]
            rows = np.repeat(np.arange(len(home)), n)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            mine = (salt % home_blocks[home])[rows]
            who, where = np.nonzero(guest)
            where = where + grid.first
            n = home_blocks[where]
            at = np.repeat(np.arange(len(who)), n)
            meets = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            seat = (home_blocks[where] + salt[who] % np.maximum(1, guest_blocks[where]))[at]
            rows, cells = np.concatenate([rows, who[at]]), np.concatenate([home[rows], where[at]])
            block, other = np.concatenate([mine, seat]), np.concatenate([other, meets])
            i, j = np.minimum(block, other), np.maximum(block, other)
            step = max(1, BATCH_BYTES // (8 * dim))
            for k in range(0, len(rows), step):
                part = slice(k, k + step)
                take = pa.array(rows[part])
                yield pa.record_batch(
                    [pa.array(cells[part], pa.int32()), pa.array(i[part], pa.int32()), pa.array(j[part], pa.int32()), pa.array(block[part], pa.int32()),
                     batch.column("vec_id").take(take), batch.column("copies").take(take), raw.take(take)],
                    names=["cell", "i", "j", "block", "vec_id", "copies", "unit"],
                )

    return run


def _sizes(grids: dict[int, _Grid], reach: float):
    """How many vectors live in, and how many are guests of, each cell; one row per cell and task."""
    n_cells = sum(len(g.pivots) for g in grids.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_home, n_guest = np.zeros(n_cells, np.int64), np.zeros(n_cells, np.int64)
        for dim, batch in (p for b in batches for p in _by_length(b, "unit", ROWS)):
            grid = grids[dim]
            home, guest = _homes(_matrix(batch.column("unit"), batch.num_rows), grid.pivots, grid.between, reach)
            its = slice(grid.first, grid.first + len(grid.pivots))
            n_home[its] += np.bincount(home, minlength=len(grid.pivots))
            n_guest[its] += guest.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(n_cells), pa.int32()), pa.array(n_home), pa.array(n_guest)], names=["cell", "n_home", "n_guest"])

    return run


def _grids(nodes: DataFrame, cell: int, max_pivots: int) -> dict[int, _Grid]:
    """Pivots for each length of vectors: those of the least salt, among a sample some four times as large."""
    spark = nodes.sparkSession
    counts = {r["dim"]: r["count"] for r in nodes.groupBy(F.size("unit").alias("dim")).count().collect()}
    wanted = {d: max(1, min(max_pivots, n // cell)) for d, n in counts.items()}
    if not wanted:
        return {}
    rows = [(d, w, min(SALT, int(SALT * (4 * w + 12) / counts[d]))) for d, w in wanted.items()]
    limits = spark.createDataFrame(rows, "dim int, wanted int, most long")
    sample = nodes.select("vec_id", "salt", "unit", F.size("unit").alias("dim")).join(F.broadcast(limits), "dim").filter("salt < most")
    best = sample.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy("salt", "vec_id"))).filter("rank <= wanted")
    found: dict[int, list] = {}
    for r in best.select("dim", "unit").toLocalIterator():
        found.setdefault(r["dim"], []).append(r["unit"])
    out, first = {}, 0
    for d in sorted(wanted):
        pivots = np.array(found[d], float) if d in found else np.eye(1, d)  # any point may be a pivot
        out[d] = _Grid(pivots, _distances(pivots, pivots), first)
        first += len(pivots)
    return out


def _merged(root: np.ndarray, links: np.ndarray) -> np.ndarray:
    """``root``, the least node of each node's component, after ``links`` have joined components."""
    links = root[links]
    links = links[links[:, 0] != links[:, 1]]
    while len(links):
        up = np.arange(len(root))
        np.minimum.at(up, links.max(axis=1), links.min(axis=1))
        while (up[up] != up).any():
            up = up[up]
        root, links = up[root], up[links]
        links = links[links[:, 0] != links[:, 1]]
    return root


def _joined(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        x = _matrix(table.column("unit"), len(ids))
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        # single precision proposes with room for its rounding, double precision decides
        one, two = x[a].astype(np.float32), x[b].astype(np.float32).T
        for k in range(0, len(a) if len(b) else 0, STRIP):
            skip = k if i == j else 0  # within a block, what lies before is done
            at = np.flatnonzero(one[k : k + STRIP] @ two[:, skip:] >= threshold - 1e-4)
            left, right = at // (len(b) - skip) + k, at % (len(b) - skip) + skip
            if i == j:
                left, right = left[left < right], right[left < right]
            left, right = a[left], b[right]
            exact = [np.einsum("ij,ij->i", x[left[c : c + 100_000]], x[right[c : c + 100_000]]) for c in range(0, len(left), 100_000)]
            keep = np.concatenate([*exact, np.empty(0)]) >= threshold
            left, right = left[keep], right[keep]
            np.add.at(n, left, copies[right])
            np.add.at(n, right, copies[left])
            root = _merged(root, np.stack([left, right], axis=1))
        linked = np.flatnonzero(n > 0)
        return pa.table({"vec_id": ids[linked], "n": n[linked], "other": ids[root[linked]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, cell: int = CELL, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors(vec_id, embedding)``.

    Links join vectors whose cosine, in double precision, is ``threshold`` or
    more: on unit vectors a metric range join at distance sqrt(2 - 2 threshold).
    Equal unit vectors fall together first and count as linked copies.
    ``max_pivots`` vectors at most, taken by the hash of their id, are pivots;
    every vector is placed, whatever the pivots. A cell's blocks of ``block`` by
    ``block`` vectors are joined in their own tasks, so no cell, however large,
    is gathered, and each task gives a row a vector, not a row a link. Each pair
    of vectors meets in one task.

    Vectors that are null, empty, zero, or that hold nulls or non-finite values
    link with nothing; nor do rows with a null vec_id. Vectors link with those of
    their own length, each length with pivots of its own. Rows that repeat a vec_id with the same vector are
    copies; each gets its row. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pivots")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("embedding")), 0).to_numpy(zero_copy_only=False)
            without = batch.column("vec_id").filter(pa.array(lengths == 0))
            yield pa.record_batch([without, pa.nulls(len(without), pa.list_(pa.float64())), pa.nulls(len(without), pa.binary())], names=["vec_id", "unit", "name"])
            for dim, part in _by_length(batch, "embedding", 4 * ROWS):
                ids = part.column("vec_id")
                x, ok = _unit(part.column("embedding"), dim)
                ok &= ~np.asarray(ids.is_null())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()), mask=pa.array(~ok))
                names = [hashlib.sha256(row.tobytes()).digest() if k else None for row, k in zip(x, ok, strict=True)]
                yield pa.record_batch([ids, lists, pa.array(names, pa.binary())], names=["vec_id", "unit", "name"])

    units = scratch.save(rows.mapInArrow(unit, "vec_id long, unit array<double>, name binary"), "units")
    named = units.filter("unit is not null")
    groups = named.groupBy("name").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = named.join(groups, "name").filter("vec_id = node").dropDuplicates(["node", "name"])
    nodes = scratch.save(nodes.select(F.col("node").alias("vec_id"), "copies", "unit", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("long").alias("salt")), "nodes")
    grids = _grids(nodes, cell, max_pivots)
    if grids:
        reach = math.sqrt(2 - 2 * threshold) + 1e-9
        sizes = nodes.select("unit").mapInArrow(_sizes(grids, reach), "cell int, n_home long, n_guest long").groupBy("cell").agg(F.sum("n_home").alias("h"), F.sum("n_guest").alias("g")).collect()
        n_cells = sum(len(g.pivots) for g in grids.values())
        home_blocks, guest_blocks = np.ones(n_cells, np.int64), np.zeros(n_cells, np.int64)
        for r in sizes:
            home_blocks[r["cell"]], guest_blocks[r["cell"]] = max(1, -(-r["h"] // block)), -(-r["g"] // block)
        dealt = nodes.mapInArrow(_cells(grids, reach, home_blocks, guest_blocks), "cell int, i int, j int, block int, vec_id long, copies long, unit array<double>")
        found = scratch.save(dealt.groupBy("cell", "i", "j").applyInArrow(_joined(threshold), "vec_id long, n long, other long"), "found")
    else:
        found = spark.createDataFrame([], "vec_id long, n long, other long")
    links = found.filter("vec_id <> other").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    reached = connected_components(links, scratch, "cc")
    totals = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    per_name = (
        groups.join(totals.withColumnRenamed("vec_id", "node"), "node", "left").join(reached, "node", "left")
        .select("name", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    out = (
        named.select("vec_id", "name").join(per_name, "name")
        .select("vec_id", "n_links", F.col("component").alias("component_id"))
        .union(units.filter("unit is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
    out = scratch.save(out, "result")
    scratch.keep_only("result")
    return out
