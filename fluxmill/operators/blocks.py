"""Symmetric matrices in blocks, for state vectors whose matrices no single machine should hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Saved

BLOCK = "bi int, bj int, block binary"


def _array(block: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(block, "<f8").reshape(rows, columns)


def width(b: int, n: int, size: int) -> int:
    return min(size, n - b * size)


def to_blocks(entries: DataFrame, n: int, size: int) -> DataFrame:
    """``entries(i, j, value)`` with indices from 1 as (bi, bj, block): every block, also those without entries, which are zero."""
    edge = -(-n // size)
    spark = entries.sparkSession
    every = spark.range(edge * edge).select((F.col("id") / edge).cast("int").alias("bi"), (F.col("id") % edge).cast("int").alias("bj"))
    at = lambda c: (F.floor((F.col(c) - 1) / size)).cast("int")
    placed = entries.select(at("i").alias("bi"), at("j").alias("bj"), ((F.col("i") - 1) % size).cast("int").alias("r"), ((F.col("j") - 1) % size).cast("int").alias("c"), F.col("value").cast("double").alias("value"))
    rows = placed.unionByName(every.select("bi", "bj", F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("value")))

    def build(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        out = np.zeros((width(bi, n, size), width(bj, n, size)))
        np.add.at(out, (table.column("r").to_numpy(), table.column("c").to_numpy()), table.column("value").to_numpy())
        return pa.table({"bi": pa.array([bi], pa.int32()), "bj": pa.array([bj], pa.int32()), "block": pa.array([out.tobytes()], pa.binary())})

    return rows.groupBy("bi", "bj").applyInArrow(build, BLOCK)


def to_entries(blocks: DataFrame, n: int, size: int) -> DataFrame:
    """(i, j, value) of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _array(r["block"], width(r["bi"], n, size), width(r["bj"], n, size))
                i, j = np.indices(x.shape)
                yield pa.record_batch([pa.array((i + 1 + r["bi"] * size).ravel().astype(np.int32)), pa.array((j + 1 + r["bj"] * size).ravel().astype(np.int32)), pa.array(x.ravel())], names=["i", "j", "value"])

    return blocks.mapInArrow(run, "i int, j int, value double")


def combined(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """factor a + b, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(factor * np.frombuffer(x, "<f8") + np.frombuffer(y, "<f8")).tobytes() for x, y in zip(batch.column("block").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("bi"), batch.column("bj"), pa.array(out, pa.binary())], names=["bi", "bj", "block"])

    return a.join(b.withColumnRenamed("block", "other"), ["bi", "bj"]).mapInArrow(run, BLOCK)


def inverse(blocks: DataFrame, n: int, size: int, save: Saved, name: str) -> DataFrame:
    """Inverse of a symmetric positive definite matrix, by block elimination; any other raises.

    Step k needs block (k, k), which the driver factors by Cholesky, and each
    block's partners in block row and column k: two equi-joins. Every step is
    written, so plans stay short, and a lost executor costs one step.
    """
    for k in range(-(-n // size)):
        rows = width(k, n, size)
        pivot = _array(bytes(blocks.filter(f"bi = {k} AND bj = {k}").first()["block"]), rows, rows)
        try:
            half = np.linalg.inv(np.linalg.cholesky(pivot))
        except np.linalg.LinAlgError:
            raise ValueError(f"the matrix isn't positive definite: block {k} has no Cholesky factor") from None
        d = half.T @ half

        def step(batches: Iterator[pa.RecordBatch], k: int = k, d: np.ndarray = d) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    bi, bj = r["bi"], r["bj"]
                    x = _array(r["block"], width(bi, n, size), width(bj, n, size))
                    if bi == k:
                        x = d if bj == k else d @ x
                    elif bj == k:
                        x = -x @ d
                    else:
                        x = x - _array(r["left"], len(x), len(d)) @ d @ _array(r["up"], len(d), x.shape[1])
                    out.append(x.tobytes())
                yield pa.record_batch([batch.column("bi"), batch.column("bj"), pa.array(out, pa.binary())], names=["bi", "bj", "block"])

        left = blocks.filter(f"bj = {k}").select("bi", F.col("block").alias("left"))
        up = blocks.filter(f"bi = {k}").select("bj", F.col("block").alias("up"))
        blocks = save(blocks.join(left, "bi").join(up, "bj").select("bi", "bj", "block", "left", "up").mapInArrow(step, BLOCK), f"{name}-{k}")
    return blocks


def times(blocks: DataFrame, vector: DataFrame, n: int, size: int) -> DataFrame:
    """(i, value): the product with ``vector(i, value)``."""
    at = vector.select(F.floor((F.col("i") - 1) / size).cast("int").alias("bj"), ((F.col("i") - 1) % size).cast("int").alias("p"), "value")
    parts = at.groupBy("bj").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))), lambda x: x["value"]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _array(r["block"], width(r["bi"], n, size), width(r["bj"], n, size)) @ np.array(r["v"])
                yield pa.record_batch([pa.array(np.arange(len(x), dtype=np.int32) + 1 + r["bi"] * size), pa.array(x)], names=["i", "value"])

    return blocks.join(parts, "bj").mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))


def diagonal_of_product(a: DataFrame, b: DataFrame, n: int, size: int) -> DataFrame:
    """(i, value): the diagonal of a b, for a symmetric b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shape = width(r["bi"], n, size), width(r["bj"], n, size)
                x = (_array(r["block"], *shape) * _array(r["other"], *shape)).sum(axis=1)
                yield pa.record_batch([pa.array(np.arange(len(x), dtype=np.int32) + 1 + r["bi"] * size), pa.array(x)], names=["i", "value"])

    both = a.join(b.withColumnRenamed("block", "other"), ["bi", "bj"])
    return both.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))


def diagonal(blocks: DataFrame, n: int, size: int) -> DataFrame:
    """(i, value) of the diagonal."""
    return to_entries(blocks.filter("bi = bj"), n, size).filter("i = j").select("i", "value")


def posterior_in_blocks(equations: DataFrame, prior: DataFrame, n: int, gamma: float, size: int = 1024) -> DataFrame:
    """(elem, xhat, variance, averaging_kernel) of the Gaussian inversion of emission elements, with all matrices in blocks.

    ``equations(i, j, value)`` are K'K, and K'dy at j = 0; ``prior(i, j, value)``
    is the prior covariance. Only the n elements' vectors are ever as long as n;
    no task holds more than three blocks.
    """
    save = Saved(equations.sparkSession, "blocks")
    precision = save(inverse(save(to_blocks(prior, n, size), "prior"), n, size, save, "precision"), "precision")
    ktk = to_blocks(equations.filter("j > 0"), n, size)
    s_post = inverse(save(combined(ktk, precision, gamma), "sum"), n, size, save, "posterior")
    kty = equations.filter("j = 0").select("i", (F.col("value") * gamma).alias("value"))
    xhat = times(s_post, kty, n, size).select(F.col("i").alias("elem"), (1 + F.col("value")).alias("xhat"))
    variance = diagonal(s_post, n, size).select(F.col("i").alias("elem"), F.col("value").alias("variance"))
    kernel = diagonal_of_product(s_post, precision, n, size).select(F.col("i").alias("elem"), (1 - F.col("value")).alias("averaging_kernel"))
    return xhat.join(variance, "elem").join(kernel, "elem")
