"""Ensembles over hyper-parameters: sums for every observation error in one pass, members solved on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import observation_variance
from .inversion import Elements, prior_covariance, qualified, solve_gaussian, solve_lognormal

#: Hyper-parameters and what they are where none is given.
DEFAULTS = {"prior_err": 0.5, "gamma": 1.0, "err_bc": 0.0, "err_oh": 0.0, "err_buffer": 0.5}


def observation_variances(obs_errs: list[float], count: str = "obs_count"):
    """One variance of an observation for each error: it isn't in proportion to the error, as transport has an error of its own."""
    return F.array(*(observation_variance(F.lit(float(e)), F.col(count)) for e in obs_errs))


def normal_stack(rows: DataFrame, n: int, m: int) -> DataFrame:
    """(err, i, row): K'dy and the rows of K'K of ``rows(k, residual, variances)``, for each of ``m`` variances.

    Observations are read once, whatever ``m``. Each task sums its own blocks in
    Arrow batches; they add up in m n groups of a row for each task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, n, n + 1))
        for batch in batches:
            k = np.asarray(batch.column("k").flatten(), float).reshape(batch.num_rows, n)
            y = batch.column("residual").to_numpy(zero_copy_only=False)
            variances = np.asarray(batch.column("variances").flatten(), float).reshape(batch.num_rows, m)
            for err in range(m):
                weighted = k / variances[:, err, None]
                total[err, :, 1:] += weighted.T @ k
                total[err, :, 0] += weighted.T @ y
        for err in range(m):
            yield pa.record_batch([pa.array(np.full(n, err), pa.int32()), pa.array(np.arange(1, n + 1), pa.int32()), pa.array(list(total[err]))], names=["err", "i", "row"])

    def added(table: pa.Table) -> pa.Table:
        found = np.zeros(n + 1)
        for row in table.column("row").chunks:
            found += np.asarray(row.flatten(), float).reshape(len(row), n + 1).sum(axis=0)
        return pa.table({"err": table.column("err").slice(0, 1), "i": table.column("i").slice(0, 1), "row": pa.array([found], pa.list_(pa.float64()))})

    parts = rows.select("k", "residual", "variances").mapInArrow(partial, "err int, i int, row array<double>")
    return parts.groupBy("err", "i").applyInArrow(added, "err int, i int, row array<double>")


def collect_stack(stack: DataFrame, n: int, m: int) -> np.ndarray:
    """The sums on the driver: m n (n + 1) numbers, whatever the number of observations."""
    out = np.zeros((m, n, n + 1))
    found = stack.toArrow()
    for err, i, row in zip(found.column("err").to_pylist(), found.column("i").to_pylist(), found.column("row"), strict=True):
        out[err, i - 1] = row.values.to_numpy()
    return out


@dataclass(frozen=True)
class Problem:
    """What all members share: the elements, correlations of the prior, relative errors by element, and the kind of errors.

    ``correlation`` covers the first elements, the rest have none. ``spread``
    multiplies each member's prior error by element. With ``lognormal`` the
    prior error is a geometric deviation, and the last ``n_buffer`` emission
    elements are normal with the member's ``err_buffer``.
    """

    elements: Elements
    correlation: np.ndarray | None = None
    spread: np.ndarray | None = None
    lognormal: bool = False
    n_buffer: int = 0


def grid(lists: dict[str, list[float]]) -> list[dict]:
    """All combinations of hyper-parameters, numbered in the order given."""
    names = list(lists)
    return [{"member": k, **dict(zip(names, map(float, v), strict=True))} for k, v in enumerate(product(*lists.values()))]


def _solve(sums: np.ndarray, p: dict, problem: Problem):
    e, kty, ktk = problem.elements, sums[:, 0], sums[:, 1:]
    h = DEFAULTS | p
    sigma = h["prior_err"] if problem.spread is None else h["prior_err"] * problem.spread
    if not problem.lognormal:
        return solve_gaussian(ktk, kty, e, *prior_covariance(e, sigma, h["err_bc"], h["err_oh"], problem.correlation), h["gamma"])
    start = np.where(e.is_bc, 0.0, 1.0)
    return solve_lognormal(ktk, kty + ktk @ start, e, problem.n_buffer, sigma, h["gamma"], h["err_buffer"], h["err_bc"], h["err_oh"])


SOLVED = "member int, elem int, ja double, dofs double, xhat double, variance double, averaging_kernel double, s_post array<double>, kernel array<double>"


def solve_members(stack: np.ndarray, obs_errs: list[float], members: list[dict], problem: Problem, spark) -> DataFrame:
    """A row for each member and element: Ja, the trace of the kernel, the posterior, and the element's rows of S and A.

    Members are independent, so each is a task of its own; the sums go to the
    executors once. Nothing of size n^2 comes back to the driver.
    """
    sent = spark.sparkContext.broadcast((stack, problem))
    at = {float(e): k for k, e in enumerate(obs_errs)}
    names = [c for c in members[0] if c != "member"]
    table = spark.createDataFrame([(m["member"], at[m.get("obs_err", float(obs_errs[0]))], [m[c] for c in names]) for m in members], "member int, err int, p array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shared = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                s = _solve(sums[r["err"]], dict(zip(names, r["p"], strict=True)), shared)
                n, dofs = len(s.xhat), float(np.trace(s.a))
                for lo in range(0, n, 256):
                    k = np.arange(lo, min(n, lo + 256))
                    columns = [np.full(len(k), r["member"], np.int32), (k + 1).astype(np.int32), np.full(len(k), s.ja), np.full(len(k), dofs), s.xhat[k], s.s_post[k, k], s.a[k, k]]
                    yield pa.record_batch([*map(pa.array, columns), pa.array(list(s.s_post[k])), pa.array(list(s.a[k]))], names=[c.split()[0] for c in SOLVED.split(", ")])

    return table.repartition(len(members), "member").mapInArrow(run, SOLVED)


def member_table(solved: DataFrame, members: list[dict]) -> DataFrame:
    """(member, hyper-parameters, ja, dofs), a row a member."""
    names = list(members[0])
    given = solved.sparkSession.createDataFrame([tuple(m.values()) for m in members], ", ".join(f"{c} {'int' if c == 'member' else 'double'}" for c in names))
    return given.join(solved.filter("elem = 1").select("member", "ja", "dofs"), "member")


def ensemble_mean(solved: DataFrame, members: DataFrame) -> DataFrame:
    """(elem, xhat, variance, averaging_kernel): means over the members whose Ja qualifies, over all if none does."""
    good = qualified(members).select("member")
    return solved.join(F.broadcast(good), "member", "left_semi").groupBy("elem").agg(*(F.avg(c).alias(c) for c in ("xhat", "variance", "averaging_kernel")))


def mean_matrix(solved: DataFrame, members: DataFrame, column: str = "s_post") -> DataFrame:
    """(i, j, value) of the mean of ``s_post`` or ``kernel`` over the members that qualify."""
    rows = solved.join(F.broadcast(qualified(members).select("member")), "member", "left_semi").select(F.col("elem").alias("i"), F.posexplode(column).alias("j", "value"))
    return rows.groupBy("i", (F.col("j") + 1).alias("j")).agg(F.avg("value").alias("value"))
