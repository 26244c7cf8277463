"""Sensitivities, normal equations as distributed sums, and the small dense solves on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_difference(base: DataFrame, perturbed: DataFrame, steps: DataFrame) -> DataFrame:
    """(obs_id, elem, k): (perturbed - base) / step of the element."""
    return perturbed.join(base.select("obs_id", F.col("model").alias("base")), "obs_id").join(steps, "elem").select("obs_id", "elem", ((F.col("model") - F.col("base")) / F.col("step")).alias("k"))


def checked(rows: DataFrame, *columns: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Fails on missing or non-finite values, also within ``arrays``, instead of leaving out what follows them."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = F.lit(True)
    for c in columns:
        ok &= finite(F.col(c))
    for c in arrays:
        ok &= F.col(c).isNotNull() & F.forall(c, lambda x: finite(x.cast("double")))
    columns += arrays
    first = columns[0]
    value = F.when(ok, F.col(first)).otherwise(F.raise_error(F.lit(f"missing or non-finite value in {', '.join(columns)}")).cast("double"))
    return rows.withColumn(first, value)


def normal_equations(rows: DataFrame, elements: list[str], residual: str, variance: str) -> DataFrame:
    """(i, j, value) of sum K' K / v, and (i, 0, value) of sum K' dy / v, in one pass.

    One aggregate of all products: no row is multiplied before the partial sums.
    For a few dozen elements; beyond that use the block form.
    """
    w = 1.0 / F.col(variance)
    names, sums = [], []
    for i, a in enumerate(elements, 1):
        names.append((i, 0))
        sums.append(F.sum(F.col(a) * F.col(residual) * w).alias(f"s{i}_0"))
        for j, b in enumerate(elements[:i], 1):
            names.append((i, j))
            sums.append(F.sum(F.col(a) * F.col(b) * w).alias(f"s{i}_{j}"))
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("value")) for i, j in names]
    entries += [F.struct(F.lit(j).alias("i"), F.lit(i).alias("j"), F.col(f"s{i}_{j}").alias("value")) for i, j in names if j and i != j]
    return rows.agg(*sums).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def normal_equations_blocks(rows: DataFrame, n: int) -> DataFrame:
    """(i, row): the same sums for ``rows(k array, residual, variance)``, a row of K'dy and K'K for each element.

    Each task sums its own n x (n + 1) block in Arrow batches; blocks add up row
    by row, in n groups of a row for each task.
    """

    from .ensemble import normal_stack

    return normal_stack(rows.select("k", "residual", F.array("variance").alias("variances")), n, 1).select("i", "row")


def long_form(blocks: DataFrame) -> DataFrame:
    """(i, j, value) of the rows of blocks."""
    return blocks.select("i", F.posexplode("row").alias("j", "value"))


def collect_normal(equations: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """K'K and K'dy on the driver, from either form: n (n + 1) numbers, whatever the number of observations."""
    a, b = np.zeros((n, n)), np.zeros(n)
    if "row" in equations.columns:
        found = equations.toArrow()
        for i, row in zip(found.column("i").to_pylist(), found.column("row"), strict=True):
            values = row.values.to_numpy()
            a[i - 1], b[i - 1] = values[1:], values[0]
        return a, b
    for r in equations.toLocalIterator():
        if r["j"]:
            a[r["i"] - 1, r["j"] - 1] = r["value"]
        else:
            b[r["i"] - 1] = r["value"]
    return a, b


@dataclass(frozen=True)
class Elements:
    """Order of a state vector: emissions, then 4 boundary elements, then 1 (regional) or 2 hydroxyl ones."""

    n: int
    bc: bool = False
    oh: bool = False
    regional: bool = True

    @property
    def n_oh(self) -> int:
        return (1 if self.regional else 2) * self.oh

    @property
    def is_bc(self) -> np.ndarray:
        at = np.arange(self.n)
        return (at >= self.n - self.n_oh - 4) & (at < self.n - self.n_oh) & self.bc

    @property
    def is_oh(self) -> np.ndarray:
        return np.arange(self.n) >= self.n - self.n_oh if self.oh else np.zeros(self.n, bool)


def prior_covariance(e: Elements, prior_err: float | np.ndarray, err_bc: float = 0.0, err_oh: float = 0.0, full: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The prior covariance, and the one of the solve, in which hydroxyl elements count by their share of the vector."""
    sigma = np.broadcast_to(np.asarray(prior_err, float), e.n).copy()
    sigma[e.is_bc], sigma[e.is_oh] = err_bc, err_oh
    cov = np.diag(sigma**2)
    if full is not None:
        m = len(full)
        if full.shape != (m, m) or m > e.n:
            raise ValueError(f"a prior of shape {full.shape} for {e.n} elements")
        cov[:m, :m] = full * np.outer(sigma[:m], sigma[:m])
    solve = cov.copy()
    if e.n_oh and e.n > e.n_oh:
        at = np.flatnonzero(e.is_oh)
        solve[at, at] = cov[at, at] * e.n_oh / (e.n - e.n_oh)
    return cov, solve


@dataclass
class Solution:
    xhat: np.ndarray
    s_post: np.ndarray
    a: np.ndarray
    ja: float


def solve_gaussian(ktk: np.ndarray, kty: np.ndarray, e: Elements, cov: np.ndarray, solve: np.ndarray, gamma: float) -> Solution:
    """Posterior of the Gaussian inversion; scale factors start from one, boundary elements from zero."""
    inverse, inverse_solve = np.linalg.inv(cov), np.linalg.inv(solve)
    delta = np.linalg.solve(gamma * ktk + inverse_solve, gamma * kty)
    s_post = np.linalg.inv(gamma * ktk + inverse)
    return Solution(np.where(e.is_bc, 0.0, 1.0) + delta, s_post, np.eye(e.n) - s_post @ inverse, float(delta @ inverse @ delta) / e.n)


def solve_lognormal(ktk: np.ndarray, kty: np.ndarray, e: Elements, n_buffer: int, deviation: float | np.ndarray, gamma: float, err_buffer: float = 0.5, err_bc: float = 10.0, err_oh: float = 0.5, kappa: float = 10.0, tolerance: float = 5e-3, most: int = 10_000) -> Solution:
    """Levenberg-Marquardt in the logarithm of the emission elements; buffer, boundary and hydroxyl ones are normal.

    With K' = K diag(x) the linearized products are diag(x) K'K diag(x), so the
    observations are passed over once; only matrices are iterated. ``kty`` is
    K' (y - background); ``deviation`` is the geometric one of the emissions.
    Boundary elements start from zero, the others from one. Hydroxyl elements
    count by their share of the normal ones in the steps, but not in the
    posterior. Steps end when no emission changes by ``tolerance`` of itself;
    a state that has not settled after ``most`` steps raises.
    """
    n, normal = e.n, n_buffer + 4 * e.bc + e.n_oh
    log = np.arange(n) < n - normal
    sigma = np.where(log, np.log(np.broadcast_to(np.asarray(deviation, float), n)), err_buffer)
    sigma[e.is_bc], sigma[e.is_oh] = err_bc, err_oh
    held = sigma**2
    if e.n_oh and normal > e.n_oh:
        held = np.where(e.is_oh, held * e.n_oh / (normal - e.n_oh), held)
    # medians exp(-sigma^2 / 2) give means of one
    prior = np.where(log, -0.5 * sigma**2, np.where(e.is_bc, 0.0, 1.0))
    inverse, inverse_step = np.diag(1 / sigma**2), np.diag(1 / held)
    value = lambda s: np.where(log, np.exp(np.where(log, s, 0)), s)
    state, change = prior.copy(), np.inf
    for _ in range(most):
        x = value(state)
        slope = np.where(log, x, 1.0)
        hessian = gamma * slope[:, None] * ktk * slope
        gradient = gamma * slope * (kty - ktk @ x) - inverse_step @ (state - prior)
        state = state + np.linalg.solve(hessian + (1 + kappa) * inverse_step, gradient)
        change = np.max(np.abs(value(state) - x)[log] / x[log], initial=0.0)
        if change < tolerance:
            break
    else:
        raise RuntimeError(f"the state still changes by {change:g} of itself after {most} steps")
    s_post = np.linalg.inv(hessian + inverse)
    mean = np.where(log, np.exp(state + 0.5 * np.diag(s_post)), state)
    d = (state - prior)[log]
    return Solution(mean, s_post, np.eye(n) - s_post @ inverse, float(d @ inverse[np.ix_(log, log)] @ d) / n)


def hyper_grid(spark, **lists: list[float]) -> DataFrame:
    """All combinations of hyper-parameters, numbered from 0 in the order given."""
    out = spark.range(1)
    for name, values in lists.items():
        out = out.select("*", F.posexplode(F.array(*(F.lit(float(v)) for v in values))).alias(f"_{name}", name))
    number = F.lit(0)
    for name, values in lists.items():
        number = number * len(values) + F.col(f"_{name}")
    return out.select(number.cast("int").alias("member"), *lists)


def qualified(members: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Members whose Ja is within bounds; all, if none is."""
    ok = F.col("ja").between(low, high)
    some = members.agg(F.coalesce(F.max(ok.cast("int")), F.lit(0)).alias("some"))
    return members.join(F.broadcast(some)).filter(ok | (F.col("some") == 0)).drop("some")


def default_member(members: DataFrame) -> DataFrame:
    """The member whose Ja is nearest to one; the first on ties."""
    return members.agg(F.min_by("member", F.struct(F.abs(F.col("ja") - 1), F.col("member"))).alias("member"))


def posterior_table(spark, s: Solution) -> DataFrame:
    rows = [(k + 1, float(s.xhat[k]), float(s.s_post[k, k]), float(s.a[k, k])) for k in range(len(s.xhat))]
    return spark.createDataFrame(rows, "elem int, xhat double, variance double, averaging_kernel double")


def gridded_posterior(cells: DataFrame, posterior: DataFrame) -> DataFrame:
    """Element values on their cells; missing scale factors are one."""
    out = cells.join(posterior, cells["label"] == posterior["elem"], "left")
    return out.select("cell_id", F.coalesce("xhat", F.lit(1.0)).alias("sf"), "variance", "averaging_kernel")


def align_with_reference(target: DataFrame, reference: DataFrame, value: str, shared: tuple[str, ...] = ("lon", "lat", "obs_count")) -> DataFrame:
    """Pairs rows whose ``shared`` columns are equal to 6 digits, halves to even; repeated ones in order of row_id."""
    from pyspark.sql import Window

    names = [f"_{c}" for c in shared]
    keys = [F.bround(c, 6).alias(n) for c, n in zip(shared, names, strict=True)]
    numbered = lambda df: df.select("*", *keys).withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy("row_id")))
    ref = numbered(reference).select(*names, "_n", F.col(value).alias(f"ref_{value}"))
    return numbered(target).join(ref, [*names, "_n"]).drop(*names, "_n")


def fit_statistics(df: DataFrame, difference: str = "d", count: str = "obs_count") -> DataFrame:
    """Count-weighted bias and RMSE, and the plain population deviation."""
    d, w = F.col(difference), F.col(count)
    return df.agg((F.sum(w * d) / F.sum(w)).alias("bias"), F.stddev_pop(d).alias("std"), F.sqrt(F.sum(w * d * d) / F.sum(w)).alias("rmse"))


def averaging_kernel_estimate(cells: DataFrame, k: float, sigma: float, obs_error: float) -> DataFrame:
    """a = sA^2 / (sA^2 + (s / k)^2 / m), 0 without observations."""
    sa2 = F.pow(F.lit(sigma) * F.col("flux"), 2)
    noise = F.try_divide(F.pow(F.lit(obs_error / k), 2), F.col("m"))
    return cells.select("label", F.when(F.col("m") > 0, F.try_divide(sa2, sa2 + noise)).otherwise(0.0).alias("a"))


def reduce_by_sector(matrix: np.ndarray, w: np.ndarray, pseudo: bool = False) -> np.ndarray:
    """W M W', or W M W' (W W')^+ for averaging kernels."""
    out = w @ matrix @ w.T
    return out @ np.linalg.pinv(w @ w.T) if pseudo else out


def reduced_by_sector(weights: DataFrame, matrix: DataFrame) -> DataFrame:
    """(a, b, value) of W M W' for ``weights(group, label, weight)`` and ``matrix(i, j, value)``: two joins, with sums by group before the second."""
    left = weights.select(F.col("group").alias("a"), F.col("label").alias("i"), F.col("weight").alias("wa"))
    right = weights.select(F.col("group").alias("b"), F.col("label").alias("j"), F.col("weight").alias("wb"))
    half = matrix.join(left, "i").groupBy("a", "j").agg(F.sum(F.col("wa") * F.col("value")).alias("value"))
    out = half.join(right, "j").groupBy("a", "b").agg(F.sum(F.col("wb") * F.col("value")).alias("value"))
    # zero entries of W leave out pairs of groups that share no element
    return weights.select(F.col("group").alias("a")).distinct().join(weights.select(F.col("group").alias("b")).distinct()).join(out, ["a", "b"], "left").select("a", "b", F.coalesce("value", F.lit(0.0)).alias("value"))


def to_correlation(cov: DataFrame) -> DataFrame:
    """(i, j, c) over the roots of its diagonal; null where that is 0."""
    d = cov.filter("i = j").select(F.col("i").alias("k"), F.sqrt("c").alias("s"))
    out = cov.join(d.withColumnRenamed("k", "i").withColumnRenamed("s", "si"), "i").join(d.withColumnRenamed("k", "j").withColumnRenamed("s", "sj"), "j")
    return out.select("i", "j", F.try_divide(F.col("c"), F.col("si") * F.col("sj")).alias("c"))
