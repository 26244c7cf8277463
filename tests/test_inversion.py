import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmill.operators import blocks, covariance
from fluxmill.operators import ensemble as ens
from fluxmill.operators import inversion as inv
from fluxmill.plans.inversion_run import invert, members_of
from fluxmill.sources.scratch import Saved


def test_one_element_by_hand():
    e = inv.Elements(1)
    s = inv.solve_gaussian(np.array([[4.0]]), np.array([2.0]), e, *inv.prior_covariance(e, 0.5), gamma=1.0)
    assert (s.xhat[0], s.s_post[0, 0], s.a[0, 0], s.ja) == pytest.approx((1.25, 0.125, 0.5, 0.25))


def test_no_information_keeps_the_prior():
    e = inv.Elements(7, bc=True, oh=True)
    s = inv.solve_gaussian(np.zeros((7, 7)), np.zeros(7), e, *inv.prior_covariance(e, 0.5, 10.0, 0.1), gamma=1.0)
    assert s.xhat.tolist() == [1, 1, 0, 0, 0, 0, 1]
    assert np.allclose(s.a, 0)


def test_known_truth_is_recovered_from_a_table(spark):
    rng = np.random.default_rng(3)
    k, truth = rng.normal(size=(300, 5)), np.array([0.7, 1.4, 1.0, 1.2, 0.9])
    y = k @ (truth - 1)
    obs = spark.createDataFrame([(float(v), 0.0, 1.0, row.tolist()) for v, row in zip(y, k, strict=True)], "sat double, model double, obs_count double, k array<double>")
    members, post = invert(obs, 5, 0.01, {"prior_err": [0.5, 1.0], "gamma": [1.0]})
    got = [r["xhat"] for r in post.orderBy("elem").collect()]
    assert members.count() == 2
    assert got == pytest.approx(truth, abs=1e-2)


def test_lognormal_agrees_with_a_direct_iteration():
    rng = np.random.default_rng(1)
    k = rng.uniform(0.1, 1, (60, 3))
    y = k @ np.array([1.5, 0.6, 1.1])
    s = inv.solve_lognormal(k.T @ k / 0.01, k.T @ y / 0.01, inv.Elements(3), 1, np.exp(0.7), 1.0, tolerance=1e-9)
    assert s.xhat == pytest.approx([1.5, 0.6, 1.1], abs=0.05)


def test_qualified_falls_back_to_all(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 4.0)], "member int, ja double")
    assert inv.qualified(df).count() == 2
    assert inv.qualified(df.union(spark.createDataFrame([(2, 1.1)], "member int, ja double"))).count() == 1
    assert inv.default_member(df).first()[0] == 0


def test_missing_values_stop_the_run(spark):
    df = spark.createDataFrame([(1.0, None)], "residual double, variance double")
    with pytest.raises(Exception, match="missing or non-finite"):
        inv.checked(df, "residual", "variance").collect()


def test_alignment_pairs_repeated_keys_in_order(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 5.0), (2, 0.0, 0.0, 1.0, 6.0), (3, 1.0, 0.0, 1.0, 7.0)], "row_id int, lon double, lat double, obs_count double, v double")
    got = {r["row_id"]: r["ref_v"] for r in inv.align_with_reference(t, t.filter("row_id < 3").withColumn("v", F.col("v") * 10), "v").collect()}
    assert got == {1: 50.0, 2: 60.0}


def test_hydroxyl_elements_count_by_their_share():
    for regional, n_oh in ((True, 1), (False, 2)):
        e = inv.Elements(9, bc=True, oh=True, regional=regional)
        cov, solve = inv.prior_covariance(e, 0.5, 10.0, 0.1)
        want = [0.25] * (5 - n_oh) + [100.0] * 4 + [0.01] * n_oh
        assert np.diag(cov) == pytest.approx(want)
        assert np.diag(solve) == pytest.approx(want[:-n_oh] + [0.01 * n_oh / (9 - n_oh)] * n_oh)


def direct_lognormal(k, y, variance, buffers, bc, n_oh, gsd, gamma, err_buffer, err_bc, err_oh, kappa=10.0):
    """The iteration over all observations, in the textbook's terms: prior medians scale the Jacobian and start at one."""
    n = k.shape[1]
    normal = buffers + 4 * bc + n_oh
    m = n - normal
    scale = np.exp(-np.log(gsd) ** 2 / 2)
    kr, kn = k[:, :m] * scale, k[:, m:]
    xa = np.concatenate([np.zeros(m), np.ones(buffers), np.zeros(4 * bc), np.ones(n_oh)])
    var = np.concatenate([np.full(m, np.log(gsd) ** 2), np.full(buffers, err_buffer**2), np.full(4 * bc, err_bc**2), np.full(n_oh, err_oh**2)])
    held = var.copy()
    if n_oh:
        held[-n_oh:] *= n_oh / (normal - n_oh)
    state = xa.copy()
    change = 1.0
    while change >= 5e-3:
        x = np.concatenate([np.exp(state[:m]), state[m:]])
        kp = np.concatenate([kr * x[:m], kn], axis=1)
        left = gamma * kp.T @ (kp / variance[:, None]) + (1 + kappa) * np.diag(1 / held)
        right = gamma * kp.T @ ((y - np.concatenate([kr, kn], axis=1) @ x) / variance) - (state - xa) / held
        fresh = state + np.linalg.solve(left, right)
        change = np.max(np.abs(np.exp(fresh[:m]) - np.exp(state[:m])) / np.exp(state[:m]))
        state = fresh
    s = np.linalg.inv(gamma * kp.T @ (kp / variance[:, None]) + np.diag(1 / var))
    mean = np.concatenate([np.exp(state[:m] + np.diag(s)[:m] / 2) * scale, state[m:]])
    return mean, s, np.sum((state[:m] - xa[:m]) ** 2 / var[:m]) / n


@pytest.mark.parametrize(("bc", "n_oh"), [(False, 0), (True, 1), (True, 2), (False, 1)])
def test_lognormal_with_buffer_boundary_and_hydroxyl(bc, n_oh):
    rng = np.random.default_rng(2)
    n = 3 + 2 + 4 * bc + n_oh
    k, variance = rng.uniform(0.1, 1, (200, n)), rng.uniform(1, 2, 200)
    y = k @ np.concatenate([[1.5, 0.6, 1.1], np.full(n - 3, 0.9)])
    e = inv.Elements(n, bc=bc, oh=n_oh > 0, regional=n_oh < 2)
    s = inv.solve_lognormal(k.T @ (k / variance[:, None]), k.T @ (y / variance), e, 2, 2.0, 0.5, 0.5, 1.0, 0.3)
    mean, post, ja = direct_lognormal(k, y, variance, 2, bc, n_oh, 2.0, 0.5, 0.5, 1.0, 0.3)
    assert s.xhat == pytest.approx(mean) and s.s_post == pytest.approx(post) and s.ja == pytest.approx(ja)


def test_an_unsettled_state_raises():
    with pytest.raises(RuntimeError, match="still changes"):
        inv.solve_lognormal(np.eye(2) * 9, np.array([50.0, 1.0]), inv.Elements(2), 0, 3.0, 1.0, most=1)


def test_missing_sensitivities_stop_the_run(spark):
    obs = spark.createDataFrame([(1.0, 0.0, 1.0, [1.0, float("nan")])], "sat double, model double, obs_count double, k array<double>")
    with pytest.raises(Exception, match="missing or non-finite"):
        invert(obs, 2, 1.0, {"prior_err": [0.5]})


def test_blocks_add_up_over_many_tasks(spark):
    rng = np.random.default_rng(5)
    k, y = rng.normal(size=(500, 6)), rng.normal(size=500)
    rows = spark.createDataFrame([(row.tolist(), float(v), 2.0) for row, v in zip(k, y, strict=True)], "k array<double>, residual double, variance double").repartition(7)
    ktk, kty = inv.collect_normal(inv.normal_equations_blocks(rows, 6), 6)
    assert ktk == pytest.approx(k.T @ k / 2) and kty == pytest.approx(k.T @ y / 2)


def ensemble_case(seed=4, n=7, m=400):
    rng = np.random.default_rng(seed)
    k, truth = rng.uniform(0.2, 1, (m, n)), rng.uniform(0.6, 1.5, n)
    return k, k @ (truth - 1) + rng.normal(size=m), rng.integers(1, 9, m).astype(float)


def variances_of(err, p):
    s2 = lambda q: err**2 * (0.45 / q + 0.55) + 4.5**2
    return s2(p) / s2(1.0) * err**2


def observations(spark, k, y, p):
    return spark.createDataFrame([(float(v), 0.0, float(c), row.tolist()) for v, c, row in zip(y, p, k, strict=True)], "sat double, model double, obs_count double, k array<double>").repartition(5)


def test_every_observation_error_has_its_own_weights(spark):
    """A list of errors isn't a scaling: each member equals a run with its error alone, and the textbook's solve."""
    k, y, p = ensemble_case()
    lists = {"prior_err": [0.5, 0.8], "obs_err": [5.0, 10.0, 15.0], "gamma": [0.25, 1.0], "err_bc": [3.0], "err_oh": [0.2]}
    e = inv.Elements(7, bc=True, oh=True)
    members, solved = members_of(observations(spark, k, y, p), 7, 15.0, lists, e)
    got = {}
    for r in solved.collect():
        got.setdefault(r["member"], {})[r["elem"]] = r
    assert members.count() == 12 == len(got)
    for m in members.collect():
        w = 1 / variances_of(m["obs_err"], p)
        s = inv.solve_gaussian((k * w[:, None]).T @ k, (k * w[:, None]).T @ y, e, *inv.prior_covariance(e, m["prior_err"], 3.0, 0.2), m["gamma"])
        rows = [got[m["member"]][i] for i in range(1, 8)]
        assert [r["xhat"] for r in rows] == pytest.approx(s.xhat) and m["ja"] == pytest.approx(s.ja) and m["dofs"] == pytest.approx(np.trace(s.a))
        assert np.array([r["s_post"] for r in rows]) == pytest.approx(s.s_post) and np.array([r["kernel"] for r in rows]) == pytest.approx(s.a)
    scaled = inv.solve_gaussian(*(x / 4 for x in ((k / variances_of(5.0, p)[:, None]).T @ k, (k / variances_of(5.0, p)[:, None]).T @ y)), e, *inv.prior_covariance(e, 0.5, 3.0, 0.2), 1.0)
    ten = next(m["member"] for m in members.collect() if (m["prior_err"], m["obs_err"], m["gamma"]) == (0.5, 10.0, 1.0))
    assert [got[ten][i]["xhat"] for i in range(1, 8)] != pytest.approx(scaled.xhat, abs=1e-4)
    mean = ens.mean_matrix(solved, members)
    good = [r["member"] for r in inv.qualified(members).collect()]
    want = np.mean([[got[m][i]["s_post"] for i in range(1, 8)] for m in good], axis=0)
    assert {(r["i"], r["j"]): r["value"] for r in mean.collect()} == pytest.approx({(i + 1, j + 1): want[i, j] for i in range(7) for j in range(7)})


def test_lognormal_members_with_buffer_errors(spark):
    k, y, p = ensemble_case(6, 9)
    lists = {"gamma": [0.5, 1.0], "prior_err": [2.0], "obs_err": [10.0, 15.0], "err_bc": [1.0], "err_buffer": [0.3, 0.6], "err_oh": [0.3]}
    e = inv.Elements(9, bc=True, oh=True)
    members, solved = members_of(observations(spark, k, y, p), 9, 15.0, lists, e, lognormal=True, n_buffer=2)
    rows = solved.collect()
    start = np.array([1.0] * 4 + [0.0] * 4 + [1.0])
    for m in members.collect():
        mean, post, ja = direct_lognormal(k, y + k @ start, variances_of(m["obs_err"], p), 2, True, 1, 2.0, m["gamma"], m["err_buffer"], 1.0, 0.3)
        mine = sorted((r for r in rows if r["member"] == m["member"]), key=lambda r: r["elem"])
        assert [r["xhat"] for r in mine] == pytest.approx(mean) and np.array([r["s_post"] for r in mine]) == pytest.approx(post) and m["ja"] == pytest.approx(ja)
    assert len({round(m["ja"], 9) for m in members.collect()}) == 8


def test_full_prior_reaches_the_solve(spark):
    k, y, p = ensemble_case(8, 6)
    rng = np.random.default_rng(3)
    places = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(30, 33, (4, 2)))], "elem int, lat double, lon double")
    pairs = covariance.with_buffer(covariance.covariance_pairs(covariance.distinct_elements(places), 200.0), 4, 2)
    c = covariance.correlation_matrix(pairs, 6)
    assert c[4:, 4:].tolist() == np.eye(2).tolist() and not c[:4, 4:].any() and 0 < c[0, 1] < 1
    w = 1 / variances_of(15.0, p)
    ktk, kty = (k * w[:, None]).T @ k, (k * w[:, None]).T @ y
    s = np.linalg.inv(ktk + np.linalg.inv(c * 0.25))
    _, post = invert(observations(spark, k, y, p), 6, 15.0, {"prior_err": [0.5]}, correlation=c)
    rows = post.orderBy("elem").collect()
    assert [r["xhat"] for r in rows] == pytest.approx(1 + s @ kty) and [r["variance"] for r in rows] == pytest.approx(np.diag(s))
    for size in (1, 2, 4, 6, 50):
        entries = [(i + 1, j + 1, float(ktk[i, j])) for i in range(6) for j in range(6)] + [(i + 1, 0, float(kty[i])) for i in range(6)]
        found = blocks.posterior_in_blocks(spark.createDataFrame(entries, "i int, j int, value double"), pairs.select("i", "j", (F.col("c") * 0.25).alias("value")), 6, 1.0, size).orderBy("elem").collect()
        assert [r["xhat"] for r in found] == pytest.approx(1 + s @ kty) and [r["variance"] for r in found] == pytest.approx(np.diag(s))
        assert [r["averaging_kernel"] for r in found] == pytest.approx(np.diag(np.eye(6) - s @ np.linalg.inv(c * 0.25)))


def test_priors_that_cannot_be_are_refused(spark):
    twice = spark.createDataFrame([(1, 30.0, 1.0), (1, 31.0, 1.0)], "elem int, lat double, lon double")
    with pytest.raises(Exception, match="more than one row for element 1"):
        covariance.covariance_pairs(covariance.distinct_elements(twice), 200.0).collect()
    with pytest.raises(ValueError, match="element 2 has 0"):
        covariance.correlation_matrix(spark.createDataFrame([(1, 1, 1.0)], "i long, j long, c double"), 2)
    odd = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 2, 1.0)], "i int, j int, value double")
    with pytest.raises(ValueError, match="positive definite"):
        blocks.inverse(blocks.to_blocks(odd, 2, 1), 2, 1, Saved(spark, "t"), "x")
