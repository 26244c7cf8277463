"""Registered queries of whole runs: observation operator, priors, statistics, previews, periods, cubed spheres, catalogues."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _BC, _VAR, ORACLES, _bc, _fold_cells, _rows, cut, query, r
from .functions import scalars as fs
from .functions import vertical as fv
from .functions.geo import spherical_quad_area
from .operators import boundary, cubed_sphere, emissions, inversion, kalman, observation, plumes, preview, statevector, stations, statistics
from .plans.adapters import cte, view
from .sources import catalogue, sinks

D = "CAST({} AS DOUBLE)".format

# -- observation operator: raw tables to modelled values and sensitivities ------------------------------------------------

#: Super-observations of the pixel view, and model columns for each of their hours and cells.
_OBS = f"""{cte('pixel')}, s AS (SELECT orbit, i, j, strftime(time, '%Y%m%d_%H') AS hour_key, avg(value) AS sat, avg(lat) AS lat, avg(lon) AS lon FROM pixel GROUP BY ALL),
e AS (SELECT *, [{D('1000')} - i, {D('700')}, {D('400')}] AS s, [{D('990')} - j, {D('800')}, {D('600')}, {D('300')}] AS m FROM s),
x AS (SELECT e.*, elem, [{D('i + j')} + elem * {D('0.5')} * (j + 1), {D('i * 2')} + elem, {D('j')} - elem * {D('0.25')}] AS c FROM e, (VALUES (0), (1), (2)) v(elem)),
w AS (SELECT orbit, i, j, hour_key, elem, l, c[k] AS ck, CASE WHEN s[l + 1] >= m[1] THEN CASE WHEN k = 1 THEN {D('1')} ELSE {D('0')} END ELSE greatest({D('0')}, least(s[l], m[k]) - greatest(s[l + 1], m[k + 1])) END AS t FROM x, (VALUES (1), (2)) a(l), (VALUES (1), (2), (3)) b(k)),
v AS (SELECT orbit, i, j, hour_key, elem, l, sum(t * ck) / sum(t) AS p FROM w GROUP BY ALL),
y AS (SELECT orbit, i, j, hour_key, elem, sum({D('0.1')} * l + ({D('0.5')} + {D('0.2')} * l) * (p * l - {D('0.1')} * l)) / 3 AS model FROM v GROUP BY ALL)"""


def _superobs(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "pixel").groupBy("orbit", "i", "j", F.date_format("time", "yyyyMMdd_HH").alias("hour_key")).agg(F.avg("value").alias("sat"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    edges = F.array(F.lit(1000.0) - F.col("i"), F.lit(700.0), F.lit(400.0))
    return rows.select("*", edges.alias("p_sat"), pair(0.1, 0.2).alias("apriori"), pair(0.7, 0.9).alias("avkern"), pair(1.0, 2.0).alias("dry_air"))


def _model(spark: SparkSession, d: str, elem: int = 0) -> DataFrame:
    at = view(spark, d, "pixel").select(F.date_format("time", "yyyyMMdd_HH").alias("hour_key"), "i", "j").distinct()
    conc = F.array((F.col("i") + F.col("j")) + elem * 0.5 * (F.col("j") + 1), (F.col("i") * 2).cast("double") + elem, F.col("j").cast("double") - elem * 0.25)
    edges = F.array(F.lit(990.0) - F.col("j"), F.lit(800.0), F.lit(600.0), F.lit(300.0))
    return at.select("hour_key", "i", "j", conc.alias("conc"), edges.alias("pedge"))


@query(f"{_OBS} SELECT s.orbit, s.i, s.j, s.hour_key, {r('sat')} AS sat, {r('model', 6)} AS model FROM s JOIN y USING (orbit, i, j, hour_key) WHERE elem = 0")
def observation_operator(spark: SparkSession, d: str) -> DataFrame:
    out = observation.modelled(_superobs(spark, d), _model(spark, d))
    return out.select("orbit", "i", "j", "hour_key", cut("sat").alias("sat"), cut("model", 6).alias("model"))


@query(f"""{_OBS} SELECT a.orbit, a.i, a.j, a.hour_key, {r('(b.model - a.model) / 0.5::DOUBLE', 5)} AS k1, {r('(c.model - a.model) / 0.25::DOUBLE', 5)} AS k2
FROM y a JOIN y b USING (orbit, i, j, hour_key) JOIN y c USING (orbit, i, j, hour_key) WHERE a.elem = 0 AND b.elem = 1 AND c.elem = 2""")
def observation_jacobian(spark: SparkSession, d: str) -> DataFrame:
    keys = ["orbit", "i", "j", "hour_key"]
    obs, base = _superobs(spark, d), _model(spark, d)
    runs = _model(spark, d, 1).withColumn("elem", F.lit(1)).unionByName(_model(spark, d, 2).withColumn("elem", F.lit(2)))
    bases = observation.modelled(obs, base).select(*keys, F.lit("base").alias("run"), "model")
    steps = spark.createDataFrame([(1, "base", 0.5), (2, "base", 0.25)], "elem int, run string, step double")
    k = observation.jacobian_rows(observation.sensitivities(observation.perturbed(obs, base, runs, keys), bases, steps, keys), 2, keys)
    return k.select(*keys, cut(F.col("k")[0], 5).alias("k1"), cut(F.col("k")[1], 5).alias("k2"))


@query(f"""{cte('pixel')}, t AS (SELECT pixel_id, i AS c, j, {D('pixel_id % 3 + 1')} AS area FROM pixel UNION ALL SELECT pixel_id, (i + 1) % 24, j, {D('2')} FROM pixel)
SELECT pixel_id, {r('sum(area * (c * 10 + j)) / sum(area)', 5)} AS model FROM t GROUP BY pixel_id""")
def pixel_virtual_column(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel").select("pixel_id", "j", F.explode(F.array(F.struct(F.col("i"), (F.col("pixel_id") % 3 + 1).cast("double").alias("area")), F.struct(((F.col("i") + 1) % 24).alias("i"), F.lit(2.0).alias("area")))).alias("t")).select("pixel_id", "j", "t.*")
    columns = px.select("pixel_id", "i", "j", (F.col("i") * 10 + F.col("j")).cast("double").alias("model"))
    return observation.overlap_weighted(px, columns).select("pixel_id", cut("model", 5).alias("model"))


@query(f"""{cte('obs_model')}, a AS (SELECT orbit, line, cell_id, max(sat) AS sat, max(model) AS model FROM obs_model GROUP BY ALL) SELECT orbit, line, cell_id, {r('sat')} AS sat, {r('model')} AS prior, {r('model * 1.25::DOUBLE + 1')} AS posterior FROM a""")
def prior_posterior_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "obs_model").groupBy("orbit", "line", "cell_id").agg(F.max("sat").alias("sat"), F.max("model").alias("model"))
    rows = rows.withColumns({"lat": F.col("cell_id") % 10, "lon": F.col("cell_id")})
    after = rows.select("orbit", "line", "cell_id", (F.col("model") * 1.25 + 1).alias("model"))
    return observation.paired(rows, after, ["orbit", "line", "cell_id"]).select("orbit", "line", "cell_id", cut("sat").alias("sat"), cut("prior").alias("prior"), cut("posterior").alias("posterior"))


@query(f"""{cte('obs_model')} SELECT orbit, line, {r('k1 * 3')} AS k1, {r('k2 * 0.5::DOUBLE')} AS k2, {r('k3')} AS k3, {r('k4')} AS k4 FROM obs_model""")
def scaled_jacobian(spark: SparkSession, d: str) -> DataFrame:
    new = spark.createDataFrame([(1, 2.0, 6.0), (2, 4.0, 2.0), (3, 1.0, 9.0)], "elem int, effective_sf double, target double")
    ref = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.0, 4.0), (3, 5.0, 1.0)], "elem int, effective_sf double, target double")
    rows = view(spark, d, "obs_model").select("orbit", "line", F.array("k1", "k2", "k3", "k4").alias("k"))
    out = observation.scaled_rows(rows, emissions.jacobian_scale_factors(new, ref), 4, n_oh=2)
    return out.select("orbit", "line", *(cut(F.col("k")[x]).alias(f"k{x + 1}") for x in range(4)))


# -- priors and posteriors ------------------------------------------------------------------------------------------------


@query(f"""{cte('emission')}, t AS (SELECT label, avg(flux) AS f, avg(CASE WHEN sector = 'SoilAbsorb' THEN flux ELSE 0 END) AS s, avg(CASE WHEN sector <> 'SoilAbsorb' THEN flux ELSE 0 END) AS e FROM emission GROUP BY label),
g AS (SELECT label, power(sqrt(power(e * 0.5::DOUBLE, 2) + power(s * 0.3::DOUBLE, 2)) / abs(f), 2) AS v FROM t), m AS (SELECT max(label) AS n FROM t), c(regional, n_oh) AS (VALUES (1, 1), (0, 2)),
e AS (SELECT regional, n_oh, label AS elem, v FROM g, c UNION ALL SELECT regional, n_oh, n + b, {D('100')} FROM m, c, range(1, 5) u(b) UNION ALL SELECT regional, n_oh, n + 4 + o, {D('0.04')} FROM m, c, range(1, 3) u(o) WHERE o <= n_oh)
SELECT regional = 1 AS regional, CAST(elem AS INT) AS elem, {r('v', 6)} AS variance, {r('CASE WHEN elem > n + 4 THEN v * n_oh / (n + 4) ELSE v END', 6)} AS step_variance FROM e, m""")
def prior_variances(spark: SparkSession, d: str) -> DataFrame:
    """Variances of emission elements whose errors know the soil sink, with boundary and hydroxyl elements after them."""
    soil = F.when(F.col("sector") == emissions.SOIL, F.col("flux")).otherwise(0.0)
    cells = view(spark, d, "emission").select("label", "flux", soil.alias("soil"), (F.col("flux") - soil).alias("flux_no_soil"))
    errors = [x["error"] for x in emissions.soil_aware_error(cells, 0.5, 0.3).orderBy("label").collect()]  # one an element
    rows = []
    for regional in (True, False):
        e = inversion.Elements(len(errors) + 4 + (1 if regional else 2), bc=True, oh=True, regional=regional)
        cov, solve = inversion.prior_covariance(e, np.array(errors + [0.0] * (e.n - len(errors))), 10.0, 0.2)
        rows += [(regional, k + 1, float(cov[k, k]), float(solve[k, k])) for k in range(e.n)]
    df = spark.createDataFrame(rows, "regional boolean, elem int, variance double, step_variance double")
    return df.select("regional", "elem", cut("variance", 6).alias("variance"), cut("step_variance", 6).alias("step_variance"))


_M = "a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13)"


@query(f"""{cte('obs_model')}, s AS (SELECT {', '.join(f'sum(k{i} * k{j} / {_VAR}) AS n{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)}, {', '.join(f'sum(k{i} * (sat - model) / {_VAR}) AS y{i}' for i in (1, 2, 3))} FROM obs_model),
a AS (SELECT *, n11 + 4 AS a11, n12 AS a12, n13 AS a13, n22 + 1 / (0.04::DOUBLE * 2) AS a22, n23 AS a23, n33 + 1 / (0.04::DOUBLE * 2) AS a33, n11 + 4 AS b11, n22 + 25 AS b22, n33 + 25 AS b33 FROM s),
d AS (SELECT *, {_M} AS det, {_M.replace('a11', 'b11').replace('a22', 'b22').replace('a33', 'b33')} AS deb FROM a)
SELECT CAST(1 AS INT) AS elem, {r('1 + (y1 * (a22 * a33 - a23 * a23) - a12 * (y2 * a33 - a23 * y3) + a13 * (y2 * a23 - a22 * y3)) / det', 5)} AS xhat, {r('(b22 * b33 - a23 * a23) / deb', 8)} AS variance FROM d
UNION ALL SELECT 2, {r('1 + (a11 * (y2 * a33 - a23 * y3) - y1 * (a12 * a33 - a23 * a13) + a13 * (a12 * y3 - y2 * a13)) / det', 5)}, {r('(b11 * b33 - a13 * a13) / deb', 8)} FROM d
UNION ALL SELECT 3, {r('1 + (a11 * (a22 * y3 - y2 * a23) - a12 * (a12 * y3 - y2 * a13) + y1 * (a12 * a23 - a22 * a13)) / det', 5)}, {r('(b11 * b22 - a12 * a12) / deb', 8)} FROM d""")
def gaussian_posterior_oh(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select(F.array("k1", "k2", "k3").alias("k"), "residual", "variance")
    ktk, kty = inversion.collect_normal(inversion.normal_equations_blocks(inversion.checked(rows, "residual", "variance", arrays=("k",)), 3), 3)
    e = inversion.Elements(3, oh=True, regional=False)
    out = inversion.posterior_table(spark, inversion.solve_gaussian(ktk, kty, e, *inversion.prior_covariance(e, 0.5, 0.0, 0.2), gamma=1.0))
    return out.select("elem", cut("xhat", 5).alias("xhat"), cut("variance", 8).alias("variance"))


@query(f"""{cte('emission')}, g AS (SELECT CASE WHEN sector IN ('Landfills', 'Wastewater') THEN 'Waste' WHEN sector IN ('Oil', 'Gas') THEN 'Oil/Gas' ELSE sector END AS "group", label, sum(flux * area_m2) AS x FROM emission WHERE sector <> 'SoilAbsorb' GROUP BY ALL),
w AS (SELECT "group", label, x / sum(x) OVER (PARTITION BY "group") AS w FROM g) SELECT a."group" AS a, b."group" AS b, {r('sum(a.w * b.w * a.label)', 6)} AS value FROM w a JOIN w b USING (label) GROUP BY ALL""")
def reduced_by_sector(spark: SparkSession, d: str) -> DataFrame:
    weights = emissions.sector_weights(view(spark, d, "emission"))
    matrix = weights.select("label").distinct().select(F.col("label").alias("i"), F.col("label").alias("j"), F.col("label").cast("double").alias("value"))
    return inversion.reduced_by_sector(weights, matrix).select("a", "b", cut("value", 6).alias("value"))


@query(f"""{cte('emission')}, t AS (SELECT label, avg(flux) AS f, avg(CASE WHEN sector = 'SoilAbsorb' THEN flux ELSE 0 END) AS s, avg(CASE WHEN sector <> 'SoilAbsorb' THEN flux ELSE 0 END) AS e FROM emission GROUP BY label)
SELECT label, {r('sqrt(power(e * 0.5::DOUBLE, 2) + power(s * 0.3::DOUBLE, 2)) / abs(f)', 6)} AS error FROM t""")
def soil_error(spark: SparkSession, d: str) -> DataFrame:
    soil = F.when(F.col("sector") == emissions.SOIL, F.col("flux")).otherwise(0.0)
    cells = view(spark, d, "emission").select("label", "flux", soil.alias("soil"), (F.col("flux") - soil).alias("flux_no_soil"))
    return emissions.soil_aware_error(cells, 0.5, 0.3).select("label", cut("error", 6).alias("error"))


# -- statistics of a run --------------------------------------------------------------------------------------------------


@query(f"{cte('obs_model')} SELECT cell_id, {r('sum(obs_count)')} AS obs_count, {r('sum(obs_count * sat) / sum(obs_count)')} AS sat, {r('sum(obs_count * model) / sum(obs_count)')} AS model FROM obs_model GROUP BY cell_id")
def gridded_superobs(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.gridded_superobs(view(spark, d, "obs_model"), ["cell_id"], ("sat", "model"))
    return out.select("cell_id", *(cut(c).alias(c) for c in ("obs_count", "sat", "model")))


_MEMBERS = f"""{cte('emission')}, m AS (SELECT CAST(g AS INT) AS member, cell_id, {D('(cell_id * (g + 1)) % 5')} / 2 AS sf FROM (SELECT DISTINCT cell_id FROM emission), range(0, 4) t(g)),
t AS (SELECT member, sector, sum(flux * CASE WHEN sector = 'SoilAbsorb' THEN 1 ELSE sf END * area_m2 * {D('31536000')} * {D('1e-9')}) AS total FROM emission JOIN m USING (cell_id) GROUP BY ALL)"""


def _totals(spark: SparkSession, d: str) -> DataFrame:
    prior = view(spark, d, "emission")
    scale = prior.select("cell_id").distinct().select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("member"))
    return statistics.member_totals(prior, scale.withColumn("sf", ((F.col("cell_id") * (F.col("member") + 1)) % 5).cast("double") / 2))


@query(f"{_MEMBERS} SELECT sector, {r('min(total)')} AS ens_min, {r('max(total)')} AS ens_max FROM t GROUP BY sector")
def sector_ranges(spark: SparkSession, d: str) -> DataFrame:
    return statistics.sector_ranges(_totals(spark, d)).select("sector", cut("ens_min").alias("ens_min"), cut("ens_max").alias("ens_max"))


@query(f"{_MEMBERS}, w AS (SELECT member, sum(total) AS t FROM t GROUP BY member) SELECT {r('avg(t)')} AS mean, {r('stddev_pop(t)')} AS std, {r('min(t)')} AS least, {r('max(t)')} AS greatest, count(*) AS members FROM w")
def ensemble_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.ensemble_statistics(_totals(spark, d))
    return out.select(*(cut(c).alias(c) for c in ("mean", "std", "least", "greatest")), "members")


@query(f"{_MEMBERS} SELECT sector, {r('avg(total)')} AS total FROM t GROUP BY sector")
def member_means(spark: SparkSession, d: str) -> DataFrame:
    return statistics.member_means(_totals(spark, d), ["sector"]).select("sector", cut("total").alias("total"))


@query(f"{cte('pixel')} SELECT kind, {r('quantile_cont(value, 0.05)', 6)} AS p5, {r('quantile_cont(value, 0.5)', 6)} AS p50, {r('quantile_cont(value, 0.95)', 6)} AS p95 FROM pixel GROUP BY kind")
def value_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return statistics.percentiles(view(spark, d, "pixel"), ["kind"], "value").select("kind", *(cut(c, 6).alias(c) for c in ("p5", "p50", "p95")))


@query(f"{cte('obs_model')} SELECT CAST(round_even(median(sat) / 25, 0) * 25 - 25 AS DOUBLE) AS low, CAST(round_even(median(sat) / 25, 0) * 25 + 25 AS DOUBLE) AS high FROM obs_model")
def colour_range(spark: SparkSession, d: str) -> DataFrame:
    return statistics.colour_range(view(spark, d, "obs_model"), "sat")


@query(f"{cte('emission')}, k AS (SELECT label, least(1, sum(flux) / {D('100000')}) AS a FROM emission GROUP BY label) SELECT {r('sum(a)', 6)} AS dofs FROM k WHERE label <= 9")
def dofs(spark: SparkSession, d: str) -> DataFrame:
    diagonal = view(spark, d, "emission").groupBy("label").agg(F.least(F.lit(1.0), F.sum("flux") / 100000.0).alias("value"))
    kernel = diagonal.select(F.col("label").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("j"), "value")
    return statistics.degrees_of_freedom(kernel, 9).select(cut("dofs", 6).alias("dofs"))


@query(f"{cte('obs_model')} SELECT {r('sum(obs_count)')} AS obs_count FROM obs_model")
def enough_observations(spark: SparkSession, d: str) -> DataFrame:
    return statistics.enough(view(spark, d, "obs_model"), "obs_count", 1, "observations").select(cut("obs_count").alias("obs_count"))


_PAIR = f"{cte('emission', 'obs_model')}, p AS (SELECT sector, sum(flux * area_m2 * {D('31536000')} * {D('1e-9')}) AS prior FROM emission GROUP BY sector)"


@query(f"{_PAIR} SELECT sector, {r('prior')} AS prior, {r('prior * 1.5::DOUBLE')} AS posterior FROM p")
def sector_pairs(spark: SparkSession, d: str) -> DataFrame:
    prior, posterior = _sector_pair(spark, d)
    return statistics.sector_pairs(prior, posterior).select("sector", cut("prior").alias("prior"), cut("posterior").alias("posterior"))


def _sector_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prior = emissions.sector_totals(view(spark, d, "emission"), positive=False)
    return prior, prior.withColumn("total", F.col("total") * 1.5)


@query(f"""{_PAIR}, q AS (SELECT * FROM p WHERE sector IN ('Coal', 'Oil')), f AS (SELECT sum(obs_count * (model - sat)) / sum(obs_count) AS bias, sqrt(sum(obs_count * (model - sat) * (model - sat)) / sum(obs_count)) AS rmse, sum(obs_count) AS n FROM obs_model)
SELECT '20240101' AS "StartDate", '20240201' AS "EndDate", {r('(SELECT sum(prior) FROM q)')} AS "PriorEmissions", {r('bias')} AS bias, {r('rmse')} AS rmse, {r('n')} AS obs_count,
{', '.join(f'''{r(f"(SELECT prior FROM q WHERE sector = '{s}')")} AS "{s}Prior", {r(f"(SELECT prior * 1.5::DOUBLE FROM q WHERE sector = '{s}')")} AS "{s}Posterior"''' for s in ('Coal', 'Oil'))}, CAST(2 AS DOUBLE) AS dofs FROM f""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    pairs = statistics.sector_pairs(*_sector_pair(spark, d)).filter(F.col("sector").isin("Coal", "Oil"))
    fit = inversion.fit_statistics(view(spark, d, "obs_model").withColumn("d", F.col("model") - F.col("sat"))).select("bias", "rmse")
    count = statistics.enough(view(spark, d, "obs_model"), "obs_count", 1, "observations")
    kernel = spark.createDataFrame([(1, 1, 1.25), (2, 2, 0.75), (1, 2, 9.0)], "i int, j int, value double")
    out = statistics.summary_row("20240101", "20240201", pairs.agg(F.sum("prior").alias("PriorEmissions")), fit, statistics.degrees_of_freedom(kernel), count, pairs)
    return out.select(*(c if t == "string" else cut(c).alias(c) for c, t in out.dtypes))


@query(f"{cte('pixel', 'place')} SELECT i AS site FROM pixel INTERSECT SELECT elem % 30 FROM place")
def shared_sites(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "pixel").select(F.col("i").alias("site"))
    return statistics.shared_sites(a, view(spark, d, "place").select((F.col("elem") % 30).alias("site")))


@query(f"{cte('pixel')} SELECT kind, pixel_id, {r('value', 6)} AS value FROM pixel QUALIFY row_number() OVER (PARTITION BY kind ORDER BY lat DESC, lon, pixel_id) = 1")
def first_by_place(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.first_of(view(spark, d, "pixel"), ["kind"], [F.desc("lat"), F.asc("lon"), F.asc("pixel_id")])
    return out.select("kind", "pixel_id", cut("value", 6).alias("value"))


@query(f"""{cte('place')}, p AS (SELECT elem, CAST(round_even(lat * 4, 0) AS BIGINT) AS y, CAST(round_even(lon * 4, 0) AS BIGINT) AS x FROM place), e AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM p),
l AS (SELECT y, x FROM (SELECT unnest(generate_series(y0, y1)) AS y FROM e), (SELECT unnest(generate_series(x0, x1)) AS x FROM e)) SELECT {r('l.y * 0.25::DOUBLE', 2)} AS lat, {r('l.x * 0.25::DOUBLE', 2)} AS lon, count(elem) AS n FROM l LEFT JOIN p USING (y, x) GROUP BY ALL""")
def dense_lattice(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "place").select("lat", "lon", "elem")
    out = statistics.on_lattice(rows, 0.25)
    return out.groupBy(cut("lat", 2).alias("lat"), cut("lon", 2).alias("lon")).agg(F.count("elem").alias("n"))


# -- previews -------------------------------------------------------------------------------------------------------------

_ELEMENTS = f"""{cte('emission', 'pixel')}, c AS (SELECT i % 10 + 1 AS label, count(*) AS n_obs, count(DISTINCT CAST(time AS DATE)) AS n_superobs FROM pixel GROUP BY 1),
g AS (SELECT label, sum(flux * area_m2 * {D('31536000')} * {D('1e-9')}) AS em, count(*) AS n_cells FROM emission WHERE label >= 1 GROUP BY label),
s AS (SELECT label, em, n_cells, 25000::DOUBLE * n_cells AS len, coalesce(n_obs, 0) AS n_obs, coalesce(n_superobs, 0) AS n_superobs FROM g LEFT JOIN c USING (label))"""


def _elements(spark: SparkSession, d: str) -> DataFrame:
    counts = view(spark, d, "pixel").groupBy((F.col("i") % 10 + 1).alias("label")).agg(F.count("*").alias("n_obs"), F.count_distinct(F.to_date("time")).alias("n_superobs"))
    return preview.element_summary(view(spark, d, "emission"), counts, preview.LENGTHS["0.25x0.3125"])


@query(f"{_ELEMENTS} SELECT label, {r('em')} AS emissions, n_cells, {r('len', 1)} AS length, n_obs, n_superobs FROM s")
def preview_elements(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("label", cut("emissions").alias("emissions"), "n_cells", cut("length", 1).alias("length"), "n_obs", "n_superobs")


_A = f"""{_ELEMENTS}, q AS (SELECT *, power(0.5::DOUBLE * em * {D('1e9')} / (3600 * 24 * 365) / (n_cells * len * len), 2) AS s2, n_superobs / 4::DOUBLE AS m,
0.4::DOUBLE * (0.029::DOUBLE * len * 9.8::DOUBLE / (0.01604::DOUBLE * (5 * (1000 / 3600::DOUBLE)) * 101325)) AS k FROM s),
z AS (SELECT *, sqrt(225 * (0.45::DOUBLE / greatest(1, coalesce(n_obs / nullif(m, 0), 0)) + 0.55::DOUBLE) + 20.25::DOUBLE) / {D('1e9')} AS e FROM q), a AS (SELECT label, CASE WHEN m > 0 THEN s2 / (s2 + power(e / k, 2) / m) ELSE 0 END AS a FROM z)"""


def _kernels(spark: SparkSession, d: str) -> DataFrame:
    return preview.expected_kernels(_elements(spark, d), "CH4", 0.5, 15.0, 4)


@query(f"{_A} SELECT label, {r('a', 6)} AS a FROM a")
def preview_kernels(spark: SparkSession, d: str) -> DataFrame:
    return _kernels(spark, d).select("label", cut("a", 6).alias("a"))


@query(f"{_A} SELECT {r('sum(a)')} AS dofs, sum(a) >= 3 AS enough FROM a")
def preview_dofs(spark: SparkSession, d: str) -> DataFrame:
    return preview.expected_dofs(_kernels(spark, d), 3.0).select(cut("dofs").alias("dofs"), "enough")


# -- state vectors --------------------------------------------------------------------------------------------------------


@query(f"{cte('emission')} SELECT label, {r('sum(flux)', 3)} AS sensitivity, count(*) AS n_cells FROM emission GROUP BY label HAVING sum(flux) >= 100")
def top_clusters(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "emission").withColumn("sensitivity", F.col("flux"))
    return statevector.top_clusters(cells, 100.0).select("label", cut("sensitivity", 3).alias("sensitivity"), "n_cells")


@query(f"{cte('place')} SELECT elem, CASE WHEN floor(elem / 8) * 8 = elem THEN {D('-9999')} ELSE lat END AS flux FROM (SELECT elem, CASE WHEN elem % 8 = 0 THEN {D('1')} ELSE lat END AS lat, {D('elem % 170')} - 85 AS y FROM place) WHERE y BETWEEN -60 AND 88")
def masked_emissions(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "place").select("elem", F.when(F.col("elem") % 8 == 0, 1.0).otherwise(F.col("lat")).alias("flux"), ((F.col("elem") % 170).cast("double") - 85).alias("lat"))
    return statevector.masked_emissions(rows, 2.0, whole_globe=True).select("elem", "flux")


@query(f"{cte('pixel')}, c AS (SELECT i, j, i * 20 + j AS label FROM pixel GROUP BY ALL), e AS (SELECT min(i) + 5 AS a, max(i) - 5 AS b, min(j) + 5 AS c, max(j) - 5 AS d FROM c) SELECT max(label) AS last FROM c, e WHERE i BETWEEN a AND b AND j BETWEEN c AND d")
def last_roi_element(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "pixel").select("i", "j", (F.col("i") * 20 + F.col("j")).alias("label")).distinct()
    return statevector.last_roi_element(cells, 1)


@query(f"{cte('emission')}, e AS (SELECT max(label) - 4 AS edge FROM emission) SELECT label, CASE WHEN label <= edge THEN label ELSE 0 END AS roi_label, CASE WHEN label > edge THEN label - 2 ELSE 0 END AS buffer_label FROM emission, e GROUP BY ALL")
def split_buffer(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "emission").select("label").distinct()
    return statevector.shift_buffer(statevector.split_buffer(cells, 4), 2).select("label", "roi_label", "buffer_label")


@query(f"""{cte('place')}, p AS (SELECT DISTINCT floor(lat / 0.25::DOUBLE + 1e-9) AS y, floor(lon / 0.3125::DOUBLE + 1e-9) AS x FROM place WHERE elem % 10 = 0)
SELECT elem, {r('CASE WHEN p.y IS NULL THEN lat / 100 ELSE 0.6::DOUBLE END', 6)} AS sensitivity FROM place LEFT JOIN p ON floor(lat / 0.25::DOUBLE + 1e-9) = p.y AND floor(lon / 0.3125::DOUBLE + 1e-9) = p.x""")
def forced_native(spark: SparkSession, d: str) -> DataFrame:
    place = view(spark, d, "place")
    points = statevector.forced_coordinates(place.filter("elem % 10 = 0"), 10**9)
    out = statevector.force_native(place.withColumn("sensitivity", F.col("lat") / 100), points, "0.25x0.3125", 0.5)
    return out.select("elem", cut("sensitivity", 6).alias("sensitivity"))


@query(f"{cte('place')}, p AS (SELECT DISTINCT lat, lon FROM place) SELECT lat, lon FROM p ORDER BY lat DESC, lon DESC LIMIT 4")
def forced_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return statevector.forced_coordinates(view(spark, d, "place"), 5)


@query(f"{cte('place')}, p AS (SELECT lat, lon, max(elem) AS elem FROM place GROUP BY ALL) SELECT elem, {r('lat * 2 + lon', 5)} AS land FROM p")
def grid_alignment(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "place").groupBy("lat", "lon").agg(F.max("elem").alias("elem"))
    out = statevector.aligned(cells, cells.select((F.col("lat") + 1e-6).alias("lat"), "lon", (F.col("lat") * 2 + F.col("lon")).alias("land")), ["land"])
    return statevector.subset(out, cells.select("lat", "lon", F.col("elem").cast("double").alias("there")), "there").select("elem", cut("land", 5).alias("land"))


# -- periods --------------------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT s_suppkey AS cell_id FROM supplier), a AS (SELECT CAST(g AS INT) AS period, cell_id, {D('(cell_id * g) % 4')} / 2 AS prior_sf, {D('(cell_id + g) % 3')} AS posterior_sf FROM c, range(1, 7) t(g)),
t AS (SELECT period, sum(prior_sf * (cell_id % 9 + 1) * 1000 * 31536000 * {D('1e-9')}) AS prior, sum(prior_sf * posterior_sf * (cell_id % 9 + 1) * 1000 * 31536000 * {D('1e-9')}) AS posterior FROM a WHERE cell_id % 4 > 0 GROUP BY period)
SELECT period, {r('prior')} AS prior, {r('posterior')} AS posterior, {r('avg(posterior) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)')} AS smooth FROM t""")
def period_totals(spark: SparkSession, d: str) -> DataFrame:
    cells = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 9 + 1).cast("double").alias("flux"), F.lit(1000.0).alias("area_m2"), (F.col("s_suppkey") % 4 > 0).alias("roi"))
    archive = cells.select("cell_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("period"))
    archive = archive.select("period", "cell_id", (((F.col("cell_id") * F.col("period")) % 4).cast("double") / 2).alias("prior_sf"), ((F.col("cell_id") + F.col("period")) % 3).cast("double").alias("posterior_sf"))
    return kalman.period_totals(archive, cells).select("period", *(cut(c).alias(c) for c in ("prior", "posterior", "smooth")))


@query(f"""{cte('emission')}, p AS (SELECT CAST(g AS INT) AS period, DATE '1995-01-01' + CAST((g - 1) * 30 AS INT) AS a, DATE '1995-01-01' + CAST(g * 30 AS INT) AS b FROM range(1, 13) t(g))
SELECT period, cell_id, sector, {r('avg(flux)')} AS flux FROM emission JOIN p ON date >= a AND date < b GROUP BY ALL""")
def period_means(spark: SparkSession, d: str) -> DataFrame:
    periods = kalman.make_periods(spark, date(1995, 1, 1), date(1995, 12, 27), 30)
    return emissions.period_means(view(spark, d, "emission"), periods).select("period", "cell_id", "sector", cut("flux").alias("flux"))


@query("SELECT s_suppkey AS cell_id, CAST(s_suppkey % 5 AS DOUBLE) / 2 * CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE CAST(s_suppkey % 3 AS DOUBLE) END AS sf FROM supplier")
def multiplied_posteriors(spark: SparkSession, d: str) -> DataFrame:
    cells = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cell_id"))
    latest = F.when(F.col("cell_id") % 7 != 0, (F.col("cell_id") % 3).cast("double"))
    return kalman.multiply_posteriors(cells.select("cell_id", ((F.col("cell_id") % 5).cast("double") / 2).alias("sf")), cells.select("cell_id", latest.alias("sf")))


# -- boundary conditions --------------------------------------------------------------------------------------------------


@query(f"""{cte('pixel')}, {_BC}, s AS (SELECT day, i + di AS i, j + dj AS j, bias FROM bc, range(-2, 3) a(di), range(-2, 3) b(dj) WHERE bias IS NOT NULL)
SELECT day, i, j, {r('CASE WHEN count(*) >= 13 THEN avg(bias) END', 5)} AS bias FROM s WHERE i BETWEEN 0 AND 23 AND j BETWEEN 0 AND 19 GROUP BY ALL""")
def spatial_rolling_grid(spark: SparkSession, d: str) -> DataFrame:
    return boundary.spatial_mean(_bc(spark, d), shape=(24, 20)).select("day", "i", "j", cut("bias", 5).alias("bias"))


@query(f"""{cte('pixel')}, {_BC}, g AS (SELECT DISTINCT i, j FROM bc), c AS (SELECT i, j, CAST(t AS DATE) AS day FROM g, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) u(t)),
f AS (SELECT c.*, bias FROM c LEFT JOIN bc USING (i, j, day))
SELECT i, j, day, {r('coalesce(avg(bias) OVER (PARTITION BY i, j ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), avg(bias) OVER (PARTITION BY i, j ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0)', 5)} AS filled FROM f""")
def trailing_on_calendar(spark: SparkSession, d: str) -> DataFrame:
    full = boundary.complete_days(_bc(spark, d).select("day", "i", "j", "bias"), "2024-01-01", "2024-02-05")
    none = full.select("day", "j", F.lit(None).cast("double").alias("filler")).distinct()
    return boundary.filled(boundary.trailing_means(full), none).select("i", "j", "day", cut("filled", 5).alias("filled"))


@query(f"""{cte('pixel')}, p AS (SELECT pixel_id, [value + 100, value + 50, lat] AS c, [{D('3')}, {D('2')}, {D('1')}] AS a, {D('pixel_id % 5')} AS bias FROM pixel), q AS (SELECT *, (c[1] * 3 + c[2] * 2 + c[3]) / 6 AS col FROM p)
SELECT pixel_id, {r('c[1] * (col - bias) / col')} AS c1, {r('c[3] * (col - bias) / col')} AS c3 FROM q""")
def corrected_profiles(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    at = [F.col("pixel_id").alias("day"), "i", "j"]
    profiles = px.select(*at, F.array(F.col("value") + 100, F.col("value") + 50, F.col("lat")).alias("conc"), F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0)).alias("air"))
    out = boundary.corrected_profile(profiles, px.select(*at, (F.col("pixel_id") % 5).cast("double").alias("bias")))
    return out.select(F.col("day").alias("pixel_id"), cut(F.col("conc")[0]).alias("c1"), cut(F.col("conc")[2]).alias("c3"))


@query(ORACLES["lat_fill"].replace("count(bias) >= 8", "count(bias) >= 15"))
def lat_fill_15(spark: SparkSession, d: str) -> DataFrame:
    return boundary.latitude_fill(_bc(spark, d)).select("day", "j", cut("filler").alias("filler"))


@query(ORACLES["sigma_clip"].replace("CAST(1.5 AS DOUBLE)", "3"))
def sigma_clip_3(spark: SparkSession, d: str) -> DataFrame:
    return stations.sigma_clip(view(spark, d, "station"), "site", "op").select("l_orderkey", "l_linenumber", "site", cut("op").alias("op"))


# -- cubed spheres --------------------------------------------------------------------------------------------------------


@query(f"""{cte('pixel')}, w AS (SELECT *, (pixel_id * 3) % 50 AS cell, {D('pixel_id % 4 + 1')} / 2 AS area FROM pixel UNION ALL SELECT *, (pixel_id * 3) % 50 + 50, {D('3')} FROM pixel), s AS (SELECT *, area / sum(area) OVER (PARTITION BY pixel_id) AS w FROM w),
a AS (SELECT orbit, cell, sum(w * value) / sum(w) AS value, sum(w) AS n, trunc(sum(w * (epoch_us(time) / {D('1000000')})) / sum(w)) AS t FROM s GROUP BY orbit, cell)
SELECT orbit, cell, {r('value', 6)} AS value, {r('n')} AS obs_count, strftime(make_timestamp(CAST(round_even(t / 3600, 0) * 3600 * 1000000 AS BIGINT)), '%Y%m%d_%H') AS hour_key FROM a""")
def cube_superobs(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    part = lambda cell, area: F.struct(cell.alias("dst"), (area / 2).alias("w"))
    weights = px.select(F.col("pixel_id").alias("src"), F.explode(F.array(part(F.col("pixel_id") * 3 % 50, (F.col("pixel_id") % 4 + 1).cast("double") / 2), part(F.col("pixel_id") * 3 % 50 + 50, F.lit(3.0)))).alias("p")).select("src", "p.*", F.lit(2.0).alias("dst_area"))
    out = cubed_sphere.superobservations_on_cube(px, weights, values=("value",))
    return out.select("orbit", "cell", cut("value", 6).alias("value"), cut("obs_count").alias("obs_count"), "hour_key")


@query(f"{cte('pixel')}, n AS (SELECT (pixel_id * 3) % 50 AS cell_id, CAST(time AS DATE) AS day, count(*) AS n FROM pixel GROUP BY ALL) SELECT cell_id, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_superobs FROM n GROUP BY cell_id")
def cube_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return cubed_sphere.daily_counts(view(spark, d, "pixel").select((F.col("pixel_id") * 3 % 50).alias("cell_id"), "time"))


@query(f"{cte('pixel')} SELECT pixel_id, CAST(CASE WHEN pixel_id % 5 > 1 AND qa >= 0.5 THEN 1 ELSE 0 END AS INT) AS imask, pixel_id % 5 > 1 AS has_area, CASE WHEN pixel_id % 5 = 0 THEN {D('-9999')} ELSE lon END AS corner FROM pixel")
def regridding_mask(spark: SparkSession, d: str) -> DataFrame:
    px, kind = view(spark, d, "pixel"), F.col("pixel_id") % 5
    first = F.when(kind != 0, F.col("lon"))
    px = px.withColumns({"lon_bounds": F.array(first, F.col("lon") + 1, F.col("lon") + 1, F.when(kind == 1, F.col("lon") + 1).otherwise(F.col("lon"))), "lat_bounds": F.array(F.col("lat"), F.col("lat"), F.col("lat") + 1, F.col("lat") + 1)})
    out = cubed_sphere.regridding_grid(px, F.col("qa") >= 0.5)
    return out.select("pixel_id", "imask", (F.col("area") > 0).alias("has_area"), F.col("corner_lon")[0].alias("corner"))


@query(f"""{cte('place')}, g AS (SELECT elem % 6 AS tile, CAST(elem % 14 AS INT) AS x, CAST(elem % 10 AS INT) AS y, lon, lat FROM place) SELECT tile, CAST(x // 2 AS INT) AS i, CAST(y // 2 AS INT) AS j, CASE WHEN x % 2 = 0 THEN 'corner' ELSE 'centre' END AS kind, {r('CASE WHEN lon < 0 THEN lon + 360 ELSE lon END', 6)} AS lon, lat FROM g WHERE x % 2 = y % 2""")
def supergrid_cells(spark: SparkSession, d: str) -> DataFrame:
    points = view(spark, d, "place").select((F.col("elem") % 6).alias("tile"), (F.col("elem") % 14).cast("int").alias("x"), (F.col("elem") % 10).cast("int").alias("y"), "lon", "lat")
    return cubed_sphere.from_supergrid(points).select("tile", "i", "j", "kind", cut("lon", 6).alias("lon"), "lat")


def _corner(k: int, lon: str, lat: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) AS x{k}, cos(radians({lat})) * sin(radians({lon})) AS y{k}, sin(radians({lat})) AS z{k}"


def _excess(a: int, b: int, c: int) -> str:
    dot = lambda p, q: f"x{p} * x{q} + y{p} * y{q} + z{p} * z{q}"
    triple = f"x{a} * (y{b} * z{c} - z{b} * y{c}) + y{a} * (z{b} * x{c} - x{b} * z{c}) + z{a} * (x{b} * y{c} - y{b} * x{c})"
    return f"2 * atan2(abs({triple}), 1 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)})"


@query(f"""{cte('place')}, c AS (SELECT elem, {_corner(0, 'lon', 'lat')}, {_corner(1, 'lon + 0.5::DOUBLE', 'lat')}, {_corner(2, 'lon + 0.6::DOUBLE', 'lat + 0.5::DOUBLE')}, {_corner(3, 'lon', 'lat + 0.4::DOUBLE')} FROM place)
SELECT elem, {r(f'({_excess(0, 1, 2)} + {_excess(0, 2, 3)}) * 6371 * 6371', 2)} AS area_km2 FROM c""")
def quadrangle_area(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    area = spherical_quad_area([lon, lon + 0.5, lon + 0.6, lon], [lat, lat, lat + 0.5, lat + 0.4], 6371.0)
    return view(spark, d, "place").select("elem", cut(area, 2).alias("area_km2"))


# -- scalars, stations, plumes --------------------------------------------------------------------------------------------


@query(f"""{cte('pixel')}, p AS (SELECT pixel_id, pixel_id % 12 + 1 AS e, value, lon FROM pixel)
SELECT pixel_id, e = 12 AS is_oh, e BETWEEN 8 AND 11 AS is_bc, CAST(CASE WHEN e <= 7 THEN ceil(e / 3::DOUBLE) ELSE e - 7 + 3 END AS INT) AS run, {r('value * 1e6::DOUBLE * 3600', 3)} AS per_hour,
CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS east, {r('(20 + (e / 31::DOUBLE - 1) * (500 / 744::DOUBLE)) * (e / 243::DOUBLE) * 2 * (e / 31::DOUBLE) / 3', 6)} AS spot_cost, {r('value * 1000000000', 1)} AS ppb FROM p""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("pixel_id") % 12 + 1
    x = e.cast("double")
    return view(spark, d, "pixel").select(
        "pixel_id", fs.is_oh_element(e, 12, True, True).alias("is_oh"), fs.is_bc_element(e, 12, True, True, True).alias("is_bc"), fs.element_run(e, 7, 3).alias("run"),
        cut(fs.per_km2_hour(F.col("value")), 3).alias("per_hour"), fs.wrap_longitude(F.col("lon"), to_360=True).alias("east"),
        cut(fs.preview_cost(x, x, F.lit(4.0), 2.0, spot=True), 6).alias("spot_cost"), cut(F.col("value") * fs.lookup(fs.MIXING_RATIO, "CH4"), 1).alias("ppb"),
    )


_NAMES = """n AS (SELECT l_orderkey, l_linenumber, 'S5P_' || CASE WHEN l_returnflag = 'R' THEN 'RPRO' ELSE 'OFFL' END || '_L2__CH4____' || strftime(l_shipdate, '%Y%m%d') || 'T010203_' || strftime(l_shipdate, '%Y%m%d') || 'T024430_' || right('00000' || CAST(l_orderkey % 100000 AS VARCHAR), 5) || '_03_020' || CAST(l_linenumber % 10 AS VARCHAR) || '00_20240101T000000.nc' AS name FROM lineitem)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyyMMdd")
    name = F.concat(
        F.lit("S5P_"), F.when(F.col("l_returnflag") == "R", "RPRO").otherwise("OFFL"), F.lit("_L2__CH4____"), day, F.lit("T010203_"), day, F.lit("T024430_"),
        F.lpad((F.col("l_orderkey") % 100000).cast("string"), 5, "0"), F.lit("_03_020"), (F.col("l_linenumber") % 10).cast("string"), F.lit("00_20240101T000000.nc"),
    )
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", name.alias("name"))


@query(f"WITH {_NAMES} SELECT l_orderkey, l_linenumber, name[5:8] AS mode, name[53:57] AS orbit, name[59:60] AS collection, name[62:67] AS processor_version, CAST(CAST(name[53:57] AS INT) AS INT) AS orbit_number, strptime(name[21:35], '%Y%m%dT%H%M%S') AS began, strptime(name[37:51], '%Y%m%dT%H%M%S') AS ended FROM n")
def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    began, ended = fs.granule_times(F.col("name"))
    orbit = fs.orbit_number(F.regexp_replace("name", r"\.nc$", "_k.nc"))
    return catalogue.parse_names(_names(spark, d)).select("l_orderkey", "l_linenumber", "mode", "orbit", "collection", "processor_version", orbit.alias("orbit_number"), began.alias("began"), ended.alias("ended"))


@query(f"WITH {_NAMES} SELECT l_orderkey, l_linenumber FROM n WHERE name[21:28] >= '19950301' AND name[21:28] < '19950601'")
def files_by_date(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.within_dates(_names(spark, d), F.col("name"), r"____(\d{8})T", "1995-03-01", "1995-06-01").select("l_orderkey", "l_linenumber")


@query(f"WITH {_NAMES} SELECT CAST(count(DISTINCT name[53:57]) AS BIGINT) AS orbits, count(*) AS files, count(DISTINCT name[53:57]) = count(*) AS one_each FROM n")
def orbit_files(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.orbit_counts(_names(spark, d))


@query("""WITH l AS (SELECT event_id, '/data/' || event_type || '_' || CAST(user_id AS VARCHAR) || '.nc' AS path, event_id % 3 = 0 AS gone FROM events) SELECT path, bool_or(NOT gone) AS found FROM l GROUP BY path""")
def logged_paths(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    path = F.concat(F.lit("/data/"), "event_type", F.lit("_"), F.col("user_id").cast("string"), F.lit(".nc"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("File not found: "), path)).otherwise(F.concat(F.lit("Opening "), path))
    return catalogue.log_paths(events.select(text.alias("value")))


_STATION = f"{cte('station')}, o AS (SELECT *, orbit_ AS id FROM (SELECT *, l_orderkey * 10 + l_linenumber AS orbit_ FROM station))"


@query(f"{_STATION} SELECT id FROM o WHERE op > 500 AND gc > 500 AND l_linenumber <> 3 AND (l_linenumber % 2 = 0 OR (site % 24 BETWEEN 10 AND 16))")
def usable_stations(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "station").select("*", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") != 3).cast("int").alias("obs_flag"), F.when(F.col("l_linenumber") % 2 == 0, "surface-flask").otherwise("surface-insitu").alias("platform"), (F.col("site") % 24).cast("double").alias("utc_conv"))
    return stations.usable(rows).select("id")


@query(f"{cte('station')} SELECT DISTINCT site FROM station WHERE gc > 9000")
def high_sites(spark: SparkSession, d: str) -> DataFrame:
    return stations.high_sites(view(spark, d, "station"), 9000.0)


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS code FROM events")
def station_names(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    name = F.concat(F.lit("obs~"), "event_type", F.lit("|"), F.col("user_id").cast("string"), F.lit("~x"))
    parts = stations.split_id(F.translate(name, "_|", "-_"))
    return events.select("event_id", F.translate(parts[0], "-", "_").alias("kind"), parts[1].alias("code"))


@query(f"{cte('plume')} SELECT datasource, count(*) AS n FROM plume WHERE instrument = 'sat' GROUP BY datasource UNION ALL SELECT 'again', count(*) FROM plume WHERE instrument = 'sat'")
def plume_union(spark: SparkSession, d: str) -> DataFrame:
    px = plumes.without_aircraft(view(spark, d, "plume"))
    both = plumes.union_sources([px, px.select("id", F.lit("again").alias("datasource"))])
    return both.groupBy("datasource").agg(F.count("*").alias("n"))


@query(f"{cte('emission')} SELECT label, {r('CASE WHEN label % 4 = 0 THEN 1 ELSE label / 10::DOUBLE END', 6)} AS sf, count(*) AS n FROM emission GROUP BY label")
def gridded_factors(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "emission").select("label", F.col("label").alias("cell_id"))
    factors = cells.filter("label % 4 > 0").select("label", (F.col("label") / 10.0).alias("sf")).distinct()
    return emissions.gridded_factors(cells, factors).groupBy(F.col("cell_id").alias("label"), cut("sf", 6).alias("sf")).agg(F.count("*").alias("n"))


@query(f"{cte('emission')} SELECT cell_id, {r('CASE WHEN label % 3 = 0 THEN 1 ELSE label * 0.5::DOUBLE END', 6)} AS sf FROM (SELECT DISTINCT cell_id, label FROM emission)")
def gridded_posterior(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "emission").select("cell_id", "label").distinct()
    found = cells.select(F.col("label").alias("elem")).distinct().filter("elem % 3 > 0").select("elem", (F.col("elem") * 0.5).alias("xhat"), F.lit(0.1).alias("variance"), F.lit(0.2).alias("averaging_kernel"))
    return inversion.gridded_posterior(cells, found).select("cell_id", cut("sf", 6).alias("sf"))


@query(f"{cte('pixel')} SELECT pixel_id, {r('value')} AS value FROM pixel WHERE pixel_id % 24 > 0 UNION ALL SELECT pixel_id, {D('1')} FROM pixel WHERE pixel_id % 24 = 0")
def hour_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel").select("pixel_id", cut("value").alias("value"))
    previous = sinks.low_background(px.filter("pixel_id % 24 < 2"), 1.0, "value")
    return sinks.replace_hour_zero(px.filter("pixel_id % 24 > 0"), previous, ["pixel_id"])


_MID47, _MID72 = (900.0, 700.0, 300.0), (950.0, 800.0, 500.0, 100.0)


@query(f"{cte('pixel')}, p AS (SELECT pixel_id, value AS a, lat AS b, lon AS c FROM pixel) SELECT pixel_id, {r('a + (950 - 900) / (700 - 900)::DOUBLE * (b - a)', 5)} AS l1, {r('a + (800 - 900) / (700 - 900)::DOUBLE * (b - a)', 5)} AS l2, {r('b + (500 - 700) / (300 - 700)::DOUBLE * (c - b)', 5)} AS l3, {r('b + (100 - 700) / (300 - 700)::DOUBLE * (c - b)', 5)} AS l4 FROM p")
def interpolated_levels(spark: SparkSession, d: str) -> DataFrame:
    out = view(spark, d, "pixel").select("pixel_id", fv.interpolate_levels(F.array("value", "lat", "lon"), list(_MID47), list(_MID72)).alias("x"))
    return out.select("pixel_id", *(cut(F.col("x")[k], 5).alias(f"l{k + 1}") for k in range(4)))


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, min(CAST(o_orderdate AS DATE)) OVER () AS s FROM orders), m AS (SELECT *, (year(d) - year(s)) * 12 + month(d) - month(s) - CASE WHEN day(d) < day(s) THEN 1 ELSE 0 END AS n FROM o)
SELECT o_orderkey, CAST(n // 12 AS INT) AS years, CAST(n % 12 AS INT) AS months, CAST(CASE WHEN day(d) >= day(s) THEN day(d) - day(s) ELSE day(d) - day(s) + day(last_day(CAST(date_trunc('month', s) AS DATE) + to_months(CAST(n AS INT)))) END AS INT) AS days FROM m""")
def run_durations(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("end"))
    first = orders.agg(F.min("end").alias("start"))
    spans = orders.join(F.broadcast(first)).select("o_orderkey", fs.run_duration_columns(F.col("start"), F.col("end")).alias("s"))
    return spans.select("o_orderkey", "s.*")


@query(f"{cte('pixel')}, e AS (SELECT DISTINCT CAST(j AS INT) AS elem FROM pixel) SELECT elem, CAST(pos AS INT) AS side, CASE WHEN elem % 4 = pos THEN {D('10')} ELSE {D('0')} END AS value FROM e, range(0, 4) t(pos)")
def boundary_perturbations(spark: SparkSession, d: str) -> DataFrame:
    elems = view(spark, d, "pixel").select(F.col("j").cast("int").alias("elem")).distinct()
    return elems.select("elem", F.posexplode(fs.boundary_perturbation(F.col("elem"), 3, 10.0)).alias("side", "value"))


@query(f"{cte('place')} SELECT elem, CASE WHEN lat >= 35 THEN {D('1.1')} WHEN lat < 32 THEN {D('0.9')} ELSE {D('1')} END AS oh FROM place")
def gridded_hydroxyl(spark: SparkSession, d: str) -> DataFrame:
    place = view(spark, d, "place").withColumns({"north": (F.col("lat") >= 35).cast("double"), "south": (F.col("lat") < 32).cast("double")})
    return place.select("elem", fs.hydroxyl_factor(F.col("north"), F.col("south"), 1.1, 0.9).alias("oh"))


@query(f"{cte('pixel')} SELECT lat, lon, {r('value', 6)} AS value, qa AS swir_albedo, time FROM pixel WHERE {'qa >= 0.5'}")
def preview_pixels(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel").filter("qa >= 0.5").select("lat", "lon", cut("value", 6).alias("value"), F.col("qa").alias("swir_albedo"), "time", "sc")
    return preview.observed(px)


@query(f"{cte('pixel')} SELECT pixel_id FROM pixel WHERE CAST(time AS DATE) = (SELECT min(CAST(time AS DATE)) FROM pixel)")
def first_times(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel").withColumn("time", F.to_date("time"))
    return sinks.first_time_only(px, "time").filter("time is not null").select("pixel_id")
