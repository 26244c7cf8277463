"""Registered queries of ensembles, full priors, polygons, reference orbits and clustered elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import cut, query, r
from .operators import blocks, clustering, covariance, emissions, polygons, regridding, stations, statevector, superobs
from .operators import ensemble as ens
from .operators import inversion as inv
from .plans.adapters import cte, view
from .plans.inversion_run import invert, members_of
from .sources import catalogue

D = "CAST({} AS DOUBLE)".format

# -- ensembles ------------------------------------------------------------------------------------------------------------

_S = lambda p: f"(e * e * ({D('0.45')} / {p} + {D('0.55')}) + {D('20.25')})"
_V = f"({_S('obs_count')} / {_S(D('1'))} * e * e)"
#: All members of two observation errors, two prior errors and two gammas, for two elements.
_ENSEMBLE = f"""{cte('obs_model')}, h AS (SELECT CAST(a * 4 + b * 2 + c AS INT) AS member, p, e, g FROM (VALUES (0, {D('0.5')}), (1, {D('0.8')})) x(a, p), (VALUES (0, {D('10')}), (1, {D('15')})) y(b, e), (VALUES (0, {D('0.0001')}), (1, {D('0.001')})) z(c, g)),
s AS (SELECT e, sum(k1 * k1 / {_V}) AS a, sum(k1 * k2 / {_V}) AS b, sum(k2 * k2 / {_V}) AS c, sum(k1 * (sat - model) / {_V}) AS y, sum(k2 * (sat - model) / {_V}) AS z FROM obs_model, (SELECT DISTINCT e FROM h) GROUP BY e),
m AS (SELECT h.*, g * a + 1 / (p * p) AS a, g * b AS b, g * c + 1 / (p * p) AS c, g * y AS y, g * z AS z FROM h JOIN s USING (e)), d AS (SELECT *, a * c - b * b AS det, (c * y - b * z) / (a * c - b * b) AS d1, (a * z - b * y) / (a * c - b * b) AS d2 FROM m),
j AS (SELECT *, (d1 * d1 + d2 * d2) / (p * p) / 2 AS ja FROM d)"""


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = view(spark, d, "obs_model").select("sat", "model", "obs_count", F.array("k1", "k2").alias("k"))
    return members_of(obs, 2, 15.0, {"prior_err": [0.5, 0.8], "obs_err": [10.0, 15.0], "gamma": [0.0001, 0.001]})


@query(f"""{_ENSEMBLE} SELECT member, p AS prior_err, e AS obs_err, g AS gamma, {r('ja', 6)} AS ja, CAST(elem AS INT) AS elem, {r('1 + CASE elem WHEN 1 THEN d1 ELSE d2 END', 6)} AS xhat, {r('CASE elem WHEN 1 THEN c ELSE a END / det', 8)} AS variance FROM j, (VALUES (1), (2)) v(elem)""")
def ensemble_posteriors(spark: SparkSession, d: str) -> DataFrame:
    members, solved = _members(spark, d)
    rows = solved.select("member", "elem", "xhat", "variance").join(members, "member")
    return rows.select("member", "prior_err", "obs_err", "gamma", cut("ja", 6).alias("ja"), "elem", cut("xhat", 6).alias("xhat"), cut("variance", 8).alias("variance"))


@query(f"{_ENSEMBLE} SELECT member, p AS prior_err, e AS obs_err, g AS gamma, {r('ja', 6)} AS ja FROM j WHERE ja BETWEEN 0.5 AND 2.0 OR NOT EXISTS (SELECT 1 FROM j WHERE ja BETWEEN 0.5 AND 2.0)")
def ensemble_grid(spark: SparkSession, d: str) -> DataFrame:
    return inv.qualified(_members(spark, d)[0]).select("member", "prior_err", "obs_err", "gamma", cut("ja", 6).alias("ja"))


@query(f"{_ENSEMBLE}, q AS (SELECT * FROM j WHERE ja BETWEEN 0.5 AND 2.0 OR NOT EXISTS (SELECT 1 FROM j WHERE ja BETWEEN 0.5 AND 2.0)) SELECT CAST(elem AS INT) AS elem, {r('avg(1 + CASE elem WHEN 1 THEN d1 ELSE d2 END)', 6)} AS xhat, {r('avg(CASE elem WHEN 1 THEN c ELSE a END / det)', 8)} AS variance FROM q, (VALUES (1), (2)) v(elem) GROUP BY elem")
def ensemble_mean_posterior(spark: SparkSession, d: str) -> DataFrame:
    members, solved = _members(spark, d)
    return ens.ensemble_mean(solved, members).select("elem", cut("xhat", 6).alias("xhat"), cut("variance", 8).alias("variance"))


@query()
def lognormal_ensemble(spark: SparkSession, d: str) -> DataFrame:
    obs = view(spark, d, "obs_model").select("sat", "model", "obs_count", F.array("k1", "k2", "k3", "k4").alias("k"))
    lists = {"gamma": [0.001, 0.01], "prior_err": [2.0], "obs_err": [10.0, 15.0], "err_buffer": [0.5]}
    members, solved = members_of(obs, 4, 15.0, lists, lognormal=True, n_buffer=1)
    return solved.select("member", "elem", "xhat", "variance").join(members, "member")


# -- a full prior ---------------------------------------------------------------------------------------------------------

_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"
_VAR15 = _V.replace("e * e", D("225"))
_FULL = f"""{cte('obs_model', 'place')}, e AS (SELECT elem % 2 + 1 AS elem, avg(lat) AS lat, avg(lon) AS lon FROM place GROUP BY 1), k AS (SELECT exp(-({_KM}) / 200) AS c FROM e a, e b WHERE a.elem = 1 AND b.elem = 2),
s AS (SELECT {', '.join(f'sum(k{i} * k{j} / {_VAR15}) AS n{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)}, {', '.join(f'sum(k{i} * (sat - model) / {_VAR15}) AS y{i}' for i in (1, 2, 3))} FROM obs_model),
p AS (SELECT 4 / (1 - c * c) AS d, -4 * c / (1 - c * c) AS o FROM k),
a AS (SELECT *, n11 + d AS a11, n12 + o AS a12, n13 AS a13, n22 + d AS a22, n23 AS a23, n33 + 4 AS a33 FROM s, p),
t AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM a)
SELECT 1 AS elem, {r('1 + (y1 * (a22 * a33 - a23 * a23) - a12 * (y2 * a33 - a23 * y3) + a13 * (y2 * a23 - a22 * y3)) / det', 5)} AS xhat, {r('(a22 * a33 - a23 * a23) / det', 8)} AS variance FROM t
UNION ALL SELECT 2, {r('1 + (a11 * (y2 * a33 - a23 * y3) - y1 * (a12 * a33 - a23 * a13) + a13 * (a12 * y3 - y2 * a13)) / det', 5)}, {r('(a11 * a33 - a13 * a13) / det', 8)} FROM t
UNION ALL SELECT 3, {r('1 + (a11 * (a22 * y3 - y2 * a23) - a12 * (a12 * y3 - y2 * a13) + y1 * (a12 * a23 - a22 * a13)) / det', 5)}, {r('(a11 * a22 - a12 * a12) / det', 8)} FROM t"""


def _correlations(spark: SparkSession, d: str) -> DataFrame:
    elements = view(spark, d, "place").groupBy((F.col("elem") % 2 + 1).alias("elem")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return covariance.with_buffer(covariance.covariance_pairs(covariance.distinct_elements(elements), 200.0), 2, 1)


def _three(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "obs_model").select("sat", "model", "obs_count", F.array("k1", "k2", "k3").alias("k"))


@query(_FULL)
def full_prior_posterior(spark: SparkSession, d: str) -> DataFrame:
    c = covariance.correlation_matrix(_correlations(spark, d), 3)
    return invert(_three(spark, d), 3, 15.0, {"prior_err": [0.5]}, correlation=c)[1].select("elem", cut("xhat", 5).alias("xhat"), cut("variance", 8).alias("variance"))


@query(_FULL)
def full_prior_posterior_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _three(spark, d).select("k", (F.col("sat") - F.col("model")).alias("residual"), ens.observation_variances([15.0]).alias("variances"))
    equations = inv.long_form(ens.normal_stack(inv.checked(rows, "residual", arrays=("k", "variances")), 3, 1))
    prior = _correlations(spark, d).select("i", "j", (F.col("c") * 0.25).alias("value"))
    return blocks.posterior_in_blocks(equations, prior, 3, 1.0, size=2).select("elem", cut("xhat", 5).alias("xhat"), cut("variance", 8).alias("variance"))


_ONE = f"{cte('obs_model')}, s AS (SELECT line % 6 + 1 AS elem, sum(k1 * k1 / {_VAR15}) AS s, sum(k1 * (sat - model) / {_VAR15}) AS y FROM obs_model GROUP BY 1), p AS (SELECT *, CASE WHEN elem = 1 THEN {D('0.25')} WHEN elem < 6 THEN {D('4')} ELSE {D('0.04')} END AS v FROM s)"


@query(f"{_ONE} SELECT CAST(elem AS INT) AS elem, {r('CASE WHEN elem BETWEEN 2 AND 5 THEN 0 ELSE 1 END + y / (s + 1 / (CASE WHEN elem = 6 THEN v / 5 ELSE v END))', 5)} AS xhat, {r('1 / (s + 1 / v)', 8)} AS variance, {r('1 - 1 / (s + 1 / v) / v', 6)} AS averaging_kernel FROM p")
def boundary_posterior(spark: SparkSession, d: str) -> DataFrame:
    """An emission element, four boundary elements and a hydroxyl one; each observation sees one of them."""
    obs = view(spark, d, "obs_model")
    seen = F.array(*(F.when(F.col("line") % 6 == e, F.col("k1")).otherwise(0.0) for e in range(6)))
    e = inv.Elements(6, bc=True, oh=True)
    _, post = invert(obs.select("sat", "model", "obs_count", seen.alias("k")), 6, 15.0, {"prior_err": [0.5], "err_bc": [2.0], "err_oh": [0.2]}, e)
    return post.select("elem", cut("xhat", 5).alias("xhat"), cut("variance", 8).alias("variance"), cut("averaging_kernel", 6).alias("averaging_kernel"))


# -- polygons and grids ---------------------------------------------------------------------------------------------------

GRID = polygons.Lattice(-105.0, 0.3125, 24, 30.0, 0.25, 20)
_AT = f"{D('-105.7')} + n_nationkey % 5 * {D('1.6')} AS x, {D('29.6')} + n_nationkey // 5 * {D('1.13')} AS y"


def _shapes(spark: SparkSession, d: str, corners: list[tuple[float, float]]) -> DataFrame:
    """One polygon a nation, moved to its place on the grid."""
    n = F.col("n_nationkey").cast("long")
    x, y = F.lit(-105.7) + (n % 5) * 1.6, F.lit(29.6) + F.floor(n / 5) * 1.13
    ring = F.array(*(F.array(x + a, y + b) for a, b in corners))
    return polygons.ring_edges(spark.read.parquet(f"{d}/nation.parquet").select(n.alias("poly_id"), F.array(ring).alias("rings")))


@query(f"""{cte('pixel')}, b AS (SELECT n_nationkey AS k, {_AT} FROM nation), c AS (SELECT DISTINCT i, j, {D('-105')} + i * {D('0.3125')} AS cx, 30 + j * {D('0.25')} AS cy FROM pixel),
o AS (SELECT i, j, CAST(k AS BIGINT) AS country, x + {D('0.75')} AS lon, y + {D('0.5')} AS lat, greatest(0, least(x + 1.5, cx + {D('0.15625')}) - greatest(x, cx - {D('0.15625')})) * greatest(0, least(y + 1, cy + {D('0.125')}) - greatest(y, cy - {D('0.125')})) / ({D('0.3125')} * {D('0.25')}) AS share FROM c, b)
SELECT i, j, country, {r('lon', 5)} AS country_lon, {r('lat', 5)} AS country_lat FROM o WHERE share > 0.001 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY round(share, 9) DESC, country) = 1""")
def cell_countries(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "pixel").select("i", "j").distinct().select((F.col("i") * 100 + F.col("j")).alias("cell_id"), "i", "j", (30 + F.col("j") * 0.25).alias("lat"), (-105 + F.col("i") * 0.3125).alias("lon"))
    edges = _shapes(spark, d, [(0.0, 0.0), (1.5, 0.0), (1.5, 1.0), (0.0, 1.0)])
    covered = polygons.cell_overlaps(edges, GRID).filter("share > 0.001").select("i", "j").distinct()
    out = polygons.countries_of(cells, edges, GRID).join(covered, ["i", "j"], "left_semi")
    return out.select("i", "j", "country", cut("country_lon", 5).alias("country_lon"), cut("country_lat", 5).alias("country_lat"))


_DIAMOND = [(0.0, -0.53), (0.71, 0.0), (0.0, 0.53), (-0.71, 0.0)]


@query(f"""{cte('pixel')}, b AS (SELECT n_nationkey AS k, {_AT} FROM nation), p AS (SELECT pixel_id, lon + {D('pixel_id % 13')} / 97 AS px, lat + {D('pixel_id % 11')} / 89 AS py FROM pixel)
SELECT pixel_id, CAST(k AS BIGINT) AS poly_id FROM p JOIN b ON abs(px - x) / {D('0.71')} + abs(py - y) / {D('0.53')} < 1""")
def pixels_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c, m, n: (F.col(c) + (F.col("pixel_id") % m).cast("double") / n).alias(c)
    points = view(spark, d, "pixel").select(F.col("pixel_id").alias("id"), at("lon", 13, 97.0), at("lat", 11, 89.0), "pixel_id")
    return polygons.points_within(points, _shapes(spark, d, _DIAMOND), 0.5).select(F.col("id").alias("pixel_id"), "poly_id")


@query(f"""WITH b AS (SELECT n_nationkey AS k, {_AT} FROM nation) SELECT CAST(k AS BIGINT) AS poly_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM b, range(0, 24) u(i), range(0, 20) v(j)
WHERE abs({D('-105')} + i * {D('0.3125')} - x) / {D('0.71')} + abs(30 + j * {D('0.25')} - y) / {D('0.53')} < 1""")
def rasterised_polygons(spark: SparkSession, d: str) -> DataFrame:
    return polygons.rasterised(_shapes(spark, d, _DIAMOND), GRID)


@query()
def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    """Square kilometres of the diamonds, with geodesics for edges."""
    return polygons.ellipsoid_areas(_shapes(spark, d, _DIAMOND)).select("poly_id", cut(F.col("area") / 1e6, 3).alias("km2"))


@query()
def regridding_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights from the pixels' grid to one of half a degree over the same cells."""
    cells = view(spark, d, "pixel").select("i", "j").distinct()
    fine = cells.select((F.col("i") * 100 + F.col("j")).alias("cell_id"), (30 + F.col("j") * 0.25).alias("lat"), (-105 + F.col("i") * 0.3125).alias("lon"))
    y, x = F.floor((30 + F.col("j") * 0.25) / 0.5), F.floor((-105 + F.col("i") * 0.3125) / 0.5)
    coarse = cells.select(((x + 1000) * 1000 + y).alias("cell_id"), (y * 0.5 + 0.25).alias("lat"), (x * 0.5 + 0.25).alias("lon")).distinct()
    return regridding.conservative_weights(regridding.lattice_cells(fine, 0.25, 0.3125), regridding.lattice_cells(coarse, 0.5, 0.5), 256)


# -- orbits, stations, elements -------------------------------------------------------------------------------------------


@query(f"{cte('obs_model')}, t AS (SELECT DISTINCT orbit FROM obs_model) SELECT orbit, o_custkey AS reference FROM t LEFT JOIN orders ON o_orderkey = orbit AND o_orderstatus <> 'F'")
def reference_orbits(spark: SparkSession, d: str) -> DataFrame:
    references = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("orbit"), F.col("o_custkey").alias("path"))
    return catalogue.with_reference(view(spark, d, "obs_model").select("orbit").distinct(), references).select("orbit", "reference")


@query(f"{cte('emission')}, f AS (SELECT label, least(greatest(CAST(5 AS DOUBLE) / flux, CAST(-1.5e7 AS DOUBLE)), CAST(1.5e7 AS DOUBLE)) AS sf, {D('cell_id % 5 + 1')} / 4 AS prior FROM emission WHERE flux <> 0) SELECT label, {r('median(sf)', 3)} AS jacobian_sf, {r('median(sf) / median(prior)', 3)} AS effective_sf FROM f GROUP BY label")
def effective_perturbations(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "emission").filter("flux <> 0")
    prior = rows.select("label", ((F.col("cell_id") % 5 + 1).cast("double") / 4).alias("sf"))
    out = emissions.perturbations(rows, 5.0, prior)
    return out.select("label", cut("jacobian_sf", 3).alias("jacobian_sf"), cut("effective_sf", 3).alias("effective_sf"))


@query(f"""{cte('pixel')}, t AS (SELECT *, {D('pixel_id % 3 + 1')} AS area FROM pixel), w AS (SELECT *, area / sum(area) OVER (PARTITION BY pixel_id) AS w FROM (SELECT *, i AS ci FROM t UNION ALL SELECT *, (i + 1) % 24 FROM t))
SELECT orbit, ci AS i, j, {r('sum(w * value) / sum(w)', 8)} AS p1, {r('sum(w * lat) / sum(w)', 8)} AS p2, {r('sum(w * qa) / sum(w)', 8)} AS p3, {r('sum(w)')} AS obs_count FROM w GROUP BY orbit, ci, j""")
def superobs_profiles(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel").withColumns({"area": (F.col("pixel_id") % 3 + 1).cast("double"), "profile": F.array("value", "lat", "qa")})
    touched = px.withColumn("i", F.explode(F.array(F.col("i"), (F.col("i") + 1) % 24)))
    out = superobs.superobservations(touched, ["orbit", "i", "j"], "pixel_id", values=(), profiles=("profile",), levels=3)
    return out.select("orbit", "i", "j", *(cut(F.col("profile")[k], 8).alias(f"p{k + 1}") for k in range(3)), cut("obs_count").alias("obs_count"))


_EDGES = [-180, -90, 0, 90, 180]
_BANDS = " ".join(f"WHEN longitude > {a} AND longitude <= {b} THEN {k}" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))


@query(f"{cte('station')}, b AS (SELECT *, {D('site * 7 % 360')} - 180 AS longitude FROM station), c AS (SELECT CAST(CASE {_BANDS} END AS INT) AS band, CAST(time AS DATE) AS day, op, gc FROM b) SELECT band, day, {r('avg(op)', 7)} AS op, {r('avg(gc)', 7)} AS gc, count(*) AS n FROM c WHERE band IS NOT NULL GROUP BY ALL")
def lonband_means(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "station").withColumn("longitude", (F.col("site") * 7 % 360).cast("double") - 180)
    out = stations.band_means(rows, "longitude", _EDGES, F.to_date("time").alias("day"))
    return out.select("band", "day", cut("op", 7).alias("op"), cut("gc", 7).alias("gc"), "n")


@query(f"{cte('station')}, c AS (SELECT CAST(CASE WHEN latitude > -90 AND latitude <= -30 THEN 0 WHEN latitude > -30 AND latitude <= 0 THEN 1 WHEN latitude > 0 AND latitude <= 30 THEN 2 WHEN latitude > 30 AND latitude <= 90 THEN 3 END AS INT) AS band, CAST(year(time) AS INT) AS year, op, gc FROM station) SELECT band, year, {r('avg(op)', 7)} AS op, {r('avg(gc)', 7)} AS gc, count(*) AS n FROM c WHERE band IS NOT NULL GROUP BY ALL")
def yearly_band_means(spark: SparkSession, d: str) -> DataFrame:
    out = stations.band_means(view(spark, d, "station"), "latitude", [-90, -30, 0, 30, 90], F.year("time").alias("year"))
    return out.select("band", "year", cut("op", 7).alias("op"), cut("gc", 7).alias("gc"), "n")


@query(f"{cte('station')} SELECT site, CAST(time AS DATE) AS day, {r('avg(op)', 7)} AS op, {r('avg(gc)', 7)} AS gc, count(*) AS n FROM station GROUP BY ALL")
def site_day_means(spark: SparkSession, d: str) -> DataFrame:
    out = stations.site_means(view(spark, d, "station"), F.to_date("time").alias("day"))
    return out.select("site", "day", cut("op", 7).alias("op"), cut("gc", 7).alias("gc"), "n")


@query(f"{cte('emission')} SELECT label, {r('sum(flux)', 3)} AS sensitivity, count(*) AS n_cells FROM emission GROUP BY label HAVING sum(flux) >= 100 ORDER BY sum(flux) DESC, label LIMIT 5")
def five_clusters(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "emission").withColumn("sensitivity", F.col("flux"))
    return statevector.top_clusters(cells, 100.0, 5).select("label", cut("sensitivity", 3).alias("sensitivity"), "n_cells")


_REGION = "cx BETWEEN -103.5 AND -99.5 AND cy BETWEEN 31 AND 33.5"


@query(f"""{cte('pixel')}, c AS (SELECT i, j, {D('-105')} + i * {D('0.3125')} AS cx, 30 + j * {D('0.25')} AS cy, avg(value) AS flux FROM pixel GROUP BY i, j),
e AS (SELECT greatest({D('-104.5')}, min(cx)) AS x0, least({D('-98.5')}, max(cx)) AS x1, greatest({D('30')}, min(cy)) AS y0, least({D('34.5')}, max(cy)) AS y1 FROM c),
d AS (SELECT *, CASE WHEN flux < 45 OR cx < x0 + {D('0.3')} OR cx > x1 - {D('0.3')} OR cy < y0 + {D('0.3')} OR cy > y1 - {D('0.3')} THEN 'unused' WHEN {_REGION} THEN 'roi' ELSE 'buffer' END AS kind FROM c, e WHERE cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1)
SELECT i, j, kind, CASE WHEN kind = 'roi' THEN count(*) OVER (PARTITION BY kind) + 1 - row_number() OVER (PARTITION BY kind ORDER BY j, i) END AS label FROM d""")
def native_state_vector(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the region; a buffer's are k-means, so SQL tells only that they are buffer."""
    px = view(spark, d, "pixel")
    cells = px.select("i", "j").distinct().select((F.col("i") * 100 + F.col("j")).alias("cell_id"), "i", "j", (30 + F.col("j") * 0.25).alias("lat"), (-105 + F.col("i") * 0.3125).alias("lon"))
    flux = px.groupBy((F.col("i") * 100 + F.col("j")).alias("cell_id")).agg(F.avg("value").alias("flux"))
    out = statevector.make_state_vector(cells, flux, (-103.5, -99.5, 31.0, 33.5), (1.0, 1.0), (0.3, 0.3), 45.0)
    return out.select("i", "j", "kind", F.when(F.col("kind") == "roi", F.col("label")).alias("label"))


@query()
def aggregated_elements(spark: SparkSession, d: str) -> DataFrame:
    """Half as many elements as places, of four places at most."""
    cells = view(spark, d, "place").select(F.col("elem").alias("cell_id"), "lat", "lon", ((F.col("elem") % 11).cast("double") / 11).alias("sensitivity"))
    return clustering.aggregate_clusters(cells, max(1, cells.count() // 2), 4).select("cell_id", "label")


@query()
def mini_batch_clusters(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "place").select(F.col("elem").alias("cell_id"), "lat", "lon", ((F.col("elem") % 11).cast("double") / 11).alias("sensitivity"))
    return clustering.cluster(cells, 8, mini_batch=True).select("cell_id", "cluster")
