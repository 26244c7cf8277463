"""All registered queries of the inversion engine, and the SQL that each must equal."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as fs
from .functions import vertical as fv
from .functions.geo import box_overlap
from .operators import boundary, clustering, covariance, emissions, inversion, kalman, plumes, quality, stations, statevector, superobs
from .plans.adapters import cte, view
from .sources import catalogue

FLAGSHIP = "gaussian_posterior"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def cut(c: Column | str, digits: int = 4) -> Column:
    """Rounding that does not depend on the engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def r(expression: str, digits: int = 4) -> str:
    return f"floor(({expression}) * CAST({10**digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10**digits} AS DOUBLE)"


_KEEP = "lon > -104 AND lon < -99 AND lat > 30 AND lat < 34 AND time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND lat > -60 AND sc_f9 <> 184 AND sc <> 1"


@query(f"{cte('pixel')} SELECT pixel_id, orbit, lat, lon, value FROM pixel WHERE {_KEEP} AND qa >= 0.5")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = quality.read_and_filter(view(spark, d, "pixel"), "Operational", "2024-01-03", "2024-01-20", (-104, -99), (30, 34))
    return kept.select("pixel_id", "orbit", "lat", "lon", "value")


@query(f"{cte('pixel')} SELECT pixel_id, sc, chi2_swir FROM pixel WHERE {_KEEP} AND sc <> 3 AND NOT (sc = 2 AND chi2_swir > 20000)")
def quality_filter_blended(spark: SparkSession, d: str) -> DataFrame:
    return quality.read_and_filter(view(spark, d, "pixel"), "Blended", "2024-01-03", "2024-01-20", (-104, -99), (30, 34)).select("pixel_id", "sc", "chi2_swir")


@query(f"{cte('pixel')} SELECT pixel_id FROM pixel WHERE lon BETWEEN -103.75 AND -100.25 AND lat BETWEEN 31 AND 33")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    return quality.inversion_domain(view(spark, d, "pixel"), (-105.0, -99.0), (30.0, 34.0), "0.25x0.3125").select("pixel_id")


@query(f"{cte('pixel')} SELECT pixel_id FROM pixel WHERE (i, j) IN (SELECT i, j FROM pixel GROUP BY i, j HAVING count(*) > 40)")
def mask_filter(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    mask = px.groupBy("i", "j").agg((F.count("*") > 40).cast("int").alias("mask"))
    return quality.in_mask(px, mask, ["i", "j"]).select("pixel_id")


@query(f"{cte('granule')} SELECT orbit, mode, processor_version, modification, name FROM granule QUALIFY row_number() OVER (PARTITION BY orbit ORDER BY mode = 'RPRO' DESC, processor_version DESC, modification DESC, name) = 1")
def orbit_dedup(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.newest_per_orbit(view(spark, d, "granule")).select("orbit", "mode", "processor_version", "modification", "name")


@query("SELECT CAST(g AS DATE) AS day FROM generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-03-01', INTERVAL 1 DAY) t(g) WHERE CAST(g AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.missing_days(view(spark, d, "pixel").select(F.to_date("time").alias("day")), "2023-12-20", "2024-03-01")


@query(f"""{cte('pixel')}, t AS (SELECT *, CAST(pixel_id % 3 + 1 AS DOUBLE) AS area FROM pixel), w AS (SELECT *, area / sum(area) OVER (PARTITION BY pixel_id) AS w FROM (SELECT *, i AS ci FROM t UNION ALL SELECT *, (i + 1) % 24 FROM t)),
a AS (SELECT orbit, ci, j, sum(w * value) / sum(w) AS value, sum(w * lat) / sum(w) AS lat, sum(w) AS n, trunc(avg(epoch_us(time) / CAST(1000000 AS DOUBLE))) AS s FROM w GROUP BY orbit, ci, j)
SELECT orbit, ci AS i, j, {r('value', 7)} AS value, {r('lat')} AS lat, {r('n')} AS obs_count, strftime(make_timestamp(CAST(round_even(s / 3600, 0) * 3600 * 1000000 AS BIGINT)), '%Y%m%d_%H') AS hour_key FROM a""")
def superobs_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel").withColumn("area", (F.col("pixel_id") % 3 + 1).cast("double"))
    touched = px.withColumn("i", F.explode(F.array(F.col("i"), (F.col("i") + 1) % 24)))
    out = superobs.superobservations(touched, ["orbit", "i", "j"], "pixel_id", values=("value", "lat"))
    return out.select("orbit", "i", "j", cut("value", 7).alias("value"), cut("lat").alias("lat"), cut("obs_count").alias("obs_count"), "hour_key")


@query(f"{cte('pixel')}, a AS (SELECT i, j, CAST(time AS DATE) AS day, count(*) AS n FROM pixel GROUP BY ALL) SELECT i, j, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_superobs FROM a GROUP BY i, j")
def daily_obs_counts(spark: SparkSession, d: str) -> DataFrame:
    return superobs.daily_counts(view(spark, d, "pixel"), ["i", "j"])


@query(f"{cte('pixel')} SELECT floor(lat / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS lat_bin, CAST(round_even(lon, 1) AS DOUBLE) AS lon_bin, {r('avg(value)')} AS value, count(*) AS n FROM pixel GROUP BY 1, 2")
def bin_mean(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    keys = [fs.bin_floor(F.col("lat"), 0.5).alias("lat_bin"), fs.bin_round(F.col("lon"), 1).cast("double").alias("lon_bin")]
    return px.groupBy(*keys).agg(cut(F.avg("value")).alias("value"), F.count("*").alias("n"))


@query(f"{cte('emission')} SELECT sector, {r('sum(flux * area_m2 * CAST(31536000 AS DOUBLE) * CAST(1e-9 AS DOUBLE))', 2)} AS total FROM emission GROUP BY sector HAVING sum(flux * area_m2) > 0")
def emission_totals_by_sector(spark: SparkSession, d: str) -> DataFrame:
    return emissions.sector_totals(view(spark, d, "emission")).select("sector", cut("total", 2).alias("total"))


_GROUP = "CASE WHEN sector IN ('Landfills', 'Wastewater') THEN 'Waste' WHEN sector IN ('Oil', 'Gas') THEN 'Oil/Gas' ELSE sector END"


@query(f"""{cte('emission')}, s AS (SELECT {_GROUP} AS "group", label, sum(flux * area_m2) AS x FROM emission WHERE sector <> 'SoilAbsorb' GROUP BY 1, 2)
SELECT "group", label, {r('x / sum(x) OVER (PARTITION BY "group")', 8)} AS weight FROM s""")
def sector_weights(spark: SparkSession, d: str) -> DataFrame:
    return emissions.sector_weights(view(spark, d, "emission")).select("group", "label", cut("weight", 8).alias("weight"))


@query(f"{cte('emission')} SELECT cell_id, sector, {r('avg(flux)')} AS flux FROM emission WHERE date >= DATE '1995-01-01' AND date < DATE '1996-01-01' GROUP BY ALL")
def mean_emissions(spark: SparkSession, d: str) -> DataFrame:
    return emissions.mean_emissions(view(spark, d, "emission"), "1995-01-01", "1996-01-01").select("cell_id", "sector", cut("flux").alias("flux"))


@query(f"{cte('emission')}, s AS (SELECT label, sum(flux) AS v FROM emission WHERE label BETWEEN 1 AND 20 GROUP BY label) SELECT CAST(g AS BIGINT) AS label, {r('coalesce(v, 0)', 3)} AS value FROM range(1, 21) t(g) LEFT JOIN s ON s.label = g")
def label_totals(spark: SparkSession, d: str) -> DataFrame:
    return emissions.by_label(view(spark, d, "emission"), 20, "flux").select("label", cut("flux", 3).alias("value"))


@query(f"{cte('emission')} SELECT label, {r('median(flux)')} AS median FROM emission GROUP BY label")
def median_by_label(spark: SparkSession, d: str) -> DataFrame:
    return emissions.median_by_label(view(spark, d, "emission"), "flux").select("label", cut("median").alias("median"))


@query(f"{cte('emission')}, s AS (SELECT label, CASE WHEN flux = 0 THEN 1.5e7 ELSE least(greatest(CAST(5 AS DOUBLE) / flux, CAST(-1.5e7 AS DOUBLE)), CAST(1.5e7 AS DOUBLE)) END AS sf FROM emission) SELECT label, {r('median(sf)', 3)} AS jacobian_sf, {r('median(sf)', 3)} AS effective_sf FROM s GROUP BY label")
def perturbation_factors(spark: SparkSession, d: str) -> DataFrame:
    out = emissions.perturbations(view(spark, d, "emission"), 5.0)
    return out.select("label", cut("jacobian_sf", 3).alias("jacobian_sf"), cut("effective_sf", 3).alias("effective_sf"))


@query(f"""{cte('emission')}, f AS (SELECT cell_id, sector, avg(flux) AS flux FROM emission GROUP BY ALL)
SELECT cell_id, sector, {r("flux * CASE WHEN sector = 'SoilAbsorb' THEN 1 ELSE 1 + CAST(cell_id % 7 AS DOUBLE) / CAST(10 AS DOUBLE) END")} AS flux FROM f""")
def posterior_emissions(spark: SparkSession, d: str) -> DataFrame:
    prior = view(spark, d, "emission").groupBy("cell_id", "sector").agg(F.avg("flux").alias("flux"))
    scale = prior.select("cell_id").distinct().withColumn("sf", 1 + (F.col("cell_id") % 7).cast("double") / 10.0)
    return emissions.posterior_emissions(prior, scale).select("cell_id", "sector", cut("flux").alias("flux"))


@query(f"""{cte('emission')}, f AS (SELECT cell_id, sector, avg(flux) AS flux FROM emission GROUP BY ALL)
SELECT cell_id, sector, {r('flux')} AS flux FROM f UNION ALL SELECT cell_id, 'Total', {r('sum(flux)')} FROM f GROUP BY cell_id
UNION ALL SELECT cell_id, 'Total_ExclSoilAbs', {r("sum(CASE WHEN sector <> 'SoilAbsorb' THEN flux ELSE 0 END)")} FROM f GROUP BY cell_id""")
def emission_totals_by_cell(spark: SparkSession, d: str) -> DataFrame:
    prior = view(spark, d, "emission").groupBy("cell_id", "sector").agg(F.avg("flux").alias("flux"))
    return emissions.with_totals(prior).select("cell_id", "sector", cut("flux").alias("flux"))


_S2 = "(CAST(225 AS DOUBLE) * (CAST(0.45 AS DOUBLE) / obs_count + CAST(0.55 AS DOUBLE)) + CAST(20.25 AS DOUBLE))"
_VAR = f"({_S2} / CAST(245.25 AS DOUBLE) * CAST(225 AS DOUBLE))"


@query(f"{cte('obs_model')} SELECT orbit, line, {r(f'sqrt({_S2})', 6)} AS error, {r(_VAR, 6)} AS variance FROM obs_model")
def superobs_error(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("obs_count")
    out = view(spark, d, "obs_model")
    return out.select("orbit", "line", cut(fs.superobs_error(F.lit(15.0), n), 6).alias("error"), cut(fs.observation_variance(F.lit(15.0), n), 6).alias("variance"))


@query(f"{cte('obs_model')} SELECT {r('sum(obs_count * (model - sat)) / sum(obs_count)')} AS bias, {r('stddev_pop(model - sat)')} AS std, {r('sqrt(sum(obs_count * (model - sat) * (model - sat)) / sum(obs_count))')} AS rmse FROM obs_model")
def bias_rmse(spark: SparkSession, d: str) -> DataFrame:
    out = inversion.fit_statistics(view(spark, d, "obs_model").withColumn("d", F.col("model") - F.col("sat")))
    return out.select(*(cut(c).alias(c) for c in ("bias", "std", "rmse")))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "obs_model")
    return rows.select("orbit", "line", "k1", "k2", "k3", "k4", (F.col("sat") - F.col("model")).alias("residual"), fs.observation_variance(F.lit(15.0), F.col("obs_count")).alias("variance"))


_NE = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'sum(k{i} * ' + (f'k{j}' if j else '(sat - model)') + f' / {_VAR})', 3)} AS value FROM obs_model" for i in range(1, 5) for j in range(5))


@query(f"{cte('obs_model')} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, value FROM ({_NE})")
def normal_equations(spark: SparkSession, d: str) -> DataFrame:
    out = inversion.normal_equations(inversion.checked(_rows(spark, d), "residual", "variance"), ["k1", "k2", "k3", "k4"], "residual", "variance")
    return out.select("i", "j", cut("value", 3).alias("value"))


@query(f"{cte('obs_model')} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, value FROM ({_NE})")
def normal_equations_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select(F.array("k1", "k2", "k3", "k4").alias("k"), "residual", "variance")
    return inversion.long_form(inversion.normal_equations_blocks(rows, 4)).select("i", "j", cut("value", 3).alias("value"))


@query(f"""{cte('obs_model')}, s AS (SELECT sum(k1 * k1 / {_VAR}) + 4 AS a, sum(k1 * k2 / {_VAR}) AS b, sum(k2 * k2 / {_VAR}) + 4 AS c, sum(k1 * (sat - model) / {_VAR}) AS y, sum(k2 * (sat - model) / {_VAR}) AS z FROM obs_model), d AS (SELECT *, a * c - b * b AS det FROM s)
SELECT CAST(1 AS INT) AS elem, {r('1 + (c * y - b * z) / det', 6)} AS xhat, {r('c / det', 8)} AS variance, {r('1 - 4 * c / det', 6)} AS averaging_kernel FROM d
UNION ALL SELECT CAST(2 AS INT), {r('1 + (a * z - b * y) / det', 6)}, {r('a / det', 8)}, {r('1 - 4 * a / det', 6)} FROM d""")
def gaussian_posterior(spark: SparkSession, d: str) -> DataFrame:
    rows = inversion.checked(_rows(spark, d), "residual", "variance")
    ktk, kty = inversion.collect_normal(inversion.normal_equations(rows, ["k1", "k2"], "residual", "variance"), 2)
    e = inversion.Elements(2)
    s = inversion.solve_gaussian(ktk, kty, e, *inversion.prior_covariance(e, 0.5), gamma=1.0)
    out = inversion.posterior_table(spark, s)
    return out.select("elem", cut("xhat", 6).alias("xhat"), cut("variance", 8).alias("variance"), cut("averaging_kernel", 6).alias("averaging_kernel"))


@query()
def lognormal_posterior(spark: SparkSession, d: str) -> DataFrame:
    rows = inversion.checked(_rows(spark, d), "residual", "variance")
    ktk, kty = inversion.collect_normal(inversion.normal_equations(rows, ["k1", "k2", "k3", "k4"], "residual", "variance"), 4)
    s = inversion.solve_lognormal(ktk, kty + ktk @ np.ones(4), inversion.Elements(4), 1, 2.0, 0.01)
    return inversion.posterior_table(spark, s)


@query(f"""{cte('pixel')}, p AS (SELECT pixel_id AS obs_id, value, CAST(1 AS INT) AS elem, value + (lat - 29) * CAST(1.5 AS DOUBLE) AS pert, CAST(1.5 AS DOUBLE) AS step FROM pixel UNION ALL SELECT pixel_id, value, 2, value + (lon + 106) * CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE) FROM pixel)
SELECT obs_id, elem, {r('(pert - value) / step', 5)} AS k FROM p""")
def jacobian_fd(spark: SparkSession, d: str) -> DataFrame:
    base = view(spark, d, "pixel").select(F.col("pixel_id").alias("obs_id"), F.col("value").alias("model"), "lat", "lon")
    pert = lambda e, x: F.struct(F.lit(e).alias("elem"), (F.col("model") + x).alias("model"))
    runs = base.select("obs_id", F.explode(F.array(pert(1, (F.col("lat") - 29) * 1.5), pert(2, (F.col("lon") + 106) * 0.5))).alias("r")).select("obs_id", "r.*")
    steps = spark.createDataFrame([(1, 1.5), (2, 0.5)], "elem int, step double")
    return inversion.finite_difference(base, runs, steps).select("obs_id", "elem", cut("k", 5).alias("k"))


@query(f"""{cte('place')} SELECT elem, CAST(CASE WHEN abs(lat - (30 + CAST(0.5 AS DOUBLE) * i)) < 0.5 THEN i END AS INT) AS i FROM (SELECT elem, lat, greatest(0, least(15, ceil((lat - 30) / CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE)))) AS i FROM place)""")
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "place").select("elem", fs.nearest_index(F.col("lat"), 30.0, 0.5, 16, 0.5).alias("i"))


@query(f"""{cte('place', 'pixel')}, c AS (SELECT DISTINCT i * 100 + j AS cell_id, lat, lon FROM pixel), x AS (SELECT elem, cell_id, power(cos(radians(p.lat)) * cos(radians(p.lon)) - cos(radians(c.lat)) * cos(radians(c.lon)), 2) + power(cos(radians(p.lat)) * sin(radians(p.lon)) - cos(radians(c.lat)) * sin(radians(c.lon)), 2) + power(sin(radians(p.lat)) - sin(radians(c.lat)), 2) AS d2 FROM place p, c WHERE p.lat < 36)
SELECT elem AS id, CAST(rank AS INT) AS rank, {r('d2', 9)} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY elem ORDER BY d2, cell_id) AS rank FROM x) WHERE rank <= 3""")
def nearest_cells(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(view(spark, d, "place").filter("lat < 36"), view(spark, d, "pixel"))


def _nearest(place: DataFrame, pixel: DataFrame) -> DataFrame:
    cells = pixel.select((F.col("i") * 100 + F.col("j")).alias("cell_id"), "lat", "lon").distinct()
    return plumes.nearest_cells(place.withColumnRenamed("elem", "id"), cells, 3, 2.0).select("id", "rank", cut("d2", 9).alias("d2"))


@query(f"""{cte('place', 'pixel')}, c AS (SELECT DISTINCT i * 100 + j AS cell_id, lat, lon FROM pixel), x AS (SELECT elem, cell_id, power(cos(radians(p.lat)) * cos(radians(p.lon)) - cos(radians(c.lat)) * cos(radians(c.lon)), 2) + power(cos(radians(p.lat)) * sin(radians(p.lon)) - cos(radians(c.lat)) * sin(radians(c.lon)), 2) + power(sin(radians(p.lat)) - sin(radians(c.lat)), 2) AS d2 FROM place p, c)
SELECT elem AS id, CAST(rank AS INT) AS rank, {r('d2', 9)} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY elem ORDER BY d2, cell_id) AS rank FROM x) WHERE rank <= 3""")
def nearest_cells_all(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(view(spark, d, "place"), view(spark, d, "pixel"))


@query(f"""{cte('pixel')}, c AS (SELECT i, j, count(*) AS n_obs, count(DISTINCT CAST(time AS DATE)) AS n_superobs FROM pixel GROUP BY i, j), l AS (SELECT DISTINCT CAST(i // 6 * 10 + j // 5 AS BIGINT) AS label, i, j FROM pixel),
p AS (SELECT DISTINCT l.label, c.i, c.j, c.n_obs, c.n_superobs FROM l JOIN c ON abs(l.i - c.i) <= 2 AND abs(l.j - c.j) <= 2)
SELECT label, CAST(sum(n_obs) AS BIGINT) AS n_obs, CAST(sum(n_superobs) AS BIGINT) AS n_superobs FROM p GROUP BY label""")
def dilated_counts(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    labels = px.select((F.floor(F.col("i") / 6) * 10 + F.floor(F.col("j") / 5)).cast("long").alias("label"), "i", "j").distinct()
    return superobs.dilated_counts(superobs.daily_counts(px, ["i", "j"]), labels)


_BOX = "lon + CAST((pixel_id % 5) AS DOUBLE) / CAST(50 AS DOUBLE)"


@query(f"""{cte('pixel')}, p AS (SELECT pixel_id, {_BOX} AS x, lat AS y FROM pixel), g AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(-105 AS DOUBLE) + i * CAST(0.3125 AS DOUBLE) AS cx, CAST(30 AS DOUBLE) + j * CAST(0.25 AS DOUBLE) AS cy FROM range(0, 24) a(i), range(0, 20) b(j)),
o AS (SELECT pixel_id, i, j, greatest(0, least(x + 0.1::DOUBLE, cx + 0.15625::DOUBLE) - greatest(x - 0.1::DOUBLE, cx - 0.15625::DOUBLE)) * greatest(0, least(y + 0.05::DOUBLE, cy + 0.125::DOUBLE) - greatest(y - 0.05::DOUBLE, cy - 0.125::DOUBLE)) AS area FROM p JOIN g ON abs(x - cx) < 0.3 AND abs(y - cy) < 0.3)
SELECT pixel_id, i, j, {r('area', 8)} AS area FROM o WHERE area > 0.0000001""")
def overlap_area(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel").select("pixel_id", (F.col("lon") + (F.col("pixel_id") % 5).cast("double") / 50.0).alias("x"), F.col("lat").alias("y"))
    corners = lambda c, h, signs: F.array(*(F.col(c) + s * h for s in signs))
    px = px.select("pixel_id", corners("x", 0.1, (-1, 1, 1, -1)).alias("lon_bounds"), corners("y", 0.05, (-1, -1, 1, 1)).alias("lat_bounds"))
    out = superobs.touched_cells(px, -105.0, 0.3125, 24, 30.0, 0.25, 20)
    return out.filter("area > 0.0000001").select("pixel_id", "i", "j", cut("area", 8).alias("area"))


@query(f"""{cte('place', 'pixel')} SELECT elem, pixel_id, {r('greatest(0, least(p.lat + 1, x.lat + 0.5::DOUBLE) - greatest(p.lat - 1, x.lat - 0.5::DOUBLE))', 6)} AS overlap FROM place p JOIN pixel x ON p.elem % 20 = x.j WHERE x.pixel_id < 2000""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(view(spark, d, "place"), view(spark, d, "pixel").filter("pixel_id < 2000"))


def _overlaps(place: DataFrame, pixel: DataFrame, blocks: int = 64) -> DataFrame:
    """Pixels are dealt to blocks, places to each. Rows with equal latitudes are one in groups up to the last step, so pairs are never shuffled."""
    p = place.select("elem", F.col("lat").alias("plat"), (F.col("elem") % 20).alias("j"))
    p = covariance.grouped(p, ["plat", "j"], ["elem"]).withColumnRenamed("members", "p").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = pixel.withColumn("block", F.pmod(F.xxhash64("pixel_id"), F.lit(blocks)).cast("int"))
    x = covariance.grouped(x, ["block", "lat", "j"], ["pixel_id"]).withColumnRenamed("members", "x")
    # a given number of partitions: small tables would be joined in one task, whatever the number of their pairs
    p, x = (side.repartition(4 * blocks, "block", "j") for side in (p, x))
    overlap = cut(box_overlap(F.col("plat") - 1, F.col("plat") + 1, F.col("lat") - 0.5, F.col("lat") + 0.5), 6)
    pairs = covariance.exploded(x.hint("merge").join(p, ["block", "j"]).select("x", "p", overlap.alias("overlap")), "x", "p", 4 * blocks)
    return pairs.select("p.elem", "x.pixel_id", "overlap")


@query(f"""{cte('place', 'pixel')} SELECT elem, pixel_id, {r('greatest(0, least(p.lat + 1, x.lat + 0.5::DOUBLE) - greatest(p.lat - 1, x.lat - 0.5::DOUBLE))', 6)} AS overlap FROM place p JOIN pixel x ON p.elem % 20 = x.j""")
def interval_overlap_all(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(view(spark, d, "place"), view(spark, d, "pixel"))


_V = "[1000.0::DOUBLE - q, 700.0::DOUBLE, 400.0::DOUBLE]"


@query(f"""{cte('pixel')}, o AS (SELECT pixel_id, CAST(pixel_id % 7 * 5 AS DOUBLE) AS q, value AS k1, lat AS k2, lon AS k3 FROM pixel), e AS (SELECT *, [1000.0::DOUBLE - q, 700.0::DOUBLE, 400.0::DOUBLE] AS s, [980.0::DOUBLE, 800.0::DOUBLE, 600.0::DOUBLE, 300.0::DOUBLE] AS m, [k1, k2, k3] AS x FROM o),
w AS (SELECT pixel_id, l, k, x[k] AS xk, CASE WHEN s[l + 1] >= m[1] THEN CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, least(s[l], m[k]) - greatest(s[l + 1], m[k + 1])) END AS t FROM e, (VALUES (1), (2)) a(l), (VALUES (1), (2), (3)) b(k)),
v AS (SELECT pixel_id, l, sum(t * xk) / sum(t) AS x FROM w GROUP BY pixel_id, l)
SELECT pixel_id, {r('sum((0.1::DOUBLE * l + (0.5::DOUBLE + 0.2::DOUBLE * l) * (x * l - 0.1::DOUBLE * l))) / 3', 6)} AS column_mean, {r('max(CASE WHEN l = 1 THEN x END)', 6)} AS lowest FROM v GROUP BY pixel_id""")
def vertical_remap(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "pixel")
    q = (F.col("pixel_id") % 7 * 5).cast("double")
    sat, model = F.array(1000.0 - q, F.lit(700.0), F.lit(400.0)), F.array(*(F.lit(x) for x in (980.0, 800.0, 600.0, 300.0)))
    o = o.withColumn("p", fv.weighted_levels(fv.overlap_weights(sat, fv.edges_descend(model)), F.array("value", "lat", "lon")))
    column = fv.averaging_kernel_column(F.array(F.lit(0.1), F.lit(0.2)), F.array(F.lit(0.7), F.lit(0.9)), F.array(F.lit(1.0), F.lit(2.0)), F.col("p"))
    return o.select("pixel_id", cut(column, 6).alias("column_mean"), cut(F.col("p")[0], 6).alias("lowest"))


@query("SELECT CAST(k + 1 AS INT) AS period, a + CAST(k * 7 AS INT) AS start, a + CAST(k * 7 + 7 AS INT) AS \"end\" FROM (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) + 1 AS b FROM events), range(0, 1000) t(k) WHERE a + CAST(k * 7 + 7 AS INT) <= b")
def kalman_periods(spark: SparkSession, d: str) -> DataFrame:
    span = view(spark, d, "pixel").agg(F.min(F.to_date("time")).alias("a"), F.date_add(F.max(F.to_date("time")), 1).alias("b")).first()
    return kalman.make_periods(spark, span["a"], span["b"], 7)


def _fold_cells(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "place")
    return s.select(F.col("elem").alias("cell_id"), (F.col("elem") % 9 + 1).cast("double").alias("flux"), F.lit(1.0).alias("area_m2"), (F.col("elem") % 4 != 0).alias("roi"))


@query(f"""{cte('emission')}, w AS (SELECT CAST(k + 1 AS INT) AS period, DATE '1993-01-01' + CAST(k * 500 AS INT) AS a, DATE '1993-01-01' + CAST(k * 500 + 500 AS INT) AS b FROM range(0, 3) t(k)),
e AS (SELECT period, cell_id, sum(m) AS flux FROM (SELECT period, cell_id, sector, avg(flux) AS m FROM emission JOIN w ON date >= a AND date < b WHERE sector <> 'SoilAbsorb' GROUP BY ALL) GROUP BY ALL),
c AS (SELECT s_suppkey AS cell_id, coalesce(f.flux, 0) AS flux, coalesce(g.flux, 0) AS flux2, s_suppkey % 4 <> 0 AS roi, CAST(s_suppkey % 3 - CAST(0.5 AS DOUBLE) AS DOUBLE) AS l1, CAST(s_suppkey % 5 + 1 AS DOUBLE) / 3 AS l2
  FROM supplier LEFT JOIN e f ON f.cell_id = s_suppkey AND f.period = 1 LEFT JOIN e g ON g.cell_id = s_suppkey AND g.period = 2),
n1 AS (SELECT *, flux * l1 AS post, 0.1::DOUBLE * flux + 0.9::DOUBLE * greatest(flux * l1, 0) AS nudged FROM c), s1 AS (SELECT sum(post) FILTER (roi) / sum(nudged) FILTER (roi) AS f FROM n1),
p2 AS (SELECT cell_id, flux2, roi, l2, CASE WHEN roi AND flux <> 0 THEN nudged * f / flux ELSE 1 END AS sf FROM n1, s1), n2 AS (SELECT *, flux2 * l2 * sf AS post, 0.1::DOUBLE * flux2 + 0.9::DOUBLE * greatest(flux2 * l2 * sf, 0) AS nudged FROM p2), s2 AS (SELECT sum(post) FILTER (roi) / sum(nudged) FILTER (roi) AS f FROM n2)
SELECT CAST(1 AS INT) AS period, cell_id, 1.0::DOUBLE AS sf FROM c UNION ALL SELECT 2, cell_id, {r('sf', 6)} FROM p2 UNION ALL SELECT 3, cell_id, {r('CASE WHEN roi AND flux2 <> 0 THEN nudged * f / flux2 ELSE 1 END', 6)} FROM n2, s2""")
def kalman_fold(spark: SparkSession, d: str) -> DataFrame:
    cells = _fold_cells(spark, d)
    latest = [F.col("cell_id") % 3 - 0.5, (F.col("cell_id") % 5 + 1).cast("double") / 3.0, F.lit(1.0)]
    periods = cells.select("cell_id", F.posexplode(F.array(*(x.cast("double") for x in latest))).alias("p", "sf")).select((F.col("p") + 1).alias("period"), "cell_id", "sf")
    fluxes = kalman.period_fluxes(view(spark, d, "emission"), kalman.make_periods(spark, date(1993, 1, 1), date(1997, 2, 9), 500))
    return kalman.replay(periods, cells, fluxes, 0.1).select("period", "cell_id", cut("sf", 6).alias("sf"))


@query(f"{cte('pixel')}, a AS (SELECT CAST(time AS DATE) AS day, sum(value) AS v FROM pixel GROUP BY 1) SELECT day, {r('avg(v) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)', 3)} AS smooth FROM a")
def moving_average_centered(spark: SparkSession, d: str) -> DataFrame:
    daily = view(spark, d, "pixel").groupBy(F.to_date("time").alias("day")).agg(F.sum("value").alias("v"))
    return kalman.centred_mean(daily, "day", "v").select("day", cut("smooth", 3).alias("smooth"))


def _bc(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    obs = px.select(F.to_date("time").alias("day"), "i", "j", F.col("value").alias("sat"), (F.col("value") + F.col("i") - F.col("j")).alias("model"))
    return boundary.daily_means(obs)


_BC = "bc AS (SELECT CAST(time AS DATE) AS day, i, j, avg(value + i - j) - avg(value) AS bias FROM pixel GROUP BY ALL)"


@query(f"{cte('pixel')}, {_BC}, w AS (SELECT i, j, day, coalesce(avg(bias) OVER (PARTITION BY i, j ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), avg(bias) OVER (PARTITION BY i, j ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS s FROM bc) SELECT i, j, day, {r('s')} AS smooth FROM w")
def trailing_15_30_fill(spark: SparkSession, d: str) -> DataFrame:
    return boundary.trailing_means(_bc(spark, d)).select("i", "j", "day", cut("smooth").alias("smooth"))


@query(f"""{cte('pixel')}, {_BC}, s AS (SELECT day, i + di AS i, j + dj AS j, bias FROM bc, range(-2, 3) a(di), range(-2, 3) b(dj))
SELECT day, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN count(*) >= 8 THEN {r('avg(bias)')} END AS bias FROM s GROUP BY day, i, j""")
def spatial_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = boundary.spatial_mean(_bc(spark, d), least=8)
    return out.select("day", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.when(F.col("bias").isNotNull(), cut("bias")).alias("bias"))


@query(f"""{cte('pixel')}, {_BC}, b AS (SELECT day, j, CASE WHEN count(bias) >= 8 THEN avg(bias) END AS m FROM bc GROUP BY day, j),
n AS (SELECT a.day, a.j, (SELECT max(x.j) FROM b x WHERE x.day = a.day AND x.j <= a.j AND x.m IS NOT NULL) AS j0, (SELECT min(x.j) FROM b x WHERE x.day = a.day AND x.j >= a.j AND x.m IS NOT NULL) AS j1 FROM b a),
v AS (SELECT n.*, p.m AS m0, q.m AS m1 FROM n LEFT JOIN b p ON p.day = n.day AND p.j = n.j0 LEFT JOIN b q ON q.day = n.day AND q.j = n.j1)
SELECT day, j, {r('CASE WHEN j0 = j1 THEN m0 WHEN j0 IS NULL THEN m1 WHEN j1 IS NULL THEN m0 ELSE m0 + (m1 - m0) * (j - j0) / (j1 - j0) END')} AS filler FROM v""")
def lat_fill(spark: SparkSession, d: str) -> DataFrame:
    return boundary.latitude_fill(_bc(spark, d), least=8).select("day", "j", cut("filler").alias("filler"))


@query(f"""{cte('station')}, s AS (SELECT site, avg(op) AS m, stddev_samp(op) AS sd FROM station GROUP BY site) SELECT l_orderkey, l_linenumber, t.site, {r('op')} AS op FROM station t JOIN s USING (site) WHERE abs(op - m) < CAST(1.5 AS DOUBLE) * sd""")
def sigma_clip(spark: SparkSession, d: str) -> DataFrame:
    return stations.sigma_clip(view(spark, d, "station"), "site", "op", 1.5).select("l_orderkey", "l_linenumber", "site", cut("op").alias("op"))


@query(f"""{cte('station')}, b AS (SELECT CASE WHEN latitude > -90 AND latitude <= -30 THEN 0 WHEN latitude > -30 AND latitude <= 0 THEN 1 WHEN latitude > 0 AND latitude <= 30 THEN 2 WHEN latitude > 30 AND latitude <= 90 THEN 3 END AS band, CAST(date_trunc('month', time) AS DATE) AS month, op, gc FROM station)
SELECT CAST(band AS INT) AS band, month, {r('avg(op)', 3)} AS op, {r('avg(gc)', 3)} AS gc, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY band, month""")
def latband_means(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "station").withColumn("band", stations.half_open_bin(F.col("latitude"), [-90, -30, 0, 30, 90])).filter("band is not null")
    return rows.groupBy("band", F.to_date(F.date_trunc("month", "time")).alias("month")).agg(cut(F.avg("op"), 3).alias("op"), cut(F.avg("gc"), 3).alias("gc"), F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey % 20 AS site, o_orderdate AS t, epoch(o_orderdate) AS s, o_totalprice AS v FROM orders) SELECT o_orderkey, site, {r('avg(v) OVER (PARTITION BY site ORDER BY s RANGE BETWEEN 1295999 PRECEDING AND 1296000 FOLLOWING)', 7)} AS rolling FROM o""")
def rolling_30d(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 20).alias("site"), F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_totalprice").alias("v"))
    return stations.rolling_days(o, ["site"], "t", "v").select("o_orderkey", "site", cut("rolling", 7).alias("rolling"))


@query(f"""{cte('place')}, d AS (SELECT a.elem AS i, b.elem AS j, 2 * 6371.0::DOUBLE * asin(sqrt(least(1, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM place a, place b)
SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE {r('exp(-km / 200)', 6)} END AS c FROM d""")
def prior_cov_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = covariance.covariance_pairs(view(spark, d, "place"), 200.0)
    return out.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(cut("c", 6)).alias("c"))


_SECTORS = ("Oil", "Gas", "Coal", "Livestock", "Landfills", "Wastewater", "Wetlands")


@query(f"""{cte('place', 'emission')}, f AS (SELECT cell_id, {', '.join(f"coalesce(sum(flux) FILTER (sector = '{s}'), 0) AS s{k}" for k, s in enumerate(_SECTORS))} FROM emission GROUP BY cell_id),
n AS (SELECT *, sqrt({' + '.join(f's{k} * s{k}' for k in range(len(_SECTORS)))}) AS norm FROM f),
d AS (SELECT a.elem AS i, b.elem AS j, 2 * 6371.0::DOUBLE * asin(sqrt(least(1, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM place a, place b),
c AS (SELECT i, j, exp(-km / 200) * CASE WHEN x.norm > 0 AND y.norm > 0 THEN ({' + '.join(f'x.s{k} * y.s{k}' for k in range(len(_SECTORS)))}) / (x.norm * y.norm) ELSE 0 END AS c FROM d LEFT JOIN n x ON x.cell_id = i LEFT JOIN n y ON y.cell_id = j)
SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE {r('greatest(0, least(1, c))', 6)} END AS c FROM c""")
def prior_cov_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    flux = view(spark, d, "emission").filter(F.col("sector").isin(*_SECTORS)).groupBy(F.col("cell_id").alias("elem"), "sector").agg(F.sum("flux").alias("flux"))
    share = lambda s: F.coalesce(F.sum(F.when(F.col("sector") == s, F.col("share"))), F.lit(0.0))
    shares = covariance.sector_shares(flux).groupBy("elem").agg(F.struct(*(share(s).alias(s) for s in _SECTORS)).alias("shares"))
    none = F.struct(*(F.lit(0.0).alias(s) for s in _SECTORS))
    elements = view(spark, d, "place").join(shares, "elem", "left").withColumn("shares", F.coalesce("shares", none))
    out = covariance.covariance_pairs(elements, 200.0)
    return out.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(cut("c", 6)).alias("c"))


@query(f"""{cte('obs_model')}, c AS ({' UNION ALL '.join(f'SELECT {i} AS i, {j} AS j, sum(k{i} * k{j}) AS c FROM obs_model' for i in range(1, 5) for j in range(1, 5))})
SELECT CAST(a.i AS INT) AS i, CAST(a.j AS INT) AS j, {r('a.c / (sqrt(x.c) * sqrt(y.c))', 6)} AS c FROM c a JOIN c x ON x.i = a.i AND x.j = a.i JOIN c y ON y.i = a.j AND y.j = a.j""")
def cov_to_corr(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "obs_model").withColumn("one", F.lit(1.0))
    cov = inversion.normal_equations(rows, ["k1", "k2", "k3", "k4"], "one", "one").filter("j > 0").withColumnRenamed("value", "c")
    return inversion.to_correlation(cov).select("i", "j", cut("c", 6).alias("c"))


@query(f"""{cte('pixel')}, c AS (SELECT CAST(i // 6 * 10 + j // 5 AS BIGINT) AS label, abs(avg(value)) AS flux, CAST(count(DISTINCT CAST(time AS DATE)) - 20 AS BIGINT) AS m FROM pixel GROUP BY 1)
SELECT label, {r('CASE WHEN m > 0 THEN power(0.5::DOUBLE * flux, 2) / (power(0.5::DOUBLE * flux, 2) + power(15.0::DOUBLE / 2, 2) / m) ELSE 0 END', 6)} AS a FROM c""")
def ak_estimate(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    cells = px.groupBy((F.floor(F.col("i") / 6) * 10 + F.floor(F.col("j") / 5)).cast("long").alias("label")).agg(F.abs(F.avg("value")).alias("flux"), (F.countDistinct(F.to_date("time")) - 20).alias("m"))
    return inversion.averaging_kernel_estimate(cells, 2.0, 0.5, 15.0).select("label", cut("a", 6).alias("a"))


@query(f"""{cte('plume')}, g AS (SELECT datasource, i, j, count(emission_rate) AS plumes, count(*) - count(emission_rate) AS non_detections, avg(emission_rate) AS rate FROM plume WHERE instrument NOT IN ('GAO', 'ang', 'av3') GROUP BY ALL)
SELECT i, j, {r('avg(plumes)', 6)} AS plumes, {r('avg(rate)', 4)} AS rate FROM g WHERE coalesce(rate > 60, false) OR plumes > 12 GROUP BY i, j""")
def plume_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = plumes.gridded(plumes.without_aircraft(view(spark, d, "plume")), [F.col("i"), F.col("j")])
    return plumes.sources_over(grid, ["i", "j"], 60.0, 12).select("i", "j", cut("plumes", 6).alias("plumes"), cut("rate", 4).alias("rate"))


@query(f"""{cte('obs_model')}, t AS (SELECT orbit * 10 + line AS row_id, round(k1, 6) AS a, round(k2, 6) AS b, round(obs_count, 6) AS c, sat FROM obs_model), n AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY row_id) AS n FROM t), q AS (SELECT a, b, c, sat, row_number() OVER (PARTITION BY a, b, c ORDER BY row_id) AS n FROM t WHERE row_id % 2 = 0)
SELECT n.row_id, q.sat AS ref_sat FROM n JOIN q USING (a, b, c, n)""")
def reference_alignment(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "obs_model").select((F.col("orbit") * 10 + F.col("line")).alias("row_id"), F.col("k1").alias("lon"), F.col("k2").alias("lat"), "obs_count", "sat")
    return inversion.align_with_reference(t, t.filter("row_id % 2 = 0"), "sat").select("row_id", "ref_sat")


@query(f"{cte('pixel')}, c AS (SELECT DISTINCT i, j FROM pixel) SELECT i, j, count(*) OVER () + 1 - row_number() OVER (ORDER BY j, i) AS label FROM c")
def number_cells(spark: SparkSession, d: str) -> DataFrame:
    return statevector.number_cells(view(spark, d, "pixel").select("i", "j").distinct()).select("i", "j", "label")


@query(f"""{cte('pixel')}, w AS (SELECT i AS src, CAST(i // 4 AS INT) AS dst, CAST(i % 4 + 1 AS DOUBLE) AS w FROM (SELECT DISTINCT i FROM pixel)), f AS (SELECT i AS src, avg(value) AS v FROM pixel GROUP BY i)
SELECT dst, {r('sum(v * w) / sum(w)')} AS value, sum(w) AS weight FROM f JOIN w USING (src) GROUP BY dst""")
def weight_table_regrid(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "pixel")
    field = px.groupBy(F.col("i").alias("src")).agg(F.avg("value").alias("value"))
    weights = px.select(F.col("i").alias("src")).distinct().select("src", F.floor(F.col("src") / 4).cast("int").alias("dst"), (F.col("src") % 4 + 1).cast("double").alias("w"))
    return superobs.by_weights(field, weights).select("dst", cut("value").alias("value"), "weight")


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "place").withColumn("sensitivity", (F.col("elem") % 11).cast("double") / 11.0)
    return clustering.cluster(p.withColumn("cell_id", F.col("elem")), 8).select("elem", "cluster")
