"""From super-observations and model columns to modelled values and sensitivities. All joins are on (hour_key, i, j)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vertical import edges_descend, seen_column

AT = ["hour_key", "i", "j"]


def model_at(superobs: DataFrame, model: DataFrame) -> DataFrame:
    """``superobs`` with their model column, ``conc`` and ``pedge``; a missing one raises, and so do edges that don't descend.

    ``model(hour_key, i, j, conc, pedge)``.
    """
    found = superobs.join(model.select(*AT, "conc", F.col("pedge").cast("array<double>").alias("pedge")), AT, "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no model column at"), *AT)).cast("array<double>")
    return found.withColumn("pedge", edges_descend(F.when(F.col("pedge").isNotNull(), F.col("pedge")).otherwise(missing)))


def seen_as(rows: DataFrame) -> DataFrame:
    """The column that the satellite would see of a model's: remapped to its layers, then by its averaging kernel."""
    return rows.withColumn("model", seen_column("p_sat", "pedge", "conc", "apriori", "avkern", "dry_air")).drop("pedge", "conc")


def modelled(superobs: DataFrame, model: DataFrame) -> DataFrame:
    """``superobs`` with ``model``, the value of the base run."""
    return seen_as(model_at(superobs, model))


def perturbed(superobs: DataFrame, model: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, elem, model): what each perturbed run of ``runs(elem, hour_key, i, j, conc)`` gives at the super-observations.

    One join for all runs, whose edges are the base run's. An observation
    without any run raises.
    """
    placed = model_at(superobs, model).drop("conc").join(runs.select("elem", *AT, "conc"), AT, "left")
    known = F.when(F.col("elem").isNotNull(), F.col("conc")).otherwise(F.raise_error(F.lit("an observation without perturbed runs")).cast("array<double>"))
    return seen_as(placed.withColumn("conc", known)).select(*keys, "elem", "model")


def sensitivities(values: DataFrame, bases: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, elem, k): (perturbed - base) / step, with each element's own base run.

    ``bases(keys, run, model)`` and ``steps(elem, run, step)``: emission elements
    step by their effective factor from the base run, hydroxyl ones by their
    perturbation less one, boundary ones by theirs from the first run. ``steps``
    has a row an element and is broadcast.
    """
    base = bases.select(*keys, "run", F.col("model").alias("_base"))
    joined = values.join(F.broadcast(steps), "elem").join(base, [*keys, "run"])
    return joined.select(*keys, "elem", ((F.col("model") - F.col("_base")) / F.col("step")).alias("k"))


def jacobian_rows(k: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(keys, k array): sensitivities of elements 1..n as one row an observation; a missing element raises."""
    rows = k.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("elem", "k"))).alias("_m"))
    full = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda e: F.col("_m")[e])
    ok = F.forall(full, lambda x: x.isNotNull())
    return rows.select(*keys, F.when(ok, full).otherwise(F.raise_error(F.lit("an element without sensitivity")).cast("array<double>")).alias("k"))


def scaled_rows(rows: DataFrame, factors: DataFrame, n: int, bc: bool = False, n_oh: int = 0) -> DataFrame:
    """Sensitivities of a reference run times ``factors(elem, factor)``; boundary and hydroxyl elements stay."""
    free = n - n_oh - 4 * bc
    table = factors.filter(F.col("elem") <= free).agg(F.map_from_entries(F.collect_list(F.struct(F.col("elem").cast("int"), "factor"))).alias("_f"))
    factor = lambda e: F.coalesce(F.col("_f")[e + 1], F.lit(1.0))
    return rows.join(F.broadcast(table)).withColumn("k", F.transform("k", lambda x, e: x * factor(e))).drop("_f")


def overlap_weighted(touched: DataFrame, columns: DataFrame, pixel: str = "pixel_id") -> DataFrame:
    """(pixel, model): area-weighted mean of the columns of the cells that a pixel touches, for pixels that are not averaged.

    ``touched(pixel, hour_key, i, j, area)`` and ``columns(pixel, i, j, model)``.
    """
    return touched.join(columns, [pixel, "i", "j"]).groupBy(pixel).agg((F.sum(F.col("area") * F.col("model")) / F.sum("area")).alias("model"))


def paired(prior: DataFrame, posterior: DataFrame, keys: list[str]) -> DataFrame:
    """Observations with their prior and posterior model values, matched by orbit and cell; the north-west comes first."""
    after = posterior.select(*keys, F.col("model").alias("posterior"))
    return prior.withColumnRenamed("model", "prior").join(after, keys).orderBy(F.desc("lat"), F.asc("lon"))


def osse_truth(elements: DataFrame, sigma: float, lognormal: bool = False, seed: int = 0) -> DataFrame:
    """(elem, sf): random true factors with mean one, normal with deviation ``sigma`` or lognormal with that geometric one."""
    z = F.randn(seed)
    spread = F.log(F.lit(sigma))
    return elements.select("elem", (F.exp(z * spread - spread * spread / 2) if lognormal else 1 + z * sigma).alias("sf"))


def with_noise(obs: DataFrame, sigma: float, seed: int = 0, value: str = "model") -> DataFrame:
    """Synthetic observations: the value with normal noise of deviation ``sigma``."""
    return obs.withColumn("sat", F.col(value) + F.randn(seed) * sigma)
