"""From observations with sensitivities to a gridded posterior: one pass over the observations, and a task for each member."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensemble as ens
from ..operators import inversion as inv
from ..sources.scratch import Saved


def members_of(obs: DataFrame, n: int, obs_err: float, lists: dict, elements: inv.Elements | None = None, correlation: np.ndarray | None = None, spread: np.ndarray | None = None, lognormal: bool = False, n_buffer: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, solved): a row a member, and a row for each member and element, as ``ensemble.solve_members`` gives them.

    ``obs(sat, model, obs_count, k array)``. ``lists`` has values of prior_err,
    obs_err, gamma, err_bc, err_oh and, for lognormal errors, err_buffer; all
    combinations are members. ``obs_err`` holds where lists has none.
    """
    errs = [float(e) for e in lists.get("obs_err", [obs_err])]
    rows = obs.select("k", (F.col("sat") - F.col("model")).alias("residual"), ens.observation_variances(errs).alias("variances"))
    stack = ens.collect_stack(ens.normal_stack(inv.checked(rows, "residual", arrays=("k", "variances")), n, len(errs)), n, len(errs))
    members = ens.grid(lists)
    problem = ens.Problem(elements or inv.Elements(n), correlation, spread, lognormal, n_buffer)
    save = Saved(obs.sparkSession, "ensemble")
    solved = save(ens.solve_members(stack, errs, members, problem, obs.sparkSession), "solved")
    return ens.member_table(solved, members), solved


def invert(obs: DataFrame, n: int, obs_err: float, lists: dict, elements: inv.Elements | None = None, cells: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(members, posterior): every member's Ja, and the mean posterior of those that qualify, on cells if given; ``options`` as for ``members_of``."""
    members, solved = members_of(obs, n, obs_err, lists, elements, **options)
    mean = ens.ensemble_mean(solved, members)
    return members, inv.gridded_posterior(cells, mean) if cells is not None else mean
