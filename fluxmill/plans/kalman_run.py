"""A whole filter run: each period's observations are inverted, and its posterior gives the next one's prior."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import kalman
from .inversion_run import invert


def run_filter(periods: DataFrame, cells: DataFrame, emission: DataFrame, observe: Callable[[int, DataFrame, DataFrame], DataFrame], n: int, obs_err: float, lists: dict, fraction: float, archive: str, last: int | None = None, **options) -> DataFrame:
    """(period, cell_id, prior_sf, posterior_sf) of ``periods(period, start, end)``, as ``kalman.run_periods`` gives and archives them.

    ``cells(cell_id, label, area_m2, roi)`` and ``emission(period, cell_id,
    flux)``. ``observe(period, window, prior)`` gives a period's observations
    (sat, model, obs_count, k), modelled with the prior factors (cell_id, sf);
    they are inverted with the members of ``lists``, and the mean posterior of
    those that qualify goes to the cells of each element. ``options`` are those
    of ``members_of``: elements, a prior's correlation, lognormal errors.
    """

    def one(period: int, window: DataFrame, prior: DataFrame) -> DataFrame:
        _, posterior = invert(observe(period, window, prior), n, obs_err, lists, cells=cells.select("cell_id", "label"), **options)
        return posterior.select("cell_id", "sf")

    return kalman.run_periods(periods, cells, emission, one, fraction, archive, last)
