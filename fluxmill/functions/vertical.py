"""Vertical profiles as array columns: regridding weights, remapping and averaging kernels; and the three at once in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edges_descend(edges: Column) -> Column:
    """The edges, or an error if they don't descend strictly."""
    ok = F.forall(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.element_at(edges, k) > F.element_at(edges, k + 1))
    return F.when(ok, edges).otherwise(F.raise_error(F.lit("pressure edges don't descend")).cast("array<double>"))


def overlap_weights(sat: Column, model: Column) -> Column:
    """For each satellite layer, its share in each model layer; edges descend.

    Layers wholly below the model's surface take its lowest layer; rows sum to
    one, or are zero without overlap.
    """
    layers = lambda edges: F.sequence(F.lit(1), F.size(edges) - 1)

    def row(i: Column) -> Column:
        bottom, top = F.element_at(sat, i), F.element_at(sat, i + 1)
        thick = F.transform(layers(model), lambda k: F.greatest(F.lit(0.0), F.least(bottom, F.element_at(model, k)) - F.greatest(top, F.element_at(model, k + 1))))
        total = F.aggregate(thick, F.lit(0.0), lambda a, x: a + x)
        lowest = F.transform(layers(model), lambda k: F.when(k == 1, 1.0).otherwise(0.0))
        return F.when(top >= F.element_at(model, 1), lowest).when(total > 0, F.transform(thick, lambda x: x / total)).otherwise(thick)

    return F.transform(layers(sat), row)


def weighted_levels(weights: Column, profile: Column) -> Column:
    """Satellite-layer values: each row of weights times the model profile."""
    return F.transform(weights, lambda row: F.aggregate(F.zip_with(row, profile, lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x))


def remap_extended(sat: Column, model: Column, profile: Column) -> Column:
    """Pressure-weighted remapping with the model's lowest layer drawn down to the satellite's surface."""
    ground = F.greatest(F.element_at(model, 1), F.element_at(sat, 1))
    extended = F.transform(model, lambda p, k: F.when(k == 0, ground).otherwise(p))
    return weighted_levels(overlap_weights(sat, extended), profile)


def averaging_kernel_column(apriori: Column, kernel: Column, dry_air: Column, profile: Column) -> Column:
    """sum(a + AK (x air - a)) / sum(air) over satellite layers."""
    seen = F.transform(F.arrays_zip(apriori.alias("a"), kernel.alias("k"), dry_air.alias("d"), profile.alias("x")), lambda s: s["a"] + s["k"] * (s["x"] * s["d"] - s["a"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return total(seen) / total(F.transform(dry_air, lambda d: d.cast("double")))


def air_weighted_mean(profile: Column, air: Column) -> Column:
    both = F.aggregate(F.zip_with(profile, air, lambda x, d: x * d), F.lit(0.0), lambda s, x: s + x)
    return both / F.aggregate(air, F.lit(0.0), lambda s, x: s + x)


def interpolate_levels(profile: Column, source: list[float], target: list[float]) -> Column:
    """Linear in pressure between fixed descending mid-levels, extrapolated at both ends."""
    out = []
    for p in target:
        k = next((i for i in range(len(source) - 1) if source[i] >= p >= source[i + 1]), 0 if p > source[0] else len(source) - 2)
        f = (p - source[k]) / (source[k + 1] - source[k])
        out.append(F.element_at(profile, k + 1) * (1 - f) + F.element_at(profile, k + 2) * f)
    return F.array(*out)


#: Columns whose layers are compared at once.
_ROWS = 2048


def seen_columns(sat: np.ndarray, model: np.ndarray, conc: np.ndarray, apriori: np.ndarray, kernel: np.ndarray, dry_air: np.ndarray) -> np.ndarray:
    """What a satellite sees of model columns, a row each: ``averaging_kernel_column`` of ``weighted_levels`` of ``overlap_weights``."""
    bottom, top = sat[:, :-1, None], sat[:, 1:, None]
    thick = np.maximum(0.0, np.minimum(bottom, model[:, None, :-1]) - np.maximum(top, model[:, None, 1:]))
    total = thick.sum(axis=2)
    mean = np.einsum("nsm,nm->ns", thick, conc) / np.where(total > 0, total, 1.0)
    profile = np.where(top[:, :, 0] >= model[:, :1], conc[:, :1], mean)
    return (apriori + kernel * (profile * dry_air - apriori)).sum(axis=1) / dry_air.sum(axis=1)


@F.pandas_udf(T.DoubleType())
def seen_column(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same for array columns (satellite edges, model edges, concentrations, prior, kernel, dry air), of any numbers of layers."""
    for columns in batches:
        out = np.full(len(columns[0]), np.nan)
        sizes = pd.Series(list(zip(columns[0].str.len(), columns[1].str.len(), strict=True)))
        for _, at in sizes.groupby(sizes).groups.items():
            for k in range(0, len(at), _ROWS):
                rows = at[k : k + _ROWS]
                out[rows] = seen_columns(*(np.array(c.iloc[rows].tolist(), float) for c in columns))
        yield pd.Series(out)
