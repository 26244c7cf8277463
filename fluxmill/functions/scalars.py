"""Column functions of the inversion: units, errors, binning, parsing and element classes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts per unit, molar masses (kg/mol), constants of the super-observation error (ppb).
MIXING_RATIO = {"CH4": 1e9, "CO2": 1e6}
MOLAR_MASS = {"CH4": 0.01604, "CO2": 0.04401}
ERROR_CORRELATION, TRANSPORT_ERROR = 0.55, 4.5
MAX_PERTURBATION = 1.5e7
SECONDS_PER_YEAR = 86400.0 * 365.0


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def lookup(table: dict[str, float], species: str) -> float:
    if species not in table:
        raise ValueError(f"unknown species {species!r}; known: {sorted(table)}")
    return table[species]


def superobs_error(sigma: Column, count: Column, transport: float = TRANSPORT_ERROR) -> Column:
    """Error of the mean of ``count`` correlated observations with error ``sigma``."""
    r = ERROR_CORRELATION
    return F.sqrt(sigma * sigma * ((1 - r) / count + r) + transport * transport)


def observation_variance(sigma: Column, count: Column) -> Column:
    """sigma^2 scaled by the squared error at ``count`` over that at one; counts below one are one; never under or at 0."""
    p = F.greatest(count, F.lit(1.0))
    scale = F.pow(superobs_error(sigma, p), 2) / F.pow(superobs_error(sigma, F.lit(1.0)), 2)
    variance = scale * sigma * sigma
    return F.when(variance > 0, variance).otherwise(F.lit(1.0))


def hour_key(t: Column, threshold: str | None = None) -> Column:
    """``yyyyMMdd_HH`` of the nearest hour, halves to the even one; the hour before where that is ``threshold``."""
    seconds = F.unix_micros(t) / F.lit(1e6)
    near = F.date_format(F.timestamp_seconds(F.bround(seconds / 3600.0) * 3600), "yyyyMMdd_HH")
    floor = F.date_format(F.date_trunc("hour", t), "yyyyMMdd_HH")
    return near if threshold is None else F.when(near == threshold, floor).otherwise(near)


def bin_floor(x: Column, step: float) -> Column:
    return F.floor(x / F.lit(step)) * F.lit(step)


def bin_round(x: Column, digits: int = 1) -> Column:
    """Half-even rounding, as array libraries round."""
    return F.bround(x, digits)


def nearest_index(x: Column, origin: float, step: float, n: int, tolerance: float) -> Column:
    """Index of the nearest of n regular grid values, the first on ties; null if none is nearer than ``tolerance``."""
    k = F.ceil((x - F.lit(origin)) / F.lit(step) - 0.5)
    k = F.greatest(F.lit(0), F.least(F.lit(n - 1), k))
    return F.when(F.abs(x - (F.lit(origin) + k * F.lit(step))) < tolerance, k.cast("int"))


def is_oh_element(e: Column, n: int, optimize_oh: bool, regional: bool) -> Column:
    """Whether element e (from 1) is one of the last one (regional) or two hydroxyl elements."""
    return e > n - (1 if regional else 2) if optimize_oh else F.lit(False)


def is_bc_element(e: Column, n: int, optimize_oh: bool, optimize_bc: bool, regional: bool) -> Column:
    """Whether element e is one of the four boundary elements before the hydroxyl ones."""
    if not optimize_bc:
        return F.lit(False)
    last = n - ((1 if regional else 2) if optimize_oh else 0)
    return (e > last - 4) & (e <= last)


def element_run(e: Column, n_emission: int, tracers: int) -> Column:
    """Run that perturbs element e: emission elements share runs, ``tracers`` each; later ones run alone."""
    shared = -(-n_emission // tracers)
    return F.when(e <= n_emission, F.ceil(e / tracers)).otherwise(e - n_emission + shared).cast("int")


def orbit_number(name: Column) -> Column:
    token = F.element_at(F.split(name, "_"), -5)
    return F.when(token.rlike(r"^\d+$"), token.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no orbit number in "), name)).cast("int"))


def granule_times(name: Column) -> tuple[Column, Column]:
    stamp = lambda k: F.to_timestamp(F.regexp_extract(name, r"_(\d{8}T\d{6})_(\d{8}T\d{6})_", k), "yyyyMMdd'T'HHmmss")
    return stamp(1), stamp(2)


def per_km2_hour(flux: Column) -> Column:
    """kg m-2 s-1 to kg km-2 h-1."""
    return flux * 1e6 * 3600


def wrap_longitude(lon: Column, to_360: bool = False) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon) if to_360 else F.when(lon > 180, lon - 360).otherwise(lon)


def perturbation_factor(target: Column, emission: Column, is_soil: Column | None = None) -> Column:
    """target / emission held to +-1.5e7 (below 0 for a soil sink); 0 / 0 and missing values are 1, x / 0 is the bound."""
    soil = F.lit(False) if is_soil is None else is_soil
    top = F.when(soil, -MAX_PERTURBATION).otherwise(MAX_PERTURBATION)
    ratio = F.when(emission != 0, target / emission).when(target != 0, top)
    held = F.greatest(F.lit(-MAX_PERTURBATION), F.least(F.lit(MAX_PERTURBATION), ratio))
    return F.coalesce(F.when(ratio.isNotNull(), held), F.lit(1.0))


def preview_cost(n: Column, days: Column, box: Column, reference_box: float, spot: bool = False) -> Column:
    """Reference cost of 20 for 243 elements and 31 days, plus storage, in proportion to elements, area and days."""
    storage = (days / 31.0 - 1) * (50 * 10 / 744.0)
    cost = (20 + storage) * (n / 243.0) * (box / reference_box) * (days / 31.0)
    return cost / 3 if spot else cost


def unit_sphere(lat: Column, lon: Column, radius: float = 1.0) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return radius * F.cos(a) * F.cos(b), radius * F.cos(a) * F.sin(b), radius * F.sin(a)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def run_duration(start: date, end: date) -> tuple[int, int, int]:
    """Years, months and days from start to end; a month that is borrowed from has its own number of days."""
    months, days = (end.year - start.year) * 12 + end.month - start.month, end.day - start.day
    if days < 0:
        months -= 1
        year, month = divmod(start.year * 12 + start.month - 1 + months, 12)
        year_after, month_after = divmod(year * 12 + month + 1, 12)
        days = (date(year_after, month_after + 1, 1) - date(year, month + 1, 1)).days + days
    return months // 12, months % 12, days


def run_duration_columns(start: Column, end: Column) -> Column:
    """``run_duration`` as a struct of columns (years, months, days)."""
    short = F.day(end) < F.day(start)
    n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - short.cast("int")
    borrowed = F.day(F.last_day(F.add_months(F.trunc(start, "month"), n)))
    days = F.day(end) - F.day(start) + F.when(short, borrowed).otherwise(0)
    return F.struct(F.floor(n / 12).cast("int").alias("years"), F.pmod(n, F.lit(12)).cast("int").alias("months"), days.cast("int").alias("days"))


def boundary_perturbation(element: Column, last: int, value: float) -> Column:
    """North, south, east and west: ``value`` at the side that element modulo last + 1 names, else 0."""
    return F.array(*(F.when(element % (last + 1) == k, float(value)).otherwise(0.0) for k in range(4)))


def hydroxyl_factor(north: Column, south: Column, north_factor: float, south_factor: float, tolerance: float = 1e-6) -> Column:
    """A hemisphere's factor where its mask is one, else one."""
    on = lambda mask: F.abs(mask - 1.0) <= tolerance
    return F.when(on(north), float(north_factor)).when(on(south), float(south_factor)).otherwise(1.0)


def pad_hour(hour: Column) -> Column:
    return F.lpad(hour.cast("string"), 2, "0")


def as_floats(x) -> list[float]:
    """One number or many, as a list."""
    return [float(v) for v in (x if isinstance(x, (list, tuple)) else [x])]
