"""Readers: Parquet tables in the engine's layouts, point-source CSV and GeoJSON, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lookup, null_if_nan, MIXING_RATIO
from ..operators.quality import surface_flags
from .sinks import write_geojson

SATELLITE = """orbit int, scanline int, ground_pixel int, time timestamp, lat float, lon float, value double, qa float,
  lat_bounds array<float>, lon_bounds array<float>, surface_pressure float, pressure_interval float, dry_air array<float>,
  apriori array<float>, avkern array<float>, swir_albedo float, nir_albedo float, surface_class int, chi2_swir float"""


def read_satellite(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """Pixels with pressure edges in hPa, profiles from the ground up, surface flags and blended albedo; NaN is null.

    With a ``product``, files must be of its kind: the names of the blended ones
    hold BLND, and theirs alone; blended pixels stand in one row of scanlines, 0.
    Any other product raises.
    """
    df = spark.read.schema(SATELLITE).parquet(path)
    if product is not None:
        if product not in ("Operational", "Blended"):
            raise ValueError(f"unknown satellite product {product!r}")
        name = F.regexp_extract(F.input_file_name(), "([^/]*)/?[^/]*$", 0)
        right = name.contains("BLND") == F.lit(product == "Blended")
        said = F.raise_error(F.concat(F.lit(f"not a file of the {product.lower()} product: "), name)).cast("int")
        df = df.withColumn("orbit", F.when(right, F.col("orbit")).otherwise(said))
        if product == "Blended":
            df = df.withColumn("scanline", F.lit(0))
    top, step = F.col("surface_pressure") / 100.0, F.col("pressure_interval") / 100.0
    sc, f9 = surface_flags(F.col("surface_class"))
    return df.select(
        *[c for c in df.columns if c not in ("surface_pressure", "pressure_interval", "dry_air", "apriori", "avkern", "value", "surface_class")],
        null_if_nan(F.col("value")).alias("value"),
        *[F.reverse(c).alias(c) for c in ("dry_air", "apriori", "avkern")],
        F.transform(F.sequence(F.lit(0), F.size("dry_air")), lambda k: top - k * step).alias("pressures"),
        (2.4 * F.col("nir_albedo") - 1.13 * F.col("swir_albedo")).alias("blended_albedo"), sc.alias("sc"), f9.alias("sc_f9"),
    )


def read_model(spark: SparkSession, path: str, species: str, start=None, end=None, runs: list[str] | None = None) -> DataFrame:
    """Model columns in ppb (ppm for CO2); time and run are pushed to the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("hour") >= F.lit(start).cast("timestamp")) & (F.col("hour") < F.lit(end).cast("timestamp")))
    df = df.filter(F.col("run_id").isin(runs)) if runs else df
    unit = lookup(MIXING_RATIO, species)
    return df.withColumns({"conc": F.transform("conc", lambda x: x * unit), "hour_key": F.date_format("hour", "yyyyMMdd_HH")})


def grid_axes(model: DataFrame) -> DataFrame:
    """(axis, low, high, step, n) of the model's cells (lat, lon): their bounds are half a step beyond low and high."""
    axis = lambda c: F.struct(F.lit(c).alias("axis"), F.min(c).alias("low"), F.max(c).alias("high"), F.count_distinct(c).alias("n"))
    rows = model.agg(axis("lat").alias("lat"), axis("lon").alias("lon")).select(F.explode(F.array("lat", "lon")).alias("a")).select("a.*")
    return rows.withColumn("step", F.try_divide(F.col("high") - F.col("low"), F.col("n") - 1))


def cropped(field: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """Cells whose centre lies in the box; the filter reaches the scan."""
    return field.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def station_pairs(observed: DataFrame, modelled: DataFrame, factor: float = 1e9) -> DataFrame:
    """Observations with what the model gives at them, both in the species' unit, matched by their id and not by position."""
    model = modelled.select("obspack_id", (F.col("gc") * factor).alias("gc"))
    return observed.withColumn("op", F.col("op") * factor).join(model, "obspack_id")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon) of a CSV with those headers."""
    df = spark.read.option("header", True).csv(path)
    if not {"lat", "lon"} <= set(df.columns):
        raise ValueError(f"{path} needs the columns lat and lon; it has {df.columns}")
    return df.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """(period, start, end) of a CSV with Starts, Ends and period_number, dates as yyyyMMdd and ends exclusive."""
    df = spark.read.option("header", True).csv(path)
    if not {"Starts", "Ends", "period_number"} <= set(df.columns):
        raise ValueError(f"{path} needs the columns Starts, Ends and period_number; it has {df.columns}")
    day = lambda c, name: F.to_date(c, "yyyyMMdd").alias(name)
    return df.select(F.col("period_number").cast("int").alias("period"), day("Starts", "start"), day("Ends", "end"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per point feature: lon, lat and the properties; a file is a collection, or has a feature a line."""
    found = spark.read.json(path)
    if "geometry" in found.columns:
        found = found.select(F.struct("geometry", "properties").alias("f"))
    else:
        found = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    place = F.col("f.geometry.coordinates")
    return found.select(place[0].cast("double").alias("lon"), place[1].cast("double").alias("lat"), "f.properties.*")


def read_polygons(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(poly_id, rings) of a GeoJSON's polygons, a row for each part of a multipolygon; other shapes are left out.

    ``poly_id`` is the property ``name``, or the feature's number. A file is a
    collection, or has a feature a line.
    """
    feature = "geometry:struct<type:string,coordinates:string>,properties:map<string,string>"
    schema = f"{feature.replace('geometry:', 'geometry ').replace(',properties:', ', properties ')}, features array<struct<{feature}>>"
    lines, whole = (spark.read.schema(schema).option("multiLine", many).json(path) for many in (False, True))
    whole = whole.select(F.explode("features").alias("f")).select("f.*")
    found = lines.select("geometry", "properties") if lines.filter("geometry is not null").limit(1).count() else whole
    found = found.withColumn("poly_id", F.col("properties")[name] if name else F.monotonically_increasing_id().cast("string"))
    one = F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", many)
    return found.select("poly_id", F.explode(parts).alias("rings"))


def readable(spark: SparkSession, paths: list[str], at_once: int = 8) -> tuple[list[str], dict[str, str]]:
    """Those of ``paths`` that can be read to their end, and why each other can't; a broken file stops nothing.

    Every file is scanned by a job of its own, some at once: a corrupt page
    within a file shows only when it is decoded.
    """
    from concurrent.futures import ThreadPoolExecutor

    def problem(path: str) -> str | None:
        try:
            spark.read.parquet(path).write.format("noop").mode("overwrite").save()
        except Exception as e:  # whatever a reader raises is the file's report
            return str(e).split("\n")[0][:300]
        return None

    with ThreadPoolExecutor(at_once) as pool:
        found = dict(zip(paths, pool.map(problem, paths), strict=True))
    return [p for p in paths if found[p] is None], {p: why for p, why in found.items() if why is not None}


#: Named point-source readers; each takes (spark, path) and gives the plume layout.
PLUME_SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plume_source(name: str):
    def register(f):
        PLUME_SOURCES[name] = f
        return f

    return register


def read_plumes(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in PLUME_SOURCES:
        raise ValueError(f"unknown point source {name!r}; known: {sorted(PLUME_SOURCES)}")
    return PLUME_SOURCES[name](spark, path).withColumn("datasource", F.lit(name))


@plume_source("tonnes_per_hour_csv")
def _tonnes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rates in t/h with one of two uncertainty columns; rows without time go."""
    df = spark.read.option("header", True).csv(path)
    error = F.coalesce(*(F.col(c) for c in ("uncertainty", "uncertainty_t/h") if c in df.columns), F.lit(None))
    return df.filter("time is not null").select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), (F.col("rate").cast("double") * 1000).alias("emission_rate"), (error.cast("double") * 1000).alias("emission_rate_std"), F.to_timestamp("time").alias("time"), F.lit("satellite").alias("instrument"))


@plume_source("paged_json")
def _paged_json(spark: SparkSession, path: str) -> DataFrame:
    """Saved result pages of a plume service, a page a line: first-light scenes go, and the automatic estimates are the rates."""
    item = spark.read.schema("items array<struct<plume_id:string,geometry_json:struct<coordinates:array<double>>,emission_auto:double,emission_uncertainty_auto:double,scene_timestamp:timestamp,instrument:string,first_light:boolean>>").json(path).select(F.explode("items").alias("p")).select("p.*")
    place = F.col("geometry_json.coordinates")
    rows = item.filter(~F.coalesce("first_light", F.lit(False)))
    return rows.select(F.col("plume_id").alias("id"), place[0].alias("lon"), place[1].alias("lat"), F.col("emission_auto").alias("emission_rate"), F.col("emission_uncertainty_auto").alias("emission_rate_std"), F.col("scene_timestamp").alias("time"), "instrument")


#: Properties of detected plumes, and what they are here.
DETECTED = {"ch4_fluxrate": "emission_rate", "ch4_fluxrate_std": "emission_rate_std", "tile_date": "time", "satellite": "instrument"}


@plume_source("detected_geojson")
def _detected(spark: SparkSession, path: str) -> DataFrame:
    """A published collection of detected plumes, in kg/h, at the places of their properties."""
    rows = spark.read.schema("features array<struct<properties:struct<lon:double,lat:double,ch4_fluxrate:double,ch4_fluxrate_std:double,tile_date:string,satellite:string>>>").option("multiLine", True).json(path).select(F.explode("features.properties").alias("p")).select("p.*")
    return rows.withColumnsRenamed(DETECTED).withColumn("time", F.to_timestamp("time"))


@plume_source("geojson")
def _geojson(spark: SparkSession, path: str) -> DataFrame:
    return read_geojson(spark, path)


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """Points from the GeoJSON at ``path`` if it was written to its end, else from ``fetch``, which are then written there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        write_geojson(fetch(), path)
    return read_geojson(spark, path)


def point_coordinates(given: DataFrame, plumes: DataFrame) -> DataFrame:
    """Distinct (lat, lon) of the user's points and of plumes."""
    return given.select("lat", "lon").unionByName(plumes.select("lat", "lon")).distinct()
