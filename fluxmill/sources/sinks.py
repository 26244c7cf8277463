"""Writers of the engine's results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, zstd; ``mode='ignore'`` skips what is there."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_ensemble(members: DataFrame, path: str, keys: list[str]) -> None:
    """Members, and their mean of every other number."""
    write_table(members, f"{path}/members")
    values = [c for c, t in members.dtypes if t == "double" and c not in keys]
    write_table(members.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in values)), f"{path}/mean")


def write_statistics(df: DataFrame, path: str) -> None:
    """One row, as CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def replace_hour_zero(hours: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Hours of a run, with its first hour filled from the run before; what both have stays."""
    first = previous.join(hours.select(*keys), keys, "left_anti")
    return hours.unionByName(first)


def low_background(field: DataFrame, factor: float, value: str = "conc") -> DataFrame:
    """One part of the species' unit everywhere."""
    return field.withColumn(value, F.lit(1.0 / factor))


def first_time_only(field: DataFrame, time: str) -> DataFrame:
    """Values of the first time; other rows keep their keys and lose the time, as a mask would leave them."""
    first = field.agg(F.min(time).alias("_t"))
    return field.join(F.broadcast(first)).withColumn(time, F.when(F.col(time) == F.col("_t"), F.col(time))).drop("_t")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text lines, in one small file: reports and perturbation lists."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)


def perturbation_lines(factors: DataFrame, template: str) -> DataFrame:
    """A run's perturbation lines: ``template`` with {elem} and {factor} filled from ``factors(elem, factor)``."""
    parts = template.replace("{elem}", "\0e\0").replace("{factor}", "\0f\0").split("\0")
    fill = {"e": F.col("elem").cast("string"), "f": F.col("factor").cast("string")}
    return factors.orderBy("elem").select(F.concat(*(fill.get(p, F.lit(p)) for p in parts)).alias("value"))


def replaced_perturbations(lines: DataFrame, factors: DataFrame, last: int) -> DataFrame:
    """(file, number, value) of perturbation files' ``lines(file, number, value)`` with their element's factor replaced.

    A file's element is in its name, as _0012.txt; the first line that begins
    with ELEM_0012 gets the factor of ``factors(elem, factor)``. Files of
    elements after ``last``, which are no emissions, and those without a factor
    stay as they are.
    """
    label = F.regexp_extract("file", r"(\d{4})\.txt$", 1)
    rows = lines.withColumns({"_label": label, "_e": F.nullif(label, F.lit("")).cast("int")})
    own = F.startswith("value", F.concat(F.lit("ELEM_"), F.col("_label"))) & (F.col("_e") <= last)
    first = rows.filter(own).groupBy("file").agg(F.min("number").alias("_first"))
    rows = rows.join(first, "file", "left").join(factors.select(F.col("elem").alias("_e"), "factor"), "_e", "left")
    fresh = F.concat(F.lit("ELEM_"), "_label", F.lit("  "), F.rpad(F.col("_e").cast("string"), 6, " "), F.col("factor").cast("string"))
    return rows.select("file", "number", F.when((F.col("number") == F.col("_first")) & F.col("factor").isNotNull(), fresh).otherwise(F.col("value")).alias("value"))


def write_geojson(points: DataFrame, path: str) -> None:
    """A feature collection of points (lon, lat) with all other columns as properties, one feature a line of JSON."""
    others = [F.col(f"`{c}`") for c in points.columns if c not in ("lon", "lat")]
    place = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), F.struct(*others).alias("properties"))
    points.select(feature.alias("f")).select("f.*").write.mode("overwrite").json(path)
