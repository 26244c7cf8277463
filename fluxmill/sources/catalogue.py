"""Satellite file catalogues: parsing of names, de-duplication of orbits, and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the format of satellite product names.
NAME = r"(OFFL|RPRO)_L2__CH4____(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{5})_(\d{2})_(\d{6})"


def parse_names(files: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("name", NAME, k)
    return files.withColumns({"mode": part(1), "orbit": part(4), "collection": part(5), "processor_version": part(6)})


def newest_per_orbit(files: DataFrame, strict_versions: list[str] | None = None, collection: str | None = None) -> DataFrame:
    """One file an orbit: reprocessed before offline, then the latest processor version, then the latest modification."""
    rows = files.filter(F.col("collection") == collection) if collection else files
    rows = rows.filter(F.col("processor_version").isin(strict_versions)) if strict_versions else rows
    order = Window.partitionBy("orbit").orderBy((F.col("mode") == "RPRO").desc(), F.col("processor_version").desc(), F.col("modification").desc(), F.col("name"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def missing_days(have: DataFrame, start, end) -> DataFrame:
    """Days of [start, end] that ``have(day)`` lacks."""
    spark = have.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.join(have.select("day").distinct(), "day", "left_anti")


def within_dates(files: DataFrame, name: Column, pattern: str, start, end, exclusive: bool = True) -> DataFrame:
    """Rows whose name holds a date (the pattern's first group) in the window; names without one go."""
    day = F.to_date(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), "yyyyMMdd")
    last = day < F.lit(end).cast("date") if exclusive else day <= F.lit(end).cast("date")
    return files.filter((day >= F.lit(start).cast("date")) & last)


def by_file_date(df: DataFrame, pattern: str, start, end, exclusive: bool = True) -> DataFrame:
    """Rows of files whose name holds a date in the window."""
    return within_dates(df, F.col("_metadata.file_name"), pattern, start, end, exclusive)


def orbit_counts(files: DataFrame) -> DataFrame:
    """(orbits, files, one_each): whether each file of a folder is the only one of its orbit; a name without an orbit raises."""
    orbit = F.regexp_extract("name", r"_(\d{5})_", 1)
    known = F.when(orbit != "", orbit).otherwise(F.raise_error(F.concat(F.lit("no orbit in "), F.col("name"))).cast("string"))
    counts = files.select(known.alias("o")).agg(F.count_distinct("o").alias("orbits"), F.count("*").alias("files"))
    return counts.withColumn("one_each", F.col("orbits") == F.col("files"))


def by_prefix(files: DataFrame, days: list[str]) -> DataFrame:
    """Files whose name begins with one of the days' prefixes; a month without any raises nothing and gives no rows."""
    return files.filter(F.left(F.col("name"), F.lit(len(days[0]))).isin(days)) if days else files.limit(0)


def log_paths(lines: DataFrame) -> DataFrame:
    """(path, found) from a dry run's log: paths that were opened, and those required but not found."""
    path = F.regexp_extract("value", r"(/\S+\.nc4?)", 1)
    return lines.select(path.alias("path"), (~F.lower("value").contains("not found")).alias("found")).filter("path <> ''").groupBy("path").agg(F.max("found").alias("found"))


def with_reference(targets: DataFrame, references: DataFrame, value: str = "path") -> DataFrame:
    """``targets(orbit, ...)`` with ``reference``, the ``value`` of the one row of ``references(orbit, value)`` of their orbit.

    Orbits are numbers, so 00012 and 12 are the same. More than one reference
    for an orbit raises; a target without one has null, and ``unreferenced``
    names them.
    """
    number = lambda df: df.withColumn("_o", F.col("orbit").cast("long"))
    one = number(references).groupBy("_o").agg(F.count("*").alias("_n"), F.min(value).alias("_r"))
    told = F.raise_error(F.concat(F.lit("more than one reference for orbit "), F.col("_o").cast("string"))).cast(references.schema[value].dataType)
    one = one.select("_o", F.when(F.col("_n") == 1, F.col("_r")).otherwise(told).alias("reference"))
    return number(targets).join(one, "_o", "left").drop("_o")


def unreferenced(paired: DataFrame) -> DataFrame:
    """Distinct orbits of ``with_reference`` that have no reference."""
    return paired.filter("reference is null").select("orbit").distinct()
