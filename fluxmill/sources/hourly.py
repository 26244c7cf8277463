"""Model output by hour: daily tables split once, so that a run reads only the hours it needs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def day_folder(target: str, day: date) -> str:
    return f"{target}/date={day:%Y-%m-%d}"


def split_hours(model: DataFrame, target: str, days: list[date], time: str = "hour") -> list[date]:
    """Writes ``model``'s rows of each day to ``target/date=.../hour_of_day=...`` and gives the days it wrote.

    A day is done when its folder has the writer's marker, which comes last:
    such days are not written again, so a stopped run goes on where it was, and
    a day that was stopped is written anew and whole. Each day is one scan of
    that day alone. An hour without rows has no folder.
    """
    spark, wrote = model.sparkSession, []
    for day in days:
        folder = day_folder(target, day)
        if _there(spark, f"{folder}/_SUCCESS"):
            continue
        start = F.lit(day).cast("timestamp")
        rows = model.filter((F.col(time) >= start) & (F.col(time) < start + F.expr("interval 1 day"))).withColumn("hour_of_day", F.hour(time))
        rows.repartition("hour_of_day").write.mode("overwrite").option("compression", "zstd").partitionBy("hour_of_day").parquet(folder)
        wrote.append(day)
    return wrote


def read_hours(spark: SparkSession, target: str, hours: list | None = None) -> DataFrame:
    """The split rows, with date and hour_of_day; only ``hours``, pairs of a date and an hour, where given: other folders are not opened."""
    rows = spark.read.option("basePath", target).parquet(target)
    if hours is None:
        return rows
    wanted = F.lit(False)
    for day in sorted({d for d, _ in hours}):
        wanted |= (F.col("date") == F.lit(day)) & F.col("hour_of_day").isin(sorted({h for d, h in hours if d == day}))
    return rows.filter(wanted)
