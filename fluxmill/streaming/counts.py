"""Extension: daily observation counts over an arriving stream of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_cell_counts(pixels: DataFrame, cell: list[str], late: str = "2 days") -> DataFrame:
    """Counts by day and cell; rows later than the watermark are left out, and days are final once it has passed."""
    day = F.window("time", "1 day").alias("day")
    return pixels.withWatermark("time", late).groupBy(day, *cell).agg(F.count("*").alias("n_obs"))


def start(counts: DataFrame, path: str, checkpoint: str):
    out = counts.withColumn("day", F.to_date("day.start"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
