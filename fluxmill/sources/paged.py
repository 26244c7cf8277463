"""Plumes from a service that answers in pages: a partition a page, fetched by the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "plume_id string, lon double, lat double, emission double, uncertainty double, time string, instrument string, first_light boolean"


class Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PageReader(DataSourceReader):
    """Asks for the number of plumes once, then for each page where its partition runs; a page that comes short raises."""

    def __init__(self, options):
        self.url, self.box = options["url"], json.loads(options["box"])
        self.limit, self.timeout = int(options.get("limit", 1000)), float(options.get("timeout", 60))

    def ask(self, offset: int, limit: int) -> dict:
        query = urlencode([*(("bbox", x) for x in self.box), ("limit", limit), ("offset", offset)])
        with urlopen(f"{self.url}?{query}", timeout=self.timeout) as answer:
            return json.load(answer)

    def partitions(self) -> list[Page]:
        self.total = int(self.ask(0, 1)["total_count"])
        return [Page(k) for k in range(0, self.total, self.limit)] or [Page(-1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.offset < 0:
            return
        answer = self.ask(partition.offset, self.limit)
        items = answer["items"]
        wanted = min(self.limit, int(answer["total_count"]) - partition.offset)
        if len(items) < wanted:
            raise RuntimeError(f"the page at {partition.offset} has {len(items)} plumes instead of {wanted}")
        for p in items:
            lon, lat = p["geometry_json"]["coordinates"][:2]
            number = lambda c: None if p.get(c) is None else float(p[c])  # noqa: B023, E731
            yield p["plume_id"], float(lon), float(lat), number("emission_auto"), number("emission_uncertainty_auto"), p.get("scene_timestamp"), p.get("instrument"), bool(p.get("first_light"))


class PagedPlumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_plumes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def read_paged(spark: SparkSession, url: str, box: tuple[float, float, float, float], limit: int = 1000) -> DataFrame:
    """Plumes of a box (west, south, east, north) in the plume layout; first-light scenes go. Pages are read apart, and again where an executor is lost."""
    spark.dataSource.register(PagedPlumes)
    rows = spark.read.format("paged_plumes").options(url=url, box=json.dumps(box), limit=str(limit)).load()
    columns = [F.col("plume_id").alias("id"), "lon", "lat", F.col("emission").alias("emission_rate"), F.col("uncertainty").alias("emission_rate_std"), F.to_timestamp("time").alias("time"), "instrument"]
    return rows.filter("NOT first_light").select(*columns)
