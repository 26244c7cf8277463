"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost
executor costs a re-read, never a recomputation of the whole chain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_dir


class Scratch:
    """Tables of one query. ``save`` writes and rereads; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fluxmill-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def settle(self) -> None:
        """Lets go of the shuffle files of steps whose tables are saved: Spark removes them once the driver's garbage is collected."""
        self.spark._jvm.System.gc()

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        for name in names:
            p, fs = self._path(self.path(name))
            fs.delete(p, True)

    def keep_only(self, *names: str) -> None:
        """Removes all tables but those named."""
        root, fs = self._path(self.root)
        for f in fs.listStatus(root):
            if f.getPath().getName() not in names:
                fs.delete(f.getPath(), True)
