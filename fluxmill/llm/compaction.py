"""Sharding by size-tiered compaction, with versioned manifests. DataFrame operations only."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .texts import free_name


@dataclass(frozen=True)
class TierParams:
    """Shards of three quarters of ``target_bytes`` are final; ``fanout`` runs of one tier are merged, a tier being ``fanout`` times the last."""

    target_bytes: int = 128 << 20
    smallest_bytes: int = 1 << 20
    fanout: int = 4

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest_bytes, self.fanout)) + 1) if size > self.smallest_bytes else 0

    def final(self, shard: dict) -> bool:
        return shard["bytes"] * 4 >= self.target_bytes * 3


@dataclass
class Manifest:
    """A version of the table: its columns, and its shards (path, bytes, run)."""

    version: int = 0
    schema: StructType = field(default_factory=StructType)
    shards: list[dict] = field(default_factory=list)

    def runs(self, params: TierParams) -> dict[str, list[dict]]:
        """The shards of each run that may still be merged."""
        found: dict[str, list[dict]] = {}
        for s in self.shards:
            if not params.final(s):
                found.setdefault(s["run"], []).append(s)
        return found


def united(a: StructType, b: StructType) -> StructType:
    """Columns of both, all of which may be null; one name with two types raises."""
    out = {f.name: f for f in a}
    for f in b:
        if f.name in out and out[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {out[f.name].dataType.simpleString()} in the table and {f.dataType.simpleString()} in the arrival")
        out.setdefault(f.name, f)
    return StructType(list(out.values()))


class ShardStore:
    """A table of immutable Parquet shards below ``root``; readers see the newest manifest only.

    A commit gives a finished manifest the next version's name, and fails if
    that name is taken, so of two writers one has to start again. A writer that
    dies leaves files that no manifest names; ``vacuum`` removes them.
    """

    def __init__(self, spark: SparkSession, root: str, params: TierParams = TierParams()):
        self.spark, self.root, self.params = spark, root.rstrip("/"), params
        self._jvm = spark._jvm
        path = self._path("")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _base(self) -> str:
        return self._fs.makeQualified(self._path("")).toString()

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[1:]) for f in self._fs.listStatus(self._path("manifests")) if f.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self.versions()
        if version is None and not versions:
            return Manifest()
        version = versions[-1] if version is None else version
        if version not in versions:
            raise ValueError(f"there is no version {version}; there are {versions}")
        lines = [json.loads(r[0]) for r in self.spark.read.text(f"{self.root}/manifests/v{version:09d}").orderBy("value").toLocalIterator()]
        return Manifest(version, StructType.fromJson(next(x["schema"] for x in lines if "schema" in x)), [x for x in lines if "path" in x])

    def commit(self, based_on: Manifest, shards: list[dict], schema: StructType | None = None) -> Manifest:
        """Makes ``shards`` the next version after ``based_on``, or raises if another commit came first."""
        out = Manifest(based_on.version + 1, schema or based_on.schema, shards)
        draft, final = self._path(f"manifests/_draft-{uuid.uuid4().hex}"), self._path(f"manifests/v{out.version:09d}")
        stream = self._fs.create(draft, False)
        lines = [{"schema": out.schema.jsonValue()}, *shards]
        stream.write(bytearray("".join(json.dumps(x, sort_keys=True) + "\n" for x in lines).encode()))
        stream.close()
        published = self._publish(draft, final)
        self._fs.delete(draft, True)
        if not published:
            raise RuntimeError(f"version {out.version} was committed by another writer")
        return out

    def _publish(self, draft, final) -> bool:
        """Gives the draft its final name in one step, unless the name is taken: by rename, or on a local disk, whose rename overwrites, by a link."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(draft, final)
        at = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri())
        try:
            self._jvm.java.nio.file.Files.createLink(at(final), at(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _write(self, df: DataFrame, runs: str | None = None) -> list[dict]:
        """Writes shards; returns their paths, sizes and runs."""
        name = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(runs) if runs else writer).parquet(f"{self.root}/{name}")
        found, files, base = [], self._fs.listFiles(self._path(name), True), self._base()
        while files.hasNext():
            f = files.next()
            path = f.getPath().toString()
            if f.getPath().getName().endswith(".parquet") and f.getLen():
                run = path.split(f"/{runs}=")[1].split("/")[0] if runs else ""
                found.append({"path": path[len(base) + 1 :], "bytes": f.getLen(), "run": f"{name}/{run}"})
        return sorted(found, key=lambda s: s["path"])

    def append(self, df: DataFrame) -> Manifest:
        """Takes an arrival in as one run of small shards, each task's part a file, in one commit."""
        base = self.manifest()
        return self.commit(base, base.shards + self._write(df), united(base.schema, df.schema))

    def append_each(self, df: DataFrame, arrival) -> Manifest:
        """Takes the arrivals in that the column expression tells apart: written in one pass, then committed and compacted one by one."""
        name = free_name(df.columns, "_arrival")
        runs: dict[str, list[dict]] = {}
        for s in self._write(df.withColumn(name, arrival), name):
            runs.setdefault(s["run"], []).append(s)
        base = self.manifest()
        if not runs:
            return self.commit(base, base.shards, united(base.schema, df.schema))
        for run in sorted(runs):
            base = self.manifest()
            self.commit(base, base.shards + runs[run], united(base.schema, df.schema))
            base = self.compact()
        return base

    def compact(self) -> Manifest:
        """Merges runs until no tier holds ``fanout`` of them.

        A run's tier is that of the bytes of its shards that are not final. The
        runs of a full tier become one run, of files of about the target size, in
        one pass that moves no row between groups: partitions are only coalesced.
        The new shards replace the old in one commit. Every pass leaves fewer
        runs, and a row is rewritten once a tier at most, until its shard is final.
        """
        while True:
            base = self.manifest()
            tiers: dict[int, list[str]] = {}
            runs = base.runs(self.params)
            for run, shards in runs.items():
                tiers.setdefault(self.params.tier(sum(s["bytes"] for s in shards)), []).append(run)
            full = sorted(t for t, names in tiers.items() if len(names) >= self.params.fanout)
            if not full:
                return base
            old = [s for run in tiers[full[0]] for s in runs[run]]
            n = math.ceil(sum(s["bytes"] for s in old) / self.params.target_bytes)
            merged = self._write(self._read(old, base.schema).coalesce(n))
            gone = {s["path"] for s in old}
            self.commit(base, [s for s in base.shards if s["path"] not in gone] + merged)

    def _read(self, shards: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version with ``shard`` (or the first free name shard_1, shard_2, ...), the number of its file in the manifest.

        Columns that a shard lacks, as it came before they did, are null.
        """
        m = self.manifest(version)
        number = free_name(m.schema.names, "shard")
        if not m.shards:
            return self.spark.createDataFrame([], m.schema).withColumn(number, F.lit(0))
        rows = self._read(m.shards, m.schema)
        name = F.expr(f"right(_metadata.file_path, length(_metadata.file_path) - {len(self._base()) + 1})")
        columns = [F.col(f"`{c}`") for c in rows.columns]
        if len(m.shards) <= 10_000:  # a shard's number is looked up where it is read
            numbers = F.create_map(*(F.lit(v) for k, s in enumerate(m.shards) for v in (s["path"], k)))[name]
            return rows.select(*columns, numbers.alias(number))
        key = free_name([*rows.columns, number], "_file")
        names = self.spark.createDataFrame([(s["path"], k) for k, s in enumerate(m.shards)], f"`{key}` string, `{number}` int")
        return rows.select(*columns, name.alias(key)).join(names, key).drop(key)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the ``keep`` newest versions, then the data files that no version names; returns their number. Run it when no writer is at work."""
        versions = self.versions()
        for v in versions[: -keep or None]:
            self._fs.delete(self._path(f"manifests/v{v:09d}"), True)
        live = {s["path"] for v in versions[-keep:] for s in self.manifest(v).shards}
        base, files, gone = self._base(), self._fs.listFiles(self._path("data"), True), []
        while files.hasNext():
            f = files.next().getPath()
            if f.getName().endswith(".parquet") and f.toString()[len(base) + 1 :] not in live:
                gone.append(f)
        for f in gone:
            self._fs.delete(f, False)
        return len(gone)


def compact_arrivals(docs: DataFrame, root: str, arrivals: int = 4, params: TierParams = TierParams(), keep: int = 1) -> ShardStore:
    """Takes ``docs`` in as ``arrivals`` runs by the hash of doc_id, each with its commit and compaction, and gives the store.

    The ``keep`` newest versions stay readable; a version comes with each
    arrival and with each merge.

    Rows are kept whatever they hold: null ids, null texts and repeated rows
    included, with all columns under their own names. An empty table gives an
    empty version with its columns.
    """
    store = ShardStore(docs.sparkSession, root, params)
    store.append_each(docs, F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(arrivals)))
    store.vacuum(keep)
    return store
