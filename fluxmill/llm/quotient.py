"""Exact duplicates: counting quotient filters find the texts in question, their bytes decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import IdFilter, place
from .scratch import Scratch
from .texts import U64

#: Fingerprints that one segment of the merged filter is made for, those a task holds before it hands a filter on, and the fewest segments.
SEGMENT, HELD, LEAST_SEGMENTS = 1 << 18, 1 << 19, 64
_ROW = "segment int, bits int, n long, occupied binary, run_end binary, remainders binary, counted binary, counts binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


@dataclass
class QuotientFilter:
    """A multiset of fingerprints of ``bits`` bits, in the order of quotient and remainder.

    The high bits of a fingerprint, its quotient, are not stored: ``occupied``
    has a bit for each quotient and ``run_end`` one for each slot, set at the
    last slot of a quotient's run. Slots hold remainders, ascending within a run,
    and none is empty. Slots of more than one copy are marked in ``counted`` and
    have their numbers in ``counts``. Nothing of a fingerprint is lost, so
    filters of any sizes merge to the filter of all their fingerprints.
    """

    bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray
    counted: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, copies: np.ndarray | None, bits: int) -> QuotientFilter:
        """From fingerprints in any order, repeated or not, each for so many ``copies``, one unless given."""
        order = np.argsort(fingerprints, kind="stable")
        x = fingerprints[order].astype(U64)
        n = np.ones(len(x), np.int64) if copies is None else copies[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
        x, n = x[starts], np.add.reduceat(n, starts) if len(x) else n
        q = min(bits, max(0, int(np.ceil(np.log2(max(1, len(x)))))))
        quotients = (x >> U64(bits - q)).astype(np.int64) if bits - q < 64 else np.zeros(len(x), np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_end = np.concatenate([quotients[1:] != quotients[:-1], np.ones(min(1, len(x)), bool)])
        return cls(bits, occupied, run_end, x & U64((1 << (bits - q)) - 1), n > 1, n[n > 1])

    @property
    def shift(self) -> int:
        return self.bits - (len(self.occupied).bit_length() - 1)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, ascending, and the copies of each."""
        ends = np.flatnonzero(self.run_end)
        quotients = np.repeat(np.flatnonzero(self.occupied), np.diff(ends, prepend=-1)).astype(U64)
        high = quotients << U64(self.shift) if self.shift < 64 else np.zeros(len(quotients), U64)
        copies = np.ones(len(self.remainders), np.int64)
        copies[self.counted] = self.counts
        return high | self.remainders, copies

    def count(self, fingerprints: np.ndarray) -> np.ndarray:
        """Copies of each fingerprint; 0 where there is none. A run is found by ranks of occupied quotients and of run ends."""
        x = fingerprints.astype(U64)
        quotients = (x >> U64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(x), np.int64)
        run = np.cumsum(self.occupied) - 1
        ends = np.concatenate([[-1], np.flatnonzero(self.run_end)])
        found, copies = np.zeros(len(x), np.int64), self.items()[1]
        for k in np.flatnonzero(self.occupied[quotients]):
            lo, hi = ends[run[quotients[k]]] + 1, ends[run[quotients[k]] + 1] + 1
            at = lo + int(np.searchsorted(self.remainders[lo:hi], x[k] & U64((1 << self.shift) - 1)))
            if at < hi and self.remainders[at] == x[k] & U64((1 << self.shift) - 1):
                found[k] = copies[at]
        return found

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all fingerprints of ``filters``, which must have the same ``bits``."""
        items = [f.items() for f in filters]
        return cls.of(np.concatenate([x for x, _ in items]), np.concatenate([n for _, n in items]), filters[0].bits)

    def row(self, segment: int) -> tuple:
        """As a row of ``_ROW``; remainders take as many whole bytes as they need."""
        width = max(1, -(-self.shift // 8))
        low = np.ascontiguousarray(self.remainders.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        packed = (np.packbits(x).tobytes() for x in (self.occupied, self.run_end))
        return (segment, self.bits, len(self.remainders), *packed, low.tobytes(), np.packbits(self.counted).tobytes(), self.counts.astype("<i8").tobytes())

    @classmethod
    def read(cls, r: dict) -> QuotientFilter:
        n = r["n"]
        bit = lambda name, k: np.unpackbits(np.frombuffer(r[name], np.uint8), count=k).astype(bool)
        q = min(r["bits"], max(0, int(np.ceil(np.log2(max(1, n))))))
        width = max(1, -(-(r["bits"] - q) // 8))
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(r["remainders"], np.uint8).reshape(n, width)
        return cls(r["bits"], bit("occupied", 1 << q), bit("run_end", n), full.reshape(-1).view("<u8").astype(U64), bit("counted", n), np.frombuffer(r["counts"], "<i8").astype(np.int64))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)


def partition_filters(fingerprints: DataFrame, bits: int, segment_bits: int) -> DataFrame:
    """Filters of each task's ``fingerprints(fp)``, one for each segment: a range of fingerprints with the same ``segment_bits`` high bits."""
    low = bits - segment_bits

    def filters(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held))
        segments = (x >> U64(low)).astype(np.int64) if segment_bits else np.zeros(len(x), np.int64)
        cuts = np.flatnonzero(np.diff(segments)) + 1
        mask = U64((1 << low) - 1)
        return _batch([QuotientFilter.of(part & mask, None, low).row(int(s)) for s, part in zip(segments[np.concatenate([[0], cuts])], np.split(x, cuts), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(U64) >> U64(64 - bits))
            n += batch.num_rows
            if n >= HELD:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    return fingerprints.select("fp").mapInArrow(run, _ROW)


def merged_filters(parts: DataFrame) -> DataFrame:
    """One filter a segment. Copies are counted within tasks before the shuffle, so a segment gets a slot for each text and task at most."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_batches([_batch([QuotientFilter.merged([QuotientFilter.read(r) for r in rows]).row(rows[0]["segment"])])])

    return parts.groupBy("segment").applyInArrow(merge, _ROW)


def repeated_fingerprints(filters: DataFrame, bits: int) -> DataFrame:
    """(fp, copies) of the fingerprints that the merged filters count more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = QuotientFilter.read(r)
                x, n = f.items()
                high = U64(r["segment"]) << U64(f.bits) if f.bits < 64 else U64(0)
                whole = (x[n > 1] | high) << U64(64 - bits)
                yield pa.record_batch([pa.array(whole.view(np.int64)), pa.array(n[n > 1])], names=["fp", "copies"])

    return filters.mapInArrow(run, "fp long, copies long")


def normal_text(text: Column) -> Column:
    """A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of ``docs(doc_id, text)``.

    Equal texts are those that are the same after lower-casing A-Z; null counts
    as empty, so null and empty texts are one group. Of equal texts the row with
    the largest doc_id stays; rows that repeat that doc_id stay with it. A row
    without doc_id is counted and gives way to any that has one; where none of a
    group has, keep_id is null and all its rows stay. Other columns are not read.

    1. Each task counts the fingerprints of its rows in counting quotient
       filters, one a segment; those of a segment merge by sorted remainders.
    2. Rows whose fingerprint counts above one go on, through a bit filter of
       fixed size: others that it lets through cost a shuffle and nothing else.
       Their texts are grouped byte by byte, first within tasks, so a group of a
       third of all rows sends its text once a task.
    3. Rows get their group by fingerprint and SHA-256; all others stay where
       they are. Texts of single rows are never shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = normal_text(F.col("text"))
    fp = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits) if bits < 64 else F.xxhash64(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp.alias("fp"), text.alias("norm"))
    signed = scratch.save(rows.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")), "signed")
    wanted = max(LEAST_SEGMENTS, -(-signed.count() // SEGMENT))
    segment_bits = min(bits - 1, (wanted - 1).bit_length())
    filters = scratch.save(merged_filters(partition_filters(signed, bits, segment_bits)), "filters")
    found = IdFilter.of(repeated_fingerprints(filters, bits), "fp")

    @F.arrow_udf("boolean")
    def may_repeat(places: pa.Array) -> pa.Array:
        return pa.array(found.holds(places.to_numpy()))

    asked = may_repeat(place(F.col("fp")))
    same = rows.filter(asked).groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = scratch.save(same.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    joined = signed.filter(asked).join(groups, ["fp", "text_sha256"], "left")
    in_group = F.col("group_size").isNotNull()
    keep = F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id"))
    joined = joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    single = signed.filter(~asked).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    out = joined.unionAll(single).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    out = scratch.save(out, "result")
    scratch.keep_only("result")
    return out
