"""Filters of fixed size that tell which ids can be in a set, so that texts of all others need no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import free_name

#: Bits of a filter, whatever the number of ids: 8 MB. A share of n / BITS of other ids passes.
BITS = 1 << 26


def place(doc_id: Column) -> Column:
    """The bit of an id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(BITS))


@dataclass
class IdFilter:
    """One bit for each id's hash, made in the JVM by partial bitmaps; an id of the set always passes, few others do."""

    bits: np.ndarray

    @classmethod
    def of(cls, ids: DataFrame, column: str = "doc_id") -> IdFilter:
        at = ids.select((place(F.col(column)) + 1).alias("at"))  # bitmaps count from one
        parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        out = np.zeros(BITS // 8, np.uint8)
        for r in parts.toLocalIterator():  # at most BITS / 32768 rows of 4 KB
            begin = (r["part"] - 1) * 4096
            out[begin : begin + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return cls(out)

    def holds(self, places: np.ndarray) -> np.ndarray:
        return (self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1

    def kept(self, batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
        return batch.filter(pa.array(self.holds(batch.column(column).to_numpy())))


def without_ids(docs: DataFrame, gone: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose doc_id ``gone`` lacks; rows with a null doc_id stay.

    Rows that the filter of ``gone`` lets through are joined with it; all others
    stay where they are. The filter has one size, so the more ids go, the more
    rows are joined, and the outcome is exact at any number.
    """
    found = IdFilter.of(gone, column)
    name = free_name(docs.columns, "_gone")

    @F.arrow_udf("boolean")
    def may_go(places: pa.Array) -> pa.Array:
        return pa.array(found.holds(places.to_numpy()))

    asked = may_go(place(F.col("doc_id").cast("long")))
    ids = gone.select(F.col(column).cast("long").alias(name)).distinct()
    doubtful = docs.filter(asked).join(ids, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    return docs.filter(~asked).unionAll(doubtful)
