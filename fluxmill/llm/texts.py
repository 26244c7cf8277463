"""Text helpers for the Arrow workers of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

U64 = np.uint64
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z lower-cased, all other bytes as they are.
LOWER_ASCII = bytes.maketrans(_UPPER, _LOWER)
#: As LOWER_ASCII, and every ASCII byte but 0-9 and a-z becomes a space.
WORDS_ASCII = bytes(c if c > 127 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: As LOWER_ASCII, and every ASCII byte but letters becomes a space.
LETTERS_ASCII = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


#: Bytes of an Arrow batch between Spark and a worker, and of the texts that become Python objects at once.
BATCH_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_BLANK = re.compile(rb"[\x09-\x0d ]")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by ``BATCH_BYTES`` where the session has Spark's default bound; any other bound stays."""
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def chunks(text: bytes | None) -> Iterator[bytes]:
    """A text in parts of about ``PIECE_BYTES``, cut at ASCII white space."""
    at, text = 0, text or b""
    while len(text) - at > PIECE_BYTES:
        cut = _BLANK.search(text, at + PIECE_BYTES)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class WordHash(dict):
    """64-bit hash of a word, remembered for the short words seen first; the memory is bounded."""

    LIMIT, LONGEST = 250_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT and len(word) <= self.LONGEST:
            self[word] = value
        return value


def hashed(texts: list[bytes | None], table: bytes, cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, translated by ``table``, in one array, and each text's number of words."""
    parts, counts = [np.empty(0, U64)], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for chunk in chunks(text):
            words = chunk.translate(table).split()
            parts.append(np.fromiter(map(cache.__getitem__, words), U64, len(words)))
            counts[k] += len(words)
    return np.concatenate(parts), counts


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit multiplicative hash."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts whose counts sum to about ``most``."""
    begin, total = 0, 0
    for i, n in enumerate(counts.tolist()):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(counts):
        yield begin, len(counts)


def pieces(batch: pa.RecordBatch, text: pa.Array | None = None, most: int = PIECE_BYTES, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of ``text``, its own column unless given, and at most ``rows`` rows."""
    text = batch.column("text") if text is None else text
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False) + most // rows
    for lo, hi in slices(sizes, most):
        yield batch.slice(lo, hi - lo)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or the first of name_1, name_2, ... if columns have it already."""
    taken, k = {c.lower() for c in columns}, 0
    while (f"{name}_{k}" if k else name).lower() in taken:
        k += 1
    return f"{name}_{k}" if k else name


def with_row(docs: DataFrame, carry: bool) -> DataFrame:
    """doc_id and text; with ``carry`` one column ``row`` instead, a struct of all columns, so that a text is sent once."""
    if carry:
        return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def reader(docs: DataFrame, carry: bool) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Gives a batch of ``with_row`` the columns doc_id and text, without copying either."""
    if not carry:
        return lambda batch: batch
    at = [docs.columns.index(c) for c in ("doc_id", "text")]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column("row")
        doc_id, text = (row.field(k) for k in at)
        return pa.record_batch([doc_id.cast(pa.int64()), text if pa.types.is_string(text.type) else text.cast(pa.string()), row], names=["doc_id", "text", "row"])

    return read


def row_schema(ddl: str, docs: DataFrame, carry: bool) -> StructType:
    fields = list(StructType.fromDDL(ddl).fields)
    return StructType(fields + [StructField("row", docs.schema)] * carry)
