"""Ranked lexical search: an inverted index a shard of documents, searched by MaxScore."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .texts import WORDS_ASCII, binary_column, chunks, pieces

#: Fixed values of the ranking: the saturation and the length shares of a term's weight, and its scale.
SATURATION, FLAT, BY_LENGTH, SCALE = 20, 50, 50, 1_000_000_000
#: Terms, with repeats, of a shard (one longer document is a shard of its own), and bytes of items that one pass over the shards carries to each worker.
SHARD_TERMS, BLOCK_BYTES = 2_000_000, 4 << 20
_SHARD = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *[(c, pa.binary()) for c in ("ids", "no_id", "lengths", "terms", "starts", "docs", "times")]])
_SHARD_DDL = "n_docs long, n_terms long, ids binary, no_id binary, lengths binary, terms binary, starts binary, docs binary, times binary"


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text, a part at a time: runs of letters and digits of ASCII, A-Z lower-cased, and of all that is not ASCII."""
    for chunk in chunks(text):
        yield chunk.translate(WORDS_ASCII).split()


class _Building:
    """A shard being filled: terms get numbers as they come, occurrences are (term, document) in one integer."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict(count().__next__)
        self.ids, self.lengths, self.occurrences, self.total = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        n = 0
        for words in terms_of(text):
            found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            found <<= 32
            found |= len(self.ids)
            self.occurrences.append(found)
            n += len(words)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.total += n

    def row(self) -> pa.RecordBatch:
        found = np.concatenate([np.empty(0, np.int64), *self.occurrences])
        found.sort()
        first = np.flatnonzero(np.diff(found, prepend=-1))
        times = np.diff(first, append=len(found))
        postings = found[first]
        starts = np.flatnonzero(np.diff(postings >> 32, prepend=-1))
        none = np.array([i is None for i in self.ids], bool)
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        arrays = ids, np.packbits(none), np.array(self.lengths, "<i8"), starts.astype("<i4"), (postings & 0xFFFFFFFF).astype("<i4"), times.astype("<i4")
        i, no, lengths, starts_, docs, times_ = (a.tobytes() for a in arrays)
        values = [sum(n > 0 for n in self.lengths), self.total, i, no, lengths, b" ".join(self.numbers), starts_, docs, times_]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, _SHARD.types, strict=True)], schema=_SHARD)


def index_shards(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """An inverted index of ``docs(doc_id, text)``, a row a shard: each task cuts its documents into shards of about ``shard_terms`` terms.

    All terms of whole texts are indexed. Nothing is shuffled. Rows that share a
    doc_id, or have none, are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Building()
        for batch in batches:
            for part in pieces(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), binary_column(part, "text"), strict=True):
                    shard.add(doc_id, text)
                    if shard.total >= shard_terms or len(shard.ids) >= shard_terms:
                        yield shard.row()
                        shard = _Building()
        if shard.ids:
            yield shard.row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SHARD_DDL)


class Shard:
    """An index read back. ``weights`` has the queries' terms; ``n`` and ``total`` are the documents and terms of all shards."""

    def __init__(self, row: dict, weights: dict[bytes, int], n: int, total: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(self.ids)).astype(bool)
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.damping = SATURATION * (100 - FLAT + (BY_LENGTH * lengths * n) // max(1, total))
        starts = np.frombuffer(row["starts"], "<i4")
        self.docs, self.times = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["times"], "<i4")
        ends = np.append(starts[1:], len(self.docs))[: len(starts)]
        self.ranges = {t: (int(a), int(b)) for t, a, b in zip(row["terms"].split(), starts, ends, strict=True) if t in weights}
        self.weights, self.lists, self.sums, self.read = weights, {}, np.zeros(len(self.ids), np.int64), 0

    def postings(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of a term, ascending, what it adds to their scores, and the most that it adds to any."""
        if term not in self.lists:
            lo, hi = self.ranges[term]
            docs, times = self.docs[lo:hi], self.times[lo:hi].astype(np.int64)
            scores = self.weights[term] * (SCALE * times // (1000 * times + self.damping[docs]))
            self.lists[term] = docs, scores, int(scores.max())
        return self.lists[term]

    def search(self, terms: list[bytes], top: Top) -> None:
        """Adds this shard's best documents to ``top``.

        Lists go from the highest upper bound down. While all that are left could
        together reach the threshold, their documents are candidates: these lists
        are essential. The others are only probed for candidates that can still
        qualify. A document is dropped when its bound is below the threshold, never
        at it, as equal scores are ordered by doc_id.
        """
        lists = sorted((self.postings(t) for t in terms if t in self.ranges and self.weights[t] > 0), key=lambda x: -x[2])
        rest = np.cumsum([0, *[u for _, _, u in reversed(lists)]])[::-1].tolist()
        sums, threshold, k = self.sums, top.threshold, 0
        while k < len(lists) and rest[k] >= threshold:
            docs, scores, _ = lists[k]
            sums[docs] += scores
            self.read += len(docs)
            k += 1
            if len(docs) >= top.k:
                threshold = max(threshold, _kth(sums[docs], top.k))
        found = np.flatnonzero(sums)
        for j in range(k, len(lists)):
            found = found[sums[found] + rest[j] >= threshold]
            if not len(found):
                break
            docs, scores, _ = lists[j]
            at = np.searchsorted(docs, found)
            at[at == len(docs)] = 0
            hit = docs[at] == found
            sums[found[hit]] += scores[at[hit]]
            self.read += len(found)
            if len(found) >= top.k:
                threshold = max(threshold, _kth(sums[found], top.k))
        found = found[sums[found] >= max(1, threshold)]
        if len(found):
            top.add(sums[found], self.no_id[found], self.ids[found])
        sums[:] = 0


def _kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k])


@dataclass
class Top:
    """The ``k`` best of one query: highest score, then least doc_id, those without one last."""

    k: int

    def __post_init__(self):
        self.scores, self.no_id, self.ids = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def threshold(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        scores, no_id, ids = (np.concatenate(x) for x in ((self.scores, scores), (self.no_id, no_id), (self.ids, ids)))
        best = np.lexsort((ids, no_id, -scores))[: self.k]
        self.scores, self.no_id, self.ids = scores[best], no_id[best], ids[best]


def _frequencies(shards: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(term number, df): in how many documents of all shards each of ``terms`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for names, starts, size in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), batch.column("size").to_pylist(), strict=True):
                lengths = np.diff(np.frombuffer(starts, "<i4"), append=size // 4)
                for t, n in zip(names.split(), lengths.tolist(), strict=True):
                    if t in terms:
                        found[terms[t]] += n
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    return shards.select("terms", "starts", F.octet_length("docs").alias("size")).mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _found(shards: DataFrame, queries: list[list[bytes]], weights: dict[bytes, int], n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best of each task, whose shards share their thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, weights, n, total)
                for terms, top in zip(queries, tops, strict=True):
                    shard.search(terms, top)
        for lo in range(0, len(tops), 256):
            some = tops[lo : lo + 256]
            item = np.repeat(np.arange(lo, lo + len(some)), [len(t.ids) for t in some])
            ids = pa.array(np.concatenate([t.ids for t in some]), mask=np.concatenate([t.no_id for t in some]))
            yield pa.record_batch([pa.array(item, pa.int32()), ids, pa.array(np.concatenate([t.scores for t in some]))], names=["item", "doc_id", "score"])

    return shards.mapInArrow(run, "item int, doc_id long, score long")


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Rows of ``items(item_id, text)`` in blocks of about ``most`` bytes."""
    block, size = [], 0
    for row in items.toLocalIterator():
        text = (row[1] or "").encode()
        block.append((row[0], text))
        size += len(text) + 64
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, shard_terms: int = SHARD_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``.

    Documents are indexed once. Items, which are the queries, pass the driver in
    blocks of ``block_bytes``, each searched in one pass over the shards; a task
    hands on at most ``k`` rows an item. Scores are those of the module's fixed
    values over whole texts, above 0; equal ones are ordered by doc_id, null
    last. Null, empty and wordless texts and items have no terms: they count as
    no document, and get no rows. Rows that share an id are documents or items
    of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    shards = scratch.save(index_shards(docs, shard_terms), "shards")
    size = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n, total = int(size[0]), int(size[1])
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number, block in enumerate(_blocks(items.select("item_id", F.col("text").cast("string")), block_bytes)):
        queries = [sorted({t for words in terms_of(text) for t in words}) for _, text in block]
        numbers = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
        df = {r["term"]: r["df"] for r in _frequencies(shards, numbers).collect()} if numbers else {}
        weights = {t: weight(n, df[i]) for t, i in numbers.items() if i in df}
        found = _found(shards, queries, weights, n, total, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", place).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind}")
        out = out.unionByName(scratch.save(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), f"found-{number}"))
    scratch.drop("shards")
    return out
