"""Benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch
from .texts import BATCH_BYTES, LOWER_ASCII, WORDS_ASCII, binary_column, bounded_batches, chunks, pieces, reader, row_schema, with_row

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of benchmark text that one pass over the documents carries to each worker; its windows take some 10 times as much.
BLOCK_BYTES = 4 << 20
#: Words of a shard; one longer document is a shard of its own.
SHARD_WORDS = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(WORDS_ASCII).split()


class Bits:
    """A bit vector with ranks: 64 bits a word, and the ones before each word in 32 bits."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        self.words = np.zeros(len(ones) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)

    def rank(self, ends: np.ndarray) -> np.ndarray:
        """How many ones there are before each end."""
        at, inside = ends >> 6, (ends & 63).astype(np.uint64)
        return self.before[at].astype(np.int64) + np.bitwise_count(self.words[at] & ((np.uint64(1) << inside) - np.uint64(1)))

    def get(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector for each bit of the alphabet: 1.5 bits a symbol and level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        start, end = np.zeros_like(ends), ends
        for bit, ones, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            a, b = ones.rank(start), ones.rank(end)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start

    def access_rank(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at rows, and how often each occurs before its row."""
        symbol, start, end = np.zeros_like(rows), np.zeros_like(rows), rows
        for bit, ones, zeros in self.levels:
            one = ones.get(end)
            symbol |= one.astype(np.int64) << bit
            a, b = ones.rank(start), ones.rank(end)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return symbol, end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; only suffixes still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    width = 1
    while True:
        sizes = np.diff(np.append(heads, n))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        which = order[at]
        after = which + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[which]))
        which, second = which[by], second[by]
        own = rank[which]
        order[at] = which
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])])
        begins = np.flatnonzero(fresh)
        rank[which] = np.repeat(at[begins], np.diff(np.append(begins, len(at))))
        ordered = rank[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        width *= 2


class FMIndex:
    """Backward search over a sequence of symbols; runs are parted by symbol 0.

    Separators order by their places, so all suffixes differ and the step from
    a row to the one before it in the text is exact. Rows at run starts and at
    every ``sample``-th place keep their place; others walk back to one.
    """

    def __init__(self, runs: np.ndarray, n_symbols: int, sample: int = 8):
        n = len(runs)
        ends = runs == 0
        n_ends = int(ends.sum())
        unique = np.where(ends, np.cumsum(ends) - 1, runs + n_ends)
        order = suffix_array(unique)
        before = np.where(order > 0, runs[order - 1], 0)
        self.matrix = WaveletMatrix(before.astype(np.int32), max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(runs, minlength=n_symbols + 1))])
        kept = (before == 0) | (order % sample == 0)
        self.kept = Bits(kept)
        self.places = order[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases, one phrase of symbols per line."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.first[c] + self.matrix.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows in the text."""
        places, steps = np.empty_like(rows), np.zeros_like(rows)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.kept.get(rows[live])
            at = live[done]
            places[at] = self.places[self.kept.rank(rows[at])] + steps[at]
            live = live[~done]
            symbol, rank = self.matrix.access_rank(rows[live])
            rows[live] = self.first[symbol] + rank
            steps[live] += 1
        return places


@dataclass
class Phrases:
    """The benchmark's windows over its own alphabet; symbols count from 1."""

    symbols: dict[bytes, int] = field(default_factory=dict)
    by_length: dict[int, np.ndarray] = field(default_factory=dict)
    items_at: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, np.ndarray] = field(default_factory=dict)
    names: list = field(default_factory=list)

    @classmethod
    def of(cls, rows: Iterator[tuple], window: int) -> Phrases:
        """Windows are kept as 32-bit arrays, equal ones once."""
        self, found = cls(), {}
        for item, text in rows:
            words = words_of(None if text is None else text.encode())
            if not words or item is None:
                continue
            ids = np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 1) for w in words), np.int32, len(words))
            width = min(window, len(ids))
            found.setdefault(width, []).append((len(self.names), np.lib.stride_tricks.sliding_window_view(ids, width)))
            self.names.append(item)
        for width, parts in found.items():
            windows = np.concatenate([w for _, w in parts])
            owners = np.repeat(np.array([k for k, _ in parts], np.int32), [len(w) for _, w in parts])
            self.by_length[width], which = np.unique(windows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owners], axis=1), axis=0)
            self.items_at[width] = np.searchsorted(pairs[:, 0], np.arange(len(self.by_length[width]) + 1))
            self.items[width] = pairs[:, 1].astype(np.int32)
        return self


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, sizes[i] values of it."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def shard_hits(documents: list[np.ndarray], phrases: Phrases) -> tuple[list[np.ndarray], list[set]]:
    """For each document's symbols: which words are hit, and which item numbers occur.

    Only runs of benchmark words at least as long as the shortest window can
    hold an occurrence; the index is built over those runs.
    """
    hit, items = [np.zeros(len(d), bool) for d in documents], [set() for _ in documents]
    if not phrases.by_length or not documents:
        return hit, items
    shortest = min(phrases.by_length)
    flat = np.concatenate([np.append(d, np.int32(0)) for d in documents])
    inside = np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    long_ = ends - begins >= shortest
    begins, sizes = begins[long_], (ends - begins)[long_] + 1  # each with the separator after it
    if not len(begins):
        return hit, items
    origin = _expand(begins, sizes)
    text = flat[origin]
    index = FMIndex(text, len(phrases.symbols))
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in documents])])
    edges = np.zeros(len(flat) + 1, np.int64)
    for width, windows in phrases.by_length.items():
        lo, hi = index.search(windows)
        which = np.flatnonzero(hi > lo)
        for part in np.array_split(which, max(1, int((hi - lo).sum()) // 1_000_000)):
            n = hi[part] - lo[part]
            at = origin[index.locate(_expand(lo[part], n))]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + width, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            pairs = np.unique(np.stack([doc, np.repeat(part, n)]), axis=1)
            for d, w in pairs.T.tolist():
                items[d].update(phrases.items[width][phrases.items_at[width][w] : phrases.items_at[width][w + 1]].tolist())
    covered = np.cumsum(edges[:-1]) > 0
    for k in np.flatnonzero(np.add.reduceat(covered, starts[:-1])).tolist():
        hit[k] = covered[starts[k] : starts[k + 1] - 1]
    return hit, items


def spans_of(hit: np.ndarray) -> np.ndarray:
    """Merged [begin, end) spans of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_OUT_SQL = "doc_id long, n_words long, spans array<array<long>>, items array<string>"


def _search(phrases: Phrases, shard_words: int, read, keep: tuple[str, ...]):
    """Searches shards of documents; columns ``keep`` of a batch that ``read`` gives are handed on."""
    names = [str(x) for x in phrases.names]
    get = phrases.symbols.get

    def flush(ids: list, docs: list[np.ndarray], rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        hit, items = shard_hits(docs, phrases)
        spans = [spans_of(h).tolist() if h.any() else [] for h in hit]
        columns = [pa.array(ids, pa.int64()), pa.array([len(d) for d in docs], pa.int64()), pa.array(spans, _OUT.field(2).type), pa.array([sorted({names[k] for k in x}) for x in items], _OUT.field(3).type)]
        return pa.record_batch(columns + [pa.concat_arrays([r.column(c) for r in rows]) for c in keep], names=[*_OUT.names, *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, rows, held, size = [], [], [], 0, 0
        for part in (p for batch in batches for p in pieces(read(batch))):
            for text in binary_column(part, "text"):
                found = [np.fromiter((get(w, 0) for w in words), np.int32, len(words)) for words in map(words_of, chunks(text))]
                docs.append(found[0] if len(found) == 1 else np.concatenate(found))
                held += len(docs[-1]) + 1
            ids += part.column("doc_id").to_pylist()
            rows.append(part)
            size += part.nbytes if keep else 0
            # what is handed on is held as long as its shard, so it bounds the shard too
            if held >= shard_words or size >= 8 * BATCH_BYTES:
                yield flush(ids, docs, rows)
                ids, docs, rows, held, size = [], [], [], 0, 0
        if ids:
            yield flush(ids, docs, rows)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts that fit ``block_bytes``; one part when all of it does."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    return [benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items): one row per row of ``docs(doc_id, text)``.

    ``spans`` are merged [begin, end) ranges of the words that lie in an
    occurrence of a ``window``-word piece of a benchmark text; ``items`` are the
    item_ids with such pieces, as sorted strings. Every task reads its documents
    in shards of about ``shard_words`` words, builds an FM-index for each and
    searches all phrases in it; nothing is shuffled. A benchmark of more than
    ``block_bytes`` is searched in several passes, one after another: each row
    takes what it has found to the next pass, by way of the shared folder, so
    rows need no key and what a pass carries to the workers is bounded. With
    ``carry``, ``row`` holds all columns of docs, so that nothing need be joined
    back.

    Null, empty and wordless texts have no words and no spans. A benchmark item
    of fewer words than ``window`` is one piece; null and wordless ones, and
    those without item_id, have none. Repeated rows, and rows that share a
    doc_id or have none, are judged one by one. Other columns of either table
    are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, block_bytes)
    phrases = lambda block: Phrases.of((tuple(r) for r in block.toLocalIterator()), window)
    if len(blocks) == 1:
        keep = ("row",) * carry
        return with_row(docs, carry).mapInArrow(_search(phrases(blocks[0]), shard_words, reader(docs, carry), keep), row_schema(_OUT_SQL, docs, carry))
    scratch = Scratch(spark, "leaks")
    sent = with_row(docs, carry)
    row = sent if carry else sent.select(F.struct("doc_id", "text").alias("row"))
    plain = docs if carry else sent
    none = F.array().cast("array<array<long>>").alias("all_spans"), F.array().cast("array<string>").alias("all_items")
    rows = row.select("row", *none)
    inner = reader(plain, True)
    read = lambda batch: pa.record_batch([*inner(batch).columns, batch.column("all_spans"), batch.column("all_items")], names=["doc_id", "text", "row", "all_spans", "all_items"])
    schema = StructType(row_schema(_OUT_SQL, plain, True).fields + [rows.schema["all_spans"], rows.schema["all_items"]])
    for k, block in enumerate(blocks):
        found = rows.mapInArrow(_search(phrases(block), shard_words, read, ("row", "all_spans", "all_items")), schema)
        spans, items = F.concat("all_spans", "spans").alias("all_spans"), F.concat("all_items", "items").alias("all_items")
        rows = scratch.save(found.select("doc_id", "n_words", "row", spans, items), f"pass-{k}")
        if k:
            scratch.drop(f"pass-{k - 1}")
        last, rows = rows, rows.select("row", "all_spans", "all_items")
    return last.select("doc_id", "n_words", _united(F.array_sort("all_spans")).alias("spans"), F.array_sort(F.array_distinct("all_items")).alias("items"), *["row"] * carry)


def _united(spans):
    """Sorted spans, merged where they meet."""
    empty = F.array().cast("array<array<bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        merged = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when(F.size(done) == 0, F.array(span)).when(span[0] <= last[1], merged).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def leak_digest(found: DataFrame) -> DataFrame:
    """The counts and the digest that the query returns for ``find_leaks`` rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: str | None, spans: list[list[int]] | None) -> str | None:
    """The text without the given word spans."""
    if not text or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(LOWER_ASCII))]
    out, done = [], 0
    for begin, end in spans:
        out.append(raw[done : at[begin][0]])
        done = at[end - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def items_sha256(items: list) -> str:
    """Digest of item_ids, as ``leak_digest`` makes it."""
    return hashlib.sha256(",".join(sorted({str(x) for x in items})).encode()).hexdigest()
