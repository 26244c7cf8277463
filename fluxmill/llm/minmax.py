"""MinHash near-duplicates by min-max hashing: each permutation gives a minimum and a maximum."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, extended_components
from .membership import IdFilter, place
from .scratch import Scratch
from .texts import LOWER_ASCII, U64, WordHash, binary_column, bounded_batches, hashed, mix, pieces, slices


@dataclass(frozen=True)
class MinMaxParams:
    """``shingle`` words a shingle; links have a Jaccard similarity of ``percent`` / 100 or more.

    ``permutations`` give twice as many signature values, cut into ``bands`` of
    ``rows`` values. With the defaults a pair at 0.85 shares no band with
    probability (1 - 0.85^5)^24 = 8e-7.
    ``rare``: shingles of at most so many of the documents still in question
    pair them directly. ``family``: buckets of more unlinked members than that
    are compared in blocks, as pairs of rows would grow with their square.
    """

    shingle: int = 3
    percent: int = 85
    permutations: int = 60
    bands: int = 24
    rows: int = 5
    rare: int = 64
    family: int = 64
    seed: int = 20231


DEFAULT = MinMaxParams()
_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("buckets", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(texts: list[bytes | None], width: int, cache: WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty for none."""
    flat, counts = hashed(texts, LOWER_ASCII, cache)
    odd = np.random.default_rng(width).integers(1, 2**63, 2 * width, dtype=np.uint64) | U64(1)
    rolled = np.zeros(max(0, len(flat) - width + 1), U64)
    for k in range(width):
        rolled += mix(flat[k : k + len(rolled)] + odd[width + k]) * odd[k]
    rolled = mix(rolled)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= width:
            sets.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:  # fewer words: the whole sequence is one shingle
            h = xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)
            sets.append(np.array([h], U64))
        else:
            sets.append(np.empty(0, U64))
        at += n
    return sets


def signatures(sets: list[np.ndarray], p: MinMaxParams) -> np.ndarray:
    """Bucket keys, one row per set and one column per band; sets must not be empty.

    One multiplication permutes the hashes; its minimum and its maximum are
    both kept, each an unbiased estimate of the Jaccard similarity.
    """
    rng = np.random.default_rng(p.seed)
    factors = rng.integers(1, 2**63, p.permutations, dtype=np.uint64) * U64(2) + U64(1)
    offsets = rng.integers(0, 2**63, p.permutations, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.empty((2 * p.permutations, len(sets)), U64)
    for lo, hi in slices(sizes, 60_000):
        flat = np.concatenate(sets[lo:hi])
        starts = np.concatenate([[0], np.cumsum(sizes[lo : hi - 1])]).astype(np.int64)
        buffer = np.empty_like(flat)
        for k in range(p.permutations):
            np.multiply(flat, factors[k], out=buffer)
            np.add(buffer, offsets[k], out=buffer)
            values[2 * k, lo:hi] = np.minimum.reduceat(buffer, starts)
            values[2 * k + 1, lo:hi] = np.maximum.reduceat(buffer, starts)
    keys = np.empty((len(sets), p.bands), np.int64)
    for band in range(p.bands):
        key = np.full(len(sets), band + 1, U64)
        for value in values[band * p.rows : (band + 1) * p.rows]:
            key = mix(key * U64(0x9E3779B97F4A7C15) + value)
        keys[:, band] = key.view(np.int64)
    return keys


def _signed(p: MinMaxParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(binary_column(part, "text"), p.shingle, cache)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = signatures([sets[i] for i in full], p) if full else np.empty((0, p.bands), np.int64)
                buckets: list = [None] * len(sets)
                for i, row in zip(full, keys, strict=True):
                    buckets[i] = row
                whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                names = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(buckets, pa.list_(pa.int64()))],
                    schema=_SIG,
                )

    return run


def _sets(p: MinMaxParams, wanted: IdFilter):
    """Shingle sets of the documents whose ``place`` the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for part in pieces(wanted.kept(batch, "place")):
                sets = shingle_sets(binary_column(part, "text"), p.shingle, cache)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=_SETS)

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full shingle sets are similar enough. Always a shuffle: both sides grow with the input."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
        .filter(small * 100 >= large * percent)
        .filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent)
        .select("a", "b")
    )


#: Members and shingles of a block, the unit in which large families are compared; columns of a product.
BLOCK_MEMBERS, BLOCK_SHINGLES, COLUMNS = 1024, 400_000, 2048


def _links_between(percent: int):
    """Links between the components of two blocks of a family, or within one: no more than a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        node, component, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        lists = table.column("shingles").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n[at] > 1
        column = (np.cumsum(n > 1) - 1)[at[shared]]
        row = np.repeat(np.arange(len(node)), sizes)[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        low, high = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        both = np.zeros((len(left), len(right)), np.float32)
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
            dense = np.zeros((len(node), COLUMNS), np.float32)
            dense[row[lo:hi], column[lo:hi] - begin] = 1
            both += dense[left] @ dense[right].T
        both = both.astype(np.int64)
        linked = both * 100 >= (sizes[left][:, None] + sizes[right][None, :] - both) * percent
        linked &= component[left][:, None] != component[right][None, :]
        i, j = np.nonzero(linked)
        # one link for two components
        ends = np.sort(np.stack([component[left[i]], component[right[j]]], axis=1), axis=1)
        first = np.unique(ends, axis=0, return_index=True)[1]
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        out = []
        for k in first.tolist():
            a, b = top(int(ends[k, 0])), top(int(ends[k, 1]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append(k)
        a, b = node[left[i[out]]], node[right[j[out]]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def links_in_blocks(members: DataFrame, sets: DataFrame, percent: int, most: int = BLOCK_MEMBERS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): links that join the components within each bucket of ``members(bucket, node, component, n)``.

    A bucket's members are cut into blocks of at most some ``most`` members and
    ``shingles`` shingles; each pair of blocks is one group, in which all full
    sets are compared by products of matrices. Rows are dealt once for each block
    of their bucket, m^2 / ``most`` for m members, and no pair is a row: a group
    gives a link fewer than it has components at most.
    """
    n = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / shingles)).cast("int")
    parts = members.groupBy("bucket").agg(n.alias("parts"))
    rows = members.join(parts, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("bucket", "node", "component", "block", other.alias("other")).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    dealt = rows.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node").select("bucket", "x", "y", "block", "node", "component", "shingles")
    return dealt.groupBy("bucket", "x", "y").applyInArrow(_links_between(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, params: MinMaxParams = DEFAULT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs(doc_id, text)``.

    Texts with equal shingle sets fall together first, by a 128-bit name of the
    set, so copies are never paired. Then, for each band:

    1. each member of a bucket is paired with the bucket's smallest member, if
       their sizes allow it, and confirmed on the full sets; a large group of near copies collapses here
       with one pair a member and band;
    2. in buckets that still hold several components, the member whose shingles
       are most common there is paired with the members close to it, in the same
       way;
    3. what then is still in different components is linked only if it shares a
       rare shingle, or if common shingles alone are enough for both (with
       c of n common shingles, |x & y| <= min(c) + rare ones shared, and a link
       needs |x & y| >= p / (100 + p) (|x| + |y|)). The first kind is paired by
       prefixes of the rare shingles and confirmed; so is the second, within
       buckets of ``family`` such members at most. In larger ones, families just
       below the threshold, full sets are compared block by block, and only links
       that join components become rows. No link between texts that share a band
       is lost.

    Null, empty and wordless texts have an empty set and link with nothing.
    Rows with a null doc_id link with nothing and are kept. Rows that share a
    doc_id count as one node. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "minmax")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(docs.mapInArrow(_signed(params), "doc_id long, n_shingles long, set_hi long, set_lo long, buckets array<long>"), "signed")
    nodes = signed.filter("n_shingles > 0 and doc_id is not null")
    names = nodes.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("node"))
    first = nodes.join(names, ["set_hi", "set_lo"]).filter("doc_id = node")
    keyed = first.select("node", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket")).distinct()
    # a head whose doc_id has several texts has several sizes
    low, high = F.min(F.struct("node", "n")).alias("low"), F.max(F.struct((-F.col("node")).alias("minus"), "n")).alias("high")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("c"), low, high).filter("c > 1").select("bucket", "low", "high")
    alike = (F.col("n") * 100 >= F.col("low.n") * params.percent) & (F.col("high.n") * 100 >= F.col("n") * params.percent)
    members = scratch.save(keyed.join(shared, "bucket").select("bucket", "node", F.col("low.node").alias("head"), alike.alias("alike")), "members")

    scratch.settle()

    # texts stay where they are: those that the filter lets through in vain have a set that no pair asks for
    wanted = IdFilter.of(members, "node")
    placed = docs.filter("doc_id is not null").withColumn("place", place(F.col("doc_id")))
    sets = scratch.save(placed.mapInArrow(_sets(params, wanted), "doc_id long, shingles array<long>"), "sets")
    heads = members.filter("node <> head and alike").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.save(_confirmed(heads, sets, params.percent), "links")
    reached = scratch.save(connected_components(links, scratch, "near"), "reached")

    scratch.drop("links")
    scratch.settle()

    # documents in buckets that still hold several components
    def mixed(components: DataFrame) -> DataFrame:
        placed = members.select("bucket", "node").join(components, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
        return placed.join(several, "bucket", "left_semi")

    asked = scratch.save(mixed(reached), "asked")
    doubtful = sets.join(asked.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    tokens = doubtful.select(F.col("doc_id").alias("node"), F.explode("shingles").alias("s"))
    common = scratch.save(tokens.groupBy("s").agg(F.count("*").alias("df")).filter(F.col("df") > params.rare).select("s", F.lit(1).alias("common")), "common")
    marked = tokens.join(common, "s", "left")
    measured = scratch.save(
        marked.groupBy("node").agg(F.count("*").alias("n"), F.count("common").alias("c"), F.array_sort(F.collect_list(F.when(F.col("common").isNull(), F.col("s")))).alias("own")), "measured"
    )
    p = params.percent

    # a document of mostly common shingles nearest to the family's centre links all that are close to it
    sized = asked.join(measured.select("node", "n", "c"), "node")
    centre = sized.groupBy("bucket").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("node")).alias("minus"))).alias("top"))
    central = (
        sized.join(centre.select("bucket", (-F.col("top.minus")).alias("head")), "bucket")
        .filter((F.col("node") != F.col("head")) & (F.col("c") * 100 >= F.col("n") * p))
        .select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    )
    reached = scratch.save(extended_components(reached, scratch.save(_confirmed(central, sets, p), "links-2"), scratch, "near-2"), "reached-2")

    scratch.drop("links-2")
    scratch.settle()

    # pairs that common shingles alone can't make similar must share a rare one, in both prefixes
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100 - F.col("c"))).cast("int")
    prefix = F.slice("own", 1, F.greatest(F.lit(0), F.size("own") - need + 1))
    component = F.coalesce("component", "node").alias("component")
    rare = measured.join(reached, "node", "left").select("node", component, "n", F.explode(prefix).alias("s"))
    other = rare.select("s", F.col("node").alias("b"), F.col("component").alias("theirs"), F.col("n").alias("m"))
    similar_size = (F.col("n") * 100 >= F.col("m") * p) & (F.col("m") * 100 >= F.col("n") * p)
    by_rare = rare.join(other, "s").filter((F.col("node") < F.col("b")) & (F.col("component") != F.col("theirs")) & similar_size).select(F.col("node").alias("a"), "b")

    # the others have common shingles enough in both; they share a bucket
    enough = lambda c: c * (100 + p) >= (F.col("n") + F.col("m")) * p
    able = scratch.save(mixed(reached).join(measured.select("node", "n", "c"), "node").filter(F.col("c") * 100 >= F.col("n") * p), "able")
    large = able.groupBy("bucket").agg(F.count("*").alias("k")).filter(F.col("k") > params.family).select("bucket")
    left = able.join(large, "bucket", "left_anti")
    right = left.select("bucket", F.col("node").alias("b"), F.col("component").alias("theirs"), F.col("n").alias("m"), F.col("c").alias("d"))
    by_bucket = (
        left.join(right, "bucket")
        .filter((F.col("node") < F.col("b")) & (F.col("component") != F.col("theirs")) & similar_size & enough(F.col("c")) & enough(F.col("d")))
        .select(F.col("node").alias("a"), "b")
    )
    pairs = scratch.save(by_rare.union(by_bucket).distinct(), "pairs")
    families = scratch.save(links_in_blocks(able.join(large, "bucket", "left_semi"), sets, p), "families")
    scratch.drop("asked", "common", "measured", "members")
    scratch.settle()
    groups = scratch.save(extended_components(reached, scratch.save(_confirmed(pairs, sets, p).union(families).distinct(), "links-3"), scratch, "near-3"), "groups")

    scratch.drop("sets", "pairs", "families", "able", "links-3")
    scratch.settle()

    grouped = names.join(groups, "node", "left").select("set_hi", "set_lo", F.coalesce("component", "node").alias("component"))
    out = (
        signed.join(grouped, ["set_hi", "set_lo"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    out = scratch.save(out, "result")
    scratch.keep_only("result")
    return out
