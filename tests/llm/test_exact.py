"""Exact dedup against brute force, its filter against a counter."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluxmill.llm import queries, quotient
from fluxmill.llm.quotient import QuotientFilter
from tests.llm.test_operators import awkward, empty


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    out = []
    for r in rows:
        ids = [i for i in groups[lower(r["text"])] if i is not None]
        keep = max(ids, default=None)
        kept = keep is None or r["doc_id"] == keep
        out.append((r["doc_id"], keep, len(groups[lower(r["text"])]), kept, hashlib.sha256(lower(r["text"]).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits", [64, 58, 20, 9])
@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_filter_holds_every_fingerprint_and_merges(bits, n):
    rng = np.random.default_rng(bits + n)
    x = rng.integers(0, 2 ** min(bits, 63), n, dtype=np.uint64) % np.uint64(max(1, n // 2) * 7919)
    x %= np.uint64(2 ** min(bits, 63))
    want = Counter(x.tolist())
    parts = [QuotientFilter.of(p, None, bits) for p in np.array_split(x, 3)]
    whole = QuotientFilter.merged([QuotientFilter.read(dict(zip(quotient._NAMES, p.row(0), strict=True))) for p in parts])
    keys, copies = whole.items()
    assert dict(zip(keys.tolist(), copies.tolist(), strict=True)) == want and keys.tolist() == sorted(want)
    asked = np.concatenate([x, rng.integers(0, 2 ** min(bits, 63), 50, dtype=np.uint64)])
    assert whole.count(asked).tolist() == [want[k] for k in asked.tolist()]


@pytest.mark.parametrize("bits", [64, 12, 3])
def test_exact_duplicates(spark, bits):
    """With few bits most texts share a fingerprint, and only their bytes part them."""
    more = [(30 + k, t) for k, t in enumerate(["É", "é", "A b", "a B", "a  b", "\x00", "K", "k", "ß", "SS", *[f"t{k % 90}" for k in range(300)]])]
    docs = awkward(spark, [*more, (None, "only"), (None, "ONLY"), (9_000, "A")]).repartition(5)
    got = quotient.exact_duplicates(docs, bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(docs.collect())


def test_a_hot_group_and_an_empty_table(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('Hot text ', 50) ELSE concat('text ', id) END AS text")
    got = quotient.exact_duplicates(docs)
    assert Counter(map(tuple, got.collect())) == brute(docs.collect())
    none = quotient.exact_duplicates(empty(spark))
    assert none.count() == 0 and none.columns == got.columns


def test_segments_merge_over_many_tasks(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id % 1000) AS text").repartition(16)
    fp = docs.selectExpr("xxhash64(text) AS fp")
    parts = quotient.partition_filters(fp, 64, 3)
    merged = quotient.merged_filters(parts)
    assert merged.count() == 8 and parts.count() == 16 * 8
    found = quotient.repeated_fingerprints(merged, 64).collect()
    assert {r["fp"] for r in found} == {r["fp"] for r in fp.collect()} and {r["copies"] for r in found} == {4}


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents").collect()
    assert Counter(map(tuple, queries.QUERIES["op13_exact_dedup"](spark, sf).collect())) == brute(docs)
