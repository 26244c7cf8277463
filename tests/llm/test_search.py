"""Ranked search against brute force and its SQL; MaxScore must also read less than all."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from fluxmill.llm import maxscore, queries
from fluxmill.llm.oracles import OP11
from tests.llm.test_operators import awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for _, _, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, length in docs:
            m = 100 - 50 + 50 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("shard_terms", [20, 400, 2_000_000])
@pytest.mark.parametrize("block_bytes", [1, 4 << 20])
def test_same_as_brute_force(spark, shard_terms, block_bytes):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(60)] + ["É", "a1", "ÀB", "-", "x.y"])
    draw = lambda n: " ".join(rng.choice(words, n, p=(p := 1 / np.arange(1, len(words) + 1)) / p.sum()))
    docs = [(int(i), draw(rng.integers(1, 40))) for i in range(150)] * 2 + [(None, "w1 w2"), (None, None), (7, ""), (8, "--"), (9, "W3 w3 w59 W59")]
    items = [(k, draw(6)) for k in range(8)] + [(8, None), (9, "..."), (10, "absent"), (10, "w3 w59"), (None, "w2 w58 É")]
    spread = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = maxscore.ranked_search(spread, spark.createDataFrame(items, "item_id long, text string"), 7, shard_terms, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(rows(got), key=str) == brute(docs, items, 7)


def test_awkward_and_empty_tables(spark):
    items = [(1, "one Two 12 wörds word7"), (2, None)]
    queried = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, item string, rank string")
    docs = awkward(spark)
    assert sorted(rows(maxscore.ranked_search(docs, queried)), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert maxscore.ranked_search(empty(spark), queried).count() == 0
    assert maxscore.ranked_search(docs, queried.limit(0)).count() == 0


def test_lists_of_low_bounds_are_only_probed():
    rng = np.random.default_rng(1)
    building = maxscore._Building()
    for i in range(4000):
        building.add(i, (b"common " * int(rng.integers(1, 3)) + b"filler " * 5 + (b"rare " if i % 40 == 0 else b"") + b"some " * int(i % 3 == 0)))
    row = {c: building.row().column(c)[0].as_py() for c in maxscore._SHARD.names}
    df = {b"common": 4000, b"rare": 100, b"some": 1334, b"filler": 4000}
    weights = {t: maxscore.weight(4000, n) for t, n in df.items()}
    weights[b"common"] = 1
    shard, top = maxscore.Shard(row, weights, 4000, building.total), maxscore.Top(20)
    shard.search([b"common", b"rare", b"some"], top)
    assert shard.read < 4000 + 100 + 1334
    whole = np.zeros(4000, np.int64)
    for t in (b"common", b"rare", b"some"):
        docs, scores, _ = shard.postings(t)
        whole[docs] += scores
    best = np.lexsort((np.arange(4000), -whole))[:20]
    assert top.ids.tolist() == best.tolist() and top.scores.tolist() == whole[best].tolist()


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = queries.QUERIES["op11_ranked_search"](spark, sf)
    assert sorted(rows(got), key=str) == sorted(con.execute(OP11).fetchall(), key=str)
