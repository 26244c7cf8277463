"""Conversation repair against an exhaustive search and the query's SQL."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import duckdb
import pytest

from fluxmill.llm import queries, repair
from fluxmill.llm.oracles import OP12

SHAPE = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """(cost, audit) over all edit strings, by search in order of cost and string, each prefix kept whole."""
    n, best = len(turns), None
    work = [(0, "", 0, "")]
    seen = {}
    while work:
        work.sort(key=lambda x: (x[2], x[3]))
        k, roles, cost, audit = work.pop(0)
        short = (k, roles if len(roles) < 3 else roles[-2:] + "*", audit.endswith("II"))
        if short in seen and seen[short] <= (cost, audit):
            continue
        seen[short] = (cost, audit)
        if k == n and SHAPE.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
            continue
        for r in "ua":
            if not audit.endswith("II"):
                work.append((k, roles + r, cost + 5, audit + "I"))
        if k < n:
            initial, fault = turns[k]
            work.append((k + 1, roles, cost + 2, audit + "D"))
            if fault < 2:
                work.append((k + 1, roles + initial if initial else roles + "?", cost + 5 * fault, audit + "K"))
                work += [(k + 1, roles + r, cost + 1 + 5 * fault, audit + "R") for r in "ua"]
        work = [w for w in work if w[1] == "" or re.fullmatch(r"s?(ua)*u?", w[1])]
    return best


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_and_ascii_least(seed):
    rng = random.Random(seed)
    turns = [(rng.choice("suauax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
    pointers, live = repair.layers(turns, {0: (0, 0)})
    cost, state = repair.ended(live)
    assert (cost, "".join(repair.traced(pointers, state)) + repair.ENDS[state][1]) == cheapest(turns)


def rows(seed, conversations=12, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " ", "", "Why?  \n", "Well, ", "x!", None, "..."]
    out = []
    for c in [*range(conversations), None]:
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.85:
                out.append((c, None if rng.random() < 0.1 else turn // rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def by_sql(data):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if data:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    return sorted(map(str, con.execute(OP12).fetchall()))


def digest(spark, data, block=4096):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    return repair.repair_digest(repair.repair_conversations(repair.damage(df), block))


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 1), (3, 2), (4, 3)])
def test_same_as_sql_with_blocks_of_any_size(spark, seed, block):
    """Nulls, blank and repeated turns, unknown roles, equal numbers; blocks part conversations where they may."""
    data = rows(seed)
    assert sorted(str(tuple(r)) for r in digest(spark, data, block).collect()) == by_sql(data)


def test_one_conversation_over_many_tasks_and_blocks(spark):
    rng = random.Random(7)
    data = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", "a b.", "", f"t{t}."])) for t in range(9000)] + [(6, 0, "user", "Hi.")]
    pieces = repair.repair_conversations(repair.damage(spark.createDataFrame(data, SCHEMA)))
    long_ = [r for r in pieces.collect() if r["conv_id"] == 5]
    assert len(long_) > 2 and max(len(r["turns"]) for r in long_) <= 2 * repair.BLOCK_TURNS
    # the same, whole and at once
    turns = []
    for c, t, role, text in data[:-1]:
        code = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if code == 1 else text.translate({ord(x): None for x in ".!?"}) if code == 2 else text
        turns += [{"turn": t, "role": "user" if code == 4 else role, "text": text}] * (0 if code == 0 else 2 if code == 3 else 1)
    want = repair._repaired_here(5, turns, 0)
    got = sorted(long_, key=lambda r: r["piece"])
    assert "".join(r["audit"] for r in got) == want["audit"]
    assert [(t["role"], t["text"]) for r in got for t in r["turns"]] == [(t["role"], t["text"]) for t in want["turns"]]
    assert all(r[c] == want[c] for r in got for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    row = next(r for r in repair.repair_digest(pieces).collect() if r["conv_id"] == 5)
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in want["turns"]).encode()).hexdigest()


def test_repaired_turns_have_the_shape(spark):
    pieces = repair.repair_conversations(repair.damage(spark.createDataFrame(rows(11, 30), SCHEMA)))
    every = sorted(pieces.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["piece"]))
    for _, group in groupby(every, key=lambda r: r["conv_id"]):
        assert SHAPE.fullmatch("".join(t["role"][0] for r in group for t in r["turns"]))


def test_empty_table_extra_columns_and_long_text(spark):
    assert digest(spark, []).count() == 0
    data = [(1, 0, "user", "w " * 3_000_000 + "end."), (1, 1, "assistant", "ok."), (2, 7, "user", "ok.")]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], SCHEMA + ", gone_ int, tie int")
    got = repair.repair_digest(repair.repair_conversations(repair.damage(df))).collect()
    assert sorted(str(tuple(r)) for r in got) == by_sql(data)


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_conversation_repair"](spark, sf)
    data = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in got.collect()) == by_sql(data)
