"""Every registered query of this subpackage, run as the driver runs it: against its SQL, or for its contract's rows and columns."""

from pathlib import Path

import duckdb
import pytest

from fluxmill.llm import queries

SF = "/root/testdata/sf0.001"
#: Columns of a contract, and the table and key of which each row gives one.
CONTRACTS = {
    "op1_packing": ({"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, None, None),
    "op2_toxicity": ({"doc_id", "held_out", "score", "predicted"}, "documents", "doc_id"),
    "op4_url_rules": ({"page_id", "host", "path", "rule", "verdict"}, "pages", "page_id"),
    "op6_compaction": ({"doc_id", "shard", "version"}, "documents", "doc_id"),
    "op7_language": ({"doc_id", "held_out", "lang_pred", "score"}, "documents", "doc_id"),
    "op8_html_text": ({"page_id", "text", "n_blocks"}, "pages", "page_id"),
    "packed_turns": ({"conv_id", "turn", "sequence_id", "offset"}, None, None),
    "shard_versions": ({"version", "doc_id"}, None, None),
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[k] for k in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_keeps_its_contract(spark, name):
    columns, table, key = CONTRACTS[name]
    rows = queries.QUERIES[name](spark, SF)
    assert columns <= set(rows.columns)
    found = rows.collect()
    assert found
    if table:
        assert sorted(r[key] for r in found) == sorted(r[key] for r in queries.table(spark, SF, table).collect())
    if "score" in columns:
        assert all(0 <= r["score"] <= 1 for r in found)
    if "predicted" in columns:
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in found)
    if "verdict" in columns:
        assert {r["verdict"] for r in found} <= {"allow", "block"}
    if name == "op1_packing":
        used: dict = {}
        for r in found:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in used.values():
            parts.sort()
            assert parts[0][0] == 0 and sum(n for _, n in parts) <= 2048 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert {r["doc_id"] for r in found} == {r["doc_id"] for r in queries.table(spark, SF, "documents").collect()}
