"""Domain-shaped views of the contract tables, by arithmetic that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_D = "CAST({} AS DOUBLE)".format

#: Each view: its table and its columns, as SQL that both engines accept.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "pixel": ("events", [
        "event_id AS pixel_id", "CAST(ts AS TIMESTAMP) AS time", "event_type AS kind", "value",
        f"{_D('user_id % 20')} * {_D(0.25)} + {_D(30)} AS lat",
        f"{_D('(user_id * 7) % 24')} * {_D(0.3125)} - {_D(105)} AS lon",
        "(user_id * 7) % 24 AS i", "user_id % 20 AS j",
        f"{_D('event_id % 10')} / {_D(10)} AS qa", "event_id % 4 AS sc",
        "CASE WHEN event_id % 97 = 0 THEN 184 ELSE event_id % 4 END AS sc_f9",
        f"{_D('event_id % 50')} * {_D(1000)} AS chi2_swir", "event_id % 40 AS orbit",
    ]),
    "emission": ("lineitem", [
        "CAST(l_shipdate AS DATE) AS date", "l_suppkey AS cell_id", "l_suppkey % 12 + 1 AS label",
        "CASE l_partkey % 8 WHEN 0 THEN 'Oil' WHEN 1 THEN 'Gas' WHEN 2 THEN 'Coal' WHEN 3 THEN 'Livestock' WHEN 4 THEN 'Landfills' WHEN 5 THEN 'Wastewater' WHEN 6 THEN 'Wetlands' ELSE 'SoilAbsorb' END AS sector",
        f"CASE WHEN l_partkey % 8 = 7 THEN -l_extendedprice ELSE l_extendedprice END / {_D(100000)} AS flux",
        f"{_D('l_suppkey % 5 + 1')} * {_D(1000)} AS area_m2",
    ]),
    "obs_model": ("lineitem", [
        "l_orderkey AS orbit", "l_linenumber AS line", "l_suppkey AS cell_id",
        f"l_extendedprice / {_D(1000)} AS sat", f"l_quantity * {_D(1.5)} AS model",
        f"{_D('l_linenumber')} AS obs_count",
        f"l_quantity / {_D(50)} AS k1", f"l_discount * {_D(10)} AS k2", f"l_tax * {_D(10)} AS k3", f"{_D('l_partkey % 7')} / {_D(7)} AS k4",
    ]),
    "station": ("lineitem", [
        "l_suppkey AS site", "CAST(l_shipdate AS TIMESTAMP) AS time", f"l_extendedprice / {_D(10)} AS op", f"l_extendedprice / {_D(10)} + l_quantity AS gc",
        f"{_D('l_suppkey % 180')} - {_D(90)} AS latitude", "l_orderkey", "l_linenumber",
    ]),
    "place": ("supplier", ["s_suppkey AS elem", f"{_D('s_suppkey % 40')} / {_D(4)} + {_D(30)} AS lat", f"{_D('(s_suppkey * 3) % 60')} / {_D(5)} - {_D(105)} AS lon"]),
    "plume": ("events", [
        "event_id AS id", "event_type AS datasource", "CASE event_id % 5 WHEN 0 THEN 'GAO' WHEN 1 THEN 'ang' ELSE 'sat' END AS instrument",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS emission_rate", "(user_id * 7) % 24 AS i", "user_id % 20 AS j",
    ]),
    "granule": ("lineitem", [
        "CAST(l_orderkey AS VARCHAR(20)) AS orbit", "CASE WHEN l_returnflag = 'R' THEN 'RPRO' ELSE 'OFFL' END AS mode",
        "l_linestatus AS processor_version", "CAST(l_shipdate AS TIMESTAMP) AS modification", "l_linenumber AS name",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return df.select(*(F.expr(c) for c in columns))


def cte(*names: str) -> str:
    """``WITH`` clause of the same views."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)
