"""Registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, fmindex, htmltext, language, linedup, maxscore, minmax, packing, pivots, quotient, repair, toxicity, urlrules
from .oracles import ORACLES
from .scratch import Scratch

#: Versions of the compacted table that stay readable.
KEPT_VERSIONS = 10
#: (host, path, verdict) of the listed URL rules.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(modulus: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit_toxicity(docs, labels.filter(~_held_out(3, 1)))
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), minmax.MinMaxParams(shingle=3, percent=85))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    mined = urlrules.mine_rules(pages.select("page_id", "url").join(bad, "page_id"))
    return urlrules.judge_urls(pages, URL_RULES, mined)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_decisions(table(spark, sf_dir, "documents"))


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = compaction.compact_arrivals(docs, Scratch(spark, "shards").path("documents"), keep=KEPT_VERSIONS)
    version = store.manifest().version
    rows = store.read()
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_text"), "shard", F.lit(version).alias("version"))


def shard_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, doc_id) of every row that each version of the compacted table holds."""
    store = compaction.compact_arrivals(table(spark, sf_dir, "documents"), Scratch(spark, "shards").path("documents"), keep=KEPT_VERSIONS)
    parts = [store.read(v).select(F.lit(v).alias("version"), "doc_id") for v in store.versions()]
    return reduce(DataFrame.unionByName, parts)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs.filter(~_held_out(4, 2)))
    found = language.predict_language(docs, model)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return fmindex.leak_digest(found)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digest(repair.repair_conversations(repair.damage(table(spark, sf_dir, "conversations"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient.exact_duplicates(table(spark, sf_dir, "documents"))


def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: whole conversations, where the limits on segments and loss-bearing tokens bind."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), tokenizer_path())


def listed_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed rules alone, without mined ones."""
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, none)


QUERIES = {f.__name__: f for f in (packed_turns, listed_url_rules, shard_versions, op1_packing, op2_toxicity, op3_minhash, op4_url_rules, op5_line_dedup, op6_compaction, op7_language, op8_html_text, op9_decontamination, op10_embeddings, op11_ranked_search, op12_conversation_repair, op13_exact_dedup)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
