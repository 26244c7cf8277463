"""A training-corpus pipeline over ``documents``: each stage is written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxmill.llm import fmindex, language, linedup, minmax, packing
from fluxmill.llm.membership import without_ids
from fluxmill.llm.queries import table, tokenizer_path
from fluxmill.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a missing lang is filled with it.

    Null texts and texts without a letter have no language and go, and so do all
    if no row has a lang to learn from. Ids may be null or repeat: each row is
    judged by its own text, and extra columns stay as they are.
    """
    model = language.fit_language(docs)
    found = language.predict_language(docs, model, carry=True).filter("lang_pred <> 'und'")
    return found.select(*(F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; those of which only blank lines are left go.

    n_chars, where the table has it, follows the text. Rows that repeat a doc_id
    and a text keep the same lines; rows with a null doc_id come last. Extra
    columns stay as they are.
    """
    done = linedup.without_repeated_lines(docs)
    left = done.filter((F.col("n_lines_dropped") == 0) | F.col("text").rlike(r"\S"))
    n_chars = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c)
    return left.select(*(n_chars(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays, with all rows that share it; rows with
    a null doc_id stay, and so do wordless texts. Extra columns stay as they are.
    """
    found = minmax.near_duplicates(docs, minmax.MinMaxParams(shingle=5, percent=80))
    return without_ids(docs, found.filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word piece of a benchmark text; each row is judged by its own text, whatever its id."""
    found = fmindex.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter(F.size("spans") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids; null and empty texts are their end id, and each row is a document of its own."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
#: Packing and the classifiers have no SQL form; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
