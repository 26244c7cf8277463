"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .texts import LETTERS_ASCII, binary_column, bounded_batches, chunks, pieces


@dataclass(frozen=True)
class ToxicParams:
    """``sample``: the most labelled rows that the classifier is fitted on, taken by the hash of doc_id.

    Terms are words and their first ``prefixes`` bytes, hashed to ``buckets``;
    the ``features`` buckets that part the classes best, of all in the sample, get
    weights and ``factors`` latent factors. Weights for all of them did far worse
    on held-out rows: see the README's figures.
    """

    sample: int = 12_000
    buckets: int = 1 << 20
    prefixes: tuple[int, ...] = (4, 5, 6)
    features: int = 2048
    factors: int = 6
    rounds: int = 240
    rate: float = 0.05
    decay: float = 2e-4
    seed: int = 17


DEFAULT = ToxicParams()


class _Terms(dict):
    """Buckets of a word's terms; those of the words seen first are remembered."""

    LIMIT = 300_000

    def __init__(self, p: ToxicParams, columns: dict[int, int] | None = None):
        super().__init__()
        self.p, self.columns = p, columns

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        terms = [b"w" + word, *(b"p" + word[:k] for k in self.p.prefixes if len(word) > k)]
        found = tuple({xxhash.xxh3_64_intdigest(t) % self.p.buckets for t in terms})
        if self.columns is not None:
            found = tuple(self.columns[b] for b in found if b in self.columns)
        if len(self) < self.LIMIT:
            self[word] = found
        return found


def _present(text: bytes | None, terms: _Terms) -> set[int]:
    words = set().union(*(chunk.translate(LETTERS_ASCII).split() for chunk in chunks(text)))
    return set(chain.from_iterable(map(terms.__getitem__, words)))


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of present features of <v_i, v_j>)."""

    columns: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, present: list[int]) -> float:
        v = self.factors[present]
        total = v.sum(axis=0)
        z = self.bias + self.weights[present].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_machine(x: np.ndarray, y: np.ndarray, columns: dict[int, int], p: ToxicParams) -> FactorizationMachine:
    """Full-batch Adam on the logistic loss, classes weighted alike."""
    rng = np.random.default_rng(p.seed)
    n = x.shape[1]
    theta = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.02, (n, p.factors))], axis=1).astype(np.float32)
    rate = y.mean() if len(y) else 0.5
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    if not len(y) or rate in (0, 1):
        return FactorizationMachine(columns, bias, theta[:, 0], np.zeros_like(theta[:, 1:]))
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32) / len(y)
    bias, first, second = 0.0, np.zeros_like(theta), np.zeros_like(theta)
    b1 = b2 = 0.0
    for step in range(1, p.rounds + 1):
        linear = x @ theta
        square = x @ (theta[:, 1:] ** 2)
        z = bias + linear[:, 0] + 0.5 * ((linear[:, 1:] ** 2).sum(axis=1) - square.sum(axis=1))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        back = x.T @ np.concatenate([error[:, None], error[:, None] * linear[:, 1:]], axis=1)
        grad = np.concatenate([back[:, :1], back[:, 1:] - back[:, :1] * theta[:, 1:]], axis=1) + p.decay * theta / n**0.5
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta = theta - p.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        g = float(error.sum())
        b1, b2 = 0.9 * b1 + 0.1 * g, 0.999 * b2 + 0.001 * g * g
        bias -= p.rate * (b1 / (1 - 0.9**step)) / (b2**0.5 / (1 - 0.999**step) ** 0.5 + 1e-8)
    return FactorizationMachine(columns, bias, theta[:, 0], theta[:, 1:])


def _terms(p: ToxicParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(p)
        for part in (p for batch in batches for p in pieces(batch)):
            found = [sorted(_present(t, terms)) for t in binary_column(part, "text")]
            yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "terms"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = DEFAULT) -> FactorizationMachine:
    """Fits the machine on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; rows without a label are not learned from.

    A doc_id labelled more than once counts as toxic if any of its labels is; of
    several texts of one id, the one of the least hash of its terms is learned from.
    Only ``params.sample`` ids are broadcast; only the chosen features of the
    sample's rows come to the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "toxic")
    y = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    chosen = scratch.save(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample), "chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.select("doc_id", "text", "y").mapInArrow(_terms(params), "doc_id long, y int, terms array<int>")
    # one text an id, so that the bound on ids is one on rows
    one = F.min(F.struct(F.xxhash64("terms").alias("hash"), "y", "terms")).alias("one")
    terms = scratch.save(found.groupBy("doc_id").agg(one).select("doc_id", "one.y", "one.terms"), "terms")
    totals = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = totals["n"], totals["pos"]
    if not n:
        return FactorizationMachine({}, 0.0, np.zeros(0, np.float32), np.zeros((0, params.factors), np.float32))
    counts = terms.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("y").alias("a"), F.count("*").alias("c"))
    share = F.lit(pos / n)
    z = F.abs(F.col("a") - F.col("c") * share) / F.sqrt(F.col("c") * share * (1 - share) + 1e-9)
    best = [r["t"] for r in counts.filter("c >= 3").orderBy(z.desc(), "t").limit(params.features).select("t").collect()]
    columns = {b: k for k, b in enumerate(best)}
    wanted = scratch.save(spark.createDataFrame([(int(b), k) for b, k in columns.items()], "t int, k int"), "wanted")
    dense = (
        terms.select("doc_id", "y", F.explode_outer("terms").alias("t")).join(F.broadcast(wanted), "t", "left")
        .groupBy("doc_id", "y").agg(F.collect_set("k").alias("k")).orderBy("doc_id")
    )
    found = dense.toLocalIterator()
    x, target = np.zeros((n, max(1, len(best))), np.float32), np.zeros(n, np.float32)
    size = 0
    for r in found:
        x[size, r["k"]] = 1
        target[size] = r["y"]
        size += 1
    machine = fit_machine(x[:size], target[:size], columns, params)
    scratch.drop("chosen", "terms", "wanted")
    return machine


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, params: ToxicParams = DEFAULT, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted): one row per row of ``docs(doc_id, text)``, over whole texts.

    Null and empty texts hold no term and get the machine's bias. Repeated rows
    are scored one by one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(params, machine.columns)
        for part in (p for batch in batches for p in pieces(batch)):
            scores = [machine.score(sorted(_present(t, terms))) for t in binary_column(part, "text")]
            yield pa.record_batch([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
