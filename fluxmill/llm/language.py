"""Language by hierarchical discrimination: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import LETTERS_ASCII, binary_column, bounded_batches, pieces, reader, row_schema, with_row

#: Languages by family; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "af", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class LanguageParams:
    """``per_language``: about how many labelled rows of a language the classifiers are fitted on, taken by the hash of doc_id; ``sample`` of all languages."""

    per_language: int = 800
    sample: int = 16_000
    buckets: int = 4096
    rounds: int = 150
    rate: float = 0.05
    decay: float = 1e-4
    sharpness: float = 3.0


DEFAULT = LanguageParams()


def family_of(lang: str) -> str:
    head = re.split(r"[-_]", lang.lower())[0]
    return next((name for name, langs in FAMILIES.items() if head in langs), lang)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(texts: list[bytes | None], buckets: int) -> np.ndarray:
    """Unit vectors of the square roots of hashed byte 2- and 3-gram counts, over whole texts."""
    out = np.zeros((len(texts), buckets), np.float32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for k, text in enumerate(texts):
        if not text:
            continue
        data = b" " + b" ".join(text.translate(LETTERS_ASCII).split()) + b" "
        counts = np.zeros(buckets, np.int64)
        for at in range(0, len(data), 1 << 20):  # long texts piece by piece
            b = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
            two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(0x9E3779B1)
            three = (two[:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
            counts += np.bincount((two * np.uint32(0x165667B1)) >> shift, minlength=buckets)
            counts += np.bincount(three >> shift, minlength=buckets)
        v = np.sqrt(counts)
        out[k] = v / max(1e-9, float(np.sqrt((v * v).sum())))
    return out


def _svm(x: np.ndarray, y: np.ndarray, p: LanguageParams) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss; y is 1 or -1. The last column of x is 1, so the last weight is the bias."""
    w, first, second = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for step in range(1, p.rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ w))
        grad = -2 * x.T @ (share * y * slack) + p.decay * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w = w - p.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class LanguageModel:
    params: LanguageParams
    families: list[str] = field(default_factory=list)
    family_svms: np.ndarray | None = None
    members: dict[str, list[str]] = field(default_factory=dict)
    pair_svms: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], params: LanguageParams) -> LanguageModel:
        """``x``: features and a last column of ones."""
        self, by = cls(params), defaultdict(list)
        for lang in sorted(set(langs)):
            by[family_of(lang)].append(lang)
        self.families, self.members = sorted(by), dict(by)
        names = np.array(langs, object)
        kin = np.array([family_of(x) for x in langs], object)
        if len(self.families) > 1:
            self.family_svms = np.stack([_svm(x, np.where(kin == f, 1, -1).astype(np.float32), params) for f in self.families], axis=1)
        for family, members in by.items():
            if len(members) > 1:
                rows = [np.flatnonzero((names == a) | (names == b)) for a, b in combinations(members, 2)]
                self.pair_svms[family] = np.stack([_svm(x[r], np.where(names[r] == a, 1, -1).astype(np.float32), params) for r, (a, _) in zip(rows, combinations(members, 2), strict=True)], axis=1)
        return self

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: the sigmoid of the family's margin times that of the weakest pair's."""
        if not self.families:
            return ["und"] * len(x), np.zeros(len(x))
        sigmoid = lambda m: 1 / (1 + np.exp(-self.params.sharpness * np.clip(m, -10, 10)))
        margins = self._margins(x, self.family_svms) if self.family_svms is not None else np.full((len(x), 1), 10.0)
        chosen, score = margins.argmax(axis=1), sigmoid(margins.max(axis=1))
        langs = np.array([self.members[self.families[k]][0] for k in chosen], object)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            if family not in self.pair_svms or not len(rows):
                continue
            members = self.members[family]
            pairs = list(combinations(range(len(members)), 2))
            m = self._margins(x[rows], self.pair_svms[family])
            votes, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
            for j, (a, b) in enumerate(pairs):
                for lang, margin in ((a, m[:, j]), (b, -m[:, j])):
                    votes[:, lang] += margin > 0
                    least[:, lang] = np.minimum(least[:, lang], margin)
            best = (votes + 1e-3 * np.tanh(least)).argmax(axis=1)
            langs[rows] = [members[j] for j in best]
            score[rows] *= sigmoid(least[np.arange(len(rows)), best])
        return langs.tolist(), score

    @staticmethod
    def _margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]


def fit_language(docs: DataFrame, params: LanguageParams = DEFAULT) -> LanguageModel:
    """Learns from ``docs(doc_id, text, lang)``; rows with null text, lang or doc_id are not learned from."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel(params)
    bounded_batches(docs.sparkSession)
    part, most = 1 << 30, min(params.per_language, max(1, params.sample // len(counts)))
    limits = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(part, int(part * most / n)))))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < limits[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in pieces(batch, rows=256):
                texts = binary_column(cut, "text")
                x = features(texts, params.buckets).astype(np.float16)
                yield pa.record_batch([cut.column("doc_id"), cut.column("lang"), pa.array([row.tobytes() if has_letter(t) else None for row, t in zip(x, texts, strict=True)], pa.binary())], names=["doc_id", "lang", "x"])

    found = sample.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, x binary").filter("x is not null")
    table = found.toPandas().sort_values(["doc_id", "lang"], kind="stable")
    if not len(table):
        return LanguageModel(params)
    x = np.ones((len(table), params.buckets + 1), np.float32)  # the driver holds the sample once
    for k, row in enumerate(table["x"]):
        x[k, :-1] = np.frombuffer(row, np.float16)
    langs = table["lang"].tolist()
    del table
    return LanguageModel.fit(x, langs, params)


def predict_language(docs: DataFrame, model: LanguageModel, carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``docs(doc_id, text)``, over whole texts.

    With ``carry``, ``row`` holds all columns of docs, so that nothing need be joined back.

    Null texts, and texts without a letter, are ``und`` with score 0, as are all
    if no language was learned. Repeated rows are judged one by one; other
    columns are not read.
    """

    read = reader(docs, carry)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in pieces(read(batch), rows=256):
                texts = binary_column(cut, "text")
                langs, scores = model.predict(features(texts, model.params.buckets))
                ok = [has_letter(t) for t in texts]
                langs = [x if k else "und" for x, k in zip(langs, ok, strict=True)]
                columns = [cut.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(ok, scores, 0.0).astype(float))]
                yield pa.record_batch(columns + ([cut.column("row")] if carry else []), names=["doc_id", "lang_pred", "score"] + ["row"] * carry)

    schema = "doc_id long, lang_pred string, score double"
    return with_row(docs, carry).mapInArrow(run, row_schema(schema, docs, carry))
