"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 10).

A text is a bag of terms: its words' hashed forms (lower-cased, stripped of digits and signs), the shape
of each word (classes of its bytes, run lengths collapsed), pairs of neighbouring words that are equal,
and its size. Terms are weighted by damped frequency and inverse document frequency and projected by a
truncated singular value decomposition. The labelled vectors are broadcast; every document's cosine
with all of them is computed exactly in blocks, and its ``neighbours`` nearest vote with their
similarity, each class weighted alike.

Fitting reads a bounded sample: at most ``fit_rows`` labelled rows of each class, those with the
smallest hash (a documented parameter), so the broadcast is ``2 * fit_rows * dimensions`` floats.

Defined results: a null or empty text is scored like any other (by its size term); without any labelled
row, or where none of a text's terms is known, the score is 0.5; a repeated row gets an equal row; extra columns are ignored (``keep_good`` keeps
them); labels that are null or given twice for a document: null ones are left out, of several the
lowest counts; of several texts under one labelled id the one with the least hash is learned from; neighbours
as near as the last that votes share the places left among them; a text of any length is one row of terms; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm import textnum as tn
from farelens.llm.language_id import row_fold
from farelens.llm.tables import table

#: Hashed terms of each kind: words, shapes, and single terms for repeats and size.
_WORD_TERMS, _SHAPE_TERMS, _EXTRA_TERMS = 512, 480, 32
TERMS = _WORD_TERMS + _SHAPE_TERMS + _EXTRA_TERMS
#: Cosines that differ by no more are equal.
TIE = 1e-6

_CLASS = np.full(256, 5, np.uint8)  # other signs
_CLASS[97:123] = _CLASS[128:] = 1  # lower-case and beyond ASCII
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b".,;:?'\"()-")] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 6, 7
_LETTERS = np.where((_CLASS == 1) | (_CLASS == 2), tn.LOWER, 0).astype(np.uint8)
_COLLAPSED = [np.array([c == k for c in _CLASS]) for k in range(8)]


@dataclass(frozen=True)
class ClassifierSize:
    fit_rows: int = 3000
    dimensions: int = 64
    neighbours: int = 15
    block: int = 512


@dataclass
class Classifier:
    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    block: int

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        out = np.empty(len(terms))
        good = self.labels == 1
        # each class votes with its own sum of weights over its share among the labelled
        share = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * len(good)
        k = min(self.neighbours, len(good))
        for at in range(0, len(terms), self.block):
            place = (terms[at : at + self.block] * self.weight) @ self.projection
            found = _unit(place) @ self.vectors.T
            near = np.argpartition(found, len(good) - k, axis=1)[:, len(good) - k :]
            cosine = np.take_along_axis(found, near, axis=1)
            vote = np.maximum(cosine, 1e-6) ** 4 * share[near]
            share_of_good = (vote * good[near]).sum(axis=1) / vote.sum(axis=1)
            last = cosine.min(axis=1, keepdims=True)
            tied = np.flatnonzero((found >= last - TIE).sum(axis=1) > k)
            if len(tied):
                share_of_good[tied] = _tied_votes(found[tied], last[tied], k, good, share)
            out[at : at + self.block] = np.where((place * place).sum(axis=1) > 1e-18, share_of_good, 0.5)
        return np.clip(out, 0.0, 1.0)


def _tied_votes(found: np.ndarray, last: np.ndarray, k: int, good: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The good's share of votes where more than k neighbours are as near as the k-th: those share the places that are left."""
    sure, level = found > last + TIE, np.abs(found - last) <= TIE
    places = (k - sure.sum(axis=1, keepdims=True)) / level.sum(axis=1, keepdims=True)
    vote = np.maximum(found, 1e-6) ** 4 * share * np.where(sure, 1.0, np.where(level, places, 0.0))
    return (vote * good).sum(axis=1) / vote.sum(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _shape_hashes(part: tn.Slice, words: tn.Words) -> np.ndarray:
    """A hash of each word's byte classes with equal neighbours collapsed."""
    kind = _CLASS[part.data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[words.start] = True
    place = np.cumsum(fresh)
    value = np.where(fresh, kind.astype(np.uint64) + np.uint64(1), np.uint64(0))
    rank = place - place[words.start][np.maximum(np.searchsorted(words.start, np.arange(len(kind)), side="right") - 1, 0)]
    value *= np.uint64(0x9FB21C651E98DF25) ** np.where(fresh, rank, 0).clip(0).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return tn.mix64(total[words.end] - total[words.start])


def term_rows(part: tn.Slice) -> np.ndarray:
    """Damped term frequencies of each row of a slice, one row per text, of unit length by kind."""
    rows = len(part)
    words = tn.Words(part)
    stem = tn.Words.hashes(_Letters(words))
    shape = _shape_hashes(part, words) if len(words) else np.zeros(0, np.uint64)
    out = np.zeros((rows, TERMS), np.float32)
    for lo, size, hashes in ((0, _WORD_TERMS, stem), (_WORD_TERMS, _SHAPE_TERMS, shape)):
        flat = words.row * size + (hashes % np.uint64(size)).astype(np.int64)
        counts = np.bincount(flat, minlength=rows * size).reshape(rows, size)
        out[:, lo : lo + size] = np.sqrt(counts / np.maximum(words.count, 1)[:, None])
    at = _WORD_TERMS + _SHAPE_TERMS
    full = words.hashes()
    same = np.zeros(len(words), bool)
    same[1:] = (full[1:] == full[:-1]) & (words.row[1:] == words.row[:-1])
    out[:, at] = np.sqrt(np.bincount(words.row[same], minlength=rows) / np.maximum(words.count, 1))
    size = np.minimum(np.log2(words.count + 1).astype(np.int64), _EXTRA_TERMS - 2)
    out[np.arange(rows), at + 1 + size] = 0.2
    return out


class _Letters:
    """Words' hashes over their letters only."""

    def __init__(self, words: tn.Words):
        self.data, self.start, self.end = _LETTERS[words.data], words.start, words.end


def _sample(docs: DataFrame, labels: DataFrame, size: ClassifierSize) -> DataFrame:
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marked = marked.withColumn("_h", F.xxhash64("doc_id"))
    rank = F.row_number().over(Window.partitionBy("quality").orderBy("_h", "doc_id"))
    counts = {r["quality"]: r["n"] for r in marked.where("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    # a hash bound lets through about 1.5 times the wanted rows, the window then takes exactly the wanted number
    bound = lambda label: F.lit((1.5 * size.fit_rows + 100) / max(1, counts.get(label, 1)))
    share = F.when(F.col("quality") == 0, bound(0)).otherwise(bound(1))
    near = marked.where("quality IN (0, 1)").where(F.col("_h") / F.lit(2.0**64) + 0.5 <= share)
    chosen = near.withColumn("_r", rank).where(F.col("_r") <= size.fit_rows).select("doc_id", "quality")
    near = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * fit_rows ids at most
    return near.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, size: ClassifierSize | None = None) -> Classifier:
    """Fits on the labelled rows of ``docs`` (doc_id, text), a bounded sample of them."""
    size = size or ClassifierSize()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch.column(0)):
                rows = term_rows(part).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(part.lo, len(part)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["quality", "terms"])

    got = _sample(docs, labels, size).select("text", "quality", "doc_id").orderBy("doc_id").select("text", "quality").mapInArrow(run, "quality int, terms binary").collect()
    y = np.array([r["quality"] for r in got], np.int64)
    if not len(y):
        return Classifier(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, size.neighbours, size.block)
    x = np.frombuffer(b"".join(r["terms"] for r in got), np.float16).reshape(len(y), TERMS).astype(np.float32)
    weight = np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= weight
    value, vector = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = vector[:, np.argsort(-value)[: size.dimensions]].astype(np.float32)
    return Classifier(weight, projection, _unit(x @ projection).astype(np.float32), y, size.neighbours, size.block)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, len(part)), pa.array(sent.value.score(term_rows(part)), pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, score double")


def keep_good(docs: DataFrame, model: Classifier, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score ``least_score`` at least; all columns stay."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch.column(batch.schema.get_field_index(text_col))):
                yield batch.slice(part.lo, len(part)).filter(pa.array(sent.value.score(term_rows(part)) >= least_score))

    return docs.mapInArrow(run, schema)


def training_rows(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return labels.where(row_fold(F.col("doc_id"), 5) != 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, training_rows(table(spark, sf_dir, "labels"))))
    return found.select("doc_id", F.coalesce(row_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
