"""Language identification: word-first backoff (operator 6).

The model holds, for each language, the log frequency of known words and of character n-grams (n from
``max_gram`` down to 1, with word borders). A text's words are scored one by one: a known word by its
own log frequency, any other by its longest known n-grams, falling back to shorter ones and at last to
a floor. The language with the highest sum wins; its score is the posterior share of that sum.

Fitting reads a bounded sample of labelled rows (``fit_rows`` per language, those with the smallest
hash; a documented parameter). Counts are taken with Spark aggregations; what is collected is the
``max_words`` most frequent words and ``max_grams`` n-grams of each length for each language, fewer for each where there are so many
languages that ``model_entries`` in all would not do. So the broadcast model has a fixed bound whatever the
input, and no language is left out; more than ``model_entries / 100`` labels are an error. Words beyond the model are
not lost: they go the n-gram way.

Defined results: null text or a text without a letter is ``und`` with score 0; ties go to the
alphabetically first language; without any labelled row every text is ``und``; a text of any length is scored whole;
repeated rows get equal rows; an empty table gives an empty result; extra columns are ignored (``keep_identified``
keeps them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm import textnum as tn
from farelens.llm.tables import table

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
#: Unseen words whose scores a task remembers; the memory is emptied when full.
_MEMO = 50_000


@dataclass(frozen=True)
class LanguageModelSize:
    fit_rows: int = 4000
    max_words: int = 20_000
    max_grams: int = 4000
    max_gram: int = 4
    smoothing: float = 0.5
    model_entries: int = 1_200_000

    def shared(self, languages: int) -> tuple[int, int]:
        """Words and n-grams of each length that each of so many languages may have."""
        part = min(1.0, self.model_entries / (max(1, languages) * (self.max_words + self.max_gram * self.max_grams)))
        return max(1, int(self.max_words * part)), max(1, int(self.max_grams * part))


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]
    floor: np.ndarray


def row_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _sample(docs: DataFrame, size: LanguageModelSize) -> tuple[DataFrame, int]:
    """At most ``fit_rows`` labelled texts per language, by smallest hash, and the number of languages; the text travels only for those."""
    keyed = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id").alias("_h"))
    most = size.model_entries // 100
    counts = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages; model_entries is {size.model_entries}")
    if not counts:
        return keyed.select("lang", "text").limit(0), 0
    # a hash bound lets through about 1.5 times the wanted rows, the window then takes exactly the wanted number
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * size.fit_rows / n + 100 / n))) for k, n in counts.items()))
    near = keyed.where((F.col("_h") / F.lit(2.0**64) + 0.5) <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", F.xxhash64("text"), "text"))
    return near.withColumn("_r", rank).where(F.col("_r") <= size.fit_rows).select("lang", "text"), len(counts)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "gram", "k"])
        del found
        tn.release()


def _grams(longest: int):
    """N-grams of words with borders, each counted as often as its word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], Counter[str]] = {}
            for lang, word, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                padded = f"<{word}>"
                for n in range(1, longest + 1):
                    counts = found.setdefault((lang, n), Counter())
                    for at in range(len(padded) - n + 1):
                        counts[padded[at : at + n]] += k
            for (lang, n), counts in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([n] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "n", "gram", "k"])
            del found
            tn.release()

    return run


def fit(docs: DataFrame, size: LanguageModelSize | None = None) -> LanguageModel:
    """Fits on the labelled rows of ``docs`` (doc_id, text, lang)."""
    size = size or LanguageModelSize()
    sample, n_languages = _sample(docs, size)
    max_words, max_grams = size.shared(n_languages)
    words = sample.mapInArrow(_word_counts, "lang string, gram string, k long").groupBy("lang", "gram").agg(F.sum("k").alias("k"))
    grams = words.mapInArrow(_grams(size.max_gram), "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    counted = words.select("lang", F.lit(0).alias("n"), "gram", "k").unionByName(grams)
    within = Window.partitionBy("lang", "n")
    top = F.row_number().over(within.orderBy(F.desc("k"), "gram"))
    wanted = counted.withColumn("total", F.sum("k").over(within)).withColumn("r", top)
    rows = wanted.where(F.col("r") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams)).select("lang", "n", "gram", "k", "total").collect()
    languages = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(languages)}
    total = np.ones((size.max_gram + 1, len(languages)))
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(size.max_gram + 1)]
    for r in rows:
        total[r["n"], at[r["lang"]]] = r["total"]
        tables[r["n"]].setdefault(r["gram"], np.zeros(len(languages)))[at[r["lang"]]] = r["k"]
    for n, grams in enumerate(tables):
        for gram, k in grams.items():
            grams[gram] = np.log((k + size.smoothing) / (total[n] + size.smoothing * (len(grams) + 1)))
    floor = np.log(size.smoothing / (total[1] + size.smoothing * (len(tables[1]) + 1)))
    return LanguageModel(languages, tables[0], tables[1:], floor)


class _Scorer:
    """Words and n-grams numbered as rows of one matrix of log frequencies; a text is the sum of its rows.

    It is made once and sent to the tasks, which is a fraction of a table of small arrays.
    """

    def __init__(self, model: LanguageModel):
        self.languages = model.languages
        size, rows = len(model.languages), []

        def number(table: dict[str, np.ndarray]) -> dict[str, int]:
            start = len(rows)
            rows.extend(table.values())
            return {key: start + i for i, key in enumerate(table)}

        self.words = number(model.words)
        self.grams = [number(t) for t in model.grams]
        self.floor = len(rows)
        self.rows = np.array([*rows, model.floor]).reshape(len(rows) + 1, size)
        self.memo: dict[str, list[int]] = {}

    def unseen(self, word: str) -> list[int]:
        """From left to right, the longest known n-gram at each place, shorter ones if there is none."""
        padded, out, at, end = f"<{word}>", [], 0, len(word) + 2
        while at < end:
            for n in range(min(len(self.grams), end - at), 0, -1):
                hit = self.grams[n - 1].get(padded[at : at + n])
                if hit is not None:
                    out.append(hit)
                    at += n
                    break
            else:
                out.append(self.floor)
                at += 1
        return out

    def text(self, text: str) -> tuple[str, float]:
        words = _WORD.findall(text.lower())
        if not self.languages or not words or not (words[0].isalpha() or _LETTER.search(text)):
            return "und", 0.0
        got = list(map(self.words.get, words))
        memo = self.memo
        for k, hit in enumerate(got[:]):
            if hit is None:
                word = words[k]
                rows = memo.get(word)
                if rows is None:
                    rows = self.unseen(word)
                    if len(word) <= 64:
                        if len(memo) >= _MEMO:
                            memo.clear()
                        memo[word] = rows
                got[k] = rows[0]
                got += rows[1:]
        total = self.rows[np.array(got)].sum(axis=0)
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; only the text decides. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(_Scorer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            got = [scorer.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "lang_pred", "score"])
            tn.release()
        scorer.memo.clear()

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose text is in one of the model's languages with ``least_score`` at least; all columns stay."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(_Scorer(model)), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            got = [scorer.text(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text_col))]
            yield batch.filter(pa.array([lang != "und" and score >= least_score for lang, score in got], pa.bool_()))
            tn.release()
        scorer.memo.clear()

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.where(row_fold(F.col("doc_id"), 3) != 1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(row_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
