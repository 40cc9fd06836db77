"""Quality rules: repetition coverage by rolling hashes (operator 4).

Every text is cut into words ``[^\\x20\\x09-\\x0D]+``. For each n-gram length a rolling hash of every
window is taken with numpy, and the characters inside windows that occur twice or more are measured
(overlapping windows count once), as are the characters of repeated lines. A document is kept if no
measure is over its limit.

Defined results: a null or empty text has zero counts and fails the base rule (fewer than
``min_words`` words); a repeated row is judged like the first; a text of any length is measured whole; of equal
lines or n-grams all count, of lines all but the first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from farelens.llm import textnum as tn
from farelens.llm.tables import table

_SYMBOLS = tn.byte_set("#*$%&|<>")
_NEWLINE = tn.byte_set("\n")


@dataclass(frozen=True)
class RuleLimits:
    """Limits in per cent, so that every comparison is between whole numbers."""

    min_words: int = 10
    repeat_window: int = 5
    max_repeat_words: int = 20
    #: Of word characters inside n-grams that occur twice or more, by n.
    max_ngram_chars: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    #: Of word characters in lines equal to an earlier line.
    max_line_chars: int = 20
    #: Symbols against words.
    max_symbols: int = 10


def _measure(part: tn.Slice, limits: RuleLimits) -> dict[str, np.ndarray]:
    rows = len(part)
    words = tn.Words(part)
    hashes = words.hashes()
    # code points of each word: bytes that do not continue a UTF-8 sequence
    points = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
    chars = points[words.end] - points[words.start]
    total = np.bincount(words.row, weights=chars, minlength=rows).astype(np.int64)
    by_row = np.concatenate(([0], np.cumsum(_SYMBOLS[part.data])))
    out = {
        "n_words": words.count,
        "word_chars": total,
        "n_symbols": by_row[part.bounds[1:]] - by_row[part.bounds[:-1]],
    }

    # lines: a line's hash is of its bytes; a line counts if it has a word
    lines = tn.Words(part, _NEWLINE)
    first = np.searchsorted(words.start, lines.start)
    after = np.searchsorted(words.start, lines.end)
    filled = after > first
    line_row, line_hash = lines.row[filled], lines.hashes()[filled]
    sums = np.concatenate(([0], np.cumsum(chars)))
    line_chars = sums[after[filled]] - sums[first[filled]]
    key = tn.mix64(line_hash ^ tn.mix64(line_row.astype(np.uint64) + np.uint64(1)))
    _, earliest = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[earliest] = False
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_row[again], weights=line_chars[again], minlength=rows).astype(np.int64)

    salt = tn.mix64(words.row.astype(np.uint64) + np.uint64(1))
    for n in sorted({limits.repeat_window, *limits.max_ngram_chars}):
        grams, at = tn.windows(hashes, words.row, n)
        inside = tn.covered(len(words), at[tn.repeated(tn.mix64(grams ^ salt[at]))], n)
        if n == limits.repeat_window:
            out["n_repeat_words"] = np.bincount(words.row[inside], minlength=rows).astype(np.int64)
        if n in limits.max_ngram_chars:
            out[f"dup_{n}gram_chars"] = np.bincount(words.row[inside], weights=chars[inside], minlength=rows).astype(np.int64)
    return out


def quality_rules(docs: DataFrame, limits: RuleLimits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``. One pass, no shuffle."""
    limits = limits or RuleLimits()
    grams = sorted(limits.max_ngram_chars)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in grams)]
    schema = f"{id_col} long, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part in tn.slices(batch.column(1)):
                m = _measure(part, limits)
                failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat_words * m["n_words"])
                good = ~failed & (100 * m["dup_line_chars"] <= limits.max_line_chars * m["word_chars"])
                good &= 100 * m["n_symbols"] <= limits.max_symbols * m["n_words"]
                for n in grams:
                    good &= 100 * m[f"dup_{n}gram_chars"] <= limits.max_ngram_chars[n] * m["word_chars"]
                arrays = [ids.slice(part.lo, len(part)), *(pa.array(m[c], pa.int64()) for c in longs), pa.array(failed), pa.array(good)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *longs, "base_failed", "kept"])

    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    return rows.mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _oracle(limits: RuleLimits) -> str:
    lengths = sorted({limits.repeat_window, *limits.max_ngram_chars})
    grams = "\nUNION ALL ".join(
        f"SELECT doc_id, {n} AS n, p AS i, array_to_string(ws[p:p + {n - 1}], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - {n - 2}, 1))) AS p) u WHERE len(ws) >= {n}" for n in lengths
    )
    counts = ", ".join(f"CAST(coalesce(sum(ch) FILTER (WHERE n = {n}), 0) AS BIGINT) AS dup_{n}gram_chars" for n in sorted(limits.max_ngram_chars))
    cols = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in sorted(limits.max_ngram_chars))
    good = " AND ".join(f"100 * dup_{n}gram_chars <= {m} * word_chars" for n, m in sorted(limits.max_ngram_chars.items()))
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
tok AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
g AS ({grams}),
rep AS MATERIALIZED (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS k FROM g) WHERE k >= 2),
cov AS (SELECT DISTINCT doc_id, n, i + o AS p FROM rep, LATERAL (SELECT unnest(range(n)) AS o) z),
dup AS (SELECT doc_id, CAST(coalesce(sum(1) FILTER (WHERE n = {limits.repeat_window}), 0) AS BIGINT) AS n_repeat_words, {counts}
        FROM (SELECT cov.doc_id, cov.n, length(tok.word) AS ch FROM cov JOIN tok USING (doc_id, p)) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM w),
again AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS BIGINT) AS dup_line_chars
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS r FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) WHERE r > 1 GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
m AS (SELECT base.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {cols}
      FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id)),
f AS (SELECT *, (n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_words} * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND 100 * dup_line_chars <= {limits.max_line_chars} * word_chars AND 100 * n_symbols <= {limits.max_symbols} * n_words AND {good}) AS kept FROM f
"""


ORACLE_SQL = _oracle(RuleLimits())
