"""Benchmark decontamination by FM-index (operator 7).

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ten
consecutive words of a benchmark item (a shorter item is one window). Each shard of documents is
indexed by itself: only words of the benchmark can be part of an occurrence, so the shard's text is the
runs of such words that are at least as long as the shortest window, with a separator between runs.
Over it a suffix array, its Burrows-Wheeler transform and a wavelet tree are built; windows are searched
backwards through the tree's ranks, all at once and sharing common suffixes, occurrences are located by
sampled suffix positions, and overlapping ones are merged into removal spans.

Defined results: a null text has no words, no hits and stays null; an item without words is skipped;
an item whose id is null counts for hits but is not listed; repeated rows get equal rows; a passage of several
items counts for all of them; a text of any length is searched whole, in its task's shard; with an empty
benchmark nothing is hit; an empty table gives an empty result; extra columns are ignored (``decontaminate`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm import textnum as tn
from farelens.sources.staging import materialize
from farelens.llm.tables import table

WINDOW = 10
#: The benchmark is searched in blocks of so many text bytes; one block is in the driver and broadcast at once.
BLOCK_BYTES = 1 << 20
#: Every so many text positions, a suffix position is kept.
SAMPLE = 8

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else (c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_SEPARATORS = np.array([c == 32 for c in _WORD_BYTES])


class WaveletTree:
    """Rank of a symbol in a prefix of a sequence, one bit level at a time (matrix layout)."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol[i]`` before position ``upto[i]``."""
        lo, hi = np.zeros_like(upto), upto
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions ``at``."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at + 1] - ones[at]
            out = out * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Over a sequence of integers from 1 up; 1 is the separator, 0 is appended as the end."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0).astype(np.int64)
        n, k = len(text), 1
        rank = text
        while True:  # prefix doubling: suffixes ranked by their first 2k symbols until all differ
            key = rank * (int(rank.max()) + 1) + np.concatenate((rank[k:], np.zeros(min(k, n), np.int64)))
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            k *= 2
            if rank[order[-1]] == n - 1:
                break
        self.size = n
        self.tree = WaveletTree(text[order - 1], max(1, int(text.max()).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        kept = order % SAMPLE == 0
        self.position, self.kept = order[kept], kept
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix range of ``symbol`` followed by what the range stands for."""
        first = self.before[symbol]
        return first + self.tree.rank(symbol, lo), first + self.tree.rank(symbol, hi)

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows of equal length): which occur, and their suffix ranges."""
        which = np.arange(len(rows))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.size)
        for k in range(rows.shape[1] - 1, -1, -1):
            symbol = rows[which, k]
            known = symbol < len(self.before) - 1  # a word that this shard lacks ends its searches
            which, symbol, lo, hi = which[known], symbol[known], lo[known], hi[known]
            lo, hi = self.extend(symbol, lo, hi)
            alive = hi > lo
            which, lo, hi = which[alive], lo[alive], hi[alive]
        return which, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one, fewer than SAMPLE steps."""
        out, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            done = self.kept[row]
            out[todo[done]] = self.position[self.kept_rank[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            symbol = self.tree.access(row)
            row = self.before[symbol] + self.tree.rank(symbol, row)
            steps += 1
        return out


class Phrases:
    """The windows of the benchmark as rows of word numbers, and the items that have each."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = (text or "").encode().translate(_WORD_BYTES).split()
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                owners = found.setdefault(tuple(ids[at : at + window]), set())
                if item is not None:
                    owners.add(str(item))
        keys, self.owners = list(found), list(found.values())
        self.shortest = min(map(len, keys), default=0)
        self.size = np.array([len(k) for k in keys], dtype=np.int64)
        self.groups = []
        for size in sorted(set(self.size.tolist())):
            at = np.flatnonzero(self.size == size)
            self.groups.append((at, np.array([keys[i] for i in at], dtype=np.int64)))

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``text``, window number) of every occurrence of every window."""
        starts, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(text):
            index = FMIndex(text)
            for at, rows in self.groups:
                which, lo, hi = index.search(rows)
                n = hi - lo
                row = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else lo
                starts.append(index.locate(row))
                owners.append(np.repeat(at[which], n))
        return np.concatenate(starts), np.concatenate(owners)


def _words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def search_shard(texts: list[bytes], phrases: Phrases) -> list[tuple[int, np.ndarray, set[str]]]:
    """For each text: its word count, the words inside an occurrence (numbers, ascending) and the items found."""
    pieces, places, at = [], [], 0
    counts = []
    for number, text in enumerate(texts):
        words = _words(text)
        counts.append(len(words))
        if not phrases.shortest or len(words) < phrases.shortest:
            continue
        ids = np.fromiter(map(phrases.vocab.get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids > 0, [False])).astype(np.int8)))
        for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= phrases.shortest]:
            pieces += [ids[a:b], np.ones(1, np.int64)]
            places.append((at, number, a))
            at += b - a + 1
    hits: list[list[np.ndarray]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if places:
        begin, number, first = np.array(places, dtype=np.int64).T
        starts, owners = phrases.occurrences(np.concatenate(pieces))
        run = np.searchsorted(begin, starts, side="right") - 1
        for s, w, r in zip(starts, owners, run, strict=True):
            a = first[r] + s - begin[r]
            hits[number[r]].append(np.arange(a, a + phrases.size[w]))
            items[number[r]] |= phrases.owners[w]
    return [(n, np.unique(np.concatenate(h)) if h else np.zeros(0, np.int64), i) for n, h, i in zip(counts, hits, items, strict=True)]


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans to remove: adjacent hit words merge into one span."""
    if not len(hit):
        return []
    data = np.frombuffer(text, np.uint8)
    words = tn.Words(tn.Slice(data, np.array([0, len(data)]), np.ones(1, bool), 0), _SEPARATORS)
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]
    return list(zip(words.start[first].tolist(), words.end[last].tolist(), strict=True))


_ROW, _HIT = "_passage_row", "_passage_hit"


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's items and the number of blocks; if there are several, as a table dealt by ``_block``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // BLOCK_BYTES))
    return (items, 1) if n == 1 else (materialize(items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("long")), "benchmark"), n)


def _collected(items: DataFrame) -> list[tuple[int | None, str | None]]:
    return [(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()]


def _hit_rows(docs: DataFrame, items: DataFrame, blocks: int, window: int, text_col: str) -> DataFrame:
    """``_ROW, _HIT, items`` of the rows that any block hits: their hit words and items over all blocks.

    A block's hits are written to the shared folder before the next block is read, so one block is held at a time.
    """
    given = docs.select(_ROW, F.col(text_col).cast("string").alias("text"))
    schema = given.select(_ROW, F.array().cast("array<long>").alias(_HIT), F.array().cast("array<string>").alias("items")).schema
    out = None
    for number in range(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(_collected(items.where(F.col("_block") == number)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value, window)
            for batch in batches:
                for part in tn.slices(batch.column(1)):
                    found = search_shard([part.text(k) for k in range(len(part))], phrases)
                    keep = [k for k, (_, hit, _) in enumerate(found) if len(hit)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(part.lo, len(part)).take(pa.array(keep, pa.int64())), pa.array([found[k][1] for k in keep], pa.list_(pa.int64())), pa.array([sorted(found[k][2]) for k in keep], pa.list_(pa.string()))], names=schema.names
                    )

        one = materialize(given.mapInArrow(run, schema), "hits")
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  as many lists as blocks at most
    return materialize(out.groupBy(_ROW).agg(merged(_HIT), merged("items")), "hits")


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, the items found (sorted strings) and the removal spans in code points.

    One pass over the documents for each block of the benchmark; with one block there is no shuffle.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    listed, blocks = _items(benchmark)
    if blocks == 1:
        had = given.withColumns({"hit": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
        sent = docs.sparkSession.sparkContext.broadcast(_collected(listed))
    else:
        given = materialize(given.withColumn(_ROW, F.monotonically_increasing_id()), "documents")
        had = given.join(_hit_rows(given, listed, blocks, window, "text"), _ROW, "left").select("doc_id", "text", F.col(_HIT).alias("hit"), "items")
        sent = None
    schema = had.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), "hit", "items", F.array().cast("array<struct<begin:long,end:long>>").alias("spans")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None if sent is None else Phrases(sent.value, window)
        for batch in batches:
            for part in tn.slices(batch.column(1)):
                old = batch.slice(part.lo, len(part))
                texts = [part.text(k) for k in range(len(part))]
                if phrases is None:
                    found = [(len(_words(t)), np.array(hit or (), np.int64), named or ()) for t, hit, named in zip(texts, old.column(2).to_pylist(), old.column(3).to_pylist(), strict=True)]
                else:
                    found = search_shard(texts, phrases)
                spans = [[{"begin": len(text[:a].decode()), "end": len(text[:b].decode())} for a, b in _spans(text, hit)] for (_, hit, _), text in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([old.column(0), old.column(1), pa.array([n for n, _, _ in found], pa.int64()), pa.array([h for _, h, _ in found], pa.list_(pa.int64())), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=schema.names)

    return had.mapInArrow(run, schema).select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with every benchmark passage cut out of their text; all columns stay.

    A cut brings words together that were apart, so a cut text is searched again, for the whole benchmark,
    until nothing is found. With several blocks, a round finds the hits of all of them, cuts their union once
    and writes the changed texts to the shared folder for the next round: blocks do not change the result.
    """
    listed, blocks = _items(benchmark)
    if blocks == 1:
        sent = docs.sparkSession.sparkContext.broadcast(_collected(listed))

        def until_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value, window)
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                for part in tn.slices(batch.column(at)):
                    texts = [part.text(k) for k in range(len(part))]
                    open_rows = list(range(len(texts)))
                    while open_rows:
                        found = search_shard([texts[k] for k in open_rows], phrases)
                        open_rows = [k for k, (_, hit, _) in zip(open_rows, found, strict=True) if _cut(texts, k, hit)]
                    yield _with_texts(batch.slice(part.lo, len(part)), part, texts, text_col, chars_col)

        return docs.mapInArrow(until_clean, docs.schema)

    columns = docs.columns
    if chars_col in columns:
        docs = docs.withColumn(chars_col, F.length(F.col(text_col).cast("string")).cast(docs.schema[chars_col].dataType))
    now, out = materialize(docs.withColumn(_ROW, F.monotonically_increasing_id()), "documents"), None

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in tn.slices(batch.column(at)):
                old = batch.slice(part.lo, len(part))
                texts = [part.text(k) for k in range(len(part))]
                for k, hit in enumerate(old.column(old.num_columns - 1).to_pylist()):
                    _cut(texts, k, np.array(hit, np.int64))
                yield _with_texts(old, part, texts, text_col, chars_col)

    while True:
        hits = _hit_rows(now, listed, blocks, window, text_col).select(_ROW, _HIT)
        clean = now.join(hits, _ROW, "left_anti").select(*columns)
        out = clean if out is None else out.unionByName(clean)
        if hits.isEmpty():
            return out
        found = now.join(hits, _ROW).select(*now.columns, _HIT)
        now = materialize(found.mapInArrow(once, found.schema).drop(_HIT), "cut")


def _with_texts(old: pa.RecordBatch, part: tn.Slice, texts: list[bytes], text_col: str, chars_col: str | None) -> pa.RecordBatch:
    new = [t.decode() if ok else None for t, ok in zip(texts, part.valid, strict=True)]
    columns, at = list(old.columns), old.schema.get_field_index(text_col)
    columns[at] = pa.array(new, old.schema.field(at).type)
    if chars_col in old.schema.names:
        c = old.schema.get_field_index(chars_col)
        columns[c] = pa.array([None if t is None else len(t) for t in new], old.schema.field(c).type)
    return pa.RecordBatch.from_arrays(columns, schema=old.schema)


def _cut(texts: list[bytes], k: int, hit: np.ndarray) -> bool:
    for a, b in reversed(_spans(texts[k], hit)):
        texts[k] = texts[k][:a] + texts[k][b:]
    return len(hit) > 0


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[p:p + least(len(ws), {WINDOW}) - 1], ' ') AS g
        FROM b, LATERAL (SELECT unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS p) u WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g FROM d, sizes, LATERAL (SELECT unnest(range(1, greatest(len(ws) - n + 2, 1))) AS p) u WHERE len(ws) >= n),
hit AS MATERIALIZED (SELECT doc_id, grams.n, p, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
w AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM hit, LATERAL (SELECT unnest(range(n)) AS o) z GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN i USING (doc_id)
"""
