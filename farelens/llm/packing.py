"""Conflict-constrained best-fit packing of documents into fixed-size training sequences (operator 1).

A document's length is its number of words ``[^\\x20\\x09-\\x0D]+``. A document longer than a sequence is
cut into pieces of ``capacity`` words and a rest. Pieces are dealt into shards by hash; a shard's pieces,
longest first, each go into the open bin that leaves the least room and fits: bins are ordered by
residual room and carry bitmaps of their sources and duplicate clusters, and a piece never joins a bin
that holds its source or its cluster already. The search starts at the smallest sufficient residual and
goes on through successors until a compatible bin is found; a new bin opens only if there is none.

A residual whose every bin holds a source (or cluster) is marked as closed for it, so the search steps
over whole residuals; the result is that of looking at each bin of the shard in turn. Shards hold about
``shard_pieces`` pieces whatever the table's size. A piece's shard is a hash of its row's place in the counted
table, so equal rows, a source or a cluster with a third of all rows are spread over all shards.

Defined results: a document without words (or null) has no piece and comes back once with a null bin; a
null source or cluster conflicts with nothing; rows that repeat are pieces of their own and conflict as
one cluster; pieces of equal length are taken in order of document, piece, source and cluster, and of bins with
equal room the one that came to it first; a text of any length is cut whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm import textnum as tn
from farelens.sources.staging import materialize
from farelens.llm.tables import table


@dataclass(frozen=True)
class PackingSize:
    capacity: int = 2048
    shard_pieces: int = 8192


class Bins:
    """Open bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room: list[int] = []  # of each bin
        self.mask: list[int] = []  # of each bin: sources and clusters as bits
        self.at: dict[int, dict[int, None]] = {}  # residual -> its bins in order of arrival
        self.common: dict[int, int] = {}  # residual -> bits that all its bins have
        self.filled = 0  # bit r: some bin has residual r
        self.closed: dict[int, int] = {}  # label's bit number -> residuals all of whose bins have it

    def _bits(self, mask: int) -> Iterator[int]:
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def _recount(self, room: int) -> None:
        bins, old = self.at.get(room), self.common.get(room, 0)
        new = 0
        if bins:
            new = -1
            for b in bins:
                new &= self.mask[b]
                if not new:
                    break
        for bit in self._bits(old & ~new):
            self.closed[bit] &= ~(1 << room)
        for bit in self._bits(new & ~old):
            self.closed[bit] = self.closed.get(bit, 0) | 1 << room
        self.common[room] = new

    def _put(self, b: int, room: int) -> None:
        self.room[b] = room
        bins = self.at.setdefault(room, {})
        bins[b] = None
        self.filled |= 1 << room
        if len(bins) == 1:
            self._recount(room)
        else:  # one more bin can only take labels away from what all have
            for bit in self._bits(self.common[room] & ~self.mask[b]):
                self.closed[bit] &= ~(1 << room)
            self.common[room] &= self.mask[b]

    def _take(self, b: int) -> None:
        room = self.room[b]
        del self.at[room][b]
        if not self.at[room]:
            self.filled &= ~(1 << room)
        self._recount(room)

    def add(self, size: int, labels: tuple[int, ...]) -> tuple[int, int]:
        """Places a piece; returns its bin and its offset there."""
        own = 0
        for bit in labels:
            own |= 1 << bit
        open_rooms = self.filled
        for bit in labels:
            open_rooms &= ~self.closed.get(bit, 0)
        open_rooms = open_rooms >> size << size
        while open_rooms:
            room = (open_rooms & -open_rooms).bit_length() - 1  # the successor: least room that suffices
            for b in self.at[room]:
                if not self.mask[b] & own:
                    self._take(b)
                    self.mask[b] |= own
                    self._put(b, room - size)
                    return b, self.capacity - room
            open_rooms &= open_rooms - 1
        self.room.append(self.capacity)
        self.mask.append(own)
        self._put(len(self.room) - 1, self.capacity - size)
        return len(self.room) - 1, 0


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; pieces are taken in the given order."""
    bit_of: dict = {}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    bins, where, offset = Bins(capacity), [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        labels = []
        if source is not None:
            labels.append(bit_of.setdefault(("source", source), len(bit_of)))
        if cluster is not None and seen[cluster] > 1:  # a cluster met once can conflict with nothing
            labels.append(bit_of.setdefault(("cluster", cluster), len(bit_of)))
        b, o = bins.add(size, tuple(labels))
        where.append(b)
        offset.append(o)
    return where, offset


def text_cluster(text: Column) -> Column:
    """Documents equal but for case and white space are one duplicate cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text.cast("string")), r"[\x20\x09-\x0D]+", " ")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tn.slices(batch.column(3)):
            counts = pa.array(tn.Words(part).count)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(part.lo, len(part)) for k in range(3)), counts], names=["doc_id", "source", "cluster", "n_words"])


def pack(docs: DataFrame, size: PackingSize | None = None, cluster: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, begin, n_words, sequence, sequence_offset."""
    size = size or PackingSize()
    cap = size.capacity
    text = F.col("text").cast("string")
    label = text_cluster(text) if cluster is None else cluster.cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(text.isNotNull(), label).alias("cluster"), text.alias("text"))
    counted = rows.mapInArrow(_word_counts, "doc_id long, source string, cluster long, n_words long")
    counted = materialize(counted.withColumn("place", F.monotonically_increasing_id()), "packing-counts")
    n = counted.agg(F.coalesce(F.sum(F.ceil(F.col("n_words") / cap)), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-n // size.shard_pieces))
    pieces = counted.where("n_words > 0").select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1, F.lit(cap).cast("long"))).alias("piece", "begin"))
    pieces = pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), "begin", F.least(F.lit(cap), F.col("n_words") - F.col("begin")).alias("n_words"), "source", "cluster", F.pmod(F.xxhash64("place", "piece"), F.lit(shards)).alias("shard"))
    schema = "doc_id long, piece long, begin long, n_words long, sequence string, sequence_offset long"

    def close(shard: int, group: pa.Table) -> pa.RecordBatch:
        where, offset = pack_shard(*(group[c].to_pylist() for c in ("n_words", "source", "cluster")), cap)
        return pa.RecordBatch.from_arrays(
            [*(group[c].combine_chunks() for c in ("doc_id", "piece", "begin", "n_words")), pa.array([f"{shard}-{b}" for b in where], pa.string()), pa.array(offset, pa.int64())],
            names=["doc_id", "piece", "begin", "n_words", "sequence", "sequence_offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not len(batch):
                continue
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and now != shard[lo]:
                    yield close(now, pa.Table.from_batches(held))
                    held = []
                now = shard[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close(now, pa.Table.from_batches(held))

    ordered = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), F.asc_nulls_first("doc_id"), "piece", "source", "cluster")
    packed = ordered.select("shard", "doc_id", "piece", "begin", "n_words", "source", "cluster").mapInArrow(run, schema)
    blank = counted.where("n_words = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("begin"), "n_words", F.lit(None).cast("string").alias("sequence"), F.lit(None).cast("long").alias("sequence_offset"))
    return packed.unionByName(blank)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
