"""Near-duplicate detection by HyperMinHash (operator 8).

A document's set is its distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` after A-Z are
lower-cased (a shorter text's whole sequence is its one shingle). Documents with 100 * intersection >=
``percent`` * union are linked; components of links are the groups.

1. One pass hashes each text's shingles and keeps a 128-bit digest of the set and a HyperMinHash sketch:
   in each of 128 buckets the smallest hash as its count of leading zeros and 10 mantissa bits.
2. Equal sets are one node from here on, so copies never meet each other.
3. Bands of 4 registers are hashed; in each band bucket every node is a candidate with the bucket's
   smallest node only (a star). Candidates pass the exact size bound and the collision-corrected
   Jaccard estimate of the sketches, and are then verified on their full sets. Links give components.
4. Buckets that still hold several components are compared in groups, across components only, by
   sketch. A bucket of up to 2 * BLOCK members is one group. A larger one is dealt to pairs of blocks, where blocks
   of one component never meet. In a bucket of more than LARGE blocks, members with MANY_SHINGLES or more meet only
   those that share a second band with them, and smaller sets those that share one of their rarest shingles, which no link
   lacks; what still is large after that is cut by set size first (sets whose sizes rule the bound out never meet), then into pairs of
   blocks. Members that the estimate admits to a partner stay; their full sets meet in the same groups, cut
   into chunks of CHUNK_BYTES, where intersections are counted exactly and a spanning forest of the links found is kept.
   So a group never gives more rows than it has members, and its memory has a bound.

Two sets at the bound share a band with probability 1 - (1 - 0.8 ** 4) ** 32 > 1 - 1e-7, two bands with
probability > 1 - 2e-6; the estimate's margin is five standard deviations.

Defined results: a null text or one without words has an empty set, is linked with nothing and is its
own component; a row whose id is null belongs to its group but never names it (a group of only such rows
has a null component); rows that repeat get equal rows (``keep_one`` keeps one of them); ties for the smallest
set id go to the smaller text hash; a text of any length is one row of its task, its set takes 8 bytes a
shingle; an empty table gives an empty result; extra columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm import textnum as tn
from farelens.llm.joins import join_unique
from farelens.sources.staging import discard, materialize
from farelens.llm.tables import table

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
ROWS = 4
BANDS = BUCKETS // ROWS
_EMPTY = np.uint16(0xFFFF)
_EMPTY_BAND = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Members of a large bucket that are compared with one block at a time.
BLOCK = 256
#: A bucket of more members than LARGE blocks is cut by a second band instead of into pairs of blocks.
LARGE = 16
#: Sets of so many shingles or more share two bands of their sketches if they meet the bound.
MANY_SHINGLES = 64
#: Bytes of full sets that are compared with one chunk at a time; a set is never split.
CHUNK_BYTES = 8 << 20
#: Nodes whose sets a task remembers to have made; the memory is emptied when full.
_MADE = 100_000


def shingle_sets(part: tn.Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, sorted by row and hash."""
    found = tn.Words(part, tn.WHITE, tn.LOWER[part.data])
    hashes = found.hashes()
    grams, at = tn.windows(hashes, found.row, words)
    row = found.row[at]
    short = np.flatnonzero((found.count > 0) & (found.count < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            more = found.count[short] > k
            whole[more] = whole[more] * np.uint64(0x9FB21C651E98DF25) + hashes[found.offset[short[more]] + k]
        grams = np.concatenate((grams, tn.mix64(whole ^ found.count[short].astype(np.uint64))))
        row = np.concatenate((row, short))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return row[fresh], grams[fresh]


def _by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[ends[1:]] - total[ends[:-1]]


def digests(row: np.ndarray, grams: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: set size, two 64-bit halves of an order-free digest, and where each row's shingles begin."""
    ends = np.searchsorted(row, np.arange(rows + 1))
    size = np.diff(ends).astype(np.uint64)
    halves = np.stack([tn.mix64(_by_row(tn.mix64(grams * np.uint64(c) + np.uint64(k)), ends) + size) for k, c in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25))], axis=1)
    return ends, size.astype(np.int64), halves


def sketches(row: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash registers, one line of BUCKETS per row."""
    spread = tn.mix64(grams ^ np.uint64(0x5851F42D4C957F2D))
    width = 64 - BUCKET_BITS
    least = np.full(rows * BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, row * BUCKETS + (spread & np.uint64(BUCKETS - 1)).astype(np.int64), spread >> np.uint64(BUCKET_BITS))
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    length = np.frexp(least.astype(np.float64))[1]  # bits of the value; leading zeros are the rest
    zeros = np.clip(width - length, 0, 62)
    mantissa = (least >> np.maximum(length - 1 - MANTISSA_BITS, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa
    return np.where(empty, _EMPTY, out.astype(np.uint16)).reshape(rows, BUCKETS).astype(np.uint16)


def features(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, node (digest of the set) and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch.column(2)):
                row, grams = shingle_sets(part, words)
                _, size, halves = digests(row, grams, len(part))
                registers = sketches(row, grams, len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, len(part)), batch.column(1).slice(part.lo, len(part)), pa.array(size), pa.array([h.tobytes() for h in halves], pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "node", "registers"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, node binary, registers binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _row_key(id_col: str) -> Column:
    """The id, or the least number for a null one: together with the text's hash it names a text."""
    return F.coalesce(F.col(id_col), F.lit(-(2**63)))


def _full_sets(docs: DataFrame, wanted: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``nid, shingles`` of the wanted nodes (nid, node, rep, text_key), made anew from one text of each.

    ``rows`` are the features of ``docs``; a row that repeats often is found there, so its copies are not
    moved to one task, and a task makes a node's set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[int] = set()
        for batch in batches:
            fresh = []
            for nid in batch.column(0).to_pylist():
                fresh.append(nid not in made)
                if len(made) >= _MADE:
                    made.clear()
                made.add(nid)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for part in tn.slices(batch.column(2)):
                row, grams = shingle_sets(part, words)
                ends, _, halves = digests(row, grams, len(part))
                nodes = batch.column(1).slice(part.lo, len(part)).to_pylist()
                same = pa.array([h.tobytes() == n for h, n in zip(halves, nodes, strict=True)])
                sets = pa.array([grams[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, len(part)), sets], names=["nid", "shingles"]).filter(same)

    keys = ["_id", "text_key"]
    given = _keyed(docs).select(_row_key("doc_id").alias("_id"), "text_key", "text")
    counts = rows.groupBy(_row_key("doc_id").alias("_id"), "text_key").agg(F.count("*").alias("n"))
    near = join_unique(given, wanted.select(_row_key("rep").alias("_id"), "text_key", "nid", "node"), keys, counts, rows.count())
    return near.select("nid", "node", "text").mapInArrow(run, "nid long, shingles binary").dropDuplicates(["nid"])


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of register lines, less the matches that chance explains, and the buckets it rests on."""
    used = (a != _EMPTY) | (b != _EMPTY)
    match = ((a == b) & (a != _EMPTY)).sum(axis=-1)
    union = np.maximum(used.sum(axis=-1), 1)
    ratio = size_a / np.maximum(size_b, 1)
    # expected number of equal registers of different values, by the sketch's published approximation
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    plain = match / union
    return np.clip((match - chance * (1 - plain)) / union, 0, 1), union


def admitted(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """False only where the sizes rule the bound out or the estimate is five deviations below it."""
    got, union = estimate(a, b, size_a, size_b)
    t = percent / 100
    sizes = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return sizes & (got >= t - 5 * np.sqrt(t * (1 - t) / union) - 1 / union)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that sizes and sketches admit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good = admitted(_registers(batch.column(2)), _registers(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    one = nodes.select(F.col("nid").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    two = nodes.select(F.col("nid").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    both = join_unique(pairs, one, ["a"]).join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rows: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Of pairs (a, b) those whose full sets meet the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    ids = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    sets = materialize(_full_sets(docs, ids.join(nodes, "nid").select("nid", "node", "rep", "text_key"), rows, words), f"{name}-sets")
    both = join_unique(pairs, sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), ["a"]).join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb")), "b")
    links = materialize(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), f"{name}-links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """``nid, label`` of every node with a link; the label is the smallest nid that it reaches.

    In a round every node hooks to its smallest neighbour if that is smaller, chains of hooks are cut by
    jumps to the end, and links are drawn between the ends that are left. A round leaves at most half of the
    nodes (only nodes smaller than all their neighbours stay), and jumps take the logarithm of a chain's length. What
    every step gives is written to the shared folder.
    """
    edges = materialize(_edges(links), "edges")
    labels = None
    while not edges.isEmpty():
        ends = _ends(edges.groupBy(F.col("high").alias("nid")).agg(F.min("low").alias("label")))
        left = materialize(_edges(_moved(_moved(edges, ends, "low"), ends, "high").select(F.col("low").alias("a"), F.col("high").alias("b"))), "edges")
        if labels is None:
            labels = ends
        else:
            new = materialize(_moved(labels, ends, "label").unionByName(ends), "labels")
            discard(labels, ends)
            labels = new
        discard(edges)
        edges = left
    if labels is None:
        return links.select(F.col("a").alias("nid"), F.col("b").alias("label")).limit(0)
    return labels.unionByName(labels.select(F.col("label").alias("nid"), "label").distinct())


def _edges(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def _moved(df: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    """``column`` goes to the end of its chain, if it hooks to one."""
    to = ends.select(F.col("nid").alias(column), F.col("label").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)


def _ends(hooks: DataFrame) -> DataFrame:
    """Hooks (nid to a smaller label) with every label moved to the end of its chain, four hooks in a step."""
    now = materialize(hooks, "labels")
    while True:
        twice = _moved(now, now, "label")
        new = materialize(_moved(twice, twice, "label"), "labels")
        moving = not new.join(new.select(F.col("nid").alias("label")), "label", "left_semi").isEmpty()
        discard(now)
        now = new
        if not moving:
            return now


def _by_group(columns: list[str], process):
    """Runs ``process`` on each group of rows that agree in the columns; rows must come grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and not np.array_equal(last, key[lo]):
                    yield from process(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key[lo]
            tn.release()
        if held:
            yield from process(pa.Table.from_batches(held))
        held = []
        tn.release()

    return run


def _grouped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.repartition(*columns).sortWithinPartitions(*columns)


#: A group: its band, a second band (or one of the marks below), its key, and two blocks.
_GROUP = ["band", "band2", "key", "i", "j"]
_WHOLE, _SMALL = -1, -2
_PLACE = "band int, band2 int, key long, i int, j int"


def _part(band: Column) -> Column:
    return F.substring(F.col("registers"), band * 2 * ROWS + 1, F.lit(2 * ROWS))


_NO_PART = bytes([255] * 2 * ROWS)


def _in_classes(rows: DataFrame, percent: int) -> DataFrame:
    """Members (band, band2, key, nid, component, n_shingles) of very large groups, grouped by set size.

    A class of sizes spans one factor of the bound, so partners are of one class or of neighbours: a class
    meets itself and the next one (``main`` marks the class itself).
    """
    step = float(np.log(100 / percent) * 1.000001) if percent < 100 else 1e-9
    size_class = F.floor(F.ln("n_shingles") / step).cast("long")
    both = rows.withColumn("_c", size_class).withColumn("_at", F.explode(F.array(F.col("_c") - 1, F.col("_c")))).withColumn("main", F.col("_c") == F.col("_at"))
    return both.select("band", "band2", F.xxhash64("key", "_at").alias("key"), "main", "nid", "component")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Members (band, band2, key, main, nid, component) of groups, dealt to pairs of blocks.

    A component of more than BLOCK members has blocks of its own, which never meet each other; all others
    share blocks.
    """
    keys = ["band", "band2", "key"]
    per = rows.groupBy(*keys, "component").agg(F.count("*").alias("n"), F.count_if("main").alias("mains"))
    blocks = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK).cast("int")).otherwise(0)
    per = per.withColumn("blocks", blocks).withColumn("before", F.sum("blocks").over(Window.partitionBy(*keys).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.collect_list(F.when(F.col("blocks") > 0, F.struct("component", F.struct(F.coalesce("before", F.lit(0)).cast("int").alias("at"), F.col("blocks").alias("size")))))
    plan = per.groupBy(*keys).agg(
        F.count("*").alias("_components"), F.sum("mains").alias("_mains"), F.sum("blocks").cast("int").alias("_large"), F.sum(F.when(F.col("blocks") == 0, F.col("n")).otherwise(0)).alias("_rest"), F.map_from_entries(own).alias("_own")
    )
    plan = plan.where("_components > 1 AND _mains > 0").select(*keys, "_large", (F.col("_large") + F.ceil(F.col("_rest") / BLOCK)).cast("int").alias("_all"), "_own")
    placed = join_unique(rows, plan, keys).withColumn("_o", F.try_element_at("_own", F.col("component"))).drop("_own")
    block = F.when(F.col("_o").isNotNull(), F.col("_o.at") + F.pmod(F.xxhash64("nid"), F.col("_o.size"))).otherwise(F.col("_large") + F.pmod(F.xxhash64("nid"), F.greatest(F.col("_all") - F.col("_large"), F.lit(1))))
    others = F.filter(F.sequence(F.lit(0), F.col("_all") - 1), lambda o: F.col("_o").isNull() | (o < F.col("_o.at")) | (o >= F.col("_o.at") + F.col("_o.size")))
    dealt = placed.withColumn("block", block.cast("int")).withColumn("_other", F.explode(others))
    return dealt.select(*keys, F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "main", "nid", "component")


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """nid, shingle: of every set (nid, shingles) its rarest shingles, as many as two sets at the bound cannot both lack.

    Ordered by how many of the sets hold a shingle, two sets of which each shares ``percent`` of its own shingles with the other have one in
    common among the first size - ceil(percent * size / 100) + 1 of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            if each:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in each]), pa.int64()), pa.array(np.concatenate(each), pa.int64())], names=["nid", "shingle"])

    each = materialize(sets.select("nid", "shingles").mapInArrow(run, "nid long, shingle long"), "dedup-shingles")
    counts = each.groupBy("shingle").agg(F.count("*").alias("n"))
    often = join_unique(each, counts.withColumnRenamed("n", "often"), ["shingle"], counts)
    # a set here has fewer than MANY_SHINGLES * 100 / percent shingles
    ordered = often.groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("_s"))
    wanted = F.size("_s") - F.ceil(F.size("_s") * percent / 100).cast("int") + 1
    return ordered.select("nid", F.explode(F.slice("_s", F.lit(1), wanted)).alias("_e")).select("nid", "_e.shingle")


def _compared(placed: DataFrame, nodes: DataFrame, percent: int, full_sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The groups in which members (band, key, n, nid, component) of open buckets are compared.

    ``full_sets`` gives the sets (nid, shingles) of some nodes; it is asked for small sets of very large buckets only.
    """
    whole = lambda df: df.select("band", "band2", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), F.lit(True).alias("main"), "nid", "component")
    every = placed.withColumns({"band2": F.lit(_WHOLE), "main": F.lit(True)})
    out = whole(every.where(F.col("n") <= 2 * BLOCK))
    out = out.unionByName(_in_blocks(every.where((F.col("n") > 2 * BLOCK) & (F.col("n") <= LARGE * BLOCK)).select("band", "band2", "key", "main", "nid", "component")))
    large = placed.where(F.col("n") > LARGE * BLOCK)
    if large.isEmpty():
        return out
    large = materialize(large.join(nodes.select("nid", "n_shingles"), "nid"), "dedup-large")

    def cut(second: DataFrame, name: str) -> DataFrame:
        """Groups of a second key: those of several components, whole or in pairs of blocks."""
        second = materialize(second, name)
        keys = ["band", "band2", "key"]
        counts = second.groupBy(*keys).agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        still = materialize(join_unique(second, counts.where("n > 1 AND low <> high").select(*keys, F.col("n").alias("members")), keys, counts.select(*keys, "n")), name)
        discard(second)
        return whole(still.where(F.col("members") <= 2 * BLOCK)).unionByName(_in_blocks(materialize(_in_classes(still.where(F.col("members") > 2 * BLOCK), percent), f"{name}-classes")))

    few = large.where(F.col("n_shingles") < MANY_SHINGLES * 100 / percent)
    if not few.isEmpty():
        sets = materialize(full_sets(few.select("nid").distinct()), "dedup-few-sets")
        rare = materialize(_rare_shingles(sets, percent), "dedup-rare")
        discard(sets)
        shared = few.join(rare, "nid").select("band", F.lit(_SMALL).alias("band2"), F.xxhash64("key", "shingle").alias("key"), "nid", "component", "n_shingles")
        out = out.unionByName(cut(shared, "dedup-few"))
    more = large.where(F.col("n_shingles") >= MANY_SHINGLES).join(nodes.select("nid", "registers"), "nid")
    later = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: (b > F.col("band")) & (_part(b) != F.lit(_NO_PART)))
    second = more.withColumn("_b", F.explode(later)).select("band", F.col("_b").cast("int").alias("band2"), F.xxhash64("key", "_b", _part(F.col("_b"))).alias("key"), "nid", "component", "n_shingles")
    return out.unionByName(cut(second, "dedup-second"))


def _active(members: DataFrame, percent: int) -> DataFrame:
    """Of each group the members that the sketches admit to a partner of another component, in chunks p and q.

    A pair counts in the first band that it shares (and the second, where the group has one), so it is
    looked at in full once. Chunks are cut by the bytes of full sets; two of them come together only if a
    pair is admitted between them.
    """

    def process(group: pa.Table) -> Iterator[pa.RecordBatch]:
        band, band2, i, j = (group[c][0].as_py() for c in ("band", "band2", "i", "j"))
        block, nid, comp, size, main = (group[c].to_numpy() for c in ("block", "nid", "component", "n_shingles", "main"))
        registers = _registers(group["registers"].combine_chunks())
        bands = registers.view(np.uint64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in left:
            others = right[(comp[right] != comp[x]) & (main[right] | main[x]) & ((nid[right] > nid[x]) if i == j else True)]
            if band2 == _SMALL:
                others = others[np.minimum(size[others], size[x]) < MANY_SHINGLES]
            if len(others):
                shared = (bands[others] == bands[x]) & (bands[x] != _EMPTY_BAND)
                here = shared.argmax(axis=1) == band
                if band2 >= 0:
                    shared[:, band] = False
                    here &= shared[:, band2] & (shared.argmax(axis=1) == band2)
                others = others[here]
                others = others[admitted(registers[others], registers[x], size[others], np.full(len(others), size[x]), percent)]
                first.append(np.full(len(others), x))
                second.append(others)
        one, two = np.concatenate(first), np.concatenate(second)
        active = np.unique(np.concatenate((one, two)))
        if not len(active):
            return
        order = active[np.argsort(size[active], kind="stable")]
        chunk = np.zeros(len(nid), np.int64)
        number = held = 0
        for x in order.tolist():
            if held and held + 8 * size[x] > CHUNK_BYTES:
                number, held = number + 1, 0
            held += 8 * size[x]
            chunk[x] = number
        low, high = np.minimum(chunk[one], chunk[two]), np.maximum(chunk[one], chunk[two])
        for p, q in np.unique(np.stack((low, high), axis=1), axis=0).tolist():
            here = (low == p) & (high == q)
            rows = np.unique(np.concatenate((one[here], two[here])))
            got = group.select([*_GROUP, "nid", "component"]).take(pa.array(rows)).combine_chunks()
            got = got.append_column("p", pa.array(np.full(len(rows), p, np.int32))).append_column("q", pa.array(np.full(len(rows), q, np.int32)))
            yield from got.select([*_GROUP, "p", "q", "nid", "component"]).to_batches()

    return _grouped(members, _GROUP).mapInArrow(_by_group(_GROUP, process), f"{_PLACE}, p int, q int, nid long, component long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of a block's sets: shared shingles in many sets by a matrix
    product, those in a few sets pair by pair."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if not m:
        return out
    grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    common = np.flatnonzero(count > 16)
    place = np.full(len(grams), -1)
    place[common] = np.arange(len(common))
    step = max(1, (1 << 21) // m)
    at = place[column]
    for lo in range(0, len(common), step):
        x = np.zeros((m, min(step, len(common) - lo)), np.float32)
        here = (at >= lo) & (at < lo + step)
        x[row[here], at[here] - lo] = 1
        out += (x @ x.T).astype(np.int64)  # at most 2 ** 21 columns, so float32 counts exactly
    few = (count[column] > 1) & (at < 0)
    order = np.argsort(column[few], kind="stable")
    row, column = row[few][order], column[few][order]
    for gap in range(1, 16):
        if gap >= len(row):
            break
        same = column[gap:] == column[:-gap]
        np.add.at(out, (row[:-gap][same], row[gap:][same]), 1)
        np.add.at(out, (row[gap:][same], row[:-gap][same]), 1)
    return out


def _exact(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside groups, on full sets; of each group a spanning forest."""

    def process(group: pa.Table) -> Iterator[pa.RecordBatch]:
        nid, comp = (group[c].to_numpy() for c in ("nid", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"].combine_chunks()]
        size = np.array([len(x) for x in sets])
        shared = intersections(sets)
        union = size[:, None] + size[None, :] - shared
        link = np.triu((100 * shared >= percent * union) & (comp[:, None] != comp[None, :]), 1)
        parent = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for x, y in zip(*np.nonzero(link), strict=True):
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q:
                parent[p] = q
                a.append(min(nid[x], nid[y]))
                b.append(max(nid[x], nid[y]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = [*_GROUP, "p", "q"]
    return _grouped(members, columns).mapInArrow(_by_group(columns, process), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, nid (its set), component_id."""
    spec = "dedup"
    rows = materialize(features(docs, words), f"{spec}-features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_key")).alias("m")
    nodes = rows.where("n_shingles > 0").groupBy("node", "n_shingles").agg(first, F.first("registers").alias("registers"))
    nodes = nodes.select("node", "n_shingles", "registers", F.col("m.doc_id").alias("rep"), F.col("m.text_key").alias("text_key"))
    # a node is named by its smallest document id; if two sets share that id, or it is null, by a hash
    clash = nodes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1 OR rep IS NULL").select(F.col("rep").alias("taken"))
    nodes = nodes.join(F.broadcast(clash) if clash.limit(1001).count() <= 1000 else clash, F.col("rep").eqNullSafe(F.col("taken")), "left")
    named = F.when(F.col("taken").isNull() & F.col("rep").isNotNull(), F.col("rep")).otherwise(F.xxhash64("node"))
    nodes = materialize(nodes.select(named.alias("nid"), "node", "n_shingles", "registers", "rep", "text_key"), f"{spec}-nodes")

    every = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: _part(b) != F.lit(_NO_PART))
    bands = nodes.withColumn("_b", F.explode(every)).select("nid", F.col("_b").cast("int").alias("band"), F.xxhash64("_b", _part(F.col("_b"))).alias("key"))
    buckets = materialize(bands.groupBy("band", "key").agg(F.min("nid").alias("lead"), F.count("*").alias("n")).where("n > 1"), f"{spec}-buckets")
    n_nodes = nodes.count()
    members = materialize(join_unique(bands, buckets, ["band", "key"], buckets, n_nodes * BANDS), f"{spec}-members")

    star = materialize(members.where("nid <> lead").select(F.col("lead").alias("a"), F.col("nid").alias("b")).distinct(), f"{spec}-star")
    admitted_star = materialize(_estimated(star, nodes, percent), f"{spec}-star")
    links = _verified(admitted_star, nodes, docs, rows, words, percent, f"{spec}-star")
    discard(star, admitted_star)
    found = components(links)

    placed = materialize(members.join(found, "nid", "left").select("band", "key", "n", "nid", F.coalesce("label", "nid").alias("component")), f"{spec}-placed")
    discard(members)
    open_buckets = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
    rest = materialize(join_unique(placed, open_buckets, ["band", "key"], buckets, n_nodes * BANDS), f"{spec}-open")
    discard(placed, buckets)
    if not rest.isEmpty():
        full = lambda wanted: _full_sets(docs, wanted.join(nodes, "nid").select("nid", "node", "rep", "text_key"), rows, words)
        compared = _compared(rest, nodes, percent, full).join(nodes.select("nid", "n_shingles", "registers"), "nid")
        active = materialize(_active(compared, percent), f"{spec}-active")
        if not active.isEmpty():
            wanted = active.select("nid").distinct().join(nodes, "nid").select("nid", "node", "rep", "text_key")
            sets = materialize(_full_sets(docs, wanted, rows, words), f"{spec}-sets")
            links = links.union(materialize(_exact(active.join(sets, "nid"), percent), f"{spec}-links"))
            discard(sets)
            found = components(links)
        discard(active)
    discard(rest)

    lowest = found.join(nodes.select("nid", "rep"), "nid").groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = found.join(lowest, "label").select("nid", "component_id", F.lit(True).alias("linked"))
    named = nodes.select("node", "nid", "rep").join(linked, "nid", "left").select("node", "nid", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    given = rows.select("doc_id", "text_key", "n_shingles", "node")
    # a set that a third of all rows have is a hot key, and empty sets have nothing to be joined with
    out = join_unique(given.where("n_shingles > 0"), materialize(named, f"{spec}-named"), ["node"]).select("doc_id", "text_key", "n_shingles", "nid", "component_id")
    return out.unionByName(given.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("nid"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    groups = materialize(near_duplicates(docs, words, percent), "dedup-groups")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own, text, n = _free_names(docs, 3)
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), text: F.xxhash64(F.col("text").cast("string"))})
    keep = kept.groupBy(_row_key("doc_id").alias(own), F.col("text_key").alias(text)).agg(F.count("*").alias("n"))
    keep = materialize(keep.withColumnRenamed("n", n), "dedup-keep")
    joined = join_unique(keyed, keep, [own, text], keep.select(own, text, F.col(n).alias("n")), groups.count())
    once = joined.where(F.col(n) == 1).select(*docs.columns)
    if keep.where(F.col(n) > 1).isEmpty():
        return once
    return once.unionByName(joined.where(F.col(n) > 1).dropDuplicates([own, text]).select(*docs.columns))


def _free_names(df: DataFrame, count: int) -> list[str]:
    """Column names that the frame does not use."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < count:
        if f"_dedup{k}" not in taken:
            out.append(f"_dedup{k}")
        k += 1
    return out


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
