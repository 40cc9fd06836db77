"""Near-duplicates, packing and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farelens.llm import near_dedup as N
from farelens.llm import packing as P
from farelens.llm import textnum as tn
from tests.llm.helpers import LOREM, odd_docs, rows

WHITE = "[^\x20\x09-\x0d]+"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(WHITE, (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(docs, k, percent):
    """Component by brute force for (row number, id, text) rows."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    members = {}
    for x in range(len(docs)):
        members.setdefault(top(x), []).append(x)
    return {x: min((docs[m][0] for m in members[top(x)] if docs[m][0] is not None), default=None) for x in range(len(docs))}, sets


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    out = []
    passage = rng.choices(words, k=25)
    for _ in range(n // 6):
        base = rng.choices(words, k=rng.choice([1, 3, 4, 8, 30, 60]))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5), (3, 4)])
def test_components_match_brute_force(spark, seed, k, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)  # many block pairs
    docs = list(enumerate(corpus(seed)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected, sets = groups(docs, k, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame, k).collect()}
    assert got == {x: (len(sets[x]), expected[x]) for x in expected}


def test_one_large_group_of_near_copies(spark):
    """Copies of one text with about a tenth of it changed: the hub is not the smallest id."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        docs.append(" ".join(copy))
    docs.append(" ".join(base))
    docs = list(enumerate(docs))
    expected, _ = groups(docs, 4, 80)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
    assert got == expected


def test_dedup_of_odd_rows(spark):
    docs = odd_docs(spark, [(40, LOREM * 3), (41, "ONE TWO"), (None, LOREM * 3)])
    given = [(r.doc_id, r.text) for r in docs.collect()]
    expected, sets = groups(given, 5, 80)
    want = Counter((i, len(sets[k]), i if not sets[k] else expected[k]) for k, (i, _) in enumerate(given))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()) == want
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) <= 1 and 1 in ids and 2 not in ids and 40 not in ids and {3, 4, 5} <= set(ids) and 41 not in ids
    assert rows(N.near_duplicates(docs.limit(0))) == [] and rows(N.keep_one(docs.limit(0))) == []


def test_two_texts_under_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in N.near_duplicates(docs, 4).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]


def test_sketch_estimates_the_similarity():
    rng = random.Random(5)
    common = [f"c{k}" for k in range(4000)]
    for share in (0.2, 0.5, 0.8):
        n = int(2000 * share / (1 - share / 2) / 2) if share < 1 else 1000
        a = common[:n] + [f"a{k}" for k in range(1000 - n // 2)]
        b = common[:n] + [f"b{k}" for k in range(1000 - n // 2)]
        rng.shuffle(a)
        part = next(tn.slices(pa.array([" ".join(a), " ".join(b)])))
        row, grams = N.shingle_sets(part, 1)
        regs = N.sketches(row, grams, 2)
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        got, _ = N.estimate(regs[0], regs[1], np.array(len(a)), np.array(len(b)))
        assert abs(float(got) - true) < 0.2


@pytest.mark.parametrize("shared,more", [(1, 0), (4, 1), (8, 2), (16, 4), (32, 8), (64, 16), (128, 32), (400, 100)])
def test_sets_at_the_bound_share_a_band_at_any_size(shared, more):
    pairs, found, twice = 2000, 0, 0
    rng = np.random.default_rng(shared)
    for _ in range(4):
        grams = rng.integers(0, 2**64, (pairs // 4, shared + more), np.uint64)
        left = rng.integers(0, more + 1, (pairs // 4, 1))  # how many of the shingles beside the shared ones the first set has
        place = np.arange(shared + more)
        has = np.stack([place < shared + left, (place < shared) | (place >= shared + left)])
        sets = [[g[h] for g, h in zip(grams, side, strict=True)] for side in has]
        regs = []
        for side in sets:
            row = np.repeat(np.arange(len(side)), [len(s) for s in side])
            regs.append(N.sketches(row, np.concatenate(side), len(side)))
        sizes = [np.array([len(s) for s in side]) for side in sets]
        bands = [r.view(np.uint64) for r in regs]
        same = ((bands[0] == bands[1]) & (bands[0] != N._EMPTY_BAND)).sum(axis=1)
        good = N.admitted(regs[0], regs[1], sizes[0], sizes[1], 80)
        found += int(((same >= 1) & good).sum())
        twice += int(((same >= 2) & good).sum())
    assert found == pairs
    assert shared + more < N.MANY_SHINGLES or twice == pairs


def test_intersections_are_exact():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(400), rng.randint(0, 120))), np.uint64) for _ in range(50)]
    sets += [sets[0]] * 30
    got = N.intersections(sets)
    for x in range(len(sets)):
        for y in range(len(sets)):
            if x != y:
                assert got[x, y] == len(np.intersect1d(sets[x], sets[y]))


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101)]
    got = {r.nid: r.label for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_components_take_few_rounds(spark, monkeypatch):
    """The path 0, n, n - 1, ..., 1, on which labels that only walk from neighbour to neighbour take n rounds."""
    written, plain = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: written.append(name) or plain(df, name))
    path = [0, *range(1024, 0, -1)]
    got = rows(N.components(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")))
    assert {label for _, label in got} == {0} and len(got) == 1025
    assert len(written) <= 12


def test_large_buckets_grow_in_proportion(spark, monkeypatch):
    """Sets of many shingles that share one band and nothing else are not laid against each other."""
    rng = np.random.default_rng(3)

    def compared(n):
        registers = rng.integers(0, 60_000, (n, N.BUCKETS)).astype(np.uint16)
        registers[:, : N.ROWS] = 7
        nodes = spark.createDataFrame([(k, 100, r.tobytes()) for k, r in enumerate(registers)], "nid long, n_shingles long, registers binary")
        placed = nodes.select(F.lit(0).alias("band"), F.lit(5).cast("long").alias("key"), F.lit(n).cast("long").alias("n"), "nid", F.col("nid").alias("component"))
        return N._compared(placed, nodes, 80).count()

    monkeypatch.setattr(N, "BLOCK", 16)
    assert compared(300) == compared(900) == 0


def test_large_buckets_of_small_sets_grow_in_proportion(spark, monkeypatch):
    """300, 900 and 2,700 sets of 20 shingles in one bucket: half of them have one shingle in common, and pairs at the bound are among them."""
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "LARGE", 4)
    rng = np.random.default_rng(4)

    def compared(n):
        made = [np.sort(rng.integers(1, 2**62, 20)) for _ in range(n)]
        for x in made[: n // 2]:
            x[0] = 5  # all of these share a band by it
        for k in range(0, 20, 2):
            made[k + 1] = np.sort(np.concatenate((made[k][2:], rng.integers(1, 2**62, 2))))  # 18 of 22 shared
        nodes = spark.createDataFrame([(k, 20, bytes(256)) for k in range(n)], "nid long, n_shingles long, registers binary")
        sets = spark.createDataFrame([(k, x.astype(np.int64).tobytes()) for k, x in enumerate(made)], "nid long, shingles binary")
        placed = nodes.select(F.lit(0).alias("band"), F.lit(5).cast("long").alias("key"), F.lit(n).cast("long").alias("n"), "nid", F.col("nid").alias("component"))
        got = N._compared(placed, nodes, 80, lambda wanted: wanted.join(sets, "nid")).collect()
        together = {}
        for r in got:
            together.setdefault((r.band, r.band2, r.key, r.i, r.j), set()).add(r.nid)
        assert all(any({k, k + 1} <= g for g in together.values()) for k in range(0, 20, 2))
        return len(got)

    sizes = [compared(n) for n in (300, 900, 2700)]
    assert sizes[2] <= 10 * sizes[0] and sizes[2] < 1000


def test_rare_shingles_are_shared_at_the_bound(spark):
    rng = random.Random(2)
    common, pairs = list(range(1000, 1040)), []
    for k in range(60):
        size = rng.randint(1, 79)
        x = rng.sample(common, min(size // 2, 40)) + [rng.randrange(10**6, 10**9) for _ in range(size - min(size // 2, 40))]
        gone = int(len(x) * 0.2 / 1.8)  # swapped for others: intersection over union stays at the bound or above
        pairs.append((set(x), set(x[gone:]) | {rng.randrange(10**6, 10**9) for _ in range(gone)}))
    sets = [s for p in pairs for s in p]
    frame = spark.createDataFrame([(k, np.array(sorted(s), np.int64).tobytes()) for k, s in enumerate(sets)], "nid long, shingles binary")
    rare = {}
    for r in N._rare_shingles(frame, 80).collect():
        rare.setdefault(r.nid, set()).add(r.shingle)
    for k, (x, y) in enumerate(pairs):
        if 100 * len(x & y) >= 80 * len(x | y):
            assert rare[2 * k] & rare[2 * k + 1]
    assert all(len(v) <= len(sets[k]) - math.ceil(0.8 * len(sets[k])) + 1 for k, v in rare.items())


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    """1,000 members of one component and 3 others: the component's blocks meet the others, not each other."""
    monkeypatch.setattr(N, "BLOCK", 100)
    rows_in = spark.range(1003).select(F.lit(0).alias("band"), F.lit(-1).alias("band2"), F.lit(5).cast("long").alias("key"), F.lit(True).alias("main"), F.col("id").alias("nid"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).cast("long").alias("component"))
    got = N._in_blocks(rows_in).collect()
    assert Counter(r.nid < 1000 for r in got) == {True: 1000, False: 3 * 11}
    together = {}
    for r in got:
        together.setdefault((r.i, r.j), set()).add(r.nid)
    assert all(any({a, b} <= g for g in together.values()) for a in range(1003) for b in range(1000, 1003))


@pytest.mark.parametrize("seed", [7, 8])
def test_hot_keys_chunks_and_second_bands_lose_nothing(spark, seed, monkeypatch):
    from farelens.llm import joins

    for module, name, value in ((N, "BLOCK", 4), (N, "LARGE", 4), (N, "MANY_SHINGLES", 20), (N, "CHUNK_BYTES", 900), (joins, "HOT_ROWS", 10), (joins, "HOT_KEYS", 40)):
        monkeypatch.setattr(module, name, value)
    docs = list(enumerate([*corpus(seed, 90), *[LOREM * 2] * 30, *[""] * 20]))
    expected, sets = groups(docs, 4, 80)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame, 4).collect()} == {x: (len(sets[x]), x if not sets[x] else expected[x]) for x in expected}
    assert {r.doc_id for r in N.keep_one(frame, 4).collect()} == {x for x in expected if not sets[x] or expected[x] == x}


def best_fit(sizes, sources, clusters, capacity):
    """Looks at every bin: the tightest room that fits, first by arrival at that room."""
    room, at, labels, clock, where = [], [], [], 0, []
    for s, x, c in zip(sizes, sources, clusters, strict=True):
        own = ({("s", x)} if x is not None else set()) | ({("c", c)} if c is not None else set())
        fits = [(room[b], at[b], b) for b in range(len(room)) if room[b] >= s and not own & labels[b]]
        if fits:
            b = min(fits)[2]
        else:
            b = len(room)
            room.append(capacity)
            at.append(0)
            labels.append(set())
        clock += 1
        room[b] -= s
        at[b] = clock
        labels[b] |= own
        where.append(b)
    return where


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_best_fit(seed):
    rng = random.Random(seed)
    n, cap = 300, 100
    sizes = sorted((rng.randint(1, cap) for _ in range(n)), reverse=True)
    sources = [rng.choice(["hot", "hot", "a", "b", "c", None]) for _ in range(n)]
    clusters = [rng.randint(0, 30) if rng.random() < 0.5 else 1000 + k for k in range(n)]
    assert P.pack_shard(sizes, sources, clusters, cap)[0] == best_fit(sizes, sources, clusters, cap)


def test_packing_of_odd_rows(spark):
    docs = odd_docs(spark, [(60 + k, "w " * (k * 37 % 90 + 1)) for k in range(60)])
    size = P.PackingSize(capacity=100, shard_pieces=200)
    got = P.pack(docs, size).collect()
    words = Counter()
    for r in docs.collect():
        words[r.doc_id] += len(re.findall(WHITE, r.text or ""))
    packed = Counter()
    for r in got:
        packed[r.doc_id] += r.n_words
    assert +packed == +words and {r.doc_id for r in got} == set(words)
    by = {}
    for r in got:
        if r.sequence is not None:
            by.setdefault(r.sequence, []).append(r)
    for bin_rows in by.values():
        spans = sorted((r.sequence_offset, r.sequence_offset + r.n_words) for r in bin_rows)
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(r.sequence is None for r in got) == sum(not re.search(WHITE, r.text or "") for r in docs.collect())
    assert rows(P.pack(docs.limit(0), size)) == []


def test_equal_rows_go_to_all_shards(spark):
    docs = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same few words").alias("text"), F.lit("s").alias("source"))
    shards = Counter(r.sequence.partition("-")[0] for r in P.pack(docs).collect())
    assert len(shards) == 5 and max(shards.values()) < 9000


def test_bins_hold_no_source_or_cluster_twice(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = P.pack(docs).where("sequence IS NOT NULL").join(docs.select("doc_id", "source", P.text_cluster(F.col("text")).alias("cluster")), "doc_id")
    for label in ("source", "cluster"):
        assert got.groupBy("sequence", label).count().where("count > 1").isEmpty()


def test_pipeline_stages_on_odd_rows(spark, folder, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    real = spark.read.parquet(f"{folder}/documents.parquet")
    odd = odd_docs(spark).select(*pipeline.COLUMNS).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = real.unionByName(odd)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/out{k}")
        now = spark.read.parquet(f"{sf}/out{k}")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    stages = [{r.doc_id for r in spark.read.parquet(f"{sf}/out{k}").collect()} for k in range(5)]
    assert not any(labels.get(i) == 0 for i in stages[0]) and sum(labels.get(i) == 1 for i in stages[0]) >= 0.98 * sum(v == 1 for v in labels.values())
    kept = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/out1").collect()]
    expected, _ = groups(kept, 5, 80)
    assert stages[2] == {i for k, (i, _) in enumerate(kept) if expected[k] == i}
    assert stages[3] == stages[2] and stages[4] == stages[3]


def test_run_is_the_stages_in_order(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "language_id", "near_dedup", "decontamination", "packing"]
    assert pipeline.ORACLE_SQL is None
    assert pipeline.run(spark, folder).where("sequence IS NOT NULL").count() > 0


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
