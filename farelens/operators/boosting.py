"""Gradient-boosted trees on counted features: leaf-wise growth, all folds in one pass over the rows.

Features are cut into bins at quantiles. Rows stand in blocks of arrays, dealt over the cluster; a round asks every
block for the gradient and curvature sums of the nodes that are to be split (per model, node, feature and bin), adds
them up in a tree of partial sums, and picks the splits. What reaches the driver are those sums - models x nodes x
features x bins, whatever the number of rows - and what goes back are the trees. The models of a cross-validation and the final
one grow side by side in the same rounds: model k leaves the rows of fold k out, the last one takes all rows.

A tree grows leaf by leaf, the leaf of most gain first, to ``leaves`` leaves. Since that order needs the gains of both
children of a split, a round evaluates all children that may be asked for, and the order is found among
evaluated nodes; a tree takes as many rounds as it is deep. Blocks are per-partition arrays and a fit of many riders is many short
passes over them, which is why they are kept as an RDD there and not planned as a query each time. A lost executor's blocks and
scores are made again from the table of binned rows and the trees. Where the rows of a fit are no more than one task holds (a
parameter), its rounds need no pass: each model grows in a task of its own.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions import stats as S
from farelens.functions.rand import hash_order


@dataclass(frozen=True)
class BoosterRules:
    trees: int = 100
    leaves: int = 15
    penalty: float = 1.0
    learning_rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 64
    least_leaf: int | None = None  # else a thirtieth of all rows, 5 at least
    least_curvature: float = 1e-3
    seed: int = 7
    block_rows: int = 10_000
    #: Rows of a part up to which a model grows in one task: under 20 bytes a row and model travel there, and its worker holds about 100.
    partition_rows: int = 2_500_000
    spread_rows: int = 100_000
    #: Scores are made anew from the bins after so many trees, so that no chain of steps grows with the trees.
    anew: int = 20


#: The fold that the final model leaves out: none.
ALL = -1


@dataclass
class Tree:
    """Nodes in order of birth: a parent stands before its children; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    below: list[int] = field(default_factory=lambda: [0])  # rows with a bin up to this go left
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, below: int, gain: float) -> int:
        """Makes two children (the right one follows the left one) and returns the left one's number."""
        first = len(self.feature)
        self.feature[node], self.below[node], self.left[node], self.gain[node] = feature, below, first, gain
        for part, start in ((self.feature, -1), (self.below, 0), (self.left, 0), (self.value, 0.0), (self.gain, 0.0)):
            part += [start, start]
        return first

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, below, left = np.array(self.feature), np.array(self.below), np.array(self.left)
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, left[at] + (x[rows, f] > below[at]), at)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(x)]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each hash and salt."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xBF58476D1CE4E5B9) % 2**64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def row_taken(h: np.ndarray, tree: int, rules: BoosterRules) -> np.ndarray:
    """The rows that a tree is grown on, by their hash."""
    return _mixed(h, rules.seed * 1_000_003 + tree) < rules.row_share


def tree_columns(n: int, tree: int, rules: BoosterRules) -> list[int]:
    """The columns a tree may split: those of smallest hash."""
    order = np.argsort(_mixed(np.arange(n), rules.seed * 7_000_003 + tree), kind="stable")
    return sorted(order[: max(1, int(n * rules.column_share + 0.5))].tolist())


def best_split(sums: np.ndarray, columns: list[int], least: int, rules: BoosterRules) -> tuple | None:
    """(gain, feature, bin) of the best split of a node, or None.

    ``sums`` holds gradient, curvature and rows by (column, bin). Gains are compared at nine significant digits, so that the order
    in which blocks were added changes nothing; ties go to the first column, then to the lowest bin.
    """
    total = sums[0].sum(axis=0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + rules.penalty)
    gain = score(left) + score(right) - score(total)
    fits = (np.rint(left[..., 2]) >= least) & (np.rint(right[..., 2]) >= least) & (left[..., 1] >= rules.least_curvature) & (right[..., 1] >= rules.least_curvature)
    gain = np.where(fits & (gain > 1e-9), gain, 0.0)
    top = gain.max(initial=0.0)
    if top <= 0:
        return None
    column, at = np.unravel_index(int(np.argmax(gain >= top * (1 - 1e-9))), gain.shape)
    return float(gain[column, at]), columns[int(column)], int(at)


class Growing:
    """One model's tree while it grows: all evaluated nodes, and the leaf-wise tree among them."""

    def __init__(self, part: int, fold: int, least: int, rules: BoosterRules):
        self.seen, self.gains, self.sums, self.frontier = Tree(), {}, {}, [0]
        self.part, self.fold, self.least, self.rules = part, fold, least, rules

    def take(self, sums: np.ndarray, columns: list[int]) -> None:
        """``sums`` of the frontier's nodes; their children are the next frontier."""
        following = []
        for node, mine in zip(self.frontier, sums, strict=True):
            self.sums[node] = mine[0].sum(axis=0)
            split = best_split(mine, columns, self.least, self.rules)
            self.gains[node] = 0.0 if split is None else split[0]
            if split is not None:
                first = self.seen.split(node, split[1], split[2], split[0])
                following += [first, first + 1]
        self.frontier = following
        if self.grown() is not None:
            self.frontier = []

    def grown(self) -> Tree | None:
        """The leaf-wise tree, or None while a leaf that might be split next was not evaluated yet."""
        tree, leaves = Tree(), [(-self.gains.get(0, 0.0), 0, 0)]  # (-gain, node among the evaluated, node of the tree)
        count = 1
        if 0 not in self.gains:
            return None
        while count < self.rules.leaves and leaves:
            negative, node, mine = heapq.heappop(leaves)
            if negative == 0:
                break
            first, old = tree.split(mine, self.seen.feature[node], self.seen.below[node], self.gains[node]), self.seen.left[node]
            count += 1
            for k in (0, 1):
                if old + k not in self.gains:
                    if count < self.rules.leaves:
                        return None
                else:
                    heapq.heappush(leaves, (-self.gains[old + k], old + k, first + k))
        return self._valued(tree)

    def _valued(self, tree: Tree) -> Tree | None:
        places = {0: 0}
        for mine in range(len(tree.feature)):
            node = places[mine]
            if tree.feature[mine] >= 0:
                places |= {tree.left[mine] + k: self.seen.left[node] + k for k in (0, 1)}
            elif node not in self.sums:
                return None  # the last leaves' sums are still to come
            else:
                g, h, _ = self.sums[node]
                tree.value[mine] = -self.rules.learning_rate * g / (h + self.rules.penalty)
        return tree


def binned(rows: DataFrame, columns: list[str], rules: BoosterRules, *kept: str) -> DataFrame:
    """``kept`` and ``x``, the bins of all columns; a bin's upper bound belongs to it. Nulls count as zero."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    probs = [k / rules.bins for k in range(1, rules.bins)]
    cuts = rows.agg(*(F.array_sort(F.array_distinct(F.percentile_approx(value(c), probs, 100 * rules.bins))).alias(c) for c in columns))
    placed = rows.withColumn("_cuts", cuts.select(F.struct(*columns)).scalar())
    return placed.select(*kept, F.array(*(S.below(F.coalesce(F.col(f"_cuts.{c}"), F.array().cast("array<double>")), value(c)).cast("short") for c in columns)).alias("x"))


def with_folds(rows: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """Adds ``fold``: the rows of a part are numbered by a hash of their key, range by range, and dealt in turn, so folds differ by one row at most."""
    placed = S.numbered(rows.withColumn("_order", hash_order(f"{seed}:fold", key)), ["part"], "_order", (key,), "_number")
    return placed.select(*rows.columns, ((F.col("_number") - 1) % max(folds, 1)).cast("int").alias("fold"))


def _blocks(table: DataFrame, n_columns: int, rules: BoosterRules) -> DataFrame:
    """The table's rows as arrays in bytes (part, x, label, fold, h); a block has rows of one part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(_bin_type(rules)).reshape(-1, n_columns)
            label, fold, h, part = (batch.column(k).to_numpy(zero_copy_only=False).astype(kind) for k, kind in ((1, np.int8), (2, np.int16), (3, np.uint32), (4, np.int64)))
            for one in np.unique(part):
                mine = np.flatnonzero(part == one)
                for lo in range(0, len(mine), rules.block_rows):
                    at = mine[lo : lo + rules.block_rows]
                    yield pa.RecordBatch.from_arrays([pa.array([int(one)], pa.int64()), *(pa.array([a[at].tobytes()], pa.binary()) for a in (x, label, fold, h))], names=["part", "x", "label", "fold", "h"])

    rows = table.select("x", F.col("label").cast("double"), *(F.col(c).cast("long") for c in ("fold", "h", "part")))
    return rows.mapInArrow(pack, "part long, x binary, label binary, fold binary, h binary")


def _bin_type(rules: BoosterRules) -> type:
    return np.uint8 if rules.bins <= 256 else np.int16


def _unpacked(part: int, x: bytes, label: bytes, fold: bytes, h: bytes, n_columns: int, rules: BoosterRules) -> tuple:
    return part, np.frombuffer(x, _bin_type(rules)).reshape(-1, n_columns), np.frombuffer(label, np.int8), np.frombuffer(fold, np.int16), np.frombuffer(h, np.uint32)


def _asked(states, growing: list[Growing], tree: int, columns: list[int], rules: BoosterRules) -> Iterator:
    """A partition's sums: for every model an array (node, column, bin, 3) of its frontier."""
    bins = rules.bins
    out = [np.zeros((len(g.frontier), len(columns), bins, 3)) for g in growing]
    for (part, x, label, fold, h), scores in states:
        drawn = row_taken(h, tree, rules)
        for m, g in enumerate(growing):
            if g.part != part or not g.frontier:
                continue
            place = np.full(len(g.seen.feature), -1, dtype=np.int64)
            place[g.frontier] = np.arange(len(g.frontier))
            node = place[g.seen.nodes_of(x)]
            rows = np.flatnonzero(drawn & (fold != g.fold) & (node >= 0))
            p = 1.0 / (1.0 + np.exp(-scores[m][rows]))
            sums = (p - label[rows], p * (1.0 - p), None)
            for c, column in enumerate(columns):
                key = node[rows] * bins + x[rows, column]
                for k, weight in enumerate(sums):
                    out[m][:, c, :, k] += np.bincount(key, weights=weight, minlength=len(g.frontier) * bins).reshape(-1, bins)
    return iter([out])


@dataclass
class Model:
    """Trees for the rows of a part; the rows of ``fold`` were left out (ALL: none)."""

    part: int
    fold: int
    start: float
    least_leaf: int = 5
    trees: list[Tree] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.scores(x) for t in self.trees), np.zeros(len(x)))


class _Here:
    """One model's blocks in its task, with its scores.

    What a tree is grown on - drawn rows, their gradients and curvatures, bins column by column - is taken once a tree, and a row's
    node is moved on from round to round. Sums are the same, and in the same order, as ``_asked`` makes them.
    """

    def __init__(self, blocks: list[tuple], models: list[Model]):
        (model,) = models
        self.blocks = []
        for _, x, label, fold, h in blocks:
            seen = np.flatnonzero(fold != model.fold)  # no other row is of use to the model
            self.blocks.append((x[seen], label[seen].astype(np.float64), h[seen]))
        self.scores = [model.scores(x) for x, _, _ in self.blocks]
        self.tree, self.grown = -1, []

    def _begin(self, tree: int, columns: list[int], rules: BoosterRules) -> None:
        self.tree, self.grown = tree, []
        for (x, label, h), scores in zip(self.blocks, self.scores, strict=True):
            rows = np.flatnonzero(row_taken(h, tree, rules))
            p = 1.0 / (1.0 + np.exp(-scores[rows]))
            taken = x[rows]
            self.grown.append([taken, [np.ascontiguousarray(taken[:, c]) for c in columns], p - label[rows], p * (1.0 - p), np.zeros(len(rows), dtype=np.int64)])

    def sums(self, growing: list[Growing], tree: int, columns: list[int], rules: BoosterRules) -> list[np.ndarray]:
        (g,) = growing
        if tree != self.tree:
            self._begin(tree, columns, rules)
        bins, seen = rules.bins, g.seen
        out = np.zeros((len(g.frontier), len(columns), bins, 3))
        feature, below, left = np.array(seen.feature), np.array(seen.below), np.array(seen.left)
        place = np.full(len(feature), -1, dtype=np.int64)
        place[g.frontier] = np.arange(len(g.frontier))
        for k, (x, by, slope, curve, node) in enumerate(self.grown):
            split = feature[node]
            still = (split >= 0) | (place[node] >= 0)
            if not still.all():  # rows in leaves that will not be split are done with
                x, by, slope, curve, node, split = x[still], [c[still] for c in by], slope[still], curve[still], node[still], split[still]
            node = np.where(split >= 0, left[node] + (x[np.arange(len(x)), split] > below[node]), node)
            self.grown[k] = [x, by, slope, curve, node]
            key = place[node] * bins
            for c, column in enumerate(by):
                cell = key + column
                for j, weight in enumerate((slope, curve, None)):
                    out[:, c, :, j] += np.bincount(cell, weights=weight, minlength=len(g.frontier) * bins).reshape(-1, bins)
        return [out]

    def add(self, last: list[Tree], models: list[Model]) -> None:
        self.scores = [s + last[0].scores(x) for (x, _, _), s in zip(self.blocks, self.scores, strict=True)]


class _Spread:
    """Blocks over the cluster, with the models' scores: each round is a pass that adds sums up in a tree."""

    def __init__(self, blocks, models: list[Model], rules: BoosterRules):
        self.blocks, self.rules = blocks.persist(StorageLevel.MEMORY_AND_DISK), rules
        self.old, self.state = None, self._anew(models)

    def _anew(self, models: list[Model]):
        given = [Model(m.part, m.fold, m.start, m.least_leaf, list(m.trees)) for m in models]
        return self.blocks.map(lambda b: _scored(b, given)).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, growing: list[Growing], tree: int, columns: list[int], rules: BoosterRules) -> list[np.ndarray]:
        return self.state.mapPartitions(lambda states: _asked(states, growing, tree, columns, rules)).treeReduce(lambda a, b: [p + q for p, q in zip(a, b, strict=True)])

    def add(self, last: list[Tree], models: list[Model]) -> None:
        if self.old is not None:
            self.old.unpersist()
        self.old = self.state
        again = len(models[0].trees) % self.rules.anew == 0
        self.state = self._anew(models) if again else self.state.map(lambda s: _added(s, last)).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        for kept in (self.old, self.state, self.blocks):
            if kept is not None:
                kept.unpersist()


def _scored(block: tuple, models: list[Model]) -> tuple:
    return block, [m.scores(block[1]) if m.part == block[0] else None for m in models]


def _added(state: tuple, last: list[Tree]) -> tuple:
    return state[0], [None if s is None else s + t.scores(state[0][1]) for s, t in zip(state[1], last, strict=True)]


def _grow(place: _Here | _Spread, models: list[Model], n_columns: int, rules: BoosterRules) -> None:
    """Adds all trees to all models, side by side, on what ``place`` sums up."""
    for number in range(rules.trees):
        columns, growing = tree_columns(n_columns, number, rules), [Growing(m.part, m.fold, m.least_leaf, rules) for m in models]
        while any(g.frontier for g in growing):
            for g, sums in zip(growing, place.sums(growing, number, columns, rules), strict=True):
                if g.frontier:
                    g.take(sums, columns)
        last = [g.grown() for g in growing]
        for model, tree in zip(models, last, strict=True):
            model.trees.append(tree)
        place.add(last, models)


def fit(table: DataFrame, n_columns: int, folds: int, rules: BoosterRules, final: bool = True) -> list[Model]:
    """For every part a model per fold and, if ``final``, one of all its rows.

    ``table`` is at rest and has x (bins), label (0 or 1), fold, h (a hash of the row) and part; models of different
    parts share nothing. A part of at most ``partition_rows`` rows is what one task holds anyway: each of its models grows in a task of
    its own, all at once. The models of larger parts grow in passes over all their blocks. Both run ``_grow`` and give the same trees.
    """
    counted = table.groupBy("part", "fold", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()  # two rows a fold and part
    counts = {(r["part"], r["fold"], r["label"]): r["n"] for r in counted}
    few, many = [], []
    for part in sorted({p for p, _, _ in counts}):
        mine = {(f, y): n for (p, f, y), n in counts.items() if p == part}
        rows = sum(mine.values())
        for m in [*range(folds), *([ALL] if final else [])]:
            ones, zeros = (sum(n for (f, y), n in mine.items() if f != m and y == label) for label in (1, 0))
            model = Model(part, m, math.log(ones / zeros) if ones and zeros else 0.0, rules.least_leaf or max(5, rows // 30))
            (few if rows <= rules.partition_rows else many).append(model)
    parts = lambda models: F.col("part").isin([*{m.part for m in models}])
    if few:
        few = _fitted_apart(_blocks(table.where(parts(few)), n_columns, rules), few, n_columns, rules)
    if many:
        rows = sum(n for (p, _, _), n in counts.items() if any(m.part == p for m in many))
        packed = _blocks(table.where(parts(many)).coalesce(max(1, math.ceil(rows / rules.spread_rows))), n_columns, rules)
        spread = _Spread(packed.rdd.map(lambda r: _unpacked(*r, n_columns, rules)), many, rules)
        _grow(spread, many, n_columns, rules)
        spread.close()
    return few + many


def _fitted_apart(blocks: DataFrame, models: list[Model], n_columns: int, rules: BoosterRules) -> list[Model]:
    """Each model in a task of its own, over the few blocks of its part."""
    by = {(m.part, m.fold): m for m in models}

    def grown(key: tuple, held: pa.Table) -> pa.Table:
        model = by[key[0].as_py(), key[1].as_py()]
        here = _Here([_unpacked(*r.values(), n_columns, rules) for r in held.select(["part", "x", "label", "fold", "h"]).to_pylist()], [model])
        _grow(here, [model], n_columns, rules)
        return pa.table({"model": [pickle.dumps(model)]})

    folds = F.explode(F.array(*(F.lit(f) for f in sorted({m.fold for m in models})))).alias("model_fold")
    wanted = blocks.select("*", folds).repartitionByRange(len(models), "part", "model_fold")  # as many tasks as models, of equal size
    return sorted((pickle.loads(bytes(r["model"])) for r in wanted.groupBy("part", "model_fold").applyInArrow(grown, "model binary").collect()), key=lambda m: (m.part, m.fold == ALL, m.fold))


def out_of_fold(table: DataFrame, models: list[Model], *kept: str) -> DataFrame:
    """``kept`` and the score of every row by the model of its part that did not see its fold. One pass, no shuffle."""
    schema = table.select(*kept).schema.add("score", "double")
    by = {(m.part, m.fold): m for m in models}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            which = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1)
            score = np.zeros(batch.num_rows)
            for part, fold in np.unique(which, axis=0):
                mine = (which == (part, fold)).all(axis=1)
                score[mine] = by[int(part), int(fold)].scores(x[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(1.0 / (1.0 + np.exp(-score)))], names=[*kept, "score"])

    return table.select("x", "part", "fold", *kept).mapInArrow(run, schema)


def gains(model: Model, columns: list[str]) -> dict[str, float]:
    """What each column's splits have gained."""
    out = dict.fromkeys(columns, 0.0)
    for tree in model.trees:
        for f, g in zip(tree.feature, tree.gain, strict=True):
            if f >= 0:
                out[columns[f]] += g
    return out
