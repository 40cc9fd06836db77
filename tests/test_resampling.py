"""Booster, permutation matrix and counted draws against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.functions import rand
from farelens.operators import boosting, fidelity, screening

# ---- booster


def _plain_tree(rows, number, rules, least):
    """One leaf-wise tree by plain loops: (gradient, curvature) from scores, a list of nodes with their rows."""
    columns = boosting.tree_columns(len(rows[0]["x"]), number, rules)
    taken = boosting.row_taken(np.array([r["h"] for r in rows], dtype=np.int64), number, rules)
    mine = [r for r, t in zip(rows, taken, strict=True) if t]
    for r in mine:
        p = 1 / (1 + math.exp(-r["score"]))
        r["g"], r["c"] = p - r["label"], p * (1 - p)
    value = lambda part: sum(r["g"] for r in part) ** 2 / (sum(r["c"] for r in part) + rules.penalty)

    def best(part):
        found = []
        for k, f in enumerate(columns):
            for b in sorted({r["x"][f] for r in part})[:-1]:
                left, right = [r for r in part if r["x"][f] <= b], [r for r in part if r["x"][f] > b]
                if min(len(left), len(right)) >= least and min(sum(r["c"] for r in s) for s in (left, right)) >= rules.least_curvature:
                    found.append((value(left) + value(right) - value(part), -k, -b, f))
        top = max((x[0] for x in found), default=0)
        if top <= 1e-9:
            return None
        gain, _, b, f = max((x for x in found if x[0] >= top * (1 - 1e-9)), key=lambda x: x[1:3])
        return gain, f, -b

    leaves, splits = [(best(mine), mine, [])], []
    while len(leaves) < rules.leaves and any(x[0] for x in leaves):
        k = max((k for k, x in enumerate(leaves) if x[0]), key=lambda k: leaves[k][0][0])
        (gain, f, b), part, path = leaves.pop(k)
        splits.append((round(gain, 6), f, b))
        for side in (0, 1):
            rest = [r for r in part if (r["x"][f] > b) == bool(side)]
            leaves.append((best(rest), rest, [*path, (f, b, side)]))
    weight = [(path, -rules.learning_rate * sum(r["g"] for r in part) / (sum(r["c"] for r in part) + rules.penalty)) for _, part, path in leaves]
    for r in rows:
        r["score"] += next(w for path, w in weight if all((r["x"][f] > b) == bool(side) for f, b, side in path))
    return splits, sorted(round(w, 6) for _, w in weight)


def _learnable(spark, n=240, parts=1):
    rng = random.Random(5)
    rows = []
    for part in range(parts):
        for k in range(n):
            y = k % 2
            rows.append((part, f"{part}:{k}", float(y), rng.gauss(0.8 * y, 1), rng.random(), float(rng.randint(0, 5) + y), rng.gauss(0, 1) * (1 + y), None if k % 17 == 0 else 1.0))
    return spark.createDataFrame(rows, "part int, item string, label double, a double, b double, c double, d double, e double")


def _table(spark, rules, folds=3, **kw):
    from farelens.sources.staging import materialize

    rows = _learnable(spark, **kw)
    placed = boosting.with_folds(boosting.binned(rows, list("abcde"), rules, "item", "label", "part"), "item", folds, 1)
    return materialize(placed.withColumn("h", F.crc32(F.col("item").cast("binary"))), "told")


def test_trees_match_a_plain_booster_tree_by_tree(spark):
    rules = boosting.BoosterRules(trees=6, leaves=6, bins=16, seed=3)
    table = _table(spark, rules)
    held = [r.asDict() for r in table.collect()]
    models = boosting.fit(table, 5, 3, rules)
    assert [(m.part, m.fold) for m in models] == [(0, 0), (0, 1), (0, 2), (0, boosting.ALL)]
    for m in models:
        rows = [dict(r, score=m.start) for r in held if r["fold"] != m.fold]
        ones = sum(r["label"] for r in rows)
        assert m.start == pytest.approx(math.log(ones / (len(rows) - ones)))
        for number, tree in enumerate(m.trees):
            splits, values = _plain_tree(rows, number, rules, max(5, len(held) // 30))
            got = [(round(g, 6), f, b) for g, f, b in zip(tree.gain, tree.feature, tree.below, strict=True) if f >= 0]
            assert sorted(got) == sorted(splits) and sorted(round(v, 6) for v, f in zip(tree.value, tree.feature, strict=True) if f < 0) == values


def test_spread_rows_give_the_same_trees_as_one_task(spark):
    both = []
    for rows in (100_000, 60):
        rules = boosting.BoosterRules(trees=5, leaves=7, bins=16, partition_rows=rows, block_rows=25, anew=2)
        models = boosting.fit(_table(spark, rules, parts=2), 5, 3, rules)
        both.append([(m.part, m.fold, [(t.feature, t.below, np.round(t.value, 9).tolist()) for t in m.trees]) for m in models])
    assert both[0] == both[1] and len(both[0]) == 8


def test_folds_are_equal_and_scores_unseen(spark):
    rules = boosting.BoosterRules(trees=20)
    table = _table(spark, rules, folds=5, n=242)
    sizes = [r["count"] for r in table.groupBy("fold").count().collect()]
    assert sorted(sizes) == [48, 48, 48, 49, 49]
    scored = boosting.out_of_fold(table, boosting.fit(table, 5, 5, rules, final=False), "item", "label").collect()
    good = np.mean([[a.score > b.score for b in scored if b.label == 0] for a in scored if a.label == 1])
    assert 0.7 < good < 0.95 and len(scored) == 242


def test_a_side_without_riders_and_equal_features(spark):
    frame = lambda n: spark.createDataFrame([(k, 1.0) for k in range(n)], "rider_id long, a double")
    scores, gains = fidelity.discriminate(frame(20), frame(20), ["a"], folds=2, trees=3)
    assert len({round(r.score, 6) for r in scores.collect()}) <= 2 and gains.first().importance == 0.0  # one value a fold
    assert fidelity.discriminate(frame(6), frame(0), ["a"], folds=2, trees=2)[0].count() == 6
    assert fidelity.discriminate(frame(0), frame(0), ["a"], folds=2, trees=2)[0].count() == 0


def test_several_configurations_are_told_apart_each_for_itself(spark):
    rng = random.Random(4)
    frame = lambda mean: spark.createDataFrame([(k, rng.gauss(mean, 1), rng.random()) for k in range(80)], "rider_id long, a double, b double")
    told = {"near": (frame(0), frame(0.1)), "far": (frame(0), frame(3))}
    scores, gains = fidelity.discriminate_all(told, ["a", "b"], folds=4, trees=15)
    auc = {c: fidelity.auc_interval(scores.where(F.col("config") == c), 50, 1).first() for c in told}
    assert auc["far"].auc > 0.95 and auc["near"].auc < 0.8 and all(a.auc_ci_low <= a.auc <= a.auc_ci_high for a in auc.values())
    assert {(r.config, r.feature) for r in gains.where("rank = 1").collect()} >= {("far", "a")}
    alone = fidelity.discriminate(*told["far"], ["a", "b"], folds=4, trees=15)[0]
    assert sorted((r.item, r.score) for r in alone.collect()) == sorted((r.item, r.score) for r in scores.where("config = 'far'").drop("config").collect())


# ---- permutations


def _auc(real, sim):
    return sum((s > r) + (s == r) / 2 for s in sim for r in real) / (len(real) * len(sim))


def _plain_matrix(rows, permutations, seed):
    names = sorted({r[0] for r in rows})
    out = {}
    for a, b in itertools.combinations(names, 2):
        real = [r[3] for r in rows if r[0] == a and r[2]]
        pooled = [(f"{c}/{i}", c, s) for c, i, is_real, s in rows if c in (a, b) and not is_real]
        n_a = sum(c == a for _, c, _ in pooled)
        diff = lambda first, rest: round(abs(_auc(real, first) - _auc(real, rest)) * 1e9) / 1e9  # noqa: E731, B023
        observed = diff([s for _, c, s in pooled if c == a], [s for _, c, s in pooled if c == b])
        hits = 0
        for perm in range(1, permutations + 1):
            digits = lambda item: hashlib.md5(f"{seed}:perm:{perm // 4}:{item}".encode()).hexdigest()[8 * (perm % 4) : 8 * (perm % 4) + 8]  # noqa: E731, B023
            order = [s for _, _, s in sorted(pooled, key=lambda x: (digits(x[0]), x[0]))]
            hits += diff(order[:n_a], order[n_a:]) >= observed
        out[a, b] = (observed, (hits + 1) / (permutations + 1))
    return out


def test_matrix_of_seven_configurations_matches_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k, c in enumerate("abcdefg"):
        rows += [(c, str(i), real, round(rng.gauss(0.05 * k, 0.3), 1)) for real in (True, False) for i in range(9 + k)]  # one decimal: many ties
    got = fidelity.permutation_test(spark.createDataFrame(rows, "config string, item string, is_real boolean, score double"), 30, 5).collect()
    want = _plain_matrix(rows, 30, 5)
    assert len(got) == 21
    for r in got:
        assert (r.auc_difference, r.p_value) == pytest.approx(want[r.config_a, r.config_b]), (r.config_a, r.config_b)


def test_permutations_with_hashes_that_collide(spark, monkeypatch):
    """With three bits to select by, many items share the n-th hash, and names decide."""
    rng = random.Random(1)
    rows = [(c, str(i), real, rng.random()) for c in "xy" for real in (True, False) for i in range(12)]
    real_dealt = fidelity._dealt
    monkeypatch.setattr(fidelity, "_dealt", lambda *a: real_dealt(*a).withColumn("h", F.shiftright("h", 29)))
    got = fidelity.permutation_test(spark.createDataFrame(rows, "config string, item string, is_real boolean, score double"), 20, 5).first()
    real = [r[3] for r in rows if r[0] == "x" and r[2]]
    pooled = [(f"{c}/{i}", c, s) for c, i, is_real, s in rows if not is_real]
    diff = lambda first, rest: round(abs(_auc(real, first) - _auc(real, rest)) * 1e9) / 1e9
    observed, hits = diff([s for _, c, s in pooled if c == "x"], [s for _, c, s in pooled if c == "y"]), 0
    for perm in range(1, 21):
        key = lambda x: (int(hashlib.md5(f"5:perm:{perm // 4}:{x[0]}".encode()).hexdigest()[8 * (perm % 4) : 8 * (perm % 4) + 8], 16) >> 29, x[0])  # noqa: E731, B023
        order = [s for _, _, s in sorted(pooled, key=key)]
        hits += diff(order[:12], order[12:]) >= observed
    assert (got.auc_difference, got.p_value) == pytest.approx((observed, (hits + 1) / 21))


def test_permutations_of_one_configuration_or_none(spark):
    kind = "config string, item string, is_real boolean, score double"
    assert fidelity.permutation_test(spark.createDataFrame([("a", "1", True, 0.5)], kind), 5, 1).count() == 0
    assert fidelity.permutation_test(spark.createDataFrame([], kind), 5, 1).count() == 0
    got = fidelity.permutation_test(spark.createDataFrame([("a", "1", True, 0.5), ("a", "2", False, 0.5), ("b", "1", True, 0.5)], kind), 5, 1).collect()
    assert len(got) == 1 and got[0].auc_difference is None  # b has no simulated item


# ---- counted draws


def _poisson_count(m, u):
    term = total = math.exp(-m)
    k = 0
    while total < u and k < 10 * m + 100:
        k += 1
        term *= m / k
        total += term
    return k


def test_counts_are_the_inverse_of_their_distribution(spark):
    sizes = (1, 2, 7, 32, 33, 60, 200)
    cells = spark.createDataFrame([(m, m) for m in sizes], "cell long, m long")
    got = rand.cell_draws(cells, "m", 400, "t", "cell").collect()
    assert len(got) == 400 * len(sizes)
    off = 0
    for r in got:
        digits = hashlib.md5(f"t:{(r.replicate - 1) // 4}:{r.cell}".encode()).hexdigest()
        at = 8 * ((r.replicate - 1) % 4)
        want = _poisson_count(r.m, (int(digits[at : at + 8], 16) + 0.5) / 2**32)
        assert r.w == want or r.m > rand.LISTED and abs(r.w - want) <= 1
        off += r.w != want
    assert off <= 25  # beyond the listed sizes the expansion is a few hundredths of a row off


def test_counts_of_riders_that_count_once(spark):
    chance = screening.DRAWN_AT_ALL
    cells = spark.createDataFrame([(m, m) for m in (1, 5, 32, 5000)], "cell long, m long")
    got = rand.cell_draws(cells, "m", 800, "t", "cell", chance=chance).groupBy("m").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("v"), F.max("w").alias("most"), F.min("w").alias("least")).collect()
    for r in got:
        assert 0 <= r.least and r.most <= r.m and abs(r.mean - r.m * chance) < 5 * math.sqrt(r.m * chance * (1 - chance) / 800)
        assert r.v == pytest.approx(r.m * chance * (1 - chance), rel=0.25)


def test_normal_quantile(spark):
    from statistics import NormalDist

    probs = [1e-9, 1e-4, 0.02, 0.0243, 0.3, 0.5, 0.9, 0.98, 0.99999]
    got = spark.createDataFrame([(p,) for p in probs], "u double").select("u", rand.normal_quantile(F.col("u")).alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.u), abs=1e-6) for r in got)


def test_bootstrap_work_follows_cells_and_not_rows(spark):
    """Ten times the rows are the same cells, and the interval narrows as it should."""
    base = spark.createDataFrame([(1.0 + k % 40 / 20, int((k * 7919) % 100 < 90 - k % 40)) for k in range(4000)], "surge double, accepted long")
    wide = base.join(spark.range(10), how="cross")
    spread = [fidelity.elasticity_replicates(df, 200, 1).agg(F.stddev("slope")).first()[0] for df in (base, wide)]
    assert 2.2 < spread[0] / spread[1] < 4.5
    cells = [df.groupBy("surge", "accepted").count().count() for df in (base, wide)]
    assert cells[0] == cells[1]


# ---- bootstraps that draw every row


def _drawn(seed, key, replicate):
    """A row's own Poisson(1) count, by plain sums of its probabilities."""
    digest = hashlib.sha256(f"{seed}:{(replicate - 1) // 8}:{key}".encode()).hexdigest()
    at = 8 * ((replicate - 1) % 8)
    return _poisson_count(1, (int(digest[at : at + 8], 16) + 0.5) / 2**32)


def _slopes(rows, replicates, seed):
    edges = np.quantile([s for s, _, _ in rows], [k / 8 for k in range(9)])
    band = [max(1, min(8, int((edges < s).sum()))) for s, _, _ in rows]
    out = {}
    for rep in range(1, replicates + 1):
        sums = {}
        for b, (s, a, key) in zip(band, rows, strict=True):
            w = _drawn(f"{seed}:boot", key, rep)
            n, t, k = sums.get(b, (0, 0, 0))
            sums[b] = (n + w, t + w * s, k + w * a)
        points = [(math.log(t / n), math.log((k + 0.5) / (n + 1))) for n, t, k in sums.values() if n]
        out[rep] = np.polyfit(*zip(*points, strict=True), 1)[0]
    return out


def _decisions():
    """Few distinct decisions with many copies each, so that a draw of copies together would show."""
    return [(1.0 + k % 16 / 8, int((k * 7919) % 100 < 80 - 3 * (k % 16)), f"o{k}") for k in range(900)]


def test_elasticity_bootstrap_draws_every_decision(spark):
    rows = _decisions()
    trace = spark.createDataFrame(rows, "surge double, accepted long, offer_id string")
    got = {r.replicate: r.slope for r in fidelity.elasticity_replicates(trace, 20, 3).collect()}
    assert got == pytest.approx(_slopes(rows, 20, 3))


def test_elasticity_report_has_the_interval_of_drawn_decisions(spark):
    rows = _decisions()
    report = fidelity.elasticity_report(spark.createDataFrame(rows, "surge double, accepted long, offer_id string"), 20, 5).first()
    assert (report.ci_low, report.ci_high) == pytest.approx(tuple(np.quantile(list(_slopes(rows, 20, 5).values()), [0.025, 0.975])))


def test_rider_bootstrap_draws_every_rider_for_all_cells(spark):
    rng = random.Random(8)
    rows = [(c, k, m, float(rng.randint(0, 3)), None if k % 50 == 3 else 1.0) for k in range(150) for c in ("a", "b") for m in ("x", "y")]
    got = screening.rider_bootstrap(spark.createDataFrame(rows, "cell string, rider_id long, metric string, delta double, covariate double"), 30, 2).collect()
    assert len(got) == 4
    for r in got:
        mine = [(k, d) for c, k, m, d, v in rows if (c, m) == (r.cell, r.metric) and v is not None]
        counts = [[_drawn("2:riders", k, rep) for k, _ in mine] for rep in range(1, 31)]
        lifts = [np.average([d for _, d in mine], weights=w) for w in counts]
        assert (r.se_rider_boot, r.lo, r.hi) == pytest.approx((np.std(lifts), *np.quantile(lifts, [0.025, 0.975])))


@pytest.mark.parametrize("dedup", [False, True])
def test_backtest_draws_every_rider(spark, dedup):
    rng = random.Random(6)
    rows = [(k, s, int(rng.random() < q)) for k in range(80) for s, q in ((1.1, 0.8), (2.5, 0.4), (1.6, 0.5))]
    got = {r.replicate: r.log_ratio for r in screening.demand_replicates(spark.createDataFrame(rows, "rider_id long, surge double, accepted long"), 20, 4, dedup).collect()}
    for rep in range(1, 21):
        w = {k: min(_drawn("4:backtest", k, rep), 1 if dedup else 99) for k in range(80)}
        n = sum(w.values())
        high, low = (sum(w[k] * a for k, s, a in rows if s == at) for at in (2.5, 1.1))
        assert got[rep] == pytest.approx(math.log((high + 0.5) / (n + 1)) - math.log((low + 0.5) / (n + 1)))


def test_row_counts_have_no_cap(spark):
    assert len(rand.poisson_edges()) == 12 and (rand.poisson_edges()[:2] / 2**32 == pytest.approx([math.exp(-1), 2 * math.exp(-1)]))
    rows = spark.range(3000).select(F.col("id").alias("k"), F.array(F.struct(F.lit("g").alias("g"), F.lit(2).alias("v"))).alias("_e"))
    got = rand.replicate_sums(rows, 11, "t", "k", ("g",), ("v",)).collect()
    want = {rep: sum(_drawn("t", k, rep) for k in range(3000)) for rep in range(1, 12)}
    assert {r.replicate: r.n for r in got} == want and all(r.v == 2 * r.n for r in got)
    assert {r.replicate: r.n for r in rand.replicate_sums(rows, 11, "t", "k", ("g",), ("v",), once=True).collect()} == {rep: sum(min(1, _drawn("t", k, rep)) for k in range(3000)) for rep in range(1, 12)}
