"""Clusters of cells and the allocation of trips against brute force, with hot cells."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.functions import stats as S
from farelens.operators import panel


def _cells(spark, n=180, seed=1):
    rng = random.Random(seed)
    keys = sorted({(rng.randint(1, 12), rng.randint(0, 23), rng.randint(0, 1), rng.randint(0, 4)) for _ in range(n)})
    return spark.createDataFrame([(k, *c, 1 + k % 7) for k, c in enumerate(keys)], "cell_id long, pickup_zone long, pickup_hour long, is_weekend long, miles_bucket long, n long")


def _standard(cells):
    x = np.array([[r[c] for c in panel.CELL] for r in cells.orderBy("cell_id").collect()], float)
    return (x - x.mean(axis=0)) / x.std(axis=0)


def _inertia(x, cluster):
    return sum(((x[cluster == c] - x[cluster == c].mean(axis=0)) ** 2).sum() for c in np.unique(cluster))


def _plain_start(x, k, rng):
    """K-means by loops from uniformly drawn cells."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(100):
        cluster = np.array([min(range(k), key=lambda c: ((row - centres[c]) ** 2).sum()) for row in x])
        new = np.array([x[cluster == c].mean(axis=0) if (cluster == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return _inertia(x, cluster)


def test_the_best_start_is_no_worse_than_ten_plain_ones(spark):
    cells = _cells(spark)
    x, k = _standard(cells), 8
    got = np.array([r.cluster for r in panel.kmeans_clusters(cells, k, 3).orderBy("cell_id").collect()])
    plain = min(_plain_start(x, k, np.random.default_rng(s)) for s in range(10))
    assert len(np.unique(got)) == k and _inertia(x, got) <= plain * 1.001
    alone = [_inertia(x, np.array([r.cluster for r in panel.kmeans_clusters(cells, k, 3, starts=n).orderBy("cell_id").collect()])) for n in (1, 4)]
    assert _inertia(x, got) <= alone[1] + 1e-9 <= alone[0] + 1e-6
    assert panel.kmeans_clusters(cells, k, 3).collect() == panel.kmeans_clusters(cells.repartition(7), k, 3).collect()


def test_more_clusters_than_cells_and_equal_cells(spark):
    cells = spark.createDataFrame([(k, 1, 1, 0, 0, 1) for k in range(4)], "cell_id long, pickup_zone long, pickup_hour long, is_weekend long, miles_bucket long, n long")
    assert panel.kmeans_clusters(cells, 16, 1).count() == 4


def _order(seed, tk):
    return int(hashlib.md5(f"{seed}:{tk}".encode()).hexdigest()[:8], 16), tk


def _plain_allocation(trips, demand, cluster, seed):
    """Riders' demands laid end to end over each pool's trips in hash order: home cell, cluster, anywhere."""
    out, used, need = set(), set(), dict(demand)
    for step, key in (("home", lambda cell: cell), ("cluster", lambda cell: cluster[cell]), ("all", lambda cell: 0)):
        pools = {}
        for tk, cell in trips:
            if tk not in used:
                pools.setdefault(key(cell), []).append(tk)
        left = {}
        for pool in pools.values():
            pool.sort(key=lambda tk: _order(f"{seed}:{step}", tk))
        for (rider, cell), k in sorted(need.items()):
            mine = pools.get(key(cell), [])
            taken, pools[key(cell)] = mine[:k], mine[k:]
            out |= {(rider, tk, step) for tk in taken}
            used |= set(taken)
            left[rider, cell] = k - len(taken)
        need = {r: k for r, k in left.items() if k}
    return out


def test_allocation_with_clusters_and_a_hot_cell_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 8)
    cells = _cells(spark, 40)
    held = cells.collect()
    rng = random.Random(6)
    trips = [(f"t{k}", held[0] if k % 3 == 0 else rng.choice(held)) for k in range(700)]  # a third of all trips in one cell
    frame = spark.createDataFrame([(tk, *(c[x] for x in panel.CELL)) for tk, c in trips], "tk string, " + ", ".join(f"{c} long" for c in panel.CELL))
    draws = [(r, held[0].cell_id if r % 10 else rng.choice(held).cell_id, rng.randint(8, 20)) for r in range(40)]
    clusters = panel.kmeans_clusters(cells, 5, 2)
    got = panel.assign_riders(frame, spark.createDataFrame(draws, "rider_id long, cell_id long, k long"), cells, clusters, 7)
    want = _plain_allocation([(tk, c.cell_id) for tk, c in trips], {(r, c): k for r, c, k in draws}, {r.cell_id: r.cluster for r in clusters.collect()}, 7)
    assert {tuple(r) for r in got.collect()} == want and {s for _, _, s in want} == {"home", "cluster", "all"}


def test_numbers_inside_keys_are_dense_and_in_order(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("g"), F.pmod(F.xxhash64("id"), F.lit(2**32)).alias("h"), "id")
    got = S.numbered(rows, ["g"], "h", ("id",), "place").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.place, r.h, r.id))
    for mine in by.values():
        mine.sort()
        assert [p for p, _, _ in mine] == list(range(1, len(mine) + 1)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
    assert S.numbered(rows.limit(0), ["g"], "h", ("id",), "place").count() == 0 and pytest is not None
