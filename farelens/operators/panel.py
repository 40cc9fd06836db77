"""Panel construction: cells of similar trips, and trips dealt to synthetic riders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions import stats as S
from farelens.functions.rand import hash_order, hash_uniform
from farelens.sources.staging import materialize

CELL = ["pickup_zone", "pickup_hour", "is_weekend", "miles_bucket"]
MIN_TRIPS, MAX_TRIPS = 5, 40
DRAW_BUCKETS = 4096


def cells(trips: DataFrame) -> DataFrame:
    """Distinct cells with a dense id in sort order, volume and probability.

    Cells are counted first, so the ordered window runs over cells (zones x hours x 2 x 5 at most).
    """
    counted = trips.groupBy(*CELL).agg(F.count("*").alias("n"))
    order, whole = Window.orderBy(*CELL), Window.partitionBy()
    return counted.select((F.row_number().over(order) - 1).cast("long").alias("cell_id"), *CELL, "n", (F.col("n") / F.sum("n").over(whole)).alias("prob"))


def draw_cells(cell_table: DataFrame, spark, n_riders: int, seed: int, min_trips: int = MIN_TRIPS, max_trips: int = MAX_TRIPS) -> DataFrame:
    """Per rider a cell drawn by volume (inverse distribution function) and a number of trips."""
    w = Window.orderBy("cell_id")
    upper = cell_table.select("cell_id", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("hi")).withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
    # a cell stands in every bucket of [0, 1) that it reaches into, so a rider looks at the cells of one bucket
    place = lambda x: F.floor(F.col(x) * DRAW_BUCKETS).cast("int")
    bounds = upper.withColumn("bucket", F.explode(F.sequence(place("lo"), F.least(place("hi"), F.lit(DRAW_BUCKETS - 1)))))  # cells + DRAW_BUCKETS rows at most
    riders = spark.range(n_riders).select(F.col("id").alias("rider_id"), hash_uniform(f"{seed}:cell", F.col("id")).alias("u"), (F.lit(min_trips) + F.floor(hash_uniform(f"{seed}:k", F.col("id")) * (max_trips - min_trips + 1))).cast("long").alias("k"))
    return riders.withColumn("bucket", place("u")).join(bounds, "bucket").where("lo <= u AND u < hi").select("rider_id", "cell_id", "k")


def cluster_count(n_riders: int) -> int:
    """Clusters of cells for a panel: one for eight riders, 16 at least."""
    return max(16, n_riders // 8)


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres: each the best of a few cells drawn by their squared distance to the centres so far."""
    trials = 2 + int(np.log(k))
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, min(k, len(x))):
        total = near.sum()
        picks = np.searchsorted(np.cumsum(near), rng.random(trials) * total) if total > 0 else rng.integers(0, len(x), trials)
        picks = np.minimum(picks, len(x) - 1)
        after = np.minimum(near, ((x[None, :, :] - x[picks][:, None, :]) ** 2).sum(axis=2))
        best = int(after.sum(axis=1).argmin())
        centres.append(x[picks[best]])
        near = after[best]
    return np.array(centres)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 300, tolerance: float = 1e-4) -> tuple[float, np.ndarray]:
    """(inertia, cluster of each row) of one start. An empty cluster moves to the row farthest from its centre."""
    centres, least = _plus_plus(x, k, rng), tolerance * float(x.var(axis=0).mean())
    for _ in range(rounds):
        d = _distances(x, centres)
        cluster = d.argmin(axis=1)
        sizes = np.bincount(cluster, minlength=len(centres))
        new = np.stack([np.bincount(cluster, weights=x[:, c], minlength=len(centres)) for c in range(x.shape[1])], axis=1)
        empty = np.flatnonzero(sizes == 0)
        new = new / np.maximum(sizes, 1)[:, None]
        if len(empty):
            new[empty] = x[np.argsort(-d[np.arange(len(x)), cluster], kind="stable")[: len(empty)]]
        moved = float(((new - centres) ** 2).sum())
        centres = new
        if moved <= least:
            break
    d = _distances(x, centres)
    return float(d.min(axis=1).sum()), d.argmin(axis=1)


def kmeans_clusters(cell_table: DataFrame, k: int, seed: int, starts: int = 10) -> DataFrame:
    """``cell_id, cluster``: K-means on standardized cell columns, the best of several starts by inertia.

    Cells are a bounded table (zones x hours x 2 x 5), so a start is one task's work and all starts are one job.
    """
    schema = "start int, inertia double, cell_id long, cluster long"

    def one_start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        x = pdf[CELL].to_numpy(float)
        deviation = x.std(axis=0)
        start = int(pdf["start"].iloc[0])
        inertia, cluster = lloyd((x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1.0), k, np.random.default_rng([seed, start]))
        return pd.DataFrame({"start": start, "inertia": inertia, "cell_id": pdf["cell_id"], "cluster": cluster})

    dealt = cell_table.select("cell_id", *CELL, F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    tried = materialize(dealt.groupBy("start").applyInPandas(one_start, schema), "kmeans-starts")
    best = tried.agg(F.min(F.struct(F.round("inertia", 9).alias("inertia"), "start")).alias("b")).select("b.start").scalar()
    return tried.withColumn("_best", best).where(F.col("start") == F.col("_best")).select("cell_id", "cluster")


def _serve(pool: DataFrame, demand: DataFrame, keys: list[str], seed: int, step: str) -> DataFrame:
    """``rider_id, tk``: inside each key, trips in hash order meet riders' demands laid end to end.

    Both sides are numbered range by range, so a cell with a third of all trips is no single task.
    """
    trips = S.numbered(pool.select("tk", *keys, hash_order(f"{seed}:{step}", "tk").alias("_order")), keys, "_order", ("tk",), "rn").select("tk", *keys, "rn")
    spans = S.grouped_running(demand.where("need > 0").select(*keys, "rider_id", "need"), keys, "rider_id", "need")
    # each demand becomes its trip numbers, so the meeting is an equi-join
    wanted = spans.select("rider_id", *keys, F.explode(F.sequence(F.col("cum_need") - F.col("need") + 1, F.col("cum_need"))).alias("rn"))
    return wanted.join(trips, [*keys, "rn"]).select("rider_id", "tk")


def _serve_all(pool: DataFrame, demand: DataFrame, seed: int) -> DataFrame:
    """The last step has no key: riders' demands laid end to end over all free trips, numbered range by range."""
    trips = S.running_sums(pool.select("tk", hash_order(f"{seed}:all", "tk").alias("_order"), F.lit(1).alias("one")), "_order", ["one"], ties=("tk",))
    spans = S.running_sums(demand.where("need > 0").select("rider_id", "need"), "rider_id", ["need"])
    wanted = spans.select("rider_id", F.explode(F.sequence(F.col("cum_need") - F.col("need") + 1, F.col("cum_need"))).alias("rn"))
    return wanted.join(trips.select("tk", F.col("cum_one").alias("rn")), "rn").select("rider_id", "tk")


def _left(demand: DataFrame, served: DataFrame) -> DataFrame:
    got = served.groupBy("rider_id").agg(F.count("*").alias("got"))
    return demand.join(got, "rider_id", "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).drop("got")


def assign_riders(trips: DataFrame, draws: DataFrame, cell_table: DataFrame, clusters: DataFrame, seed: int) -> DataFrame:
    """``rider_id, tk, step``: each trip is used once at most and each rider gets ``k`` trips, from the
    home cell first, then from its cluster of cells, then from anywhere."""
    placed = materialize(trips.select("tk", *CELL).join(cell_table.select("cell_id", *CELL), CELL).join(clusters, "cell_id").select("tk", "cell_id", "cluster"), "placed-trips")
    demand = materialize(draws.join(clusters, "cell_id").select("rider_id", "cell_id", "cluster", F.col("k").alias("need")), "demand")
    home = materialize(_serve(placed, demand, ["cell_id"], seed, "home"), "home-trips")
    free, demand = placed.join(home, "tk", "left_anti"), _left(demand, home)
    near = materialize(_serve(free, demand, ["cluster"], seed, "cluster"), "cluster-trips")
    free, demand = free.join(near, "tk", "left_anti"), _left(demand, near)
    rest = _serve_all(free, demand, seed)
    return home.withColumn("step", F.lit("home")).unionByName(near.withColumn("step", F.lit("cluster"))).unionByName(rest.withColumn("step", F.lit("all")))


def panel_summary(trips: DataFrame) -> DataFrame:
    """One row: riders, trips, fewest, median and most trips of a rider, and distinct home zones."""
    per = trips.groupBy("rider_id").agg(F.count("*").alias("n"), F.mode("pickup_zone", deterministic=True).alias("home_zone"))
    totals = per.agg(F.count("*").alias("n_riders"), F.sum("n").alias("n_trips"), F.min("n").alias("min_trips"), F.max("n").alias("max_trips"), F.count_distinct("home_zone").alias("n_home_zones"))
    return totals.withColumn("median_trips", S.global_quantiles(per, "n", [0.5]).scalar())
