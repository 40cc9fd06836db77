"""A rider's memory: recall over the decision log, strictly of the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X

HIGH_SURGE, BAD_WAIT_SLACK = 1.5, 10.0


MATCHES = {"purpose": 4, "origin_zone": 3, "band": 3}  # tenths, so that ties are exact


def recall(log: DataFrame, k: int = 5) -> DataFrame:
    """For every decision the ``k`` most similar earlier ones of its rider, the later first on ties.

    Similarity is 0.4 for the same purpose, 0.3 for the same origin and 0.3 for the same surge band (given
    in tenths). An episode that agrees in a set of traits and is not among the last ``k`` that do is
    outranked by those, so the last ``k`` of each of the eight trait sets hold the answer: eight bounded
    window frames instead of a join of every decision with its past.
    """
    out = log.withColumn("band", X.surge_band("surge")).select("rider_id", "seq", *MATCHES)
    found = []
    for chosen in range(1 << len(MATCHES)):
        traits = [t for bit, t in enumerate(MATCHES) if chosen >> bit & 1]
        w = Window.partitionBy("rider_id", *traits).orderBy("seq").rowsBetween(-k, -1)
        out = out.withColumn(f"_w{chosen}", F.collect_list(F.struct("seq", *MATCHES)).over(w))
        found.append(f"_w{chosen}")

    def scored(e: Column) -> Column:
        points = sum((F.when(e[t] == F.col(t), p).otherwise(0) for t, p in MATCHES.items()), F.lit(0))
        return F.struct(points.cast("long").alias("similarity"), e["seq"].alias("episode_seq"))

    best = F.slice(F.sort_array(F.transform(F.array_distinct(F.flatten(F.array(*found))), scored), asc=False), 1, k)
    ranked = out.select("rider_id", "seq", F.posexplode(best).alias("at", "e"))
    return ranked.select("rider_id", "seq", "e.episode_seq", "e.similarity", (F.col("at") + 1).cast("long").alias("rank"))


def aggregates(log: DataFrame, running: bool = False) -> DataFrame:
    """Counts and means over a rider's episodes: all of them, or before each decision (``running``)."""
    high = F.col("surge") > HIGH_SURGE
    parts = {
        "episodes_total": F.count("*"),
        "_paid": F.sum(F.col("realized_fare").cast("decimal(18,4)")),  # exact, so that rounding does not hang on the order of a sum
        "_n_paid": F.count("realized_fare"),
        "accept_rate_high_surge": F.avg(F.when(high, (F.col("action") == "accept").cast("int"))),
        "bad_wait_experiences": F.count_if(F.col("realized_wait") > F.col("eta_min") + BAD_WAIT_SLACK),
    }
    finish = {"mean_fare_paid": X.rounded(F.try_divide(F.col("_paid").cast("double"), F.col("_n_paid")), 2), "accept_rate_high_surge": X.rounded("accept_rate_high_surge", 3)}
    if not running:
        return log.groupBy("rider_id").agg(*(c.alias(n) for n, c in parts.items())).withColumns(finish).drop("_paid", "_n_paid")
    w = Window.partitionBy("rider_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.select("rider_id", "seq", *(c.over(w).alias(n) for n, c in parts.items())).withColumns(finish).drop("_paid", "_n_paid")


def record_realizations(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fills outcomes (rider_id, offer_id, realized_fare, realized_wait) into the latest episode of each offer."""
    latest = F.row_number().over(Window.partitionBy("rider_id", "offer_id").orderBy(F.desc("seq"))) == 1
    given = outcomes.select("rider_id", "offer_id", F.col("realized_fare").alias("_f"), F.col("realized_wait").alias("_w"), F.lit(True).alias("_g"))
    joined = log.withColumn("_latest", latest).join(given, ["rider_id", "offer_id"], "left")
    hit = F.col("_latest") & F.col("_g")
    return joined.withColumns({"realized_fare": F.when(hit, F.col("_f")).otherwise(F.col("realized_fare")), "realized_wait": F.when(hit, F.col("_w")).otherwise(F.col("realized_wait"))}).select(*log.columns)
