"""The registered queries: each an operator over the canonical views, beside its independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S
from farelens.operators import agent_io, decisions, features, fidelity, logit, lookups, memory, offers, panel, personas, screening, tool_rounds, trips
from farelens.plans.oracle import SEED, chain, clip, drawn_rows, purpose, r, rounded, u
from farelens.sources import arrival, views
from farelens.sources.staging import materialize, new_path, staged
from farelens.sources.tables import table
from farelens.streaming import decisions as streaming
from farelens.streaming import memory as streaming_memory

TRIPS_PER_RIDER = 4
#: The reference's counts: elasticity and screening replicates, redraws, permutations, riders of a panel, replicates of an AUC.
REPLICATES, SCREEN_REPLICATES, REDRAWS, PERMUTATIONS, PANEL, INTERVAL = 500, 1000, 200, 200, 2000, 200
Query = Callable[[SparkSession, str], DataFrame]


def six(c: Column | str, digits: int = 6) -> Column:
    return F.round(X.col(c) * float(10**digits)) / float(10**digits)


def pick(df: DataFrame, exact: tuple[str, ...], doubles: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.select(*exact, *(six(d, digits).alias(d) for d in doubles))


class Inputs:
    """Canonical frames of one folder. Staged are the items of trips with their riders, what is measured of trips, the median rate, personas,
    and sampled trips with their riders' traits.

    What is made of a staged row cheaply and without a shuffle - a trip's key as a text and its prices, six offers of a sampled trip and their
    decisions - is made where it is read: it would be several times the size of the inputs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def raw(self) -> DataFrame:
        return views.trips_of(self._items)

    @property
    def _items(self) -> DataFrame:
        return staged(self.spark, self.folder, "items", lambda: views.trip_items(self.spark, self.folder))

    @property
    def trips(self) -> DataFrame:
        measured = staged(self.spark, self.folder, "measured", lambda: trips.measured_trips(views.trips_of(self._items, text=False)))
        median = staged(self.spark, self.folder, "median", lambda: trips.pay_per_mile_median(self.raw))
        return trips.priced_trips(measured.withColumn("tk", views.key_text(F.col("tk"))), median)

    @property
    def personas(self) -> DataFrame:
        return staged(self.spark, self.folder, "personas", lambda: personas.fit_personas(personas.riders_of(self.trips), self.trips))

    @property
    def offers(self) -> DataFrame:
        return offers.offers_of(self._bases, SEED)

    @property
    def known(self) -> DataFrame:
        """The offers with their riders' traits, and the median fare that the logit asks for."""
        return offers.offers_of(self._bases, SEED, *decisions.TRAITS, "median_fare_paid")

    @property
    def seen(self) -> DataFrame:
        return self.known.drop("median_fare_paid")

    @property
    def _bases(self) -> DataFrame:
        return staged(self.spark, self.folder, "bases", lambda: decisions.with_persona(offers.offer_bases(self.trips, TRIPS_PER_RIDER, SEED), self.personas, *decisions.TRAITS, "median_fare_paid"))

    @property
    def full(self) -> DataFrame:
        return decisions.rule_decisions(self.seen, None)

    @property
    def choices(self) -> DataFrame:
        return decisions.statistical_decisions(offers.simulation_offers(self.trips, TRIPS_PER_RIDER, SEED), self.personas, SEED)

    @property
    def real(self) -> DataFrame:
        return trips.accepted_events(self.trips)

    @property
    def log(self) -> DataFrame:
        return views.decision_log(self.spark, self.folder)

    @property
    def split(self) -> DataFrame:
        return screening.pre_post_split(screening.with_cells(self.full))

    @property
    def deltas(self) -> DataFrame:
        return screening.paired_deltas(screening.rider_metrics(self.split))


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, build: Callable[[Inputs], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
    if sql is not None:
        _SQL[name] = sql


_TRIP = ("tk", "pickup_zone", "dropoff_zone", "pickup_hour", "is_weekend", "miles_bucket", "wait_secs")
register("trip_clean", lambda i: pick(trips.clean_trips(i.raw), _TRIP, ("fare_paid", "surge_ratio")), rounded(("trips",), "trips", _TRIP, ("fare_paid", "surge_ratio")))
register("median_ppm", lambda i: pick(trips.pay_per_mile_median(i.raw), (), ("median_ppm",)), rounded(("ppm",), "ppm", (), ("median_ppm",)))
register("miles_bucket_hist", lambda i: trips.counts_by(i.trips, F.col("miles_bucket"), "miles_bucket"), chain(("trips",), "SELECT miles_bucket, count(*) AS n FROM trips GROUP BY miles_bucket"))
register("purpose_by_trip", lambda i: trips.with_purpose(i.trips).select("tk", "purpose"), chain(("trips",), f"SELECT tk, {purpose()} AS purpose FROM trips"))
register("time_of_day_hist", lambda i: trips.counts_by(i.trips, X.time_of_day("pickup_hour"), "time_of_day"),
         chain(("trips",), "SELECT CASE WHEN pickup_hour <= 5 THEN 'night' WHEN pickup_hour <= 11 THEN 'morning' WHEN pickup_hour <= 16 THEN 'midday' ELSE 'evening' END AS time_of_day, count(*) AS n FROM trips GROUP BY 1"))
register("accepted_events", lambda i: pick(i.real, ("tk", "purpose", "accepted", "pickup_hour"), ("quoted_fare", "surge", "eta_min")), rounded(("real",), "real", ("tk", "purpose", "accepted", "pickup_hour"), ("quoted_fare", "surge", "eta_min")))
register("purpose_mix_by_rider", lambda i: pick(personas.purpose_mix(i.trips), ("rider_id",), X.PURPOSES), rounded(("mix",), "mix", ("rider_id",), X.PURPOSES))

_STATS = ("median_fare_paid", "median_fpm", "median_miles", "median_wait_min", "p75_wait_min", "tip_rate")
register("rider_stats", lambda i: pick(personas.rider_stats(i.trips), ("rider_id", "observed_trip_count"), _STATS), rounded(("stats",), "stats", ("rider_id", "observed_trip_count"), _STATS))
register("rider_pct_rank", lambda i: pick(personas.ranked_stats(personas.rider_stats(i.trips)), ("rider_id",), ("fare_pctl", "spend_pctl")), rounded(("ranked",), "ranked", ("rider_id",), ("fare_pctl", "spend_pctl")))
_PERSONA = ("rider_id", "home_zone", "work_zone", "income_bracket", "has_transit_alternative", "loyalty_tier", "observed_trip_count")
_TRAITS = (*X.PURPOSES, "price_sensitivity", "wait_tolerance_minutes", "median_fare_paid", "median_wait_experienced")
register("personas", lambda i: pick(personas.fit_personas(personas.riders_of(i.trips), i.trips), _PERSONA, _TRAITS), rounded(("personas",), "personas", _PERSONA, _TRAITS))
_COUNTS = tuple(f"income_{b}" for b in ("low", "middle", "upper_middle", "high")) + tuple(f"tier_{t}" for t in ("member", "silver", "gold", "platinum"))
register("persona_summary", lambda i: pick(personas.persona_summary(i.personas), ("n", *_COUNTS), ("transit_share", "median_sensitivity", "median_tolerance", "median_fare")),
         chain(("personas",), "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {'income_bracket' if c.startswith('income') else 'loyalty_tier'} = '{c.split('_', 1)[1]}') AS {c}" for c in _COUNTS)
               + f", {r('avg(CASE WHEN has_transit_alternative THEN 1.0 ELSE 0.0 END)')} AS transit_share, {r('median(price_sensitivity)')} AS median_sensitivity, {r('median(wait_tolerance_minutes)')} AS median_tolerance, {r('median(median_fare_paid)')} AS median_fare FROM personas"))


def _broken(df: DataFrame, place: str, n: int, faults: dict[str, tuple[str, str]]) -> DataFrame:
    """Breaks the k-th rule in the rows whose ``place`` modulo ``n`` is k; rows beyond the rules stay as they are."""
    return df.withColumns({c: F.when(F.col(place) % n == k, F.expr(bad).cast(df.schema[c].dataType)).otherwise(F.col(c)) for k, (c, bad) in enumerate(faults.values())})


def _faults_sql(faults: dict[str, tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{field}')" for k, field in enumerate(faults)) + ") f(k, field)"


_PERSONA_FAULTS = {
    "rider_id": ("rider_id", "-1 - rider_id"), "home_zone": ("home_zone", "0"), "work_zone": ("work_zone", "NULL"), "trip_purpose_mix": ("commute", "commute + 1"), "price_sensitivity": ("price_sensitivity", "1.5"),
    "wait_tolerance_minutes": ("wait_tolerance_minutes", "0"), "income_bracket": ("income_bracket", "'unknown'"), "loyalty_tier": ("loyalty_tier", "NULL"), "observed_trip_count": ("observed_trip_count", "0"),
    "median_fare_paid": ("median_fare_paid", "-0.01"), "median_wait_experienced": ("median_wait_experienced", "-1"),
}
_OFFER_FAULTS = {
    "origin_zone": ("origin_zone", "0"), "dest_zone": ("dest_zone", "-1"), "trip_purpose": ("purpose", "'leisure'"), "quoted_fare": ("quoted_fare", "0.004"), "surge_multiplier": ("surge", "0.99"), "eta_minutes": ("eta_min", "0.02"),
    "eta_framing": ("eta_framing", "NULL"), "discount_pct": ("discount_pct", "100.1"), "time_of_day": ("time_of_day", "'dusk'"), "transit_alt_minutes": ("transit_alt_minutes", "-0.5"),
}
register("persona_violations", lambda i: personas.persona_violations(_broken(i.personas, "rider_id", 13, _PERSONA_FAULTS)),
         chain(("personas",), f"SELECT CASE WHEN field = 'rider_id' THEN -1 - rider_id ELSE rider_id END AS rider_id, field FROM personas JOIN {_faults_sql(_PERSONA_FAULTS)} ON rider_id % 13 = k"))
register("work_zone_mode", lambda i: personas.riders_of(i.trips), chain(("riders",), "SELECT * FROM riders"))
register("sample_riders", lambda i: personas.sample_riders(personas.riders_of(i.trips), 50, SEED).select("rider_id"), chain(("riders",), f"SELECT rider_id FROM riders ORDER BY {u(str(SEED), 'rider_id')}, rider_id LIMIT 50"))

_CELL_SQL = "SELECT (row_number() OVER (ORDER BY pickup_zone, pickup_hour, is_weekend, miles_bucket) - 1)::BIGINT AS cell_id, pickup_zone, pickup_hour, is_weekend, miles_bucket, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS prob FROM trips GROUP BY pickup_zone, pickup_hour, is_weekend, miles_bucket"
register("cell_volume", lambda i: pick(panel.cells(i.trips), ("cell_id", *panel.CELL, "n"), ("prob",)), chain(("trips",), f"SELECT cell_id, pickup_zone, pickup_hour, is_weekend, miles_bucket, n, {r('prob')} AS prob FROM ({_CELL_SQL})"))
_DRAWS = f"""draws AS (SELECT d.id AS rider_id, c.cell_id, c.pickup_zone AS zone, (5 + CAST(floor({u(f'{SEED}:k', 'd.id')} * 36) AS BIGINT))::BIGINT AS k FROM (SELECT unnest(range({PANEL})) AS id) d
    JOIN (SELECT *, coalesce(lag(hi) OVER (ORDER BY cell_id), 0) AS lo FROM (SELECT *, sum(n) OVER (ORDER BY cell_id) / sum(n) OVER ()::DOUBLE AS hi FROM cells)) c ON {u(f'{SEED}:cell', 'd.id')} >= lo AND {u(f'{SEED}:cell', 'd.id')} < hi)"""
register("weighted_cell_draw", lambda i: panel.draw_cells(panel.cells(i.trips), i.spark, PANEL, SEED), chain(("trips",), "SELECT 1").replace("\nSELECT 1", f",\ncells AS ({_CELL_SQL}),\n{_DRAWS}\nSELECT rider_id, cell_id, k FROM draws"))


def _allocated(i: Inputs) -> DataFrame:
    t, c = i.trips, panel.cells(i.trips)
    by_zone = c.select("cell_id", F.col("pickup_zone").alias("cluster"))
    return panel.assign_riders(t, panel.draw_cells(c, i.spark, PANEL, SEED), c, by_zone, SEED)


register("panel_allocation", _allocated, chain(("trips",), "SELECT 1").replace("\nSELECT 1", f""",
cells AS ({_CELL_SQL}),
{_DRAWS},
placed AS MATERIALIZED (SELECT tk, cell_id, t.pickup_zone AS zone FROM trips t JOIN cells USING (pickup_zone, pickup_hour, is_weekend, miles_bucket)),
s1 AS (SELECT rider_id, cell_id, sum(k) OVER w AS hi, sum(k) OVER w - k AS lo FROM draws WINDOW w AS (PARTITION BY cell_id ORDER BY rider_id)),
t1 AS (SELECT tk, cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY {u(f'{SEED}:home', 'tk')}, tk) AS rn FROM placed),
home AS MATERIALIZED (SELECT rider_id, tk FROM s1 JOIN t1 ON s1.cell_id = t1.cell_id AND rn > lo AND rn <= hi),
n2 AS (SELECT d.rider_id, zone, k - coalesce(g, 0) AS need FROM draws d LEFT JOIN (SELECT rider_id, count(*) AS g FROM home GROUP BY 1) h ON d.rider_id = h.rider_id),
s2 AS (SELECT rider_id, zone, sum(need) OVER w AS hi, sum(need) OVER w - need AS lo FROM n2 WHERE need > 0 WINDOW w AS (PARTITION BY zone ORDER BY rider_id)),
t2 AS (SELECT tk, zone, row_number() OVER (PARTITION BY zone ORDER BY {u(f'{SEED}:cluster', 'tk')}, tk) AS rn FROM placed WHERE tk NOT IN (SELECT tk FROM home)),
near AS MATERIALIZED (SELECT rider_id, tk FROM s2 JOIN t2 ON s2.zone = t2.zone AND rn > lo AND rn <= hi),
n3 AS (SELECT n2.rider_id, need - coalesce(g, 0) AS need FROM n2 LEFT JOIN (SELECT rider_id, count(*) AS g FROM near GROUP BY 1) h ON n2.rider_id = h.rider_id),
s3 AS (SELECT rider_id, sum(need) OVER w AS hi, sum(need) OVER w - need AS lo FROM n3 WHERE need > 0 WINDOW w AS (ORDER BY rider_id)),
t3 AS (SELECT tk, row_number() OVER (ORDER BY substr(md5(concat_ws(':', '{SEED}:all', tk)), 1, 8), tk) AS rn FROM placed WHERE tk NOT IN (SELECT tk FROM home) AND tk NOT IN (SELECT tk FROM near))
SELECT rider_id, tk, 'home' AS step FROM home UNION ALL SELECT rider_id, tk, 'cluster' FROM near UNION ALL SELECT rider_id, tk, 'all' FROM s3 JOIN t3 ON rn > lo AND rn <= hi"""))
register("panel_assigned", lambda i: panel.assign_riders(i.trips, panel.draw_cells(panel.cells(i.trips), i.spark, PANEL, SEED), panel.cells(i.trips), panel.kmeans_clusters(panel.cells(i.trips), panel.cluster_count(PANEL), SEED), SEED), None)
register("panel_summary", lambda i: pick(panel.panel_summary(i.trips), ("n_riders", "n_trips", "min_trips", "max_trips", "n_home_zones"), ("median_trips",)),
         chain(("riders",), f"SELECT count(*) AS n_riders, CAST(sum(observed_trip_count) AS BIGINT) AS n_trips, min(observed_trip_count) AS min_trips, max(observed_trip_count) AS max_trips, count(DISTINCT home_zone) AS n_home_zones, {r('median(observed_trip_count)')} AS median_trips FROM riders"))
register("kmeans_cells", lambda i: panel.kmeans_clusters(panel.cells(i.trips), panel.cluster_count(PANEL), SEED), None)

_LANE = ("pickup_zone", "dropoff_zone")
register("lane_price_history", lambda i: pick(lookups.price_history(i.trips), (*_LANE, "scope", "n_trips"), ("market_fare_p50", "market_fare_p90")),
         chain(("scoped", "city"), f"SELECT pickup_zone, dropoff_zone, scope, n AS n_trips, {r('CASE scope WHEN $l$lane$l$ THEN l50 WHEN $l$origin_zone$l$ THEN z50 ELSE p50 END')} AS market_fare_p50, {r('CASE scope WHEN $l$lane$l$ THEN l90 WHEN $l$origin_zone$l$ THEN z90 ELSE p90 END')} AS market_fare_p90 FROM scoped, city".replace("$l$", "'")))
register("rider_price_history", lambda i: pick(lookups.rider_price_history(i.trips), ("rider_id", *_LANE, "scope"), ("rider_median_fare", "rider_fare_percentile")),
         chain(("trips", "scoped"), f"""SELECT q.rider_id, q.pickup_zone, q.dropoff_zone, q.scope, {r('m')} AS rider_median_fare, {r("(SELECT avg(CASE WHEN fare_paid <= m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM trips t WHERE (q.scope = 'citywide' OR t.pickup_zone = q.pickup_zone) AND (q.scope <> 'lane' OR t.dropoff_zone = q.dropoff_zone))")} AS rider_fare_percentile
         FROM (SELECT d.rider_id, d.pickup_zone, d.dropoff_zone, s.scope, median(t.fare_paid) AS m FROM (SELECT DISTINCT rider_id, pickup_zone, dropoff_zone FROM trips) d JOIN scoped s ON d.pickup_zone = s.pickup_zone AND d.dropoff_zone = s.dropoff_zone
         JOIN trips t ON t.rider_id = d.rider_id AND (s.scope = 'citywide' OR t.pickup_zone = d.pickup_zone) AND (s.scope <> 'lane' OR t.dropoff_zone = d.dropoff_zone) GROUP BY ALL) q"""))
register("eta_reliability", lambda i: pick(lookups.eta_reliability(i.trips), ("pickup_zone", "pickup_hour", "scope", "n_trips"), ("wait_p50_minutes", "wait_p90_minutes")),
         chain(("trips", "zone"), f"SELECT h.pickup_zone, pickup_hour, CASE WHEN h.n >= 100 THEN 'zone_hour' ELSE 'origin_zone' END AS scope, h.n AS n_trips, {r('CASE WHEN h.n >= 100 THEN h50 ELSE w50 END')} AS wait_p50_minutes, {r('CASE WHEN h.n >= 100 THEN h90 ELSE w90 END')} AS wait_p90_minutes FROM (SELECT pickup_zone, pickup_hour, count(*) AS n, median(wait_secs) / 60.0::DOUBLE AS h50, quantile_cont(wait_secs, 0.9) / 60.0::DOUBLE AS h90 FROM trips GROUP BY 1, 2) h JOIN zone z ON h.pickup_zone = z.pickup_zone"))
_PAIRS = "(SELECT a.pickup_zone, b.dropoff_zone FROM (SELECT DISTINCT pickup_zone FROM trips) a CROSS JOIN (SELECT DISTINCT dropoff_zone FROM trips) b) q LEFT JOIN lane l ON q.pickup_zone = l.pickup_zone AND q.dropoff_zone = l.dropoff_zone LEFT JOIN zone z ON q.pickup_zone = z.pickup_zone"
_MINUTES = r("coalesce(l.miles, z.miles) / 12.0::DOUBLE * 60.0::DOUBLE", 1)
register("transit_alternative", lambda i: lookups.transit_alternative(i.trips, lookups.all_lanes(i.trips)), chain(("trips", "lane", "zone"), f"SELECT q.pickup_zone, q.dropoff_zone, {_MINUTES} AS transit_minutes, CASE WHEN {_MINUTES} IS NOT NULL THEN 2.9::DOUBLE END AS transit_cost, coalesce(l.n, 0) AS n_trips FROM {_PAIRS}"))
register("lane_transit_fallback", lambda i: lookups.lane_transit_minutes(i.trips, lookups.all_lanes(i.trips)), chain(("trips", "lane", "zone"), f"SELECT q.pickup_zone, q.dropoff_zone, coalesce({_MINUTES}, 60.0::DOUBLE) AS transit_alt_minutes FROM {_PAIRS}"))
register("rider_median_transform", lambda i: i.trips.join(i.trips.groupBy("rider_id").agg(F.median("fare_paid").alias("m")), "rider_id").select("tk", six(F.col("fare_paid") / F.col("m")).alias("fare_rel")),
         chain(("trips", "stats"), f"SELECT tk, {r('fare_paid / median_fare_paid')} AS fare_rel FROM trips t JOIN stats s ON t.rider_id = s.rider_id"))
register("sample_trips_per_rider", lambda i: offers.sample_trips(i.trips, TRIPS_PER_RIDER, SEED).select("rider_id", "tk", "trip_index"), chain(("bases",), "SELECT rider_id, tk, trip_index FROM bases"))

_OFFER = ("offer_id", "origin_zone", "dest_zone", "purpose", "pickup_hour", "eta_framing", "time_of_day", "weather", "is_base", "reject_counterfactual")
_OFFER_D = ("quoted_fare", "surge", "eta_min", "discount_pct", "transit_alt_minutes", "price_mult", "surge_mult")
register("offer_grid", lambda i: pick(offers.evaluation_offers(i.trips, TRIPS_PER_RIDER, SEED), _OFFER, _OFFER_D), rounded(("offers",), "offers", _OFFER, _OFFER_D))
register("offer_violations", lambda i: offers.offer_violations(_broken(i.offers, "pickup_hour", 12, _OFFER_FAULTS)),
         chain(("offers",), f"SELECT offer_id, field FROM offers JOIN {_faults_sql(_OFFER_FAULTS)} ON pickup_hour % 12 = k"))
_CHOICE = ("rider_id", "tk", "accepted")
register("simulate_offers", lambda i: pick(offers.simulation_offers(i.trips, TRIPS_PER_RIDER, SEED), ("rider_id", "tk"), ("price_mult", "wait_mult", "offered_fare", "offered_wait_min")),
         chain(("bases", "simgrid"), f"SELECT rider_id, tk, {r('price_mult')} AS price_mult, {r('wait_mult')} AS wait_mult, {r('fare_paid * price_mult')} AS offered_fare, {r('wait_secs / 60.0::DOUBLE * wait_mult')} AS offered_wait_min FROM bases CROSS JOIN simgrid"))
register("statistical_decisions", lambda i: pick(i.choices, _CHOICE, ("price_mult", "wait_mult", "p")), rounded(("choices",), "choices", _CHOICE, ("price_mult", "wait_mult", "p")))
register("base_accept_rate", lambda i: pick(decisions.base_accept_rate(i.choices), (), ("base_accept_rate",)), chain(("choices",), f"SELECT {r('avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END)')} AS base_accept_rate FROM choices WHERE price_mult = 1 AND wait_mult = 1"))

_DECISION = ("offer_id", "action", "accepted")
_DECISION_D = ("confidence", "reservation_fare", "p_accept")
for _name, _config, _build in (
    ("offline_decisions", "full", lambda i: decisions.rule_decisions(i.seen, None)),
    ("demographics_only_decisions", "demographics_only", lambda i: decisions.rule_decisions(i.seen, None, "demographics_only")),
    ("random_decisions", "random_baseline", lambda i: decisions.random_decisions(i.seen, None, SEED)),
):
    register(_name, lambda i, b=_build: pick(b(i), _DECISION, _DECISION_D), rounded(("trace",), "trace", _DECISION, _DECISION_D, f"WHERE config = '{_config}'"))
register("trace_by_config", lambda i: pick(decisions.trace_all(i.seen, None, SEED).groupBy("config", "action").agg(F.count("*").alias("n"), F.avg("p_accept").alias("mean_p"), F.avg("reservation_fare").alias("mean_fare")), ("config", "action", "n"), ("mean_p", "mean_fare")),
         chain(("trace",), f"SELECT config, action, count(*) AS n, {r('avg(p_accept)')} AS mean_p, {r('avg(reservation_fare)')} AS mean_fare FROM trace GROUP BY config, action"))
register("persona_pruning", lambda i: i.personas.select(*decisions.DEMOGRAPHICS), chain(("personas",), "SELECT rider_id, home_zone, work_zone, income_bracket, loyalty_tier, observed_trip_count FROM personas"))

register("brier_overall", lambda i: pick(fidelity.brier(fidelity.labeled_offers(i.full)), ("n",), ("brier",)), chain(("labeled",), f"SELECT count(*) AS n, {r('avg((p_accept - label) * (p_accept - label))')} AS brier FROM labeled"))
register("brier_by_segment", lambda i: pick(fidelity.brier_by_segment(fidelity.labeled_offers(i.full)), ("segment", "n"), ("brier",)), chain(("segments",), f"SELECT segment, count(*) AS n, {r('avg((p_accept - label) * (p_accept - label))')} AS brier FROM segments WHERE segment <> 'overall' GROUP BY segment HAVING count(*) >= 4"))
register("reliability_curve", lambda i: pick(fidelity.reliability_curve(fidelity.labeled_offers(i.full)), ("segment", "bin", "n"), ("observed", "predicted")),
         chain(("segments",), f"SELECT segment, bin, n, {r('o')} AS observed, {r('p')} AS predicted FROM (SELECT *, sum(n) OVER (PARTITION BY segment) AS size FROM (SELECT segment, ({' + '.join(f'CAST({k}::DOUBLE / 10::DOUBLE < p_accept AS INT)' for k in range(1, 10))})::BIGINT AS bin, count(*) AS n, avg(label) AS o, avg(p_accept) AS p FROM segments GROUP BY 1, 2)) WHERE segment = 'overall' OR size >= 20"))
register("tercile_labels", lambda i: fidelity.tercile_labels(i.personas, "price_sensitivity", "tercile").groupBy("tercile").agg(F.count("*").alias("n")),
         chain(("personas",), "SELECT CASE WHEN price_sensitivity <= a THEN 'low' WHEN price_sensitivity > b THEN 'high' ELSE 'mid' END AS tercile, count(*) AS n FROM personas, (SELECT quantile_cont(price_sensitivity, 1.0::DOUBLE / 3) AS a, quantile_cont(price_sensitivity, 2.0::DOUBLE / 3) AS b FROM personas) GROUP BY 1"))


def _ks_sql(needs: tuple[str, ...], sample: str) -> str:
    return chain(needs, f"""SELECT {r('max(abs(fa - fb))')} AS ks_d FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER ()::DOUBLE AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER ()::DOUBLE AS fb FROM (SELECT v, sum(s) AS a, sum(1 - s) AS b FROM ({sample}) GROUP BY v))""")


def _ks(i: Inputs, value: str) -> DataFrame:
    both = i.real.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("s")).unionByName(i.full.where("accepted = 1").select(F.col(value).cast("double").alias("v"), F.lit(0).alias("s")))
    return S.ks_statistic(both, "v", F.col("s") == 1).select(six("ks_d").alias("ks_d"))


register("ks_fare", lambda i: _ks(i, "quoted_fare"), _ks_sql(("real", "base_trace"), "SELECT quoted_fare AS v, 1 AS s FROM real UNION ALL SELECT quoted_fare, 0 FROM base_trace WHERE accepted = 1"))
register("ks_wait", lambda i: _ks(i, "eta_min"), _ks_sql(("real", "base_trace"), "SELECT eta_min AS v, 1 AS s FROM real UNION ALL SELECT eta_min, 0 FROM base_trace WHERE accepted = 1"))
register("ks_surge", lambda i: _ks(i, "surge"), _ks_sql(("real", "base_trace"), "SELECT surge AS v, 1 AS s FROM real UNION ALL SELECT surge, 0 FROM base_trace WHERE accepted = 1"))
_MATCHED = "SELECT {v} AS v, 1 AS s FROM (SELECT *, row_number() OVER (ORDER BY concat_ws(':', substr(md5(concat_ws(':', '{seed}', tk)), 1, 8), tk)) AS k FROM real) WHERE k <= (SELECT count(*) FROM base_trace WHERE accepted = 1)"
_RANK = "(SELECT purpose AS q, row_number() OVER (ORDER BY count(*) DESC, purpose) - 1 AS rank FROM real GROUP BY purpose)"
_HOURS = "(SELECT r.pickup_hour, r.a AS ra, s.a AS sa FROM (SELECT pickup_hour, avg(accepted) AS a FROM real GROUP BY 1) r JOIN (SELECT pickup_hour, avg(accepted) AS a FROM base_trace GROUP BY 1) s ON r.pickup_hour = s.pickup_hour)"


def _marginal(name: str, sample: str) -> str:
    return f"SELECT '{name}' AS marginal, {r('max(abs(fa - fb))')} AS statistic, CAST(max(na) AS BIGINT) AS n_real, CAST(max(nb) AS BIGINT) AS n_sim FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER ()::DOUBLE AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER ()::DOUBLE AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (SELECT v, sum(s) AS a, sum(1 - s) AS b FROM ({sample}) GROUP BY v))"


register("distribution_statistics", lambda i: pick(fidelity.distribution_statistics(i.full, i.real, SEED), ("marginal", "n_real", "n_sim"), ("statistic",)), chain(("real", "base_trace"), "\nUNION ALL ".join((
    _marginal("accepted_fare", _MATCHED.format(v="quoted_fare", seed=SEED) + " UNION ALL SELECT quoted_fare, 0 FROM base_trace WHERE accepted = 1"),
    _marginal("accepted_wait", _MATCHED.format(v="eta_min", seed=SEED + 1) + " UNION ALL SELECT eta_min, 0 FROM base_trace WHERE accepted = 1"),
    _marginal("accept_rate_by_hour", f"SELECT ra AS v, 1 AS s FROM {_HOURS} UNION ALL SELECT sa, 0 FROM {_HOURS}"),
    _marginal("purpose_mix", f"SELECT rank AS v, s FROM ({_MATCHED.format(v='purpose', seed=SEED + 2)} UNION ALL SELECT purpose, 0 FROM base_trace WHERE accepted = 1) x JOIN {_RANK} o ON x.v = o.q"),
))))
register("accept_rate_by_hour", lambda i: pick(fidelity.accept_rate_by_hour(i.full), ("pickup_hour", "n"), ("accept_rate",)), chain(("base_trace",), f"SELECT pickup_hour, count(*) AS n, {r('avg(accepted)')} AS accept_rate FROM base_trace GROUP BY pickup_hour"))
register("purpose_order", lambda i: fidelity.purpose_order(i.real), chain(("real",), "SELECT purpose, (row_number() OVER (ORDER BY count(*) DESC, purpose) - 1)::BIGINT AS rank FROM real GROUP BY purpose"))
register("surge_bands", lambda i: pick(fidelity.surge_bands(i.full), ("band", "n"), ("mean_surge", "rate")), rounded(("bands",), "bands", ("band", "n"), ("mean_surge", "rate")))
_SLOPE = "CASE WHEN count(*) >= 3 AND count(DISTINCT round(ln(mean_surge) * 1000)) >= 3 THEN regr_slope(ln(rate), ln(mean_surge)) END"
register("surge_elasticity", lambda i: pick(fidelity.surge_elasticity(i.full), (), ("elasticity",)), chain(("bands",), f"SELECT {r(_SLOPE)} AS elasticity FROM bands"))
register("elasticity_bootstrap", lambda i: pick(fidelity.elasticity_replicates(i.full, REPLICATES, SEED), ("replicate",), ("slope",)), chain(("banded",), f"""SELECT replicate, {r('regr_slope(y, x)')} AS slope FROM (SELECT replicate, ln(s / n) AS x, ln((k + 0.5::DOUBLE) / (n + 1.0::DOUBLE)) AS y FROM (
    SELECT replicate, band, sum(w)::DOUBLE AS n, sum(w * surge) AS s, sum(w * accepted)::DOUBLE AS k FROM {drawn_rows('banded', REPLICATES, f'{SEED}:boot', 'offer_id')} GROUP BY 1, 2) WHERE n > 0)
    GROUP BY replicate HAVING count(*) >= 3 AND count(DISTINCT round(x * 1000)) >= 3"""))
_REPORT = ("elasticity", "ci_low", "ci_high")
register("elasticity_report", lambda i: pick(fidelity.elasticity_report(i.full, REPLICATES, SEED), ("sign_pass", "magnitude_pass", "verdict"), _REPORT), chain(("bands",), f"""SELECT sign_pass, magnitude_pass, CASE WHEN sign_pass AND magnitude_pass THEN 'PASS' ELSE 'FAIL' END AS verdict, {', '.join(f'{r(c)} AS {c}' for c in _REPORT)} FROM (
    SELECT *, coalesce(elasticity < 0, FALSE) AS sign_pass, coalesce(ci_low <= {fidelity.ELASTICITY_RANGE[1]} AND ci_high >= {fidelity.ELASTICITY_RANGE[0]}, FALSE) AS magnitude_pass FROM
    (SELECT {_SLOPE} AS elasticity FROM bands), (SELECT quantile_cont(slope, 0.025) AS ci_low, quantile_cont(slope, 0.975) AS ci_high FROM ({_SQL["elasticity_bootstrap"].replace(r("regr_slope(y, x)"), "regr_slope(y, x)")})))"""))
register("distribution_tests", lambda i: pick(fidelity.distribution_tests(i.full, i.real, SEED), ("marginal", "passed"), ("statistic", "p_value", "bonferroni_alpha")), None)
register("action_entropy", lambda i: pick(features.action_entropy(i.log), ("rider_id",), ("action_entropy",)), rounded(("entropy",), "entropy", ("rider_id",), ("action_entropy",)))
register("run_lengths", lambda i: pick(features.run_lengths(i.log, ["seq"]), ("rider_id",), ("run_accept_mean", "run_accept_max")), rounded(("runs",), "runs", ("rider_id",), ("run_accept_mean", "run_accept_max")))
register("fare_ecdf", lambda i: pick(features.fare_percentiles(i.log, i.real), ("offer_id",), ("fare_pctl",)), chain(("log", "real"), f"SELECT offer_id, {r('(SELECT count(*) FROM real WHERE real.quoted_fare <= log.quoted_fare) / (SELECT count(*) FROM real)::DOUBLE')} AS fare_pctl FROM log"))
_FEATURES = tuple(f for f in features.FEATURES if f != "surge_elasticity")
register("sequence_features", lambda i: pick(features.sequence_features(i.log, i.log, ["seq"], slopes=False), ("rider_id",), _FEATURES, 9), chain(("log", "entropy", "runs"), f"""SELECT a.rider_id, {', '.join(f'{r(f, 9)} AS {f}' for f in _FEATURES)} FROM (
    SELECT rider_id, avg(accepted) AS accept_rate, coalesce(avg(pctl) FILTER (WHERE accepted = 1), 0) AS fare_pctl_accepted, coalesce(median(eta_min) FILTER (WHERE accepted = 1), 0) AS wait_accepted_median, {', '.join(f"avg(CASE WHEN purpose = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS purpose_{p}" for p in ('commute', 'social', 'airport'))},
    coalesce(avg(surge) FILTER (WHERE accepted = 1), 0) AS surge_accepted_mean, ln(count(*)) AS log_n_decisions FROM (SELECT *, cume_dist() OVER (ORDER BY quoted_fare) AS pctl FROM log) GROUP BY rider_id) a JOIN entropy e ON a.rider_id = e.rider_id JOIN runs x ON a.rider_id = x.rider_id"""))
register("surge_slopes", lambda i: pick(features.surge_slopes(i.log), ("rider_id",), ("surge_elasticity",)), None)
register("auc_rank", lambda i: pick(S.auc(fidelity.labeled_offers(i.full), "p_accept", "label"), (), ("auc",)), chain(("labeled",), f"SELECT {r('(sum(CASE WHEN label = 1 THEN k ELSE 0.0::DOUBLE END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label))')} AS auc FROM (SELECT label, rank() OVER (ORDER BY p_accept) + (count(*) OVER (PARTITION BY p_accept) - 1) / 2.0::DOUBLE AS k FROM labeled)"))


def _scores(i: Inputs) -> DataFrame:
    """Riders' accept rates under the six configurations without a fitted model against riders' real tip rates, as stand-in scores."""
    trace = decisions.trace_all(i.seen, None, SEED)
    sim = trace.groupBy("config", "rider_id").agg(F.avg("accepted").alias("score")).select("config", F.col("rider_id").cast("string").alias("item"), F.lit(False).alias("is_real"), six("score").alias("score"))
    real = personas.rider_stats(i.trips).select(F.explode(F.array(*(F.lit(c) for c in (*decisions.RULE_CONFIGS, "random_baseline")))).alias("config"), F.col("rider_id").cast("string").alias("item"), F.lit(True).alias("is_real"), six("tip_rate").alias("score"))
    return sim.unionByName(real)


register("permutation_test", lambda i: pick(fidelity.permutation_test(_scores(i), PERMUTATIONS, SEED), ("config_a", "config_b"), ("auc_difference", "p_value")), chain(("trace", "stats"), f"""SELECT config_a, config_b, {r('max(o)')} AS auc_difference, {r(f'(count(*) FILTER (WHERE perm > 0 AND d >= o) + 1) / {PERMUTATIONS + 1}.0::DOUBLE')} AS p_value FROM (
    SELECT *, max(d) FILTER (WHERE perm = 0) OVER (PARTITION BY config_a, config_b) AS o FROM (SELECT config_a, config_b, perm, {r('abs(avg(f) FILTER (WHERE in_a) - avg(f) FILTER (WHERE NOT in_a))', 9)} AS d FROM (
    SELECT x.*, perm, CASE WHEN perm = 0 THEN first ELSE row_number() OVER (PARTITION BY config_a, config_b, perm ORDER BY substr(md5(concat_ws(':', '{SEED}:perm', perm // 4, item)), CAST(1 + 8 * (perm % 4) AS INT), 8), item) <= sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY config_a, config_b, perm) END AS in_a FROM (
    SELECT a.config AS config_a, b.config AS config_b, s.config || '/' || s.rider_id AS item, s.config = a.config AS first, f.f FROM (SELECT DISTINCT config FROM trace) a JOIN (SELECT DISTINCT config FROM trace) b ON a.config < b.config
    JOIN (SELECT config, rider_id, {r('avg(accepted)')} AS score FROM trace GROUP BY config, rider_id) s ON s.config IN (a.config, b.config)
    JOIN (SELECT v, (SELECT count(*) FILTER (WHERE t < v) + count(*) FILTER (WHERE t = v) / 2.0::DOUBLE FROM (SELECT {r('tip_rate')} AS t FROM stats)) / (SELECT count(*) FROM stats)::DOUBLE AS f FROM (SELECT DISTINCT {r('score')} AS v FROM (SELECT avg(accepted) AS score FROM trace GROUP BY config, rider_id))) f ON f.v = s.score) x, (SELECT unnest(range(0, {PERMUTATIONS + 1})) AS perm)) GROUP BY 1, 2, 3)) GROUP BY 1, 2"""))

register("pre_post_split", lambda i: i.split.select("cell", "offer_id", "period"), chain(("split",), "SELECT cell, offer_id, period FROM split"))
register("cell_metrics", lambda i: pick(screening.rider_metrics(i.split), ("cell", "period", "rider_id"), screening.METRICS), rounded(("metrics",), "metrics", ("cell", "period", "rider_id"), screening.METRICS))
register("paired_deltas", lambda i: pick(i.deltas, ("cell", "rider_id", "metric"), ("delta", "covariate")), rounded(("deltas",), "deltas", ("cell", "rider_id", "metric"), ("delta", "covariate")))
_LIFT = ("lift", "se_rider", "theta", "cuped_var_reduction", "se_rider_cuped")
register("cuped_lifts", lambda i: pick(screening.cell_lifts(i.deltas), ("cell", "metric", "n"), _LIFT), chain(("lifts",), f"SELECT cell, metric, n, {', '.join(f'CASE WHEN n >= 5 THEN {r(c)} END AS {c}' for c in _LIFT)} FROM lifts"))
register("rider_bootstrap_se", lambda i: pick(screening.rider_bootstrap(i.deltas, SCREEN_REPLICATES, SEED), ("cell", "metric"), ("se_rider_boot", "lo", "hi")), chain(("deltas",), f"""SELECT cell, metric, {r('stddev_pop(l)')} AS se_rider_boot, {r('quantile_cont(l, 0.025)')} AS lo, {r('quantile_cont(l, 0.975)')} AS hi FROM (
    SELECT cell, metric, replicate, sum(w * delta) / sum(w) AS l FROM {drawn_rows('deltas', SCREEN_REPLICATES, f'{SEED}:riders', 'rider_id')} WHERE delta IS NOT NULL AND covariate IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(w) > 0) GROUP BY 1, 2"""))
register("sampling_errors", lambda i: pick(screening.sampling_errors(i.split), ("cell",), ("se_sampling",)), rounded(("noise",), "noise", ("cell",), ("se_sampling",)))
_DRAWN = ("accept_rate", "completed_rides", "mean_fare", "abandonment_rate")
register("bernoulli_redraw", lambda i: pick(screening.redraw_totals(i.split, REDRAWS, SEED), ("cell", "replicate"), _DRAWN), chain(("split",), f"""SELECT cell, replicate::INT AS replicate, {', '.join(f'{r(f"sum({c})")} AS {c}' for c in _DRAWN)} FROM (
    SELECT cell, rider_id, replicate, avg(hit) AS accept_rate, sum(hit) AS completed_rides, avg(quoted_fare) FILTER (WHERE hit = 1) AS mean_fare, 1.0::DOUBLE - avg(hit) AS abandonment_rate FROM (
    SELECT *, CASE WHEN {u(f'{SEED}:draw', "concat_ws(':', replicate, cell, offer_id)")} < p_accept THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM split, (SELECT unnest(range(1, {REDRAWS + 1})) AS replicate) WHERE period = 'post') GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
_SCREEN = ("lift", "se_total", "ci_low", "ci_high", "cuped_ci_low")
register("screen_rank", lambda i: pick(screening.screen(i.full), ("cell", "rank", "screen_in"), _SCREEN), chain(("screened",), f"SELECT cell, rank, CASE WHEN cuped_var_reduction > 0 THEN cuped_ci_low ELSE ci_low END > 0 AS screen_in, {', '.join(f'{r(c)} AS {c}' for c in _SCREEN)} FROM (SELECT *, lift - {screening.Z_975!r}::DOUBLE * se_total AS ci_low, lift + {screening.Z_975!r}::DOUBLE * se_total AS ci_high, lift - {screening.Z_975!r}::DOUBLE * se_cuped AS cuped_ci_low FROM screened)"))
register("recommendations", lambda i: screening.recommend(screening.screen(i.full).withColumn("_v", screening.backtest(i.full, i.trips, SCREEN_REPLICATES, SEED).select("verdict").scalar()), F.col("_v")).select("cell", "recommendation"),
         chain(("screened", "real_demand", "sim_ratio", "sim_boot"), f"""SELECT cell, CASE WHEN contains(cell, 'surge') AND NOT agrees THEN 'veto' WHEN lift - {screening.Z_975!r}::DOUBLE * CASE WHEN cuped_var_reduction > 0 THEN se_cuped ELSE se_total END > 0 THEN 'screen_in' ELSE 'hold' END AS recommendation
         FROM screened, (SELECT coalesce((SELECT log_ratio FROM sim_ratio) * ln((n_high / n_total::DOUBLE) / (n_low / n_total::DOUBLE)) > 0, FALSE) AS agrees FROM real_demand)"""))


def _by_config(i: Inputs) -> DataFrame:
    trace = decisions.trace_all(i.seen, None, SEED)
    per = fidelity.labeled_offers(trace).groupBy("config").agg(F.avg(F.pow(F.col("p_accept") - F.col("label"), 2)).alias("brier"), F.avg(F.col("accepted").cast("double")).alias("accept_rate"))
    base = per.where("config = 'full'").select("brier").scalar()
    return per.withColumn("brier_delta_vs_full", F.col("brier") - base)


register("brier_by_config", lambda i: pick(_by_config(i), ("config",), ("brier", "accept_rate", "brier_delta_vs_full")), chain(("trace",), f"""SELECT config, {r('b')} AS brier, {r('a')} AS accept_rate, {r("b - max(b) FILTER (WHERE config = 'full') OVER ()")} AS brier_delta_vs_full FROM (
    SELECT config, avg(pow(p_accept - CASE WHEN is_base THEN 1 ELSE 0 END, 2)) AS b, avg(accepted) AS a FROM trace WHERE is_base OR reject_counterfactual GROUP BY config)"""))
register("daily_volume", lambda i: screening.daily_volume(i.raw), chain(("raw",), "SELECT strftime(m, '%Y-%m') AS month, n, CAST(floor(n / day(last_day(m))) AS BIGINT) AS daily FROM (SELECT date_trunc('month', req) AS m, count(*) AS n FROM raw GROUP BY 1)"))


def _effects(i: Inputs) -> DataFrame:
    base = i.full
    daily = screening.daily_volume(i.raw).agg(F.max("daily").alias("d")).scalar()
    return screening.power_table(screening.effects_of(screening.screen(base), base), daily)


register("power_table", lambda i: pick(_effects(i), ("name", "n_per_arm"), ("p0", "p1", "days")), chain(("screened", "base_trace", "raw"), f"""SELECT name, n AS n_per_arm, {r('p0')} AS p0, {r('p1')} AS p1, {r(r('n / (daily * 0.5::DOUBLE)', 2))} AS days FROM (SELECT *, CAST(ceil(pow(1.959963984540054 * sqrt(2.0::DOUBLE * ((p0 + p1) / 2.0::DOUBLE) * (1.0::DOUBLE - (p0 + p1) / 2.0::DOUBLE)) + 0.8416212335729143 * sqrt(p0 * (1.0::DOUBLE - p0) + p1 * (1.0::DOUBLE - p1)), 2) / nullif((p1 - p0) * (p1 - p0), 0)) AS BIGINT) AS n FROM (
    SELECT cell AS name, {clip('c', 1e-6, 1 - 1e-6)} AS p0, {clip('c + lift', 1e-6, 1 - 1e-6)} AS p1 FROM screened, (SELECT avg(accepted) AS c FROM base_trace WHERE price_mult = 1 AND surge_mult = 1))), (SELECT max(CAST(floor(n / day(last_day(m))) AS BIGINT)) AS daily FROM (SELECT date_trunc('month', req) AS m, count(*) AS n FROM raw GROUP BY 1))"""))
register("backtest_real", lambda i: pick(screening.real_demand(i.trips), ("n_total", "n_high", "n_low"), ("share_high", "share_low", "log_ratio")), chain(("real_demand",), f"SELECT n_total, n_high, n_low, {r('n_high / n_total::DOUBLE')} AS share_high, {r('n_low / n_total::DOUBLE')} AS share_low, {r('ln((n_high / n_total::DOUBLE) / (n_low / n_total::DOUBLE))')} AS log_ratio FROM real_demand"))
register("backtest_sim", lambda i: pick(screening.simulated_demand(i.full), ("n_high", "n_low"), ("log_ratio",)), rounded(("sim_ratio",), "sim_ratio", ("n_high", "n_low"), ("log_ratio",)))
register("backtest_verdict", lambda i: pick(screening.backtest(i.full, i.trips, SCREEN_REPLICATES, SEED), ("direction_agrees", "ci_covers_real", "verdict"), ("real", "sim", "ci_low", "ci_high", "signed_error")), chain(("real_demand", "sim_ratio", "rider_boot"), f"""SELECT direction_agrees, ci_covers_real, CASE WHEN direction_agrees AND ci_covers_real THEN 'PASS' WHEN direction_agrees THEN 'PARTIAL' ELSE 'FAIL' END AS verdict, {', '.join(f'{r(c)} AS {c}' for c in ('real', 'sim', 'ci_low', 'ci_high', 'signed_error'))} FROM (
    SELECT *, sim - real AS signed_error, coalesce(sim * real > 0, FALSE) AS direction_agrees, coalesce(real BETWEEN ci_low AND ci_high, FALSE) AS ci_covers_real FROM (SELECT ln((n_high / n_total::DOUBLE) / (n_low / n_total::DOUBLE)) AS real FROM real_demand), (SELECT log_ratio AS sim FROM sim_ratio), (SELECT quantile_cont(log_ratio, 0.025) AS ci_low, quantile_cont(log_ratio, 0.975) AS ci_high FROM rider_boot))"""))


def _gate(i: Inputs) -> DataFrame:
    """The run's own figures against the published ones: all riders' discriminator, the four KS tests, the slope's sign."""
    metrics = fidelity.distribution_tests(i.full, i.real, SEED).agg(F.count_if("passed").cast("int").alias("ks_passed"))
    slope = fidelity.surge_elasticity(i.full).scalar()
    metrics = metrics.withColumns({"discriminator_auc": _discriminator(i).scalar(), "elasticity_sign": F.when(slope < 0, "negative").otherwise("positive")})
    return screening.gate_checks(metrics, i.spark.createDataFrame([GATE], "discriminator_auc double, discriminator_auc_tolerance double, min_ks_marginals_passed int, elasticity_sign string"))


#: The published baseline of the gate.
GATE = (1.0, 0.02, 2, "negative")
register("gate_checks", _gate, None)

_BAND = "least(round_even(surge * 2.0::DOUBLE, 0) / 2.0::DOUBLE, 5.0::DOUBLE)"
register("memory_recall_topk", lambda i: memory.recall(i.log), chain(("log",), f"""SELECT rider_id, seq, episode_seq, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY rider_id, seq ORDER BY similarity DESC, episode_seq DESC) AS rank FROM (SELECT o.rider_id, o.seq, e.seq AS episode_seq,
    (CASE WHEN e.purpose = o.purpose THEN 4 ELSE 0 END + CASE WHEN e.origin_zone = o.origin_zone THEN 3 ELSE 0 END + CASE WHEN e.b = o.b THEN 3 ELSE 0 END)::BIGINT AS similarity FROM (SELECT *, {_BAND} AS b FROM log) o JOIN (SELECT *, {_BAND} AS b FROM log) e ON o.rider_id = e.rider_id AND e.seq < o.seq)) WHERE rank <= 5"""))
_AGG = f"count(*) OVER w AS episodes_total, {r('sum(CAST(realized_fare AS DECIMAL(18,4))) OVER w::DOUBLE / count(realized_fare) OVER w', 2)} AS mean_fare_paid, {r('avg(CASE WHEN surge > 1.5 THEN accepted END) OVER w', 3)} AS accept_rate_high_surge, count(*) FILTER (WHERE realized_wait > eta_min + 10) OVER w AS bad_wait_experiences"
register("memory_aggregates", lambda i: memory.aggregates(i.log), chain(("log",), f"SELECT DISTINCT rider_id, {_AGG} FROM log WINDOW w AS (PARTITION BY rider_id)"))
register("memory_running", lambda i: memory.aggregates(i.log, running=True), chain(("log",), f"SELECT rider_id, seq, {_AGG} FROM log WINDOW w AS (PARTITION BY rider_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))


def _remembered(i: Inputs) -> DataFrame:
    """The event files as a stream through riders' memory, drained into a table."""
    schema = table(i.spark, i.folder, "events").schema
    i.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = streaming.event_stream(i.spark, i.folder, schema)
    decided = views.decisions_of(events).withColumn("event_time", F.col("ts").cast("timestamp"))
    return streaming.drain(i.spark, streaming_memory.remember(decided, late="3650 days"), new_path(i.spark, "memory-checkpoint"), new_path(i.spark, "memory"))


def _remembered_recall(i: Inputs) -> DataFrame:
    return _remembered(i).select("rider_id", "seq", F.posexplode("recalled").alias("at", "e")).select("rider_id", "seq", "e.episode_seq", "e.similarity", (F.col("at") + 1).cast("long").alias("rank"))


register("memory_stream_recall", _remembered_recall, _SQL["memory_recall_topk"])
register("memory_stream_running", lambda i: _remembered(i).drop("recalled", "offer_id"), _SQL["memory_running"])


def _conversations(i: Inputs) -> DataFrame:
    return table(i.spark, i.folder, "conversations")


def _cache(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests are all messages, the cache holds those up to turn 1, and new answers those from turn 1 on."""
    keyed = _conversations(i).select(F.sha2(F.concat_ws(":", "conv_id", "turn").cast("binary"), 256).alias("key"), F.col("text").alias("response_json"), F.col("turn").alias("created_at"))
    new = keyed.where("created_at >= 1").select("key", F.concat(F.lit("new:"), "response_json").alias("response_json"), (F.col("created_at") + 100).alias("created_at"))
    return keyed.where("created_at <= 1"), keyed, new


_KEYED = "(SELECT sha256(concat_ws(':', conv_id, turn)) AS key, text AS response_json, turn AS created_at FROM conversations)"
register("cache_upsert", lambda i: agent_io.cache_upsert(_cache(i)[0], _cache(i)[2]), f"SELECT key, CASE WHEN created_at >= 1 THEN 'new:' || response_json ELSE response_json END AS response_json, CASE WHEN created_at >= 1 THEN created_at + 100 ELSE created_at END AS created_at FROM {_KEYED}")
register("cache_misses", lambda i: agent_io.cache_misses(_cache(i)[1].select("key"), _cache(i)[0]), f"SELECT key FROM {_KEYED} WHERE created_at > 1")
register("cache_hits", lambda i: agent_io.cache_hits(_cache(i)[1].select("key"), _cache(i)[0]), f"SELECT key, response_json FROM {_KEYED} WHERE created_at <= 1")


def _stored_lookup(i: Inputs) -> DataFrame:
    """All requests against a cache at rest: two puts and a compaction between them."""
    cached, asked, new = _cache(i)
    path = new_path(i.spark, "cache")
    agent_io.cache_put(cached, path)
    agent_io.cache_vacuum(i.spark, agent_io.cache_compact(i.spark, path))
    agent_io.cache_put(new, path)
    return agent_io.cache_lookup(asked.select("key"), path).select("key", "response_json")


register("cache_lookup", _stored_lookup, f"SELECT key, CASE WHEN created_at >= 1 THEN 'new:' || response_json ELSE response_json END AS response_json FROM {_KEYED}")


def _pauses(i: Inputs) -> DataFrame:
    """A rider's time between two decisions, as the latency of the second."""
    before = F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("rider_id").orderBy("seq"))
    return i.log.select("action", ((F.unix_micros(F.col("ts").cast("timestamp")) - before) / 1000.0).alias("latency_ms"))


register("latency_percentiles", lambda i: pick(agent_io.latency_percentiles(_pauses(i), "latency_ms", "action"), ("action", "n"), ("latency_p50", "latency_p95"), 3),
         chain(("log",), f"SELECT action, count(*) AS n, {r('quantile_cont(ms, 0.5)', 3)} AS latency_p50, {r('quantile_cont(ms, 0.95)', 3)} AS latency_p95 FROM (SELECT action, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY rider_id ORDER BY seq)) / 1000.0::DOUBLE AS ms FROM log) WHERE ms IS NOT NULL GROUP BY action"))
register("token_cost", lambda i: pick(agent_io.token_cost(_conversations(i)), ("conv_id", "input_tokens", "output_tokens"), ("cost_usd",)), f"SELECT conv_id, i AS input_tokens, o AS output_tokens, {r('(i * 3.0::DOUBLE + o * 15.0::DOUBLE) / 1000000.0::DOUBLE')} AS cost_usd FROM (SELECT conv_id, CAST(coalesce(sum(t) FILTER (WHERE role <> 'assistant'), 0) AS BIGINT) AS i, CAST(coalesce(sum(t) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS o FROM (SELECT *, greatest(1, length(text) // 4) AS t FROM conversations) GROUP BY conv_id)")
_P, _M, _O = "'{\"rider_id\":' || rider_id || '}'", "'{\"seq\":' || seq || '}'", "'{\"offer_id\":' || offer_id || ',\"purpose\":\"' || purpose || '\"}'"
register("prompt_render", lambda i: i.log.select("offer_id", agent_io.render_prompt(agent_io.PROMPT, agent_io.canonical_json("rider_id"), agent_io.canonical_json("seq"), agent_io.canonical_json("purpose", "offer_id")).alias("prompt")).withColumns({"key": agent_io.cache_key("prompt"), "offer_json": agent_io.fenced_json("prompt", 2)}),
         chain(("log",), f"SELECT offer_id, prompt, sha256('{{\"prompt\":' || to_json(prompt) || '}}') AS key, {_O} AS offer_json FROM (SELECT *, replace(replace(replace('{agent_io.PROMPT}', '{{{{persona_json}}}}', {_P}), '{{{{memory_json}}}}', {_M}), '{{{{offer_json}}}}', {_O}) AS prompt FROM log)"))


def _outputs(i: Inputs) -> DataFrame:
    body = F.concat(F.lit('{"action": "'), "action", F.lit('", "reasoning": "fine", "confidence": '), (F.col("offer_id") % 7 / 5.0).cast("string"), F.lit(', "reservation_fare": '), (F.col("offer_id") % 11).cast("string"), F.lit(', "tools_called": []}'))
    text = F.when(F.col("offer_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("offer_id") % 5 == 1, F.concat(F.lit("So {not json} then "), body)).when(F.col("offer_id") % 5 == 2, "no decision").otherwise(body)
    return i.log.select("offer_id", text.alias("text"))


register("decision_parse", lambda i: agent_io.parse_decisions(_outputs(i)).select("offer_id", "error", F.col("decision.action").alias("action"), F.col("decision.reservation_fare").alias("reservation_fare")),
         chain(("log",), "SELECT offer_id, error, CASE WHEN error IS NULL THEN action END AS action, CASE WHEN error IS NULL THEN (offer_id % 11)::DOUBLE END AS reservation_fare FROM (SELECT *, CASE WHEN offer_id % 5 = 2 THEN 'no JSON object found in output' WHEN offer_id % 7 > 5 THEN 'confidence' END AS error FROM log)"))
def _script(i: Inputs) -> DataFrame:
    """Written answers for every event: decisions at once, after one round or two, calls without end, broken outputs, mended or not."""
    k = F.col("offer_id") % 6
    body = F.concat(F.lit('{"action": "'), "action", F.lit('", "reasoning": "fine", "confidence": 0.5, "reservation_fare": '), (F.col("offer_id") % 11).cast("string"), F.lit(', "tools_called": []}'))
    lane = F.create_map(F.lit("origin_zone"), F.col("origin_zone"), F.lit("dest_zone"), (F.col("offer_id") * 7 % 25 + 1).cast("long"))
    hour = F.create_map(F.lit("origin_zone"), F.col("origin_zone"), F.lit("hour"), (F.col("offer_id") % 24).cast("long"))
    call = lambda name, arguments: F.struct(F.lit("c").alias("id"), F.lit(name).alias("name"), arguments.alias("arguments"))
    price, eta, transit = call("check_price_history", lane), call("check_eta_reliability", hour), call("check_transit_alternative", lane)
    none = F.array().cast(tool_rounds.CALLS)
    steps = {
        "0": (F.when(k == 0, body).otherwise("let me see"), F.when(k == 1, F.array(price)).when(k == 2, F.array(price, eta)).when(k == 3, F.array(eta)).otherwise(none)),
        "1": (F.when(k == 1, body).otherwise("more"), F.when(k.isin(2, 3), F.array(transit)).otherwise(none)),
        "2": (F.when(k == 2, body).otherwise("and more"), F.when(k == 3, F.array(price)).otherwise(none)),
        tool_rounds.REPAIR: (F.when(k == 4, "still {no} decision").otherwise(body), none),
    }
    rows = F.array(*(F.struct(F.lit(step).alias("step"), content.alias("content"), calls.cast(tool_rounds.CALLS).alias("calls")) for step, (content, calls) in steps.items()))
    return i.log.select("offer_id", F.explode(rows).alias("r")).select("offer_id", "r.*")


def _tool_log(i: Inputs) -> DataFrame:
    lanes = ["pickup_zone", "dropoff_zone"]
    price = pick(lookups.price_history(i.trips), (*lanes, "scope", "n_trips"), ("market_fare_p50",), 2)
    eta = pick(lookups.eta_reliability(i.trips), ("pickup_zone", "pickup_hour", "scope", "n_trips"), ("wait_p50_minutes",), 2)
    transit = lookups.transit_alternative(i.trips, lookups.all_lanes(i.trips))
    lane = {"origin_zone": "pickup_zone", "dest_zone": "dropoff_zone"}
    tools = {"check_price_history": (price, lane), "check_eta_reliability": (eta, {"origin_zone": "pickup_zone", "hour": "pickup_hour"}), "check_transit_alternative": (transit, lane)}
    log = tool_rounds.converse(i.log, agent_io.canonical_json("offer_id", "purpose"), tools, tool_rounds.scripted(_script(i)), logged_at=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    seen = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "tool"), lambda m: m["content"]), ";")
    return log.select("offer_id", "action", "confidence", "reservation_fare", "prompt_version", F.array_join("tools_called", ",").alias("tools_called"), "parse_ok", F.date_format("logged_at", "yyyy-MM-dd").alias("logged_on"), F.size("messages").cast("long").alias("n_messages"), seen.alias("results"))


_SEEN = {
    "price": """'{"result":{"market_fare_p50":' || coalesce(CAST(round(p.market_fare_p50 * 100) / 100 AS VARCHAR), 'null') || ',"n_trips":' || coalesce(CAST(p.n_trips AS VARCHAR), 'null') || ',"scope":' || coalesce('"' || p.scope || '"', 'null') || '},"tool":"check_price_history"}'""",
    "eta": """'{"result":{"n_trips":' || coalesce(CAST(e.n_trips AS VARCHAR), 'null') || ',"scope":' || coalesce('"' || e.scope || '"', 'null') || ',"wait_p50_minutes":' || coalesce(CAST(round(e.wait_p50_minutes * 100) / 100 AS VARCHAR), 'null') || '},"tool":"check_eta_reliability"}'""",
    "transit": """'{"result":{"n_trips":' || coalesce(CAST(t.n_trips AS VARCHAR), 'null') || ',"transit_cost":' || coalesce(CAST(t.transit_cost AS VARCHAR), 'null') || ',"transit_minutes":' || coalesce(CAST(t.transit_minutes AS VARCHAR), 'null') || '},"tool":"check_transit_alternative"}'""",
}
register("tool_rounds", _tool_log, chain(("log",), f"""SELECT offer_id, CASE WHEN k = 4 THEN 'reject' ELSE action END AS action, CASE WHEN k = 4 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN k = 4 THEN round(quoted_fare * 100) / 100 ELSE (offer_id % 11)::DOUBLE END AS reservation_fare,
    'v1' AS prompt_version, CASE k WHEN 1 THEN 'check_price_history' WHEN 2 THEN 'check_price_history,check_eta_reliability,check_transit_alternative' WHEN 3 THEN 'check_eta_reliability,check_transit_alternative' ELSE '' END AS tools_called, k <> 4 AS parse_ok, '2024-01-01' AS logged_on,
    (CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 7 ELSE 3 END)::BIGINT AS n_messages,
    CASE k WHEN 1 THEN {_SEEN['price']} WHEN 2 THEN {_SEEN['price']} || ';' || {_SEEN['eta']} || ';' || {_SEEN['transit']} WHEN 3 THEN {_SEEN['eta']} || ';' || {_SEEN['transit']} ELSE '' END AS results
    FROM (SELECT *, offer_id % 6 AS k, offer_id * 7 % 25 + 1 AS dz, offer_id % 24 AS hr FROM log) l LEFT JOIN ({_SQL['lane_price_history']}) p ON p.pickup_zone = l.origin_zone AND p.dropoff_zone = l.dz
    LEFT JOIN ({_SQL['eta_reliability']}) e ON e.pickup_zone = l.origin_zone AND e.pickup_hour = l.hr LEFT JOIN ({_SQL['transit_alternative']}) t ON t.pickup_zone = l.origin_zone AND t.dropoff_zone = l.dz"""))
register("parquet_row_count", lambda i: arrival.footer_rows(i.spark, f"{i.folder}/lineitem.parquet").agg(F.sum("rows").alias("n")), "SELECT count(*) AS n FROM lineitem")


def _daily(i: Inputs) -> DataFrame:
    return streaming.windowed_accept_rate(table(i.spark, i.folder, "events").withColumn("event_time", F.col("ts").cast("timestamp"))).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "accepted")


register("windowed_accept_rate", _daily, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS accepted FROM events GROUP BY 1")


def _logit(i: Inputs) -> DataFrame:
    model = logit.fit_trips(i.trips, SEED)
    return pick(logit.logit_decisions(i.known, None, model, SEED), _DECISION, _DECISION_D)


register("logit_training_rows", lambda i: pick(logit.training_rows(i.trips, SEED).groupBy("action").agg(F.count("*").alias("n"), *(F.avg(f).alias(f) for f in logit.FEATURES)), ("action", "n"), logit.FEATURES), chain(("trips", "stats"), f"""SELECT action, count(*) AS n, {', '.join(f'{r(f"avg({f})")} AS {f}' for f in logit.FEATURES)} FROM (
    WITH b AS (SELECT tk, fare_paid / median_fare_paid AS fare_rel, {clip('surge_ratio', 1.0, 3.0)} AS surge, wait_secs / 60.0::DOUBLE AS eta_min, trip_miles / 12.0::DOUBLE * 60.0::DOUBLE AS transit_min, CASE WHEN pickup_zone IN (1, 132, 138) OR dropoff_zone IN (1, 132, 138) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_airport FROM trips t JOIN stats s ON t.rider_id = s.rider_id),
    h AS (SELECT * FROM b WHERE {u(f'{SEED}:half', 'tk')} < 0.5)
    SELECT 'accept' AS action, fare_rel, surge, eta_min, transit_min, is_airport FROM b UNION ALL SELECT 'reject', fare_rel * 1.8::DOUBLE, surge, eta_min, transit_min, is_airport FROM h
    UNION ALL SELECT 'wait_for_better', fare_rel * 1.3::DOUBLE, 2.5::DOUBLE, eta_min * 1.5::DOUBLE, transit_min, is_airport FROM h UNION ALL SELECT 'switch_mode', fare_rel, 1.8::DOUBLE, eta_min, eta_min * 0.6::DOUBLE, is_airport FROM h) GROUP BY action"""))
register("logit_baseline", _logit, None)


def _rider_features(i: Inputs) -> tuple[DataFrame, DataFrame]:
    order = [F.col("offer_id")]
    return features.sequence_features(i.real.withColumn("offer_id", F.col("tk")), i.real, order), features.sequence_features(i.full, i.real, order)


def _discriminator(i: Inputs) -> DataFrame:
    scores = fidelity.discriminator(*_rider_features(i), list(features.FEATURES), folds=5, trees=100)
    return S.auc(scores.withColumn("label", (~F.col("is_real")).cast("int")), "score", "label").select(six("auc").alias("auc"))


register("discriminator_auc", _discriminator, None)
register("discriminator_importances", lambda i: fidelity.importances(*_rider_features(i), list(features.FEATURES), trees=100), None)
register("discriminator_interval", lambda i: pick(fidelity.auc_interval(fidelity.discriminator(*_rider_features(i), list(features.FEATURES), folds=5, trees=100), INTERVAL, SEED), (), ("auc", "auc_ci_low", "auc_ci_high")), None)


def _traces(i: Inputs) -> dict[str, DataFrame]:
    """The trace of each of the seven configurations."""
    fitted = lambda: logit.logit_decisions(i.known, None, logit.fit_trips(i.trips, SEED), SEED)
    return {c: fitted() if c == "logit_baseline" else decisions.trace_all(i.seen, None, SEED, (c,)) for c in decisions.CONFIGS}


def _matrix(i: Inputs) -> DataFrame:
    """All 21 pairs of configurations by the discriminator's own scores."""
    order, real = [F.col("offer_id")], i.real
    ours = materialize(features.sequence_features(real.withColumn("offer_id", F.col("tk")), real, order), "real-features")
    told = {c: (ours, features.sequence_features(trace, real, order)) for c, trace in _traces(i).items()}
    scores, _ = fidelity.discriminate_all(told, list(features.FEATURES), folds=5, trees=100, final=False)
    return pick(fidelity.permutation_test(scores, PERMUTATIONS, SEED), ("config_a", "config_b"), ("auc_difference", "p_value"))


register("permutation_matrix", _matrix, None)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
