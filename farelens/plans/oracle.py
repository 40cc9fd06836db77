"""Independent DuckDB SQL for the registered queries: named steps, chained into one statement each."""

from __future__ import annotations

from farelens.functions.rand import LISTED, QUANTILE, TAIL

SEED = 7


def u(seed: str, *keys: str) -> str:
    joined = ", ".join((f"'{seed}'", *keys))
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {joined})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def u32(seed: str, replicate: str, *keys: str) -> str:
    """The uniform number of a replicate: eight digits of a hash that four replicates share."""
    joined = ", ".join((f"'{seed}'", f"({replicate} - 1) // 4", *keys))
    return f"((CAST(('0x' || substr(md5(concat_ws(':', {joined})), CAST(1 + 8 * (({replicate} - 1) % 4) AS INT), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def drawn_rows(rows: str, replicates: int, seed: str, key: str) -> str:
    """Each row and replicate with its own Poisson(1) count ``w``, by 32 bits of a hash that eight replicates share."""
    digits = f"substr(sha256(concat_ws(':', '{seed}', (replicate - 1) // 8, {key})), CAST(1 + 8 * ((replicate - 1) % 8) AS INT), 8)"
    total, term, count = 0.0, 0.36787944117144233, ""
    for k in range(13):
        total += term
        count += f" WHEN u < {total!r}::DOUBLE THEN {k}"
        term /= k + 1
    return f"(SELECT * EXCLUDE (u), CASE{count} ELSE 13 END AS w FROM (SELECT d.*, replicate, (CAST(('0x' || {digits}) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM {rows} d, (SELECT unnest(range(1, {replicates + 1})) AS replicate)))"


def horner(x: str, parts: tuple[float, ...]) -> str:
    out = f"{parts[0]!r}::DOUBLE"
    for c in parts[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def quantile(u: str) -> str:
    """The standard normal quantile of a column named ``u``."""
    centre, under, top, bottom = QUANTILE
    tail = lambda p: f"({horner(f'sqrt(-2.0::DOUBLE * ln({p}))', top)} / {horner(f'sqrt(-2.0::DOUBLE * ln({p}))', bottom)})"
    q = f"({u} - 0.5::DOUBLE)"
    return f"CASE WHEN {u} < {TAIL} THEN {tail(u)} WHEN {u} > {1.0 - TAIL} THEN -{tail(f'(1.0::DOUBLE - {u})')} ELSE {q} * {horner(f'({q} * {q})', centre)} / {horner(f'({q} * {q})', under)} END"


def drawn_cells(cells: str, replicates: int, seed: str, keys: tuple[str, ...]) -> str:
    """Each cell (with ``m`` equal rows) and replicate with the Poisson(m) count ``w``.

    Small cells count the entries of a distribution function below their uniform number; the function comes from the closed form of its
    terms. Large ones use the expansion in the normal quantile.
    """
    return f"""(SELECT * EXCLUDE (u, z, cdf), CASE WHEN m <= {LISTED} THEN len(list_filter(cdf, lambda c: c < u)) ELSE greatest(0, CAST(floor(m + sqrt(m::DOUBLE) * z + (z * z - 1.0::DOUBLE) / 6.0::DOUBLE + ((z * z * z - 3.0::DOUBLE * z) / 24.0::DOUBLE - (2.0::DOUBLE * z * z * z - 5.0::DOUBLE * z) / 36.0::DOUBLE) / sqrt(m::DOUBLE) + 0.5::DOUBLE) AS BIGINT)) END AS w FROM (
        SELECT *, {quantile('u')} AS z FROM (SELECT c.*, replicate, {u32(seed, 'replicate', *keys)} AS u FROM {cells} c, (SELECT unnest(range(1, {replicates + 1})) AS replicate))) LEFT JOIN (
        SELECT m AS dm, list(p ORDER BY k) AS cdf FROM (SELECT m, k, sum(exp(k * ln(m::DOUBLE) - m - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY m ORDER BY k) AS p FROM (SELECT DISTINCT m FROM {cells} WHERE m <= {LISTED}), LATERAL (SELECT unnest(range(0, CAST(ceil(m + 12 * sqrt(m::DOUBLE) + 12) AS BIGINT) + 1)) AS k)) GROUP BY m) ON dm = m)"""


def r(x: str, digits: int = 6) -> str:
    return f"(round(({x}) * {10**digits}::DOUBLE) / {10**digits}::DOUBLE)"


def purpose(p: str = "pickup_zone", d: str = "dropoff_zone", h: str = "pickup_hour", w: str = "is_weekend") -> str:
    return f"CASE WHEN {p} IN (1, 132, 138) OR {d} IN (1, 132, 138) THEN 'airport' WHEN {h} >= 21 OR {h} <= 4 THEN 'social' WHEN {w} = 0 AND ({h} BETWEEN 6 AND 9 OR {h} BETWEEN 15 AND 19) THEN 'commute' ELSE 'errand' END"


def clip(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE)"


def logistic(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


def band(c: str, lo: float, hi: float) -> str:
    return f"({c} >= {lo} AND {c} < {hi})"


def rule(sens: str, tol: str) -> str:
    return logistic(f"2.0::DOUBLE - 2.5::DOUBLE * {sens} * (surge - 1.0::DOUBLE) - 1.5::DOUBLE * (eta_shown - {tol}) / greatest({tol}, 1.0::DOUBLE)")


#: step -> (steps it reads, its SQL)
STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "waits": ((), """SELECT *, CASE WHEN l_partkey % 97 = 0 THEN -60.0::DOUBLE ELSE ((l_partkey * 37 + l_suppkey * 11) % 1200 + 30)::DOUBLE END + (l_linenumber % 4) * 0.25::DOUBLE AS dt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""),
    "raw": (("waits",), """SELECT o_custkey::BIGINT AS rider_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS tk,
        (c_nationkey + 1)::BIGINT AS pu, (s_nationkey + 1)::BIGINT AS dz, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS req, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) + to_microseconds(CAST(dt * 1000000 AS BIGINT)) AS pick,
        l_quantity / 5.0::DOUBLE AS trip_miles, l_quantity * 36.0::DOUBLE AS trip_time, l_extendedprice / 1000.0::DOUBLE AS base_passenger_fare,
        l_extendedprice / 1000.0::DOUBLE * greatest(l_tax - 0.04::DOUBLE, 0.0::DOUBLE) AS tips, l_extendedprice / 1000.0::DOUBLE * (1 - l_discount) AS driver_pay FROM waits"""),
    "ppm": (("raw",), "SELECT median(driver_pay / trip_miles) AS median_ppm FROM raw WHERE trip_miles > 0 AND driver_pay >= 0 AND base_passenger_fare > 0"),
    "trips": (("raw", "ppm"), """SELECT rider_id, tk, pu AS pickup_zone, dz AS dropoff_zone, CAST(extract('hour' FROM pick) AS BIGINT) AS pickup_hour, CASE WHEN dayofweek(pick) IN (0, 6) THEN 1 ELSE 0 END::BIGINT AS is_weekend,
        (CASE WHEN trip_miles < 1 THEN 0 WHEN trip_miles < 2 THEN 1 WHEN trip_miles < 4 THEN 2 WHEN trip_miles < 8 THEN 3 ELSE 4 END)::BIGINT AS miles_bucket, base_passenger_fare, tips, trip_miles, trip_time,
        least(greatest(CAST(round_even(epoch_us(pick) / 1000000.0::DOUBLE - epoch_us(req) / 1000000.0::DOUBLE, 0) AS BIGINT), 0), 3600)::BIGINT AS wait_secs, driver_pay, base_passenger_fare + tips AS fare_paid,
        least(greatest(driver_pay / (trip_miles * median_ppm), 0.0::DOUBLE), 10.0::DOUBLE) AS surge_ratio
        FROM raw, ppm WHERE trip_miles > 0 AND trip_time > 0 AND base_passenger_fare > 0 AND driver_pay >= 0 AND pick >= req"""),
    "stats": (("trips",), """SELECT rider_id, median(fare_paid) AS median_fare_paid, median(fare_paid / trip_miles) AS median_fpm, median(trip_miles) AS median_miles, median(wait_secs) / 60.0::DOUBLE AS median_wait_min,
        quantile_cont(wait_secs, 0.75) / 60.0::DOUBLE AS p75_wait_min, avg(CASE WHEN tips > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tip_rate, count(*) AS observed_trip_count FROM trips GROUP BY rider_id"""),
    "ranked": (("stats",), """SELECT *, (rank() OVER (ORDER BY median_fpm) + (count(*) OVER (PARTITION BY median_fpm) - 1) / 2.0::DOUBLE) / count(*) OVER () AS fare_pctl,
        (rank() OVER (ORDER BY median_fare_paid) + (count(*) OVER (PARTITION BY median_fare_paid) - 1) / 2.0::DOUBLE) / count(*) OVER () AS spend_pctl FROM stats"""),
    "mix": (("trips",), "SELECT rider_id, " + ", ".join(f"avg(CASE WHEN p = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {k}" for k in ("commute", "social", "errand", "airport")) + f" FROM (SELECT rider_id, {purpose()} AS p FROM trips) GROUP BY rider_id"),
    "riders": (("trips",), """SELECT a.rider_id, home_zone, work_zone, n AS observed_trip_count FROM
        (SELECT rider_id, pickup_zone AS home_zone, row_number() OVER (PARTITION BY rider_id ORDER BY count(*) DESC, pickup_zone) AS k FROM trips GROUP BY rider_id, pickup_zone) a
        JOIN (SELECT rider_id, dropoff_zone AS work_zone, row_number() OVER (PARTITION BY rider_id ORDER BY count(*) DESC, dropoff_zone) AS k FROM trips GROUP BY rider_id, dropoff_zone) b ON a.rider_id = b.rider_id AND a.k = 1 AND b.k = 1
        JOIN (SELECT rider_id, count(*) AS n FROM trips GROUP BY rider_id) c ON a.rider_id = c.rider_id"""),
    "personas": (("riders", "ranked", "mix"), """SELECT rider_id, home_zone, work_zone, commute, social, errand, airport, price_sensitivity, wait_tolerance_minutes, income_bracket,
        median_miles <= 2.5 AND price_sensitivity >= 0.55 AS has_transit_alternative, loyalty_tier, observed_trip_count, median_fare_paid, median_wait_min AS median_wait_experienced FROM (
        SELECT r.rider_id, home_zone, work_zone, commute, social, errand, airport, least(greatest(1.0::DOUBLE - (0.6::DOUBLE * fare_pctl + 0.4::DOUBLE * tip_rate), 0.0::DOUBLE), 1.0::DOUBLE) AS price_sensitivity,
        greatest(p75_wait_min, 1.25::DOUBLE * median_wait_min, 0.5::DOUBLE) AS wait_tolerance_minutes,
        CASE WHEN spend_pctl < 0.25 THEN 'low' WHEN spend_pctl < 0.5 THEN 'middle' WHEN spend_pctl < 0.75 THEN 'upper_middle' ELSE 'high' END AS income_bracket,
        CASE WHEN r.observed_trip_count < 8 THEN 'member' WHEN r.observed_trip_count < 15 THEN 'silver' WHEN r.observed_trip_count < 25 THEN 'gold' ELSE 'platinum' END AS loyalty_tier,
        r.observed_trip_count, median_fare_paid, median_wait_min, median_miles FROM riders r JOIN ranked s ON r.rider_id = s.rider_id JOIN mix m ON r.rider_id = m.rider_id)"""),
    "lane": (("trips",), "SELECT pickup_zone, dropoff_zone, count(*) AS n, median(fare_paid) AS p50, quantile_cont(fare_paid, 0.9) AS p90, median(trip_miles) AS miles FROM trips GROUP BY pickup_zone, dropoff_zone"),
    "zone": (("trips",), "SELECT pickup_zone, count(*) AS n, median(fare_paid) AS p50, quantile_cont(fare_paid, 0.9) AS p90, median(trip_miles) AS miles, median(wait_secs) / 60.0::DOUBLE AS w50, quantile_cont(wait_secs, 0.9) / 60.0::DOUBLE AS w90 FROM trips GROUP BY pickup_zone"),
    "city": (("trips",), "SELECT median(fare_paid) AS p50, quantile_cont(fare_paid, 0.9) AS p90 FROM trips"),
    "scoped": (("lane", "zone"), "SELECT l.pickup_zone, l.dropoff_zone, l.n, CASE WHEN l.n >= 20 THEN 'lane' WHEN z.n >= 100 THEN 'origin_zone' ELSE 'citywide' END AS scope, l.p50 AS l50, l.p90 AS l90, z.p50 AS z50, z.p90 AS z90 FROM lane l JOIN zone z USING (pickup_zone)"),
    "grid": ((), "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE), (1, 0.8::DOUBLE, 1.0::DOUBLE), (2, 1.25::DOUBLE, 1.0::DOUBLE), (3, 1.8::DOUBLE, 1.0::DOUBLE), (4, 1.0::DOUBLE, 2.0::DOUBLE), (5, 1.25::DOUBLE, 2.0::DOUBLE)) g(variant, price_mult, surge_mult)"),
    "simgrid": ((), "SELECT * FROM (VALUES (0, 0.8::DOUBLE, 1.0::DOUBLE), (1, 1.0::DOUBLE, 1.0::DOUBLE), (2, 1.25::DOUBLE, 1.0::DOUBLE), (3, 1.0::DOUBLE, 0.5::DOUBLE), (4, 1.0::DOUBLE, 2.0::DOUBLE)) g(variant, price_mult, wait_mult)"),
    "bases": (("trips",), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY {u(str(SEED), 'tk')}, tk) - 1 AS trip_index FROM trips) WHERE trip_index < 4"),
    "offers": (("bases", "grid", "lane"), f"""SELECT rider_id, offer_id, pickup_zone AS origin_zone, dropoff_zone AS dest_zone, purpose, pickup_hour, quoted_fare, surge, eta_min, eta_framing, discount_pct, time_of_day,
        (['clear', 'rain', 'snow'])[CAST(floor({u(f'{SEED}:weather', 'offer_id')} * 3) AS BIGINT) + 1] AS weather, transit_alt_minutes, price_mult, surge_mult, price_mult = 1 AND surge_mult = 1 AS is_base, price_mult = 1.8 AND surge_mult = 1 AS reject_counterfactual
        FROM (SELECT b.rider_id, 'r' || b.rider_id || 't' || trip_index || 'v' || variant AS offer_id, b.pickup_zone, b.dropoff_zone, {purpose('b.pickup_zone', 'b.dropoff_zone')} AS purpose, pickup_hour, {r('fare_paid * price_mult', 2)} AS quoted_fare,
        {r(f"least({clip('surge_ratio', 1.0, 3.0)} * surge_mult, 5.0::DOUBLE)", 2)} AS surge, wait_secs / 60.0::DOUBLE AS eta_min, (['numeric', 'range', 'reassuring'])[variant % 3 + 1] AS eta_framing,
        CASE WHEN price_mult < 1 THEN {r('(1.0::DOUBLE - price_mult) * 100.0::DOUBLE', 1)} ELSE 0.0::DOUBLE END AS discount_pct,
        CASE WHEN pickup_hour <= 5 THEN 'night' WHEN pickup_hour <= 11 THEN 'morning' WHEN pickup_hour <= 16 THEN 'midday' ELSE 'evening' END AS time_of_day, {r('l.miles / 12.0::DOUBLE * 60.0::DOUBLE', 1)} AS transit_alt_minutes, price_mult, surge_mult
        FROM bases b, grid JOIN lane l ON TRUE WHERE b.pickup_zone = l.pickup_zone AND b.dropoff_zone = l.dropoff_zone)"""),
    "shown": (("offers", "personas"), f"SELECT o.*, {r('eta_min', 1)} AS eta_shown, price_sensitivity, wait_tolerance_minutes, income_bracket, loyalty_tier, has_transit_alternative FROM offers o JOIN personas p ON o.rider_id = p.rider_id"),
    "probs": (("shown",), f"SELECT unnest(['full', 'prompt_v2', 'no_memory', 'no_tools']) AS config, *, {rule('price_sensitivity', 'wait_tolerance_minutes')} AS p FROM shown UNION ALL SELECT 'demographics_only' AS config, *, {rule('0.5::DOUBLE', '5.0::DOUBLE')} AS p FROM shown"),
    "ruled": (("probs",), f"""SELECT * EXCLUDE (p), action, confidence, {r('quoted_fare * (1.0::DOUBLE + 0.8::DOUBLE * greatest(p - 0.5::DOUBLE, 0.0::DOUBLE))', 2)} AS reservation_fare, CASE WHEN action = 'accept' THEN confidence ELSE 1.0::DOUBLE - confidence END AS p_accept FROM (
        SELECT *, CASE WHEN p >= 0.6 THEN 'accept' WHEN surge > 1.5 AND p >= 0.35 THEN 'wait_for_better' WHEN transit_alt_minutes < eta_shown AND surge > 1.2 THEN 'switch_mode' ELSE 'reject' END AS action, {r('2.0::DOUBLE * abs(p - 0.5::DOUBLE)', 3)} AS confidence FROM probs)"""),
    "randomized": (("shown",), f"""SELECT 'random_baseline' AS config, *, (['accept', 'reject', 'wait_for_better', 'switch_mode'])[CAST(floor({u(f'{SEED}:action', 'offer_id')} * 4) AS BIGINT) + 1] AS action, {u(f'{SEED}:confidence', 'offer_id')} AS confidence,
        {r(f"quoted_fare * (0.9::DOUBLE + 0.4::DOUBLE * {u(f'{SEED}:fare', 'offer_id')})", 2)} AS reservation_fare, 0.25::DOUBLE AS p_accept FROM shown"""),
    "trace": (("ruled", "randomized"), "SELECT *, CASE WHEN action = 'accept' THEN 1 ELSE 0 END::BIGINT AS accepted FROM (SELECT * FROM ruled UNION ALL BY NAME SELECT * FROM randomized)"),
    "base_trace": (("trace",), "SELECT * FROM trace WHERE config = 'full'"),
    "choices": (("bases", "simgrid", "personas"), f"""SELECT *, {u(f'{SEED}:choice', "concat_ws(':', tk, variant)")} < p AS accepted FROM (
        SELECT b.rider_id, tk, variant, price_mult, wait_mult, fare_paid * price_mult AS offered_fare, wait_secs / 60.0::DOUBLE * wait_mult AS offered_wait_min,
        {logistic('2.0::DOUBLE - 2.5::DOUBLE * price_sensitivity * (price_mult - 1.0::DOUBLE) - 1.5::DOUBLE * (wait_secs / 60.0::DOUBLE * wait_mult - wait_tolerance_minutes) / greatest(wait_tolerance_minutes, 1.0::DOUBLE)')} AS p
        FROM bases b JOIN personas p ON b.rider_id = p.rider_id CROSS JOIN simgrid)"""),
    "labeled": (("base_trace",), "SELECT *, CASE WHEN is_base THEN 1 ELSE 0 END AS label FROM base_trace WHERE is_base OR reject_counterfactual"),
    "cuts": (("labeled",), "SELECT quantile_cont(price_sensitivity, 1.0/3.0) AS p1, quantile_cont(price_sensitivity, 2.0/3.0) AS p2, quantile_cont(wait_tolerance_minutes, 1.0/3.0) AS w1, quantile_cont(wait_tolerance_minutes, 2.0/3.0) AS w2 FROM (SELECT price_sensitivity::DOUBLE AS price_sensitivity, wait_tolerance_minutes FROM labeled)"),
    "segments": (("labeled", "cuts"), """SELECT labeled.*, unnest(['overall', 'price_sensitivity=' || CASE WHEN price_sensitivity <= p1 THEN 'low' WHEN price_sensitivity > p2 THEN 'high' ELSE 'mid' END,
        'wait_tolerance_minutes=' || CASE WHEN wait_tolerance_minutes <= w1 THEN 'low' WHEN wait_tolerance_minutes > w2 THEN 'high' ELSE 'mid' END, 'has_transit_alternative=' || CASE WHEN has_transit_alternative THEN 'True' ELSE 'False' END]) AS segment FROM labeled, cuts"""),
    "real": (("trips",), f"SELECT rider_id, tk, fare_paid AS quoted_fare, {clip('surge_ratio', 1.0, 3.0)} AS surge, wait_secs / 60.0::DOUBLE AS eta_min, {purpose()} AS purpose, 1::BIGINT AS accepted, pickup_hour FROM trips"),
    "log": ((), f"""SELECT *, CASE WHEN accepted = 1 AND offer_id % 3 <> 0 THEN round(quoted_fare * 105) / 100 END AS realized_fare, CASE WHEN accepted = 1 THEN eta_min + offer_id % 25 END AS realized_wait FROM (
        SELECT *, CASE WHEN action = 'accept' THEN 1 ELSE 0 END::BIGINT AS accepted FROM (SELECT user_id::BIGINT AS rider_id, event_id::BIGINT AS offer_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
        CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'wait_for_better' WHEN 'view' THEN 'switch_mode' ELSE 'reject' END AS action, (['commute', 'social', 'errand', 'airport'])[event_id % 4 + 1] AS purpose,
        event_id % 25 + 1 AS origin_zone, round(value * 100) / 100 AS quoted_fare, 1 + (event_id % 13) / 8.0::DOUBLE AS surge, (event_id * 7 % 200) / 10.0::DOUBLE AS eta_min FROM events))"""),
    "entropy": (("log",), "SELECT rider_id, -sum(p * ln(p)) AS action_entropy FROM (SELECT rider_id, count(*) / sum(count(*)) OVER (PARTITION BY rider_id)::DOUBLE AS p FROM log GROUP BY rider_id, action) GROUP BY rider_id"),
    "runs": (("log",), """SELECT rider_id, coalesce(avg(n) FILTER (WHERE accepted = 1), 0)::DOUBLE AS run_accept_mean, coalesce(max(n) FILTER (WHERE accepted = 1), 0)::DOUBLE AS run_accept_max FROM (
        SELECT rider_id, accepted, island, count(*) AS n FROM (SELECT rider_id, accepted, row_number() OVER (PARTITION BY rider_id ORDER BY seq) - row_number() OVER (PARTITION BY rider_id, accepted ORDER BY seq) AS island FROM log) GROUP BY ALL) GROUP BY rider_id"""),
    "edges": (("base_trace",), "SELECT " + ", ".join(f"quantile_cont(surge, {k / 8}) AS e{k}" for k in range(9)) + " FROM base_trace"),
    "banded": (("base_trace", "edges"), "SELECT base_trace.*, greatest(1, least(8, " + " + ".join(f"CAST(e{k} < surge AS INT)" for k in range(9)) + ")) AS band FROM base_trace, edges"),
    "bands": (("banded",), "SELECT band::BIGINT AS band, avg(surge) AS mean_surge, count(*) AS n, (sum(accepted) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE) AS rate FROM banded GROUP BY band"),
    "celled": (("base_trace",), "SELECT *, CASE WHEN price_mult = 1 AND surge_mult = 1 THEN 'control' WHEN price_mult = 0.8 AND surge_mult = 1 THEN 'price_-20' WHEN price_mult = 1.25 AND surge_mult = 1 THEN 'price_+25' WHEN price_mult = 1.8 AND surge_mult = 1 THEN 'price_+80' WHEN price_mult = 1 AND surge_mult = 2 THEN 'surge_2x' WHEN price_mult = 1.25 AND surge_mult = 2 THEN 'price_+25_surge_2x' END AS cell FROM base_trace"),
    "split": (("celled",), "SELECT *, CASE WHEN row_number() OVER (PARTITION BY cell, rider_id ORDER BY offer_id) <= greatest(1, floor(count(*) OVER (PARTITION BY cell, rider_id) * 0.5)) THEN 'pre' ELSE 'post' END AS period FROM celled WHERE cell IS NOT NULL"),
    "metrics": (("split",), "SELECT cell, period, rider_id, avg(accepted) AS accept_rate, sum(accepted)::DOUBLE AS completed_rides, avg(quoted_fare) FILTER (WHERE accepted = 1) AS mean_fare, 1.0::DOUBLE - avg(accepted) AS abandonment_rate FROM split GROUP BY cell, period, rider_id"),
    "long": (("metrics",), "SELECT cell, period, rider_id, unnest(['accept_rate', 'completed_rides', 'mean_fare', 'abandonment_rate']) AS metric, unnest([accept_rate, completed_rides, mean_fare, abandonment_rate]) AS value FROM metrics"),
    "deltas": (("long",), """SELECT t.cell, t.rider_id, t.metric, t.value - c.value AS delta, x.value AS covariate FROM long t JOIN long c ON t.rider_id = c.rider_id AND t.metric = c.metric AND c.cell = 'control' AND c.period = 'post'
        LEFT JOIN long x ON t.rider_id = x.rider_id AND t.metric = x.metric AND x.cell = 'control' AND x.period = 'pre' WHERE t.cell <> 'control' AND t.period = 'post'"""),
    "lifts0": (("deltas",), "SELECT cell, metric, count(*) AS n, avg(delta) AS lift, var_pop(delta) AS vd, var_pop(covariate) AS vx, covar_samp(delta, covariate) AS cs, covar_pop(delta, covariate) AS cp FROM deltas WHERE delta IS NOT NULL AND covariate IS NOT NULL GROUP BY cell, metric"),
    "lifts": (("lifts0",), """SELECT cell, metric, n, lift, sqrt(vd / n) AS se_rider, theta, CASE WHEN ok THEN 1.0::DOUBLE - adj / vd ELSE 0.0::DOUBLE END AS cuped_var_reduction, sqrt(greatest(adj, 0.0::DOUBLE) / n) AS se_rider_cuped FROM (
        SELECT *, vd - 2 * theta * cp + theta * theta * vx AS adj FROM (SELECT *, vx > 0 AND vd > 0 AND n >= 3 AS ok, CASE WHEN vx > 0 AND vd > 0 AND n >= 3 THEN cs / vx ELSE 0.0::DOUBLE END AS theta FROM lifts0))"""),
    "noise0": (("split",), "SELECT cell, rider_id, sum(p_accept * (1 - p_accept)) / (count(*) * count(*))::DOUBLE AS v FROM split WHERE period = 'post' GROUP BY cell, rider_id"),
    "noise": (("noise0",), "SELECT a.cell, sqrt(avg(a.v + b.v) / count(*)) AS se_sampling FROM noise0 a JOIN noise0 b ON a.rider_id = b.rider_id AND b.cell = 'control' WHERE a.cell <> 'control' GROUP BY a.cell"),
    "screened": (("lifts", "noise"), """SELECT *, row_number() OVER (ORDER BY lift DESC NULLS LAST, cell) AS rank FROM (SELECT l.*, se_sampling, sqrt(se_rider * se_rider + se_sampling * se_sampling) AS se_total,
        sqrt(se_rider_cuped * se_rider_cuped + se_sampling * se_sampling) AS se_cuped FROM lifts l JOIN noise USING (cell) WHERE metric = 'accept_rate')"""),
    "real_demand": (("trips",), f"SELECT count(*) AS n_total, count(*) FILTER (WHERE {band('surge_ratio', 2.0, 3.0)}) AS n_high, count(*) FILTER (WHERE {band('surge_ratio', 1.0, 1.2)}) AS n_low FROM trips"),
    "sim_demand": (("base_trace",), f"""SELECT count(*) FILTER (WHERE {band('surge', 2.0, 3.0)}) AS n_high, count(*) FILTER (WHERE {band('surge', 1.0, 1.2)}) AS n_low,
        coalesce(sum(accepted) FILTER (WHERE {band('surge', 2.0, 3.0)}), 0) AS k_high, coalesce(sum(accepted) FILTER (WHERE {band('surge', 1.0, 1.2)}), 0) AS k_low FROM base_trace"""),
}

_RATIO = "ln(((k_high + 0.5::DOUBLE) / (n_high + 1.0::DOUBLE)) / ((k_low + 0.5::DOUBLE) / (n_low + 1.0::DOUBLE)))"
STEPS["sim_ratio"] = (("sim_demand",), f"SELECT n_high, n_low, CASE WHEN n_high >= 5 AND n_low >= 5 THEN {_RATIO} END AS log_ratio FROM sim_demand")
STEPS["alike_riders"] = (("base_trace",), f"""SELECT n_high, n_low, k_high, k_low, count(*) AS m FROM (SELECT rider_id, count(*) FILTER (WHERE {band('surge', 2.0, 3.0)}) AS n_high, count(*) FILTER (WHERE {band('surge', 1.0, 1.2)}) AS n_low,
    CAST(coalesce(sum(accepted) FILTER (WHERE {band('surge', 2.0, 3.0)}), 0) AS BIGINT) AS k_high, CAST(coalesce(sum(accepted) FILTER (WHERE {band('surge', 1.0, 1.2)}), 0) AS BIGINT) AS k_low FROM base_trace GROUP BY rider_id) GROUP BY 1, 2, 3, 4""")
STEPS["rider_sums"] = (("base_trace",), f"""SELECT rider_id, count(*) FILTER (WHERE {band('surge', 2.0, 3.0)}) AS n_high, count(*) FILTER (WHERE {band('surge', 1.0, 1.2)}) AS n_low,
    CAST(coalesce(sum(accepted) FILTER (WHERE {band('surge', 2.0, 3.0)}), 0) AS BIGINT) AS k_high, CAST(coalesce(sum(accepted) FILTER (WHERE {band('surge', 1.0, 1.2)}), 0) AS BIGINT) AS k_low FROM base_trace GROUP BY rider_id""")
STEPS["rider_boot"] = (("rider_sums", "sim_ratio"), f"""SELECT replicate, CASE WHEN n_high > 0 AND n_low > 0 THEN {_RATIO} ELSE (SELECT log_ratio FROM sim_ratio) END AS log_ratio FROM (
    SELECT replicate, sum(w * n_high) AS n_high, sum(w * n_low) AS n_low, sum(w * k_high) AS k_high, sum(w * k_low) AS k_low FROM {drawn_rows('rider_sums', 1000, f'{SEED}:backtest', 'rider_id')} GROUP BY replicate)""")
STEPS["sim_boot"] = (("alike_riders", "sim_ratio"), f"""SELECT replicate, CASE WHEN n_high > 0 AND n_low > 0 THEN {_RATIO} ELSE (SELECT log_ratio FROM sim_ratio) END AS log_ratio FROM (
    SELECT replicate, sum(w * n_high) AS n_high, sum(w * n_low) AS n_low, sum(w * k_high) AS k_high, sum(w * k_low) AS k_low FROM {drawn_cells('alike_riders', 1000, f'{SEED}:backtest', ('n_high', 'n_low', 'k_high', 'k_low'))} GROUP BY replicate)""")


def chain(needs: tuple[str, ...], select: str) -> str:
    """``select`` with every step that it needs before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in STEPS[name][0]:
                visit(n)
            order.append(name)

    for name in needs:
        visit(name)
    steps = ",\n".join(f'"{n}" AS MATERIALIZED ({_quoted(STEPS[n][1])})' for n in order)
    return (f"WITH {steps}\n" if steps else "") + _quoted(select)


def _quoted(sql: str) -> str:
    return sql


def rounded(needs: tuple[str, ...], source: str, exact: tuple[str, ...], doubles: tuple[str, ...], where: str = "") -> str:
    """Columns of a source as they are, and doubles at six places."""
    return chain(needs, f"SELECT {', '.join((*exact, *(f'{r(d)} AS {d}' for d in doubles)))} FROM {source} {where}")
