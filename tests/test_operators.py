"""Known truths, invariants and edge cases of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import rand
from farelens.functions import stats as S
from farelens.functions.rand import hash_uniform
from farelens.operators import agent_io, decisions, features, fidelity, logit, lookups, memory, offers, panel, personas, screening, trips
from farelens.plans.registry import Inputs
from farelens.sources import tables
from farelens.sources.views import raw_trips


@pytest.fixture(scope="module")
def inputs(spark, folder):
    return Inputs(spark, folder)


def numbers(spark, values, name="v"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


@pytest.mark.parametrize("values", [[1], [1, 2], [3, 1, 2], [5, 5, 5, 1], list(range(101)), [random.Random(1).gauss(0, 1) for _ in range(777)]])
def test_global_quantiles_are_exact(spark, values):
    got = S.global_quantiles(numbers(spark, [*values, None]), "v", [0, 0.25, 0.5, 0.9, 1]).first()
    ordered = sorted(values)
    for k, p in enumerate([0, 0.25, 0.5, 0.9, 1]):
        place = (len(ordered) - 1) * p
        low = math.floor(place)
        high = math.ceil(place)
        assert got[k] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (place - low))


def test_statistics_of_nothing_are_null(spark):
    empty = numbers(spark, [])
    assert S.global_quantiles(empty, "v", [0.5]).first()[0] is None
    assert S.ks_statistic(empty.withColumn("s", F.lit(True)), "v", F.col("s")).first()[0] is None


def test_auc_counts_ties_as_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "s double, y int")
    assert S.auc(df, "s", "y").first()[0] == pytest.approx(3.5 / 4)


def test_ks_of_disjoint_samples_is_one(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False)], "v double, s boolean")
    assert S.ks_statistic(df, "v", F.col("s")).first()[0] == 1.0


def test_ks_p_values():
    assert fidelity.ks_p_value(None, 10, 10) is None
    assert fidelity.ks_p_value(1.0, 5, 5) == pytest.approx(2 / 252)  # only two of the orders separate the samples
    assert fidelity.ks_p_value(0.0, 9, 9) == pytest.approx(1.0)
    assert fidelity.ks_p_value(0.05, 1000, 1000) == pytest.approx(0.1641, abs=0.01)
    assert fidelity.ks_p_value(0.2, 1000, 1000) < 1e-6


def _paths(d, n, m):
    """Every order of two samples, by steps: the share that reaches the distance."""
    at = {(0, 0): 1}
    for s in range(1, n + m + 1):
        new = {}
        for (i, j), k in at.items():
            for x, y in ((i + 1, j), (i, j + 1)):
                if x <= n and y <= m and abs(x / n - y / m) < d - 1e-12:
                    new[x, y] = new.get((x, y), 0) + k
        at = new
    return 1 - at.get((n, m), 0) / math.comb(n + m, n)


@pytest.mark.parametrize(("d", "n", "m"), [(0.5, 7, 5), (0.3, 30, 20), (0.1, 201, 201), (0.12, 300, 150)])
def test_ks_p_value_counts_paths_at_any_size(d, n, m):
    assert fidelity.ks_p_value(d, n, m) == pytest.approx(_paths(d, n, m), abs=1e-9)


def test_ks_p_value_does_not_jump():
    assert fidelity.ks_p_value(0.02, 10_000, 10_000) == pytest.approx(fidelity.ks_p_value(0.02, 10_001, 10_001), abs=1e-3)


def test_grouped_running_sums_of_a_hot_group(spark):
    rows = [("hot", v, 1 + v % 3, 1) for v in range(500)] + [("small", 7, 2, 5), ("small", 3, 1, 1)]
    got = {(r.g, r.v): (r.cum_n, r.all_n, r.cum_k) for r in S.grouped_running(spark.createDataFrame(rows, "g string, v long, n long, k long"), ["g"], "v", "n", "k").collect()}
    for g, v, *_ in rows:
        assert got[g, v] == (sum(n for h, w, n, _ in rows if h == g and w <= v), sum(n for h, _, n, _ in rows if h == g), sum(k for h, w, _, k in rows if h == g and w <= v))


def test_replicate_weights_are_poisson(spark):
    got = rand.replicate_weights(spark.range(400), 50, "t", "id")
    assert got.columns == ["id", "replicate", "w"]
    n, w, least, most = got.agg(F.count("*"), F.sum("w"), F.min("replicate"), F.max("replicate")).first()
    assert abs(w / 20_000 - 1) < 0.03 and abs(n / 20_000 - (1 - math.exp(-1))) < 0.02 and (least, most) == (1, 50)


def test_surge_bands_round_half_to_even(spark):
    got = [r[0] for r in numbers(spark, [1.0, 1.25, 1.75, 2.3, 9]).select(X.surge_band("v")).collect()]
    assert got == [1.0, 1.0, 2.0, 2.5, 5.0]


@pytest.mark.parametrize(("hour", "name"), [(0, "night"), (5, "night"), (6, "morning"), (12, "midday"), (16, "midday"), (17, "evening")])
def test_time_of_day(spark, hour, name):
    assert spark.range(1).select(X.time_of_day(F.lit(hour))).first()[0] == name


def test_power_table_of_known_effect(spark):
    got = spark.range(1).select(screening.sample_size(F.lit(0.5), F.lit(0.55))).first()[0]
    assert got == 1565
    assert spark.range(1).select(screening.sample_size(F.lit(0.5), F.lit(0.5))).first()[0] is None
    row = screening.power_table(spark.createDataFrame([("a", 0.5, 0.05)], "name string, control_rate double, lift double"), F.lit(1000)).first()
    assert row.n_per_arm == 1565 and row.days == 3.13


def test_elasticity_recovers_an_injected_slope(spark):
    rng = random.Random(3)
    rows = [(s, int(rng.random() < 0.9 * s**-0.5), f"o{k}{s}") for s in (1.0, 1.5, 2.0, 2.5, 3.0) for k in range(600)]
    trace = spark.createDataFrame(rows, "surge double, accepted long, offer_id string")
    report = fidelity.elasticity_report(trace, 50, 1).first()
    assert -0.65 < report.elasticity < -0.35 and report.sign_pass and report.ci_low < report.elasticity < report.ci_high
    flat = trace.withColumn("accepted", F.lit(1).cast("long"))
    assert fidelity.elasticity_report(flat, 20, 1).first().verdict == "FAIL"


def screening_trace(spark, lift, seed=11, riders=60, n=40):
    rng = random.Random(seed)
    rows = []
    for r in range(riders):
        base = rng.uniform(0.3, 0.7)
        for cell, price in (("c", 1.0), ("t", 0.8)):
            p = min(1.0, base + (lift if cell == "t" else 0))
            rows += [(r, f"{cell}{k:03d}", price, 1.0, p, 20.0, 1.1, int(rng.random() < p)) for k in range(n)]
    return spark.createDataFrame(rows, "rider_id long, offer_id string, price_mult double, surge_mult double, p_accept double, quoted_fare double, surge double, accepted long")


def test_screening_recovers_a_lift_and_a_null(spark):
    for lift in (0.1, 0.0):
        trace = screening_trace(spark, lift)
        row = screening.screen(trace).where("cell = 'price_-20'").first()
        assert row.ci_low < lift < row.ci_high
        deltas = screening.paired_deltas(screening.rider_metrics(screening.pre_post_split(screening.with_cells(trace))))
        by = {r.metric: r for r in screening.cell_lifts(deltas).collect()}
        assert by["abandonment_rate"].lift == pytest.approx(-by["accept_rate"].lift)


def test_redraws_agree_with_the_closed_form(spark):
    split = screening.pre_post_split(screening.with_cells(screening_trace(spark, 0.1)))
    a, b = screening.sampling_errors(split).first(), screening.redraw_errors(split, 60, 5).first()
    assert b.se_sampling_draws == pytest.approx(a.se_sampling, rel=0.2)


def test_all_four_metrics_have_errors_and_intervals(spark):
    trace = screening_trace(spark, 0.1)
    by = {r.metric: r for r in screening.screen_metrics(trace, 60, 5).collect()}
    assert set(by) == set(screening.METRICS) and {r.cell for r in by.values()} == {"price_-20"}
    for r in by.values():
        assert r.se_total == pytest.approx((r.se_rider**2 + r.se_sampling**2) ** 0.5)
        assert r.ci_low <= r.lift <= r.ci_high and r.cuped_ci_low <= r.lift <= r.cuped_ci_high
        assert (r.se_total > 0) == (r.metric != "mean_fare")  # all fares are equal here
    top, split = screening.screen(trace).first(), screening.pre_post_split(screening.with_cells(trace))
    assert (by["accept_rate"].se_total, by["accept_rate"].cuped_ci_low) == pytest.approx((top.se_total, top.cuped_ci_low))
    assert by["abandonment_rate"].se_sampling == pytest.approx(by["accept_rate"].se_sampling)
    per = {}
    for r in screening.bernoulli_redraws(split, 200, 5).collect():
        per.setdefault((r.cell, r.rider_id), []).append(r.completed_rides)
    riders = {r for _, r in per}
    v = [np.var(np.subtract(per["price_-20", r], per["control", r])) for r in riders]
    assert by["completed_rides"].se_sampling == pytest.approx((np.mean(v) / len(v)) ** 0.5, rel=0.2)


def test_mean_fare_error_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(r, f"{c}{k}", m, 1.0, 0.5, rng.uniform(5, 50), 1.1, (r + k) % 2) for r in range(12) for c, m in (("c", 1.0), ("t", 0.8)) for k in range(8)]
    trace = spark.createDataFrame(rows, "rider_id long, offer_id string, price_mult double, surge_mult double, p_accept double, quoted_fare double, surge double, accepted long")
    got = screening.screen_metrics(trace, 30, 5).where("metric = 'mean_fare'").first()
    drawn = {(r.cell, r.rider_id, r.replicate): r.mean_fare for r in screening.bernoulli_redraws(screening.pre_post_split(screening.with_cells(trace)), 30, 5).collect()}
    v = []
    for r in range(12):
        both = [(drawn["price_-20", r, k], drawn["control", r, k]) for k in range(1, 31)]
        v.append(np.var([a - b for a, b in both if a is not None and b is not None]))
    assert got.n == 12 and got.se_sampling == pytest.approx((np.mean(v) / 12) ** 0.5)


def test_importances_name_the_feature_that_tells_riders_apart(spark):
    rng = random.Random(2)
    make = lambda shift: spark.createDataFrame([(k, rng.random(), rng.random() + shift, rng.random()) for k in range(60)], "rider_id long, a double, b double, c double")
    got = fidelity.importances(make(0), make(2), ["a", "b", "c"], trees=3).collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0].feature == "b" and [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def test_few_pairs_give_nulls(spark):
    trace = screening_trace(spark, 0.1, riders=4)
    deltas = screening.paired_deltas(screening.rider_metrics(screening.pre_post_split(screening.with_cells(trace))))
    assert all(r.lift is None for r in screening.cell_lifts(deltas).collect())
    one_offer = screening_trace(spark, 0.1, riders=6, n=1)
    assert screening.paired_deltas(screening.rider_metrics(screening.pre_post_split(screening.with_cells(one_offer)))).count() == 0


def test_dedup_bootstrap_is_narrower(spark):
    rng = random.Random(4)
    trace = spark.createDataFrame([(k % 60, s, int(rng.random() < q)) for k in range(1200) for s, q in ((1.1, 0.8), (2.5, 0.4))], "rider_id long, surge double, accepted long")
    spread = [screening.demand_replicates(trace, 200, 3, dedup=d).agg(F.stddev("log_ratio")).first()[0] for d in (False, True)]
    assert spread[1] < spread[0]


def test_gate(spark):
    base = spark.createDataFrame([(1.0, 0.02, 2, "negative")], "discriminator_auc double, discriminator_auc_tolerance double, min_ks_marginals_passed int, elasticity_sign string")
    for metrics, want in (((0.99, 2, "negative"), [True] * 3), ((0.9, 2, "negative"), [False, True, True]), ((1.0, 1, "negative"), [True, False, True]), ((1.0, 4, "positive"), [True, True, False])):
        m = spark.createDataFrame([metrics], "discriminator_auc double, ks_passed int, elasticity_sign string")
        assert [r.passed for r in screening.gate_checks(m, base).collect()] == want


def test_personas_keep_their_constraints(inputs):
    assert personas.persona_violations(inputs.personas).count() == 0
    assert inputs.personas.where("abs(commute + social + errand + airport - 1) > 1e-9").count() == 0


def test_sampling_is_checked(inputs):
    r = personas.riders_of(inputs.trips)
    assert personas.sample_personas(r, inputs.trips, 5, 1).count() == 5
    with pytest.raises(ValueError):
        personas.sample_personas(r, inputs.trips, 10**6, 1)
    with pytest.raises(ValueError):
        personas.sample_riders(r, 0, 1)


def test_allocation_uses_each_trip_once_and_serves_all(spark, inputs):
    t, c = inputs.trips, panel.cells(inputs.trips)
    draws = panel.draw_cells(c, spark, 120, 7)
    got = panel.assign_riders(t, draws, c, panel.kmeans_clusters(c, 8, 1), 7)
    rows = got.collect()
    need = {r.rider_id: r.k for r in draws.collect()}
    have = {}
    for r in rows:
        have[r.rider_id] = have.get(r.rider_id, 0) + 1
    assert have == need and len({r.tk for r in rows}) == len(rows) and {r.step for r in rows} >= {"home", "cluster"}


def test_offers_have_six_variants_and_rules(inputs):
    assert inputs.offers.groupBy("rider_id").count().where("count % 6 <> 0").isEmpty()
    assert offers.offer_violations(inputs.offers).count() == 0
    assert decisions.select_configs("baselines") == ("logit_baseline", "random_baseline") and len(decisions.select_configs("all")) == 7
    with pytest.raises(ValueError):
        decisions.select_configs("other")


def test_logit_trace_is_consistent(inputs):
    model = logit.fit(logit.training_rows(inputs.trips, 7))
    got = logit.logit_decisions(inputs.offers, inputs.personas, model, 7)
    assert got.count() == inputs.offers.count()
    assert got.where("p_accept < 0 OR p_accept > 1 OR confidence < 0.25 OR (action = 'accept' AND reservation_fare < quoted_fare)").isEmpty()


def test_slopes_are_zero_where_undefined(spark):
    rows = [(1, 1.0, 1), (1, 2.0, 0), (2, 1.0, 1), (2, 1.0, 0), (2, 1.0, 1), (2, 1.0, 1)] + [(3, 1.0 + k / 10, 1) for k in range(6)] + [(4, 1.0 + k / 10, int(k < 8 or k == 12)) for k in range(16)]
    got = {r.rider_id: r.surge_elasticity for r in features.surge_slopes(spark.createDataFrame(rows, "rider_id long, surge double, accepted long")).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] < -1


def test_permutations_tell_different_scores_apart(spark):
    rng = random.Random(2)
    make = lambda c, mean, real: [(c, str(k), real, rng.gauss(mean, 0.1)) for k in range(60)]
    rows = [x for c, m in (("a", 0.5), ("b", 0.5), ("z", 0.9)) for x in make(c, m, False) + make(c, 0.4, True)]
    got = {(r.config_a, r.config_b): r.p_value for r in fidelity.permutation_test(spark.createDataFrame(rows, "config string, item string, is_real boolean, score double"), 60, 1).collect()}
    assert got["a", "z"] < 0.05 and got["a", "b"] > 0.01 and len(got) == 3


def test_memory_realizations_reach_the_latest_episode(spark):
    log = spark.createDataFrame([(1, 7, 1, None, None), (1, 7, 2, None, None), (1, 8, 3, 1.0, 2.0)], "rider_id long, offer_id long, seq long, realized_fare double, realized_wait double")
    out = memory.record_realizations(log, spark.createDataFrame([(1, 7, 9.5, 3.0)], "rider_id long, offer_id long, realized_fare double, realized_wait double"))
    assert sorted((r.seq, r.realized_fare) for r in out.collect()) == [(1, None), (2, 9.5), (3, 1.0)]


def test_decisions_parse_repair_and_fall_back(spark):
    good = '{"action": "accept", "reasoning": "ok", "confidence": 0.9, "reservation_fare": 12.5, "tools_called": []}'
    texts = [good, f"```json\n{good}\n```", "text { broken then " + good, "nothing", good.replace("0.9", "1.9"), good.replace('"ok"', '"' + "w " * 61 + '"'), good.replace("accept", "fly"), good.replace("}", ', "more": 1}'), None]
    df = spark.createDataFrame([(k, t, 20.0) for k, t in enumerate(texts)], "k long, text string, quoted_fare double")
    got = {r.k: r.error for r in agent_io.parse_decisions(df).collect()}
    assert [got[k] for k in range(9)] == [None, None, None, "no JSON object found in output", "confidence", "reasoning", "action", "extra field", "no JSON object found in output"]
    fixed = agent_io.parse_decisions(df.where("k = 4").withColumn("text", F.lit(good)))
    final = {r.k: (r.decision.action, r.parse_ok, r.decision.reservation_fare) for r in agent_io.resolve_decisions(agent_io.parse_decisions(df), fixed, "k").collect()}
    assert final[0] == ("accept", True, 12.5) and final[4] == ("accept", True, 12.5) and final[3] == ("reject", False, 20.0)


def test_objects_are_found_with_and_without_the_scanner(spark):
    good = '{"action": "accept", "reasoning": "a } in \\u00e9", "confidence": 0.9, "reservation_fare": 12.5, "tools_called": ["x"]}'
    texts = [good, " \n" + good + " and more {", "```json\n" + good + "\n```\n" + good.replace("accept", "reject"), "{", "{}", "[1] {x} " + good, good[:-1], "{{" + good + "}}", "", None, '{"a": NaN} ' + good, good + good]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = {r.k: (r.decision, r.error) for r in agent_io.parse_decisions(df).collect()}
    for k, t in enumerate(texts):
        found = agent_io._first_object(t)
        again = agent_io.parse_decisions(spark.createDataFrame([(found,)], "text string")).first()
        assert got[k] == (again.decision, again.error), t
    plain = {r.k for r in df.where(agent_io.plain_object("text").isNotNull()).collect()}
    assert {0, 1, 2, 4, 11} <= plain and not plain & {3, 5, 6, 7, 8, 9}


def test_stored_cache_keeps_the_newest(spark, tmp_path):
    columns = "key string, response_json string, created_at double"
    agent_io.cache_put(spark.createDataFrame([("a", "1", 1.0), ("b", "1", 1.0)], columns), f"{tmp_path}/c")
    agent_io.cache_put(spark.createDataFrame([("a", "2", 2.0), ("b", "0", 0.5), ("c", "9", 1.0)], columns), f"{tmp_path}/c")
    assert {(r.key, r.response_json) for r in agent_io.cache_get(spark, f"{tmp_path}/c").collect()} == {("a", "2"), ("b", "1"), ("c", "9")}
    asked = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r.key for r in agent_io.cache_misses(asked, agent_io.cache_get(spark, f"{tmp_path}/c")).collect()] == ["z"]


def test_an_offer_without_persona_is_an_error(inputs):
    some = inputs.personas.where("rider_id % 2 = 0")
    for decide in (lambda: decisions.rule_decisions(inputs.offers, some), lambda: decisions.random_decisions(inputs.offers, some, 7)):
        with pytest.raises(Exception, match="no persona for rider"):
            decide().count()
    assert decisions.rule_decisions(inputs.offers, inputs.personas).count() == inputs.offers.count()


def test_broken_personas_are_not_loaded(inputs):
    assert personas.checked_personas(inputs.personas).count() == inputs.personas.count()
    with pytest.raises(ValueError, match="price_sensitivity of rider"):
        personas.checked_personas(inputs.personas.withColumn("price_sensitivity", F.lit(1.5)))


def test_slopes_rest_on_counts(spark):
    rows = [(1, s, int(i % 4 < c)) for s, c in ((1.0, 3), (1.5, 2), (2.0, 1)) for i in range(400)] + [(2, 1.2, 1)] * 9 + [(3, None, 1), (3, 1.0, None)]
    got = {r.rider_id: r.surge_elasticity for r in features.surge_slopes(spark.createDataFrame(rows, "rider_id long, surge double, accepted long")).collect()}
    x, y = np.log([r[1] for r in rows[:1200]]), np.array([r[2] for r in rows[:1200]], float)
    grid = [(abs(np.sum(y - p)) + abs(np.sum((y - p) * x)), b) for b in np.linspace(-4, -2, 201) for a in np.linspace(0.9, 1.5, 121) for p in [1 / (1 + np.exp(-a - b * x))]]
    assert got[1] == pytest.approx(min(grid)[1], abs=0.03) and got[2] == got[3] == 0.0


def test_ranges_follow_the_cluster_within_bounds(spark, monkeypatch):
    df = numbers(spark, range(1, 300))
    assert S.ranges_of(df) == S.RANGES
    monkeypatch.setattr(S, "RANGES", 200)
    assert S.global_quantiles(df, "v", [0.5]).first()[0] == 150.0


def test_backend_is_called_per_prompt_and_retried(spark):
    got = agent_io.complete(spark.createDataFrame([("a", "x"), ("b", "yy")], "key string, prompt string"), lambda p: p * 2)
    assert sorted((r.key, r.text) for r in got.collect()) == [("a", "xx"), ("b", "yyyy")]


def test_tools_by_name(inputs):
    assert lookups.call_tool("check_eta_reliability", inputs.trips).count() > 0
    with pytest.raises(KeyError):
        lookups.call_tool("nothing")


def test_hash_uniform_is_uniform(spark):
    got = spark.range(4000).select(hash_uniform(7, "id").alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(got[0] - 0.5) < 0.02 and 0 <= got[1] and got[2] < 1


def test_raw_trips_filter_reaches_the_scan(spark, folder):
    plan = trips.usable(raw_trips(spark, folder)).select("trip_miles")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "l_comment" not in plan


def test_tables_round_trip(spark, inputs, tmp_path):
    tables.write_personas(inputs.personas, f"{tmp_path}/p")
    back = tables.read_personas(spark, f"{tmp_path}/p")
    assert sorted(back.columns) == sorted(inputs.personas.columns) and back.select(*inputs.personas.columns).exceptAll(inputs.personas).isEmpty()
    trace = decisions.trace_all(inputs.offers, inputs.personas, 7, ("full", "random_baseline")).withColumn("run_id", F.lit("r1"))
    tables.write_trace(trace, f"{tmp_path}/t")
    assert tables.read_trace(spark, f"{tmp_path}/t", "r1", "full").count() == inputs.offers.count()
    assert [tuple(r) for r in tables.list_runs(spark, f"{tmp_path}/t").collect()] == [("r1", "full"), ("r1", "random_baseline")]
    (tmp_path / "z.csv").write_text("LocationID,Borough,Zone,service_zone\n1,EWR,Newark,EWR\n")
    assert tables.read_zones(spark, f"{tmp_path}/z.csv").first().Zone == "Newark"
    tables.write_json_document(spark.createDataFrame([(1, "a")], "k int, v string"), f"{tmp_path}/j")
    assert tables.read_json_document(spark, f"{tmp_path}/j", "k int, v string").first().v == "a"
