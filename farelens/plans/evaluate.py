"""End-to-end plans: build a panel, evaluate decision policies, screen interventions, gate the result.

Each step reads the tables the step before it wrote, so a step can be run again by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.functions.rand import hash_uniform
from farelens.operators import agent_io, decisions, features, fidelity, logit, offers, panel, personas, screening, trips
from farelens.sources import tables
from farelens.sources.staging import discard


@dataclass(frozen=True)
class Settings:
    n_riders: int = 2000
    trips_per_rider: int = 4
    seed: int = 7
    replicates: int = 500
    permutations: int = 200
    clusters: int | None = None  # as many as panel.cluster_count gives
    discriminator_folds: int = 5
    discriminator_trees: int = 100
    redraws: int = 200


def build_panel(spark: SparkSession, raw: DataFrame, out: str, settings: Settings | None = None) -> None:
    """Raw trips -> ``trips`` and ``riders`` tables (cells, clusters, draws and allocation), and the ``daily`` volume of raw trips."""
    s = settings or Settings()
    tables.write_table(screening.daily_volume(raw), f"{out}/daily")
    keyed = trips.clean_trips(raw)
    if keyed.count() < s.n_riders * panel.MIN_TRIPS:
        raise ValueError(f"too few usable trips for {s.n_riders} riders")
    tables.write_table(keyed.drop("rider_id"), f"{out}/usable")
    usable = spark.read.parquet(f"{out}/usable")
    cells = panel.cells(usable)
    assigned = panel.assign_riders(usable, panel.draw_cells(cells, spark, s.n_riders, s.seed), cells, panel.kmeans_clusters(cells, s.clusters or panel.cluster_count(s.n_riders), s.seed), s.seed)
    tables.write_table(usable.join(assigned.select("tk", "rider_id"), "tk"), f"{out}/trips")
    tables.write_table(personas.riders_of(spark.read.parquet(f"{out}/trips")), f"{out}/riders")


def build_personas(spark: SparkSession, out: str, n: int, seed: int) -> None:
    """``riders`` and ``trips`` -> ``personas`` with the purpose mix as JSON."""
    tables.write_personas(personas.sample_personas(spark.read.parquet(f"{out}/riders"), spark.read.parquet(f"{out}/trips"), n, seed), f"{out}/personas")


def simulate(spark: SparkSession, out: str, n_personas: int, trips_per_persona: int, seed: int) -> DataFrame:
    """Price and wait choices of sampled personas -> ``simulated_choices``; asking for more personas than there are takes all."""
    t, people = spark.read.parquet(f"{out}/trips"), personas.checked_personas(tables.read_personas(spark, f"{out}/personas"))
    chosen = personas.sample_riders(people, n_personas, seed)
    made = offers.simulation_offers(t.join(chosen.select("rider_id"), "rider_id", "left_semi"), trips_per_persona, seed)
    tables.write_table(decisions.statistical_decisions(made, chosen, seed), f"{out}/simulated_choices")
    return spark.read.parquet(f"{out}/simulated_choices")


def write_traces(spark: SparkSession, out: str, run_id: str, selector: str = "all", settings: Settings | None = None) -> None:
    """Decisions of the selected configurations into the partitioned trace table."""
    s = settings or Settings()
    t, people = spark.read.parquet(f"{out}/trips"), personas.checked_personas(tables.read_personas(spark, f"{out}/personas"))
    made = offers.evaluation_offers(t, s.trips_per_rider, s.seed, people)
    names = decisions.select_configs(selector)
    trace = decisions.trace_all(made, people, s.seed, tuple(n for n in names if n != "logit_baseline")) if names != ("logit_baseline",) else None
    if "logit_baseline" in names:
        baseline = logit.logit_decisions(made, people, logit.fit(logit.training_rows(t, s.seed)), s.seed)
        trace = baseline if trace is None else trace.unionByName(baseline)
    versions = F.when(F.col("config") == "prompt_v2", "v2").otherwise("v1")
    tables.write_trace(decisions.timed(trace).withColumns({"run_id": F.lit(run_id), "prompt_version": versions, "cost_usd": F.lit(0.0)}), f"{out}/trace")


def rider_features(trace: DataFrame, real: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The features of real and of simulated riders of one configuration."""
    order = [hash_uniform(settings.seed, "offer_id"), F.col("offer_id")]
    sim = features.sequence_features(trace, real, order)
    seen = real.join(trace.select("rider_id").distinct(), "rider_id", "left_semi").withColumn("offer_id", F.col("tk"))
    return features.sequence_features(seen, real, order), sim


def config_metrics(trace: DataFrame, real: DataFrame, scores: DataFrame, settings: Settings) -> DataFrame:
    """One summary row of a configuration's trace and its discriminator scores."""
    auc = fidelity.auc_interval(scores, settings.replicates, settings.seed)
    mechanism = fidelity.elasticity_report(trace, settings.replicates, settings.seed)
    labeled = fidelity.labeled_offers(trace)
    brier = fidelity.brier(labeled).select("brier")
    segments = fidelity.brier_by_segment(labeled).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment", "brier")))).alias("m"))  # nine segments
    tests = fidelity.distribution_tests(trace, real, settings.seed)  # four rows
    marginals = tests.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("marginal", F.struct("statistic", "p_value", "passed").alias("test"))))).alias("m"))
    took = agent_io.latency_percentiles(trace, "latency_s", "config").select(F.struct("latency_p50", "latency_p95").alias("l"))
    cost = trace.agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost"))
    row = auc.withColumns({
        "brier": brier.scalar(), "ks_passed": tests.agg(F.count_if("passed")).scalar(), "mechanism": mechanism.select(F.struct("elasticity", "ci_low", "ci_high", "sign_pass", "verdict")).scalar(),
        "brier_by_segment": segments.scalar(), "ks_marginals": marginals.scalar(), "latency": took.scalar(),
        "n_decisions": cost.select("n").scalar(), "cost_usd": cost.select("cost").scalar(), "cost_per_1k": cost.select(agent_io.cost_per_thousand(F.col("cost"), F.col("n"))).scalar(),
    })
    return row.select(
        F.col("auc").alias("discriminator_auc"), "auc_ci_low", "auc_ci_high", "brier", "ks_passed", F.col("mechanism.elasticity").alias("elasticity"), F.col("mechanism.ci_low").alias("elasticity_ci_low"), F.col("mechanism.ci_high").alias("elasticity_ci_high"),
        F.when(F.col("mechanism.elasticity") < 0, "negative").otherwise("positive").alias("elasticity_sign"), F.col("mechanism.verdict").alias("elasticity_verdict"), "cost_usd", "cost_per_1k", "n_decisions",
        F.col("latency.latency_p50").alias("latency_p50"), F.col("latency.latency_p95").alias("latency_p95"), "brier_by_segment", "ks_marginals",
    )


def with_deltas(summary: DataFrame) -> DataFrame:
    """Adds the difference of each headline metric to the ``full`` configuration's."""
    base = summary.where("config = 'full'").select(F.struct("discriminator_auc", "brier", "elasticity").alias("base")).scalar()
    return summary.withColumn("_b", base).withColumns({f"{m}_delta_vs_full": F.col(m) - F.col(f"_b.{m}") for m in ("discriminator_auc", "brier", "elasticity")}).drop("_b")


def evaluate(spark: SparkSession, out: str, run_id: str, selector: str = "all", settings: Settings | None = None) -> DataFrame:
    """Traces -> ``metrics`` (one row per configuration), ``permutations`` and ``importances`` of a run; returns the metrics."""
    s = settings or Settings()
    write_traces(spark, out, run_id, selector, s)
    real = trips.accepted_events(spark.read.parquet(f"{out}/trips"))
    traces = {config: tables.read_trace(spark, f"{out}/trace", run_id, config) for config in decisions.select_configs(selector)}  # a handful of named configurations
    told = {config: rider_features(trace, real, s) for config, trace in traces.items()}
    scores, gains = fidelity.discriminate_all(told, list(features.FEATURES), s.discriminator_folds, s.discriminator_trees, s.seed)
    rows = [config_metrics(trace, real, scores.where(F.col("config") == config).drop("config"), s).withColumn("config", F.lit(config)) for config, trace in traces.items()]
    tables.write_run(with_deltas(reduce(DataFrame.unionByName, rows)), f"{out}/metrics", run_id)
    tables.write_run(fidelity.permutation_test(scores, s.permutations, s.seed), f"{out}/permutations", run_id)
    tables.write_run(gains, f"{out}/importances", run_id)
    tables.write_metrics_document(tables.read_run(spark, f"{out}/metrics", run_id), f"{out}/metrics_document/{run_id}", s.seed)
    discard(scores)
    return tables.read_run(spark, f"{out}/metrics", run_id)


def screen_run(spark: SparkSession, out: str, run_id: str, config: str = "full", settings: Settings | None = None) -> DataFrame:
    """A trace -> ranked cells with power, days and recommendation, written as ``screening``; all metrics as ``screening_metrics``."""
    s = settings or Settings()
    trace, t = tables.read_trace(spark, f"{out}/trace", run_id, config), spark.read.parquet(f"{out}/trips")
    ranked = screening.screen(trace)
    verdict = screening.backtest(trace, t, s.replicates, s.seed).select("verdict").scalar()
    advised = screening.recommend(ranked.withColumn("_verdict", verdict), F.col("_verdict")).drop("_verdict")
    daily = spark.read.parquet(f"{out}/daily").agg(F.max("daily").alias("d")).scalar()
    power = screening.power_table(screening.effects_of(ranked, trace), daily).select(F.col("name").alias("cell"), "n_per_arm", "days")
    tables.write_run(screening.screen_metrics(trace, s.redraws, s.seed), f"{out}/screening_metrics", run_id)
    tables.write_run(advised.join(power, "cell", "left"), f"{out}/screening", run_id)
    return tables.read_run(spark, f"{out}/screening", run_id).orderBy("rank")


def gate(spark: SparkSession, out: str, baselines: DataFrame, run_id: str | None = None) -> tuple[int, DataFrame]:
    """Exit code 0 (passed), 1 (failed) or 2 (nothing to check) and the checks of a run, by default the last by name."""
    every = tables.read_run(spark, f"{out}/metrics")
    last = every.agg(F.max("run_id")).scalar() if run_id is None else F.lit(run_id)
    metrics = every.withColumn("_last", last).where("run_id = _last AND config = 'full'").select("discriminator_auc", "ks_passed", "elasticity_sign")
    checks = screening.gate_checks(metrics, baselines)
    passed = [r["passed"] for r in checks.collect()]
    return (2 if not passed else 0 if all(passed) else 1), checks
