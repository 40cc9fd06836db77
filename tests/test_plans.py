"""End-to-end plans, streaming and the driver entry."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from farelens.operators import features, fidelity, panel, screening
from farelens.plans import evaluate as E
from farelens.plans import registry, report
from farelens.sources import tables
from farelens.sources.views import raw_trips
from farelens.streaming import decisions as D
from tests.conftest import ROOT


def test_build_evaluate_screen_and_gate(spark, folder, tmp_path):
    out = str(tmp_path)
    s = E.Settings(n_riders=60, trips_per_rider=2, replicates=20, permutations=10, clusters=4, discriminator_folds=2, discriminator_trees=2)
    E.build_panel(spark, raw_trips(spark, folder), out, s)
    with pytest.raises(ValueError):
        E.build_panel(spark, raw_trips(spark, folder), out, E.Settings(n_riders=10**6))
    panel = spark.read.parquet(f"{out}/trips").groupBy("rider_id").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert panel[0] >= 5 and panel[1] <= 40 and panel[2] == 60
    E.build_personas(spark, out, 30, 7)
    choices = E.simulate(spark, out, 5, 2, 7)
    assert choices.count() == 5 * 2 * 5 and choices.where("price_mult = 1 AND wait_mult = 1").count() == 10
    assert E.simulate(spark, out, 10**6, 2, 7).count() == 30 * 2 * 5
    metrics = {r.config: r for r in E.evaluate(spark, out, "run1", "baselines", s).collect()}
    assert set(metrics) == {"logit_baseline", "random_baseline"} and all(0 <= r.discriminator_auc <= 1 and r.n_decisions == 360 for r in metrics.values())
    assert all(0 < r.latency_p50 <= r.latency_p95 and set(r.ks_marginals) == set(fidelity.MARGINALS) and r.brier_by_segment for r in metrics.values())
    document = tables.read_metrics_document(spark, f"{out}/metrics_document/run1").first()
    figures = json.loads(document.configs["random_baseline"])
    assert (document.run_id, document.seed, set(document.configs)) == ("run1", 7, set(metrics)) and figures["n_decisions"] == 360 and figures["ks_marginals"]["purpose_mix"]["passed"] in (True, False)
    assert abs(figures["discriminator_auc"] - metrics["random_baseline"].discriminator_auc) < 1e-12
    E.write_traces(spark, out, "run2", "llm", s)
    runs = [tuple(r) for r in tables.list_runs(spark, f"{out}/trace").collect()]  # a second run leaves the first one's traces
    assert len(runs) == 7 and {c for r, c in runs if r == "run1"} == set(metrics)
    E.write_traces(spark, out, "run2", "baselines", s)
    assert tables.list_runs(spark, f"{out}/trace").count() == 9
    tables.write_run(tables.read_run(spark, f"{out}/metrics", "run1").drop("run_id"), f"{out}/metrics", "run3")
    assert {tuple(r) for r in tables.read_run(spark, f"{out}/metrics").select("run_id", "config").collect()} == {(r, c) for r in ("run1", "run3") for c in metrics}
    assert tables.read_run(spark, f"{out}/permutations", "run1").count() == 1
    ranked = E.screen_run(spark, out, "run2", settings=s)
    assert [r["rank"] for r in ranked.collect()] == [1, 2, 3, 4, 5]
    assert "| cell |" in report.screening_report("run2", ranked) and "AUC differences" in report.fidelity_report("run1", spark.read.parquet(f"{out}/metrics"), spark.read.parquet(f"{out}/permutations"))
    text = report.fidelity_report("run1", tables.read_run(spark, f"{out}/metrics", "run1"), tables.read_run(spark, f"{out}/permutations", "run1"), tables.read_run(spark, f"{out}/importances", "run1"))
    assert all(f"## {t}" in text for t in ("Ablations", "AUC differences", "What tells riders apart")) and text.count("_baseline | ") >= 2 + 2 + 2 * 8
    assert "## All metrics" in report.screening_report("run2", ranked, tables.read_run(spark, f"{out}/screening_metrics", "run2"))
    base = spark.createDataFrame([(1.0, 1.0, 0, "negative")], "discriminator_auc double, discriminator_auc_tolerance double, min_ks_marginals_passed int, elasticity_sign string")
    assert E.gate(spark, out, base)[0] == 2  # there is no "full" row among the baselines


def test_days_are_those_of_the_month(spark):
    raw = spark.range(290).select(F.expr("timestamp'2024-02-01' + make_dt_interval(0, int(id * 2))").cast("timestamp_ntz").alias("request_datetime"))
    assert [tuple(r) for r in screening.daily_volume(raw).collect()] == [("2024-02", 290, 10)]


def test_a_long_table_says_what_it_leaves_out(spark):
    assert report.markdown_table(spark.range(5), 3).endswith("| 2 |\n\n2 more rows are not shown.") and "more rows" not in report.markdown_table(spark.range(3), 3)


def test_figure_series(spark, folder):
    from farelens.plans.registry import Inputs

    i = Inputs(spark, folder)
    gains = spark.createDataFrame([(k, f"f{k}", 1.0 / k) for k in range(1, 13)], "rank long, feature string, importance double")
    metrics = spark.createDataFrame([("full", 0.0), ("no_tools", 0.1)], "config string, brier_delta_vs_full double")
    series = report.figure_series(i.full, i.real, metrics, gains)
    assert set(series) == {"calibration", "fare_ecdf", "elasticity", "importances", "ablations"} and all(df.count() > 0 for df in series.values())
    assert series["importances"].count() == 8 and [r.config for r in series["ablations"].collect()] == ["no_tools"]


def test_stream_equals_batch(spark, folder, tmp_path):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = D.event_stream(spark, folder, schema)
    got = D.drain(spark, D.windowed_accept_rate(stream), f"{tmp_path}/c", f"{tmp_path}/o")
    batch = D.windowed_accept_rate(spark.read.parquet(f"{folder}/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp")))
    assert got.exceptAll(batch).isEmpty() and got.count() > 0  # windows after the watermark are still open
    assert D.sessions(spark.read.parquet(f"{folder}/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == 1000


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150 and set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_optional_part(tmp_path):
    """The entry still imports when the optional subpackage and the pipeline are gone."""
    code = "import shutil, sys; r, t = sys.argv[1:]; shutil.copytree(r + '/farelens', t + '/farelens', ignore=shutil.ignore_patterns('llm', '__pycache__')); shutil.copy(r + '/__spark_entry__.py', t); sys.path.insert(0, t); import __spark_entry__ as e; assert len(e.queries()) > 70 and 'pipeline' not in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code, ROOT, str(tmp_path)], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})


def test_discriminator_query_has_all_features_folds_and_trees(spark, folder, monkeypatch):
    asked = {}

    def scores(real, sim, columns, folds, trees):
        asked.update(columns=columns, folds=folds, trees=trees, missing=set(columns) - set(real.columns) & set(sim.columns))
        return spark.createDataFrame([("a", True, 0.1), ("b", False, 0.9)], "item string, is_real boolean, score double")

    monkeypatch.setattr(fidelity, "discriminator", scores)
    assert registry.queries()["discriminator_auc"](spark, folder).first().auc == 1.0
    assert asked == {"columns": list(features.FEATURES), "folds": 5, "trees": 100, "missing": set()}


def test_gate_query_judges_computed_figures(spark, folder, monkeypatch):
    asked = []
    monkeypatch.setattr(registry, "_discriminator", lambda i: spark.createDataFrame([(0.99,)], "auc double"))
    monkeypatch.setattr(fidelity, "distribution_tests", lambda *a: asked.append(a) or spark.createDataFrame([("a", True), ("b", True), ("c", False)], "marginal string, passed boolean"))
    run = lambda: {r["check"]: r.passed for r in registry.queries()["gate_checks"](spark, folder).collect()}
    assert run() == {"discriminator AUC": True, "KS marginals passed": True, "elasticity sign": True} and len(asked) == 1
    monkeypatch.setattr(registry, "_discriminator", lambda i: spark.createDataFrame([(0.9,)], "auc double"))
    monkeypatch.setattr(fidelity, "distribution_tests", lambda *a: spark.createDataFrame([("a", True), ("b", False)], "marginal string, passed boolean"))
    assert run() == {"discriminator AUC": False, "KS marginals passed": False, "elasticity sign": True}


class Asked(Exception):
    pass


@pytest.mark.parametrize(("given", "k"), [({}, 50), ({"clusters": 4}, 4), ({"n_riders": 60}, 16)])
def test_panel_has_a_cluster_for_eight_riders(spark, folder, tmp_path, monkeypatch, given, k):
    def asked(cells, k, seed):
        raise Asked(k)

    monkeypatch.setattr(panel, "kmeans_clusters", asked)
    with pytest.raises(Asked, match=f"^{k}$"):
        E.build_panel(spark, raw_trips(spark, folder), str(tmp_path), E.Settings(**{"n_riders": 400} | given))
    assert E.Settings().discriminator_trees == 100


def test_staged_tables_follow_their_inputs_and_can_be_cleared(spark, tmp_path):
    from farelens.sources import staging

    built = []

    def make(n):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/in/t{n}")
        return staging.staged(spark, f"{tmp_path}/in", "step", lambda: built.append(n) or spark.range(n).toDF("id")).count()

    assert make(3) == 3 and make(5) == 5 and built == [3, 5]
    assert staging.staged(spark, f"{tmp_path}/in", "step", lambda: built.append(0)).count() == 5 and built == [3, 5]


def test_an_applications_tables_are_in_one_folder(spark, monkeypatch, tmp_path):
    from farelens.sources import staging

    monkeypatch.setattr(staging, "shared_root", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(staging, "_STAGED", {})
    staging.materialize(spark.range(3), "a"), staging.materialize(spark.range(3), "b")
    (own,) = (tmp_path / "farelens").iterdir()
    assert len(list(own.iterdir())) == 2
    staging.clear(spark)
    assert not own.exists()
