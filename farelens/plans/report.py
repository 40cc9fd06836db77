"""Markdown reports and figure series from small result tables; nothing is computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions import stats as S
from farelens.operators import fidelity


def _cell(value: object) -> str:
    if value is None:
        return "n/a"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A summary table; of more than ``limit`` rows the first are shown and the others' number is said."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = df.limit(limit + 1).collect()
    lines += ["| " + " | ".join(_cell(v) for v in row) + " |" for row in rows[:limit]]
    if len(rows) > limit:
        lines += ["", f"{df.count() - limit} more rows are not shown."]
    return "\n".join(lines)


def _section(title: str, df: DataFrame | None) -> str:
    return "" if df is None else f"\n## {title}\n\n{markdown_table(df)}\n"


def fidelity_report(run_id: str, metrics: DataFrame, permutations: DataFrame, importances: DataFrame | None = None, distributions: DataFrame | None = None, segments: DataFrame | None = None) -> str:
    """A run's figures by configuration, then a section for each other table that is given.

    ``metrics`` with differences to the ``full`` configuration give a section of ablations.
    """
    metrics = metrics.select(*(c for c, kind in metrics.dtypes if not kind.startswith(("map", "struct", "array"))))
    deltas = [c for c in metrics.columns if c.endswith("_delta_vs_full")]
    out = f"# Fidelity of {run_id}\n\n{markdown_table(metrics.drop(*deltas).orderBy('config'))}\n"
    out += _section("Ablations", ablations(metrics) if deltas else None)
    out += _section("AUC differences", permutations.orderBy("config_a", "config_b"))
    out += _section("What tells riders apart", None if importances is None else top_importances(importances))
    out += _section("Distributions", None if distributions is None else distributions.orderBy("marginal"))
    return out + _section("Calibration by segment", None if segments is None else segments.orderBy("segment"))


def screening_report(run_id: str, screening: DataFrame, metrics: DataFrame | None = None) -> str:
    """The ranked cells, their recommendations, and all metrics of each cell where given."""
    advice = screening.groupBy("recommendation").agg(F.count("*").alias("cells")).orderBy("recommendation") if "recommendation" in screening.columns else None
    out = f"# Screening of {run_id}\n\n{markdown_table(screening.orderBy('rank'))}\n" + _section("Recommendations", advice)
    return out + _section("All metrics", None if metrics is None else metrics.orderBy("cell", "metric"))


def top_importances(importances: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` features with most gain, of each configuration if there are several."""
    keys = [c for c in ("config",) if c in importances.columns]
    return importances.where(F.col("rank") <= n).select(*keys, "rank", "feature", "importance").orderBy(*keys, "rank")


def ablations(metrics: DataFrame) -> DataFrame:
    """What each configuration loses or gains against the full one."""
    metrics = metrics.select(*(c for c, kind in metrics.dtypes if not kind.startswith(("map", "struct", "array"))))
    deltas = [c for c in metrics.columns if c.endswith("_delta_vs_full")]
    return metrics.where("config <> 'full'").select("config", *deltas).orderBy("config")


def figure_series(trace: DataFrame, real: DataFrame, metrics: DataFrame | None = None, importances: DataFrame | None = None) -> dict[str, DataFrame]:
    """The points behind the figures: reliability, fare distributions, acceptance over surge, and where their
    tables are given the leading importances and the ablations."""
    fares = S.ecdf(real, "quoted_fare").withColumn("side", F.lit("real")).unionByName(S.ecdf(trace.where("accepted = 1"), "quoted_fare").withColumn("side", F.lit("simulated")))
    series = {"calibration": fidelity.reliability_curve(fidelity.labeled_offers(trace)), "fare_ecdf": fares, "elasticity": fidelity.surge_bands(trace)}
    if importances is not None:
        series["importances"] = top_importances(importances)
    if metrics is not None:
        series["ablations"] = ablations(metrics)
    return series
