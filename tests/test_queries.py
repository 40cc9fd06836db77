"""Every registered query against its independent SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from farelens.plans import registry

SQL = registry.oracle_sql()


def canonical(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (str, bytes)) or hasattr(v, "isoformat"):
            return str(v)
        return bool(v) if type(v).__name__ in ("bool", "bool_") else round(float(v), 6)

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(one, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, duck, name):
    got = registry.queries()[name](spark, folder).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want) and len(got) > 0


def test_every_query_without_sql_is_named_here():
    assert set(registry.queries()) - set(SQL) == {"kmeans_cells", "panel_assigned", "surge_slopes", "logit_baseline", "discriminator_auc", "discriminator_importances", "discriminator_interval", "permutation_matrix", "distribution_tests", "gate_checks"}
