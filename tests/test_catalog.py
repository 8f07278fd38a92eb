"""Every registered query runs, and those with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from macrolith.plans import catalog
from macrolith.plans.base import TABLES

SF = "/root/testdata/sf0.001"
#: These run in the driver's check; here they would take most of the time.
SLOW = {"equality_tests_two_groups", "heckman_ml", "did_honest", "did_pretrend", "panel_logit_margins", "panel_logit_re", "panel_logit_cre", "panel_logit_fe", "panel_probit_re", "panel_probit_cre", "robust_mm", "tobit_effects", "structural_learning_rate"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df) -> list[str]:
    cols = sorted(df.columns)
    return sorted(map(str, map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist())))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4 and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_the_training_data_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "macrolith"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
