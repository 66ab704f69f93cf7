"""Every query with SQL gives DuckDB's rows; the others run and give rows."""

from __future__ import annotations

import oracle
import pytest

from tidemark.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(name, spark, con, sf_dir):
    oracle.compare(spark, con, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
