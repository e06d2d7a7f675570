"""Every registered query against its SQL on the given tables."""

from pathlib import Path

import pytest

from loadweave.catalog import REGISTRY, feature_queries
from loadweave.plans.model import BoostingParams
from tests.compare import differences, open_tables

FOLDER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    """What SQL can check does not depend on the number of trees; test_live_model checks accuracy."""
    monkeypatch.setattr(feature_queries, "PARAMS", BoostingParams(trees=3))


@pytest.fixture(scope="module")
def tables():
    con = open_tables(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is not None])
def test_matches_sql(spark, tables, name):
    query = REGISTRY[name]
    assert differences(query.run(spark, FOLDER), tables, query.sql) == []


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is None])
def test_gives_rows(spark, name):
    assert REGISTRY[name].run(spark, FOLDER).count() > 0
