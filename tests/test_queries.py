import os

import pytest

import __spark_entry__ as entry
from checks import catalog, compare

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF_DIR)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["consolidated_commune", "nombre_pdc_commune", "label"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    ok, note = compare.check(spark, db, name, SF_DIR)
    assert ok, note
