"""Every registered query against its SQL twin, at the smallest scale."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as contract
from driver_queries.oracles import ORACLES
from driver_queries.queries import QUERIES
from verify import normalized, oracle_connection

SF_DIR = "/root/testdata/sf0.001"

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = oracle_connection(SF_DIR)
    yield con
    con.close()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["product_category", "fill_rate"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows_equal(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cursor = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert types == {c: SQL_TYPES.get(t, t.upper()) for c, t in df.dtypes}
    columns = [d[0] for d in cursor.description]
    want = pd.DataFrame(cursor.fetchall(), columns=columns, dtype=object)
    pd.testing.assert_frame_equal(normalized(got), normalized(want))
