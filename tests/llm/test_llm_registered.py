"""The text queries that SQL can express, against their SQL on the smallest tables."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as contract
from shelfcast.llm.oracles import ORACLES
from shelfcast.llm.queries import QUERIES
from verify import normalized, oracle_connection

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_rows_equal(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cursor = oracle_connection(SF_DIR).execute(ORACLES[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    pd.testing.assert_frame_equal(normalized(got), normalized(want))
