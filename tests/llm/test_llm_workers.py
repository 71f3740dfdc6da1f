"""All text queries where Python workers can't import the library: it is shipped by value."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPOSITORY = Path(__file__).resolve().parents[2]
SF_DIR = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPOSITORY)!r})  # of the driver alone
from pyspark.sql import functions as F
import __spark_entry__ as contract
from shelfcast.session import local_session
spark = local_session(4, "far", {{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": sys.argv[1]}})

@F.pandas_udf("boolean")
def importable(values):
    try:
        import shelfcast
    except ModuleNotFoundError:
        return values != values
    return values == values

assert not spark.range(1).select(importable("id")).first()[0]
for name in contract.TEXT_QUERIES:
    contract.TEXT_QUERIES[name](spark, {SF_DIR!r}).write.format("noop").mode("overwrite").save()
    print("done", name)
"""


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_workers_need_no_copy_of_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("done") == 14
