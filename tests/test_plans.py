"""What the physical plans must and must not contain."""

import contextlib
import io
import re
from pathlib import Path

import pytest

from driver_queries.queries import QUERIES
from shelfcast.operators.compare import row_differences
from shelfcast.plans import analyses
from shelfcast.sources import adapters, generate

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def plan_of(df, mode: str = "simple") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_all_pairs_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_rank_moves_only_group_sizes_to_one_task(spark):
    plan = plan_of(generate.sample_tables(spark)["shipment_orders"])
    single = [m.start() for m in re.finditer("SinglePartition", plan)]
    assert len(single) == 1
    below = plan[single[0]:].split("\n")
    assert "HashAggregate" in below[1] and "count" in below[1]


@pytest.mark.parametrize("made", ["sample", "from_tables"])
def test_rank_makes_the_pairs_once(spark, made):
    orders = (
        generate.sample_tables(spark)["shipment_orders"]
        if made == "sample"
        else QUERIES["gen_shipments"](spark, SF_DIR)
    )
    orders.collect()
    plan = orders._jdf.queryExecution().executedPlan().toString()
    done = plan[: plan.index("Initial Plan")]
    assert done.count("Generate explode") == 2  # once to cells, once to dates


def test_distinct_measures_do_not_copy_rows(spark):
    plan = plan_of(QUERIES["shipment_metrics_by_month"](spark, SF_DIR))
    assert "Expand" not in plan


def test_only_needed_tables_and_columns_are_read(spark):
    plan = plan_of(QUERIES["fill_rate_by_category"](spark, SF_DIR))
    schemas = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == [
        "l_orderkey:bigint,l_partkey:bigint,l_returnflag:string,l_linestatus:string",
        "o_orderkey:bigint,o_orderstatus:string",
        "p_partkey:bigint,p_type:string",
    ]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "forecasts")
    adapters.forecasts(spark, SF_DIR).write.parquet(path)
    plan = plan_of(
        analyses.actual_vs_forecast(spark.read.parquet(path), "PROMO"), "formatted"
    )
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "EqualTo(product_category,PROMO)" in pushed
    assert "GreaterThanOrEqual(forecast_date,2025-10-01)" in pushed


def test_latest_snapshot_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "inventory")
    adapters.inventory(spark, SF_DIR).write.partitionBy("snapshot_date").parquet(path)
    df = analyses.below_reorder(spark.read.parquet(path))
    plan = plan_of(df)
    pruning = [p for p in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "ubquery" in p]
    assert pruning and "snapshot_date" in pruning[0]


def test_trailing_window_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "shipments")
    columns = ["order_id", "order_date", "quantity", "warehouse_id", "order_status"]
    adapters.shipments(spark, SF_DIR, columns).where("order_date > '2001-06-01'").write.partitionBy(
        "order_date"
    ).parquet(path)
    plan = plan_of(analyses.recent_volume_by_warehouse(spark.read.parquet(path)))
    pruning = [p for p in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "ubquery" in p]
    assert pruning and "add_months" in pruning[0]


def test_demand_is_aggregated_before_its_join(spark):
    plan = plan_of(
        analyses.days_of_supply(
            adapters.inventory(spark, SF_DIR),
            adapters.shipments(
                spark, SF_DIR,
                ["product_sku", "warehouse_id", "order_date", "quantity", "order_status"],
            ),
        )
    )
    join = plan.index("LeftOuter")
    assert "HashAggregate" in plan[join:] or "SortAggregate" in plan[join:]


def test_comparison_shuffles_each_side_once_and_drops_sorts(spark, tmp_path):
    path = str(tmp_path / "inventory")
    adapters.inventory(spark, SF_DIR).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = plan_of(row_differences(stored.orderBy("unit_cost"), stored.orderBy("product_sku")))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "rangepartitioning" not in plan and "Sort [" not in plan
