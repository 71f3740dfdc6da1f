import random

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.ordering import order_violations
from shelfcast.plans.benchmarks import check_answers
from shelfcast.plans.catalogue import answer
from shelfcast.sources.contracts import SHIPMENTS

COLUMNS = "a int, b string"


def least_first(value):
    return (value is not None, value)


def before(row, other):
    """By a ascending, then b descending; null is least."""
    if row[0] != other[0]:
        return least_first(row[0]) < least_first(other[0])
    return row[1] != other[1] and least_first(row[1]) > least_first(other[1])


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_equals_a_walk_over_the_rows(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for _ in range(200)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), COLUMNS)
    want = sum(before(row, ahead) for ahead, row in zip(rows, rows[1:]))
    assert order_violations(df, ["a", "-b"]).first().asDict() == {"n_rows": 200, "out_of_order": want}


def test_sorted_rows_have_none(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100).cast("int").alias("a"), F.col("id").cast("string").alias("b"))
    assert order_violations(df.orderBy("a", F.desc("b")), ["a", "-b"]).first().out_of_order == 0
    assert order_violations(df.orderBy(F.desc("a")), ["a"]).first().out_of_order == 99


def test_empty_partitions_and_no_rows(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(2, "x"), (1, "x")], 6), COLUMNS)
    assert tuple(order_violations(rows, ["a"]).first()) == (2, 1)
    assert tuple(order_violations(rows.where("a > 5"), ["a"]).first()) == (0, 0)
    with pytest.raises(ValueError):
        order_violations(rows, [])


def test_an_answer_in_the_wrong_order(spark, make_shipments):
    rows = [
        (f"O{i}", "2025-01-02", "S1", "Electronics", 10 * i, "2.00", f"W{i}", "Pacific", "Delivered")
        for i in range(1, 6)
    ]
    tables = {SHIPMENTS.table: make_shipments(*rows)}
    name = "volume_by_warehouse"
    given = answer(name, tables)
    order = {name: ["-total_shipped"]}
    right = check_answers({name: given}, tables, orders=order).first()
    assert (right.out_of_order, right.matches) == (0, True)
    turned = {name: given.orderBy("total_shipped")}
    wrong = check_answers(turned, tables, orders=order).first()
    assert (wrong.missing_rows, wrong.extra_rows, wrong.out_of_order, wrong.matches) == (0, 0, 4, False)
    assert check_answers(turned, tables).first().matches
    with pytest.raises(ValueError):
        check_answers(turned, tables, orders={"revenue_by_region": ["-total_revenue"]})
