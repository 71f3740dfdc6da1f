import random

import pytest
from pyspark.sql import Window, functions as F

from conftest import tuples
from shelfcast.operators.compare import compare, difference_counts, row_differences
from shelfcast.operators.dictionary import (
    ENTITY_COLUMNS,
    FORMAT_COLUMNS,
    format_profile,
    value_dictionary,
)
from shelfcast.operators.pairing import pair_up
from shelfcast.operators.ranking import global_rank, range_bucket, range_cuts
from shelfcast.operators.snippets import SNIPPETS, snippet


@pytest.mark.parametrize("cells", [1, 3, 50])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_pairs_are_complete_and_unique(spark, cells, threshold):
    left = spark.range(37).select(F.col("id").cast("string").alias("a"))
    right = spark.range(11).select(F.col("id").alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = sorted(tuples(pair_up(left, right, "a", cells)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((str(a), b) for a in range(37) for b in range(11))


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_rank_equals_the_single_task_window(spark, buckets):
    rng = random.Random(buckets)
    triples = {
        # one lead value holds most rows
        (0 if rng.random() < 0.7 else rng.randrange(9), f"s{rng.randrange(60):02d}", rng.randrange(9))
        for _ in range(900)
    }
    df = spark.createDataFrame(sorted(triples, key=str), "lead int, sku string, wh int")
    cuts = range_cuts(df, "sku", buckets)
    assert len(cuts) < buckets and cuts == sorted(cuts)
    ranked = global_rank(
        df.withColumn("part", range_bucket("sku", cuts)), "rank", "lead", "part", ["sku", "wh"]
    )
    plain = F.row_number().over(Window.orderBy("lead", "sku", "wh"))
    want = df.withColumn("rank", plain)
    assert sorted(tuples(ranked.select("lead", "sku", "wh", "rank"))) == sorted(tuples(want))


def test_rank_does_not_depend_on_the_cuts(spark):
    df = spark.range(100).selectExpr("int(id % 3) as lead", "lpad(string(id), 3, '0') as sku")
    results = []
    for cuts in ([], ["050"], ["000", "001", "099", "zzz"]):
        ranked = global_rank(
            df.withColumn("part", range_bucket("sku", cuts)), "rank", "lead", "part", ["sku"]
        )
        results.append(sorted(tuples(ranked.select("sku", "rank"))))
    assert results[0] == results[1] == results[2]


def test_difference_counts(spark):
    want = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3)], "k string, v int")
    got = spark.createDataFrame([(1, "a"), (None, "b"), (4, "c"), (4, "c")], "v int, k string")
    assert difference_counts(got, want).first() == (2, 2, False)
    assert sorted(tuples(row_differences(got, want)), key=str) == [
        ("a", 1, -1), ("c", 3, -1), ("c", 4, 2),
    ]
    assert difference_counts(want, want).first() == (0, 0, True)


def test_compare(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert compare(df.select("v", "k").orderBy("v"), df).matches
    retyped = df.withColumn("v", F.col("v").cast("long"))
    result = compare(retyped, df)
    assert (result.same_schema, result.missing_rows, result.matches) == (False, 0, False)
    other = compare(df.withColumnRenamed("v", "w"), df)
    assert (other.same_schema, other.missing_rows, other.extra_rows) == (False, 2, 2)
    with pytest.raises(ValueError, match="columns differ"):
        row_differences(df.select("k"), df)


def test_types_are_compared_first(spark):
    five = spark.createDataFrame([(5,)], "n int")
    near = spark.createDataFrame([(5.7,)], "n double")
    assert difference_counts(near, five).first() == (1, 1, False)
    assert difference_counts(five.select(F.col("n").cast("long")), five).first() == (0, 0, True)
    text = spark.createDataFrame([("five",), ("x",)], "n string")
    assert difference_counts(text, five).first() == (1, 2, False)
    assert difference_counts(five.withColumnRenamed("n", "m"), five).first() == (1, 1, False)
    close = spark.createDataFrame([(5.000001,)], "n double")
    assert difference_counts(close, five).first() == (1, 1, False)
    assert difference_counts(close, five.select(F.col("n").cast("double")), digits=3).first() == (0, 0, True)


@pytest.mark.parametrize("ranges", [1, 2, 1024, 5000])
def test_rank_with_many_ranges(spark, ranges):
    df = spark.range(6000).selectExpr("int(id % 2) as lead", "lpad(string(id * 7 % 6000), 5, '0') as sku")
    cuts = [f"{i:05d}" for i in range(1, ranges)]
    ranked = global_rank(df.withColumn("part", range_bucket("sku", cuts)), "rank", "lead", "part", ["sku"])
    plain = df.withColumn("rank", F.row_number().over(Window.orderBy("lead", "sku")))
    assert ranked.select("sku", "rank").exceptAll(plain.select("sku", "rank")).count() == 0


def test_value_dictionary(spark):
    df = spark.createDataFrame(
        [("x", 1, None), ("x", 2, "n"), ("y", 2, None)], "a string, b int, c string"
    )
    assert sorted(tuples(value_dictionary(df, ["a", "b", "c"]))) == [
        ("a", "x", 2), ("a", "y", 1), ("b", "1", 1), ("b", "2", 2), ("c", "n", 1),
    ]


def test_format_profile(spark):
    df = spark.createDataFrame([("x", 3), ("y", None)], "a string, b int")
    assert tuples(format_profile(df, ["a", "b"])) == [
        ("a", "string", "x", "y", 2), ("b", "int", "3", "3", 1),
    ]


def test_profiled_columns():
    assert {t: len(c) for t, c in ENTITY_COLUMNS.items()} == {
        "demand_forecasts": 3, "inventory_levels": 4, "shipment_orders": 5,
    }
    only_format = {t: set(c) - set(ENTITY_COLUMNS[t]) for t, c in FORMAT_COLUMNS.items()}
    assert only_format == {
        "demand_forecasts": {"forecast_date"}, "inventory_levels": set(), "shipment_orders": {"order_date"},
    }


def test_snippets_by_name_and_synonym():
    kinds = [s.kind for s in SNIPPETS]
    assert [kinds.count(k) for k in ("filter", "expression", "measure")] == [3, 3, 4]
    names = [n for s in SNIPPETS for n in (s.alias, *s.names)]
    assert len(names) == len(set(names))
    assert snippet(" Low Stock ").alias == "below_reorder_point"
    assert snippet("order_quarter") is snippet("quarterly")
    with pytest.raises(KeyError, match="no snippet"):
        snippet("nope")


def test_snippet_measures_count_every_status(make_shipments):
    ship = make_shipments(
        ("O1", "2025-01-01", "A", "x", 2, "1.50", "W", "R", "Delivered"),
        ("O2", "2025-01-01", "A", "x", 4, "1.50", "W", "R", "Cancelled"),
    )
    both = [snippet("units shipped").column(), snippet("revenue").column()]
    assert ship.agg(*both).first().asDict() == {"gross_units": 6, "gross_revenue": 9}
    delivered = ship.where(snippet("fulfilled orders").build())
    assert delivered.agg(*both).first().asDict() == {"gross_units": 2, "gross_revenue": 3}


def one_column(spark, kind, *values):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize(
    "left, right, equal",
    [
        (("decimal(19,2)", "90071992547409930.01"), ("decimal(21,4)", "90071992547409930.0300"), False),
        (("decimal(19,2)", "90071992547409930.01"), ("decimal(21,4)", "90071992547409930.0100"), True),
        (("bigint", 2**53 + 1), ("double", float(2**53)), False),
        (("bigint", 2**53), ("double", float(2**53)), True),
        (("int", 5), ("double", 5.5), False),
        (("int", 5), ("decimal(3,1)", "5.5"), False),
        (("int", 5), ("decimal(3,1)", "5.0"), True),
        (("decimal(38,0)", "9" * 38), ("decimal(38,38)", "0." + "9" * 38), False),
        (("decimal(38,0)", "-7"), ("decimal(38,30)", "-7." + "0" * 30), True),
        (("decimal(38,0)", "-7"), ("decimal(38,30)", "-7." + "0" * 29 + "1"), False),
        (("decimal(10,2)", "12.34"), ("double", 12.34), True),
        (("decimal(10,2)", "12.34"), ("double", 12.340000000000002), False),
        (("decimal(19,2)", "90071992547409930.01"), ("double", 90071992547409930.01), False),
        (("bigint", 1), ("double", float("nan")), False),
        (("bigint", 1), ("double", 1e300), False),
        (("float", 0.5), ("double", 0.5), True),
        (("double", 0.0), ("double", -0.0), True),
        (("double", None), ("decimal(5,1)", None), True),
        (("string", "5"), ("int", 5), False),
    ],
)
def test_numbers_are_compared_exactly(spark, left, right, equal):
    def frame(kind, value):
        return one_column(spark, "string", None if value is None else str(value)).select(F.col("x").cast(kind).alias("x"))

    for one, two in ((left, right), (right, left)):
        got = difference_counts(frame(*one), frame(*two)).first()
        assert got == ((0, 0, True) if equal else (1, 1, False)), (one, two)


def test_nulls_of_different_columns_differ(spark):
    one = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string")
    two = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    assert difference_counts(one, two).first() == (2, 2, False)
    assert difference_counts(one, one.orderBy("x")).first() == (0, 0, True)


def test_equal_answers_move_no_rows(spark):
    many = spark.range(1000).withColumn("y", F.col("id") % 7)
    plan = plan_text(difference_counts(many, many.orderBy(F.desc("y"))))
    assert "Exchange" not in plan
    assert "Exchange" in plan_text(difference_counts(many, many.where("y > 0")))


def test_rounded_where_asked(spark):
    exact = one_column(spark, "double", 1.23456).select("x", F.lit("1.2346").cast("decimal(8,4)").alias("d"))
    near = one_column(spark, "double", 1.23461).select("x", F.lit(1.23456).alias("d"))
    assert difference_counts(near, exact, digits=4).first() == (0, 0, True)
    assert difference_counts(near, exact).first() == (1, 1, False)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_part_has_its_own_partition(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = pair_up(spark.range(400).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b"), "a", cells=16)
        filled = pairs.groupBy(F.spark_partition_id()).count().collect()
        assert len(filled) == 16 and sum(r["count"] for r in filled) == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
