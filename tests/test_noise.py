import datetime as dt

from pyspark.sql import functions as F

from conftest import tuples
from shelfcast.functions import noise_fraction, noise_int


def keyed(spark, n=2000):
    return spark.range(n).select(
        F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 365).cast("int")).alias("d"),
        F.concat(F.lit("SKU-"), F.col("id").cast("string")).alias("sku"),
    )


def test_noise_is_spark_hash_of_seed_salt_and_typed_keys(spark):
    df = keyed(spark, 50).withColumn("x", noise_int(7, "salt", "d", "sku", modulo=100, offset=-1))
    df = df.withColumn("y", F.expr("pmod(hash('7', 'salt', d, sku), 100) - 1"))
    assert df.where("x <> y").count() == 0
    as_text = df.withColumn("z", F.expr("pmod(hash('7', 'salt', string(d), sku), 100) - 1"))
    assert as_text.where("x <> z").count() > 0


def test_fraction_is_on_a_grid_below_one(spark):
    f = noise_fraction(7, "s", "d", "sku")
    got = keyed(spark).select(f.alias("f")).agg(
        F.min("f"), F.max("f"), F.avg("f"), F.count_if(F.round(F.col("f") * 10000) / 10000 != F.col("f"))
    ).first()
    assert 0 <= got[0] and got[1] < 1 and abs(got[2] - 0.5) < 0.03 and got[3] == 0


def test_seed_and_salt_matter_and_layout_does_not(spark):
    df = keyed(spark)
    one = sorted(tuples(df.select("sku", noise_fraction(1, "a", "d", "sku"))))
    assert one == sorted(tuples(df.repartition(7).select("sku", noise_fraction(1, "a", "d", "sku"))))
    assert one != sorted(tuples(df.select("sku", noise_fraction(2, "a", "d", "sku"))))
    assert one != sorted(tuples(df.select("sku", noise_fraction(1, "b", "d", "sku"))))
