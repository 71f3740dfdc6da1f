import random
from collections import Counter

import pytest

from conftest import tuples
from shelfcast.operators.top_values import top_values


def brute(rows, columns, k):
    out = []
    for i, c in enumerate(columns):
        counts = Counter(str(r[i]) for r in rows if r[i] is not None)
        out += [(c, v, n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("buckets", [1, 7, 65536])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_against_counting_every_value(spark, buckets, k):
    rng = random.Random(3)
    rows = [
        (int(rng.paretovariate(0.7)) % 5000, f"v{i % 300}", None if i % 3 else "hot", i)
        for i in range(3000)
    ]
    columns = ["skewed", "flat", "one", "key"]
    df = spark.createDataFrame(rows, "skewed int, flat string, one string, key int")
    assert sorted(tuples(top_values(df, columns, k, buckets))) == brute(rows, columns, k)


def test_columns_named_like_its_own_ties_and_nothing(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, None)], "value string, bucket int")
    assert sorted(tuples(top_values(df, ["value", "bucket"], 1))) == [("bucket", "1", 2), ("value", "a", 1)]
    assert tuples(top_values(df.limit(0), ["value"], 3)) == []
    assert tuples(top_values(df.where("value is null"), ["value"], 3)) == []
    with pytest.raises(ValueError):
        top_values(df, ["value"], 0)
