from bisect import bisect_right

from pyspark.sql import functions as F

from graphloom.llm.common import range_bounds, range_bucket


def test_range_buckets(spark):
    keys = spark.createDataFrame([(k,) for k in [*range(-3, 120), None]], "k bigint")
    for n in (0, 1, 2, 5, 9, 10, 17):
        bounds = [7 * i for i in range(n)]
        got = keys.select("k", range_bucket(F.col("k"), bounds).alias("b")).collect()
        assert all(r.b == (bisect_right(bounds, r.k) if r.k is not None else 0) for r in got)
    assert range_bounds(keys.limit(0), "k", 5) == [] == range_bounds(keys, "k", 1)
    assert range_bounds(keys, "k", 4) == sorted(set(range_bounds(keys, "k", 4))) and len(range_bounds(keys, "k", 4)) == 3
