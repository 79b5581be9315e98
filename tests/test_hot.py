import random

import pytest
from pyspark.sql import functions as F

from kikitori.operators.hot import hot_keys, spread_join
from kikitori.operators.prefix import prefix_sum, range_buckets


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, how):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 50 + ["a", "b", "c", "gone", None])) for i in range(400)] + [(0, "hot"), (0, "hot")]
    df = spark.createDataFrame(rows, "i int, k string")
    table = spark.createDataFrame([("hot", 1, "x"), ("a", 2, None), ("b", 3, "y"), ("c", 4, "z"), ("other", 5, "w"), (None, 6, "n")], "k string, v int, w string")
    got = spread_join(df, table, "k", how, share=0.05)
    assert got.columns == ["i", "k", "v", "w"]
    assert sorted(got.collect(), key=str) == sorted(df.join(table, "k", how).select("i", "k", "v", "w").collect(), key=str)
    assert hot_keys(df, "k", 0.05) == ["hot"]
    assert spread_join(df.where("false"), table, "k", how).count() == 0
    assert spread_join(df, table.where("false"), "k", how).count() == (len(rows) if how == "left" else 0)


def test_ranges_follow_the_order(spark):
    df = spark.range(3_000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"), (F.rand(1) ** 20).alias("x"), F.lit(1).alias("one"))
    got = prefix_sum(range_buckets(df, ["s", "x", "id"], "bucket", 3_000_000), ["s"], "bucket", ["x", "id"], "one", "before", "n").collect()
    assert len({r.bucket for r in got}) > 20
    for s in map(str, range(7)):
        own = sorted((r for r in got if r.s == s), key=lambda r: (r.x, r.id))
        assert [r.before for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
