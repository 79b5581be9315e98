import random

from pyspark.sql import functions as F

from kikitori.operators.eager import eager_join_aggregate, heavy_keys, join_states


def test_join_aggregate_against_plain_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice("aab") if i % 7 else None, rng.choice(["x", "y", None]), i % 5 if i % 4 else None) for i in range(200)], "k string, g string, m int")
    right = spark.createDataFrame([(rng.choice("abc") if i % 5 else None, i % 3) for i in range(90)], "k string, w int")
    got = eager_join_aggregate(left, right, ["k"], ["g"], {"ml": F.col("m")}, {"wr": F.col("w")}).select("g", "joined_rows", "ml", "wr")
    want = left.join(right, "k").groupBy("g").agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("ml"), F.sum("w").alias("wr"))
    key = lambda rows: sorted((str(r[0]), *[int(x) for x in r[1:]]) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_left_keeps_unmatched_and_hot_products_dont_overflow(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, m bigint")
    right = spark.createDataFrame([], "k string, w bigint")
    got = {r.k: int(r.ml) for r in eager_join_aggregate(left, right, ["k"], ["k"], {"ml": F.col("m")}, {"wr": F.col("w")}, how="left").collect()}
    assert got == {"a": 1, None: 2}
    big = 4_000_000_000_000_000_000
    hot = spark.createDataFrame([("a", big)], "k string, m bigint")
    many = spark.createDataFrame([("a", 1)] * 5, "k string, w bigint")
    assert int(eager_join_aggregate(hot, many, ["k"], ["k"], {"ml": F.col("m")}, {}).first().ml) == 5 * big


def test_states_and_heavy_keys(spark):
    a = spark.createDataFrame([("a", 97), (None, 1), ("b", 2)], "k string, n bigint")
    b = spark.createDataFrame([("a", 5), (None, 7)], "k string, c bigint")
    assert sorted((str(r.k), r.c) for r in join_states(a, b, ["k"], ["c"]).collect()) == [("None", 7), ("a", 5), ("b", 0)]
    assert [r.k for r in heavy_keys(a, "k", "n", 0.025).collect()] == ["a"]
    assert heavy_keys(a.where("false"), "k", "n", 0.025).count() == 0
