import random

from pyspark.sql import functions as F

from kikitori.operators.runs import periods_and_gaps, run_bitmaps, to_ms


def brute(intervals):
    out, last = [], None
    for s, e in sorted(i for i in intervals if i[0] is not None and i[1] is not None and i[1] > i[0]):
        if last and s <= last[1]:
            last[1] = max(last[1], e)
        else:
            if last:
                out.append(("gap", last[1], s))
            last = [s, e]
            out.append(last)
    return sorted(("period", x[0], x[1]) if isinstance(x, list) else x for x in out)


def test_against_brute_force_across_shards(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for entity in range(12):
        own = []
        for _ in range(rng.randint(0, 60)):
            s = rng.randint(-300_000, 900_000)
            own.append((s, s + rng.choice([0, -5, 1, 500, 3000, 65_536, 200_000])))
        if entity == 5:  # blocks, coarser levels, what they cover
            own += [(10, 40_000_000), (2**33, 2**33 + 2**34), (2**33 + 70_000, 2**33 + 80_000), (2**40, 2**50), (2**41 + 5, 2**41 + 9), (2**52, 2**52 + 65_536), (40_000_000, 40_000_001)]
        if entity == 6:
            own += [(-(2**45), 2**45), (2**45, 2**45 + 1), (-(2**62), -(2**60)), (7 << 23, 8 << 23), (8 << 23, 9 << 23)]
        if entity == 3:  # edges of shards, whole shards, touching
            own += [(0, 65_536), (65_536, 131_072), (131_072, 131_073), (262_144, 327_680), (327_681, 327_690)]
        own += own[:5] + [(None, 5), (5, None)]
        rows += [(entity, s, e) for s, e in own]
        want[entity] = brute(own)
    df = spark.createDataFrame(rows, "entity int, s bigint, e bigint").withColumn("kind", F.lit("clash"))
    got = {}
    for r in periods_and_gaps(df, ["entity"], "s", "e").collect():
        got.setdefault(r.entity, []).append((r.kind, r.start_ms, r.end_ms))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_a_corrupt_end_makes_few_runs(spark):
    df = spark.createDataFrame([("a", 5, 9_000_000_000_000_000_000), ("a", 100, 200), ("b", 1, 3)], "k string, s bigint, e bigint")
    assert run_bitmaps(df, ["k"], "s", "e").count() <= 10
    got = sorted((r.k, r.kind, r.start_ms, r.end_ms) for r in periods_and_gaps(df, ["k"], "s", "e").collect())
    assert got == [("a", "period", 5, 9_000_000_000_000_000_000), ("b", "period", 1, 3)]


def test_many_runs_of_one_shard(spark):
    df = spark.range(30_000).select(F.lit("a").alias("k"), (F.col("id") * 2).alias("s"), (F.col("id") * 2 + 1).alias("e"))
    assert periods_and_gaps(df, ["k"], "s", "e").groupBy("kind").count().orderBy("kind").collect() == [("gap", 29_999), ("period", 30_000)]


def test_empty_and_null_entities(spark):
    df = spark.createDataFrame([(None, 1, 5), ("a", 5, 5)], "k string, s bigint, e bigint")
    assert periods_and_gaps(df, ["k"], "s", "e").count() == 0
    assert periods_and_gaps(df.where("false"), ["k"], "s", "e").count() == 0


def test_milliseconds(spark):
    df = spark.createDataFrame([(1.0005,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(to_ms(F.col("x"))).collect()] == [1001, None, None, None]
