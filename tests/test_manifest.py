import random

import pytest
from pyspark.sql import functions as F

from kikitori.operators import manifest as M
from kikitori.operators.prefix import hash_bucket, prefix_sum


def test_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "p string, i int, w int").withColumn("b", (F.col("i") / 40).cast("int"))
    got = {(r.p, r.i): r.s for r in prefix_sum(df, ["p"], "b", ["i"], "w", "s").collect()}
    run, want = {}, {}
    for p, i, w in rows:
        want[p, i] = run.get(p, 0)
        run[p] = run.get(p, 0) + (w or 0)
    assert got == want
    assert prefix_sum(df.where("false"), ["p"], "b", ["i"], "w", "s").count() == 0


def test_reasons_first_wins(spark):
    df = spark.createDataFrame([("", False, 8000, 0), ("a", False, 8000, 0), ("a", True, 8000, 0), ("a", True, 16000, 0), ("a", True, 16000, 9)], "t string, ok boolean, r int, n bigint")
    got = [r[0] for r in df.select(M.skip_reason(F.col("t"), F.col("ok"), F.col("r"), F.col("n"), 16000, 1.0)).collect()]
    assert got == ["empty_text", "audio_decode", "low_sample_rate", "trimmed_empty", None]


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a = M.split_train_valid(df, "id", 0.05, 3)
    assert a.where("split = 'valid'").count() == 50 and a.count() == 1000
    assert {r.id for r in a.where("split = 'valid'").collect()} == {r.id for r in M.split_train_valid(df.repartition(7), "id", 0.05, 3).where("split = 'valid'").collect()}
    assert M.split_train_valid(spark.range(3), "id", 0.999, 1).where("split = 'valid'").count() == 2
    assert M.split_train_valid(df, "id", 0, 3).where("split = 'valid'").count() == 0
    with pytest.raises(ValueError):
        M.split_train_valid(spark.range(1), "id", 0.5, 3)


def test_references(spark):
    rows = [(i, "hot" if i < 300 else f"s{i % 40}" if i < 400 else None) for i in range(410)] + [(999, "single")]
    df = spark.createDataFrame(rows, "id int, speaker string")
    of = dict(rows)
    for r in M.reference_pairs(df, "id", ["speaker"], 5).collect():
        if r.has_ref:
            assert r.ref != r.id and of[r.ref] == r.speaker
        else:
            assert r.ref == r.id and (r.speaker is None or r.speaker == "single")


def test_shards_and_offsets(spark):
    df = spark.createDataFrame([(i, "é" * i) for i in range(20)], "n bigint, t string")
    got = {r.n: r.byte_offset for r in M.line_offsets(df, "n", F.col("t")).collect()}
    at = 0
    for i in range(20):
        assert got[i] == at
        at += 2 * i + 1
    # ids that start high are spread too
    high = df.select((F.col("n") + 10**12).alias("n"), "t")
    assert high.select(M.number_bucket(high, "n")).distinct().count() > 5
    assert {r.n - 10**12: r.byte_offset for r in M.line_offsets(high, "n", F.col("t")).collect()} == got
    assert M.line_offsets(df.where("false"), "n", F.col("t")).count() == 0
    ranks = [r[0] for r in spark.range(10).select(M.rank_contiguous(F.col("id"), 2, 10, 3)).collect()]
    assert ranks == [None, None, 0, 0, 0, 1, 1, 1, 2, 2]
    seen = M.first_accepted(spark.range(20).select("id", F.lit(0).alias("rank"), (F.col("id") % 3 == 0).alias("ok")), "rank", "id", F.col("ok"), 2)
    assert seen.count() == 4
    assert spark.range(4).select(hash_bucket(F.col("id"), buckets=2)).distinct().count() <= 2
