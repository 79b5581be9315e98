import random

from pyspark.sql import functions as F

from kikitori.operators import segments as S


def brute_islands(x, gap, inclusive):
    out = []
    for s, e in sorted(x):
        if out and ((s - out[-1][1] <= gap) if inclusive else (s - out[-1][1] < gap)):
            out[-1] = [out[-1][0], max(out[-1][1], e), out[-1][2] + 1]
        else:
            out.append([s, e, 1])
    return sorted(map(tuple, out))


def test_islands_and_neighbours(spark):
    rng = random.Random(3)
    segs, others = [], []
    for k in range(6):
        for _ in range(25):
            s = rng.randint(0, 100)
            segs.append((k, float(s), float(s + rng.randint(1, 6))))
            s = rng.randint(0, 110)
            others.append((k, float(s), float(s + rng.randint(1, 3))))
    df, ot = spark.createDataFrame(segs, "k int, a double, b double"), spark.createDataFrame(others, "k int, a double, b double")
    for inclusive in (False, True):
        got = S.islands(df, ["k"], "a", "b", 2.0, inclusive)
        for k in range(6):
            assert sorted((r.s, r.e, r.n) for r in got.where(f"k = {k}").collect()) == brute_islands([(a, b) for q, a, b in segs if q == k], 2.0, inclusive)
    spans = S.islands(df, ["k"], "a", "b", 2.0)
    for r in S.nearest_bounds(spans, ot, ["k"], "a", "b").collect():
        assert r.prev_end == max((b for q, a, b in others if q == r.k and b <= r.s), default=None)
        assert r.next_start == min((a for q, a, b in others if q == r.k and a >= r.e), default=None)
    for r in S.padded(S.nearest_bounds(spans, ot, ["k"], "a", "b"), 0.5, 9.0).collect():
        assert r.s >= 0 and r.e >= r.s


def test_empty_segments(spark):
    df = spark.createDataFrame([], "k int, a double, b double")
    assert S.islands(df, ["k"], "a", "b", 1.0).count() == 0


def test_long_enough_cuts_each_bound(spark):
    df = spark.createDataFrame([(0.9, 1.9), (0.00009, 1.00005)], "a double, b double")
    assert [r[0] for r in df.select(S.long_enough(F.col("a"), F.col("b"), 1.0, 10_000)).collect()] == [int(1.9 * 10_000) - int(0.9 * 10_000) >= 10_000, int(1.00005 * 10_000) - int(0.00009 * 10_000) >= 10_000]


def test_words(spark):
    w = spark.createDataFrame([(1, 0.0, 0.4, "あ"), (1, 0.5, 0.9, "い。"), (1, 1.0, 1.2, "う"), (1, 3.0, 3.2, "え")], "rec int, a double, b double, t string")
    got = sorted(r.text for r in S.regroup_words(w, ["rec"], "a", "b", "t", 0.5, 12.0, "。").collect())
    assert got == ["あい。", "う", "え"]
    t = spark.createDataFrame([(1, "x", 0.0, 0.45), (1, "y", 0.45, 3.1), (1, None, 5.0, 6.0)], "rec int, speaker string, ts double, te double")
    words = w.select("rec", F.monotonically_increasing_id().alias("word_id"), F.col("a").alias("ws"), F.col("b").alias("we"), "t")
    assert {r.t: r.speaker for r in S.assign_speakers(words, t, ["rec"]).collect()} == {"あ": "x", "い。": "y", "う": "y", "え": "y"}


def test_mapping_report(spark):
    want = spark.createDataFrame([(i, 1.0) for i in range(300)], "i int, seconds double")
    have = spark.createDataFrame([(i, 1.0 if i > 2 else 2.0) for i in range(300)], "i int, seconds double")
    assert S.mapping_report(want, have, ["i"], 0.05).first()[:] == (300, 3, True)
    assert S.mapping_report(want, have.where("false"), ["i"], 0.05).first().ok is False
