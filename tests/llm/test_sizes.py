import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kikitori.llm.mixing import draw_mix, reached_shares
from kikitori.llm.packing import best_fit, configurations, linear_groups, pack
from kikitori.llm.pieces import RangeMax, boundary_strengths, cut_pieces, oversized_rows, recording_pieces
from kikitori.llm.tokens import token_count


def test_range_maximum():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 97)
    table = RangeMax(x)
    for _ in range(500):
        lo, hi = sorted(rng.integers(0, 97, 2).tolist())
        want = max(x[lo : hi + 1])
        assert table.strongest(lo, hi) == (want, max(i for i in range(lo, hi + 1) if x[i] == want))


def test_pieces_cover_and_overlap():
    rng = random.Random(5)
    for _ in range(100):
        n, limit, overlap = rng.randint(1, 400), rng.randint(20, 90), rng.randint(0, 15)
        talk, at = [], 0
        while at < n * 40 and rng.random() < 0.95:
            a = at + rng.randint(1, 900)
            talk.append((a, a + rng.randint(1, 5000)))
            at = talk[-1][1]
        s = boundary_strengths(n, 25.0, talk)
        p = cut_pieces(n, limit, overlap, s)
        assert p[0][0] == 0 and p[-1][1] == n and all(0 < b - a <= limit for a, b, _ in p)
        assert all(b == c + overlap for (_, b, _), (c, _, _) in zip(p, p[1:]))
        for a, b, natural in p[:-1]:
            assert natural == (s[b] > 0) and (natural or not s[a + overlap + 1 : a + limit + 1].any())
            if natural and b - a >= limit // 2:
                window = s[a + max(overlap + 1, int(limit * 0.5)) : a + limit + 1]
                assert s[b] == window.max() and not (s[b + 1 : a + limit + 1] == s[b]).any()
    with pytest.raises(ValueError):
        cut_pieces(10, 5, 5, np.zeros(11))


def test_recordings(spark):
    seg = "array<struct<speaker string, start_s double, end_s double, duration double>>"
    d = spark.createDataFrame(
        [("a.wav", 40.0, [("x", 0.0, 31.0, 31.0), (None, 20.0, 25.0, 5.0), ("x", None, 3.0, 1.0)]), ("a.wav", 41.0, [("y", 35.0, 34.0, 1.0)]), ("b.wav", 40.0, []), ("c.wav", 8.0, None)],
        f"audio_file string, duration double, segments {seg}",
    )
    m = spark.createDataFrame([(1, "l/a.pt", None), (2, "/x/b.pt", 1000), (3, "c.pt", None), (4, "zz.pt", 5000), (5, None, 5000), (6, "./a.pt", 750)], "row_id bigint, latent_path string, num_frames int").withColumn("stem", F.lit("clash"))
    p = recording_pieces(m, d, 750, 50, 25.0)
    assert sorted((r.row_id, r.kind) for r in oversized_rows(p, 750, 25.0).collect()) == [(1, "forced"), (1, "oversized"), (2, "oversized")]
    assert max(r.end_frame for r in p.where("row_id = 1").collect()) == 1025
    assert recording_pieces(m.where("false"), d, 750, 50, 25.0).count() == 0 and recording_pieces(m, d.where("false"), 750, 50, 25.0).count() == 0


def test_groups_and_configurations():
    rng = random.Random(6)
    h = {}
    for _ in range(3000):
        s = rng.randint(13, 100)
        h[s] = h.get(s, 0) + 1
    groups = linear_groups(h, 16)
    assert sum(g[2] for g in groups) == 3000 and all(a[0] > b[1] for a, b in zip(groups, groups[1:]))
    plan = configurations([g[1] for g in groups], [g[2] for g in groups], 100)
    used = [0] * len(groups)
    for times, slots in plan:
        assert times > 0 and sum(groups[g][1] * k for g, k in slots.items()) <= 100
        for g, k in slots.items():
            used[g] += k * times
    assert used == [g[2] for g in groups]
    placed = dict(best_fit([(10, 1), (4, 2)], [(7, 4), (8, 9), (9, 50)], 60, 100))
    assert placed == {9: 100, 8: 1, 7: 2}


def test_packing(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([0, 3, 40, 333, rng.randint(1, 2000), 2048, 5000])) for i in range(3000)] + [(5000, None), (5001, 2048 * 2)]
    df = spark.createDataFrame(sizes, "k bigint, n int").withColumn("size", F.lit("clash"))
    rows = pack(df.drop("size"), "k", "n", 2048).collect()
    bins, parts = {}, {}
    for r in rows:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.end_unit - r.start_unit
        parts.setdefault(r.item, []).append((r.start_unit, r.end_unit))
    assert max(bins.values()) <= 2048 and set(parts) == {k for k, _ in sizes}
    for k, n in sizes:
        p = sorted(parts[k])
        assert p[0][0] == 0 and p[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(p, p[1:])) and len(p) == max(1, -(-(n or 0) // 2048))
    assert sum(bins.values()) / (2048 * len(bins)) > 0.97
    assert pack(df.where("false"), "k", "n", 2048).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, "big", rng.randint(1, 50), 1.0) for i in range(4000)] + [(10_000 + i, "small", rng.randint(1, 50), rng.choice([None, 0.0, float("nan"), 2.0])) for i in range(150)] + [(20_000, None, 9, 1.0), (20_001, "big", None, 1.0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int, weight double")
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 4), ("nothing", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = draw_mix(d, t)
    s = {r.source: r for r in reached_shares(mix, t).collect()}
    assert abs(s["big"].reached_share - 0.8) < 0.01 and abs(s["small"].reached_share - 0.2) < 0.01 and s["nothing"].reached_share == 0
    assert s["small"].most_repeats <= 4 and s["big"].most_repeats == 1
    reps = {r.repeats for r in mix.where("source = 'small'").collect()}
    assert max(reps) - min(reps) <= 1
    assert {tuple(r) for r in mix.collect()} == {tuple(r) for r in draw_mix(d.repartition(5), t).collect()}
    assert draw_mix(d.where("false"), t).count() == 0


def test_heavier_documents_are_drawn_more(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("n_tokens"), F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5).alias("weight"))
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = draw_mix(d, t, total_tokens=10_000.0)
    n = got.count()
    assert abs(n - 1000) <= 1 and got.where("doc_id % 2 = 0").count() > 0.7 * n


def test_tokens(spark):
    df = spark.createDataFrame([("こんにちは",), ("",), (None,)], "t string")
    n = [r[0] for r in df.select(token_count(F.col("t"))).collect()]
    assert n[0] > 0 and n[1:] == [0, 0]
