import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kikitori.functions import arrays as A
from kikitori.functions import schedules as H
from kikitori.operators import cluster as C
from kikitori.operators import metrics as X


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_patches(spark):
    rows = F.array(*[lits([i, -i]) for i in range(7)])
    r = one(spark, A.patchify(rows, 3).alias("p"), A.unpatchify(A.patchify(rows, 3), 3, 2).alias("u"), A.patchify(F.slice(rows, 1, 2), 3).alias("short"))
    assert r.p == [[0, 0, 1, -1, 2, -2], [3, -3, 4, -4, 5, -5]]
    assert r.u == [[float(i), float(-i)] for i in range(6)]
    assert r.short == []
    assert one(spark, A.patch_mask(F.array(*[F.lit(x) for x in (True, True, True, False, True)]), 2))[0] == [True, False]


def test_flattening_and_tail(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(10, 4)), np.zeros((9, 4))])
    def brute(x, w):
        padded = np.concatenate([x, np.zeros((w, x.shape[1]))])
        return next((i for i in range(len(x)) if padded[i : i + w].std() < 0.05 and abs(padded[i : i + w].mean()) < 0.1), len(x))
    arr = F.array(*[lits(r) for r in x])
    loud = F.array(*[lits(r) for r in x[:10]])
    r = one(spark, A.flattening_point(arr, 5).alias("a"), A.flattening_point(loud, 5).alias("b"))
    assert (r.a, r.b) == (brute(x, 5), brute(x[:10], 5))
    wav = [0.5] * 30 + [0.0001] * 25
    t = one(spark, A.speech_end(lits(wav), 500).alias("e"), A.tail_fade_pad(lits(wav), 500, 20.0, 8.0).alias("x"))
    assert t.e == 35 and len(t.x) == 35 + 4 and abs(t.x[34]) < 1e-9 and t.x[10] == 0.5


def test_layout_masks_levels(spark):
    x = F.array(lits([1, 2, 3]), lits([4, 5, 6]))
    r = one(spark, A.coerce_layout(x, 3).alias("same"), A.coerce_layout(x, 2).alias("turned"), A.mono_mix(x).alias("mono"), A.l2_normalize(lits([0, 0])).alias("zero"), A.l2_normalize(lits([float("nan"), 1])).alias("nan"))
    assert r.same == [[1, 2, 3], [4, 5, 6]] and r.turned == [[1, 4], [2, 5], [3, 6]] and r.mono == [2.5, 3.5, 4.5] and r.zero is None and r.nan is None
    none = F.array(F.lit(False), F.lit(False))
    v, m = A.safe_mask(lits([1, 2]), none)
    r = one(spark, v.alias("v"), m.alias("m"), A.masked_mean(lits([1, 2]), none).alias("mm"), A.peak_limit(lits([2, -4])).alias("p"), A.peak_limit(lits([0.5])).alias("q"))
    assert r.v == [0, 0] and r.m == [True, False] and r.mm == 0 and r.p == [0.5, -1.0] and r.q == [0.5]
    e = one(spark, A.ema_peak_hold(lits([1, 0, 0])).alias("e")).e
    assert [round(x.level, 6) for x in e] == [0.35, 0.2275, 0.147875] and [round(x.peak, 6) for x in e] == [35.0, 34.85, 34.55]


def test_schedules(spark):
    def reference(s, kind):
        if s < 10:
            return (s + 1) / 10
        if kind == "wsd" and s < 40:
            return 1.0
        p = min(1.0, max(0.0, (s - 10) / 90 if kind == "cosine" else (s - 40) / 60))
        return 0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * p))
    got = spark.range(120).select("id", H.lr_scale(F.col("id"), "cosine", 100, 10, 0, 0.1).alias("c"), H.lr_scale(F.col("id"), "wsd", 100, 10, 30, 0.1).alias("w")).collect()
    assert all(abs(r.c - reference(r.id, "cosine")) < 1e-12 and abs(r.w - reference(r.id, "wsd")) < 1e-12 for r in got)
    ts = H.t_schedule(10, -1.0)
    assert ts[0] == 0.999 and ts[-1] == 0 and all(a > b for a, b in zip(ts, ts[1:]))
    with pytest.raises(ValueError):
        H.t_schedule(10, 5.0)
    s = [r[0] for r in spark.range(64).select(H.stratified_t(F.col("id").cast("double"), F.lit(0.5), 64)).collect()]
    assert s == sorted(s) and abs(np.mean(s) - 0.5) < 0.01
    with pytest.raises(ValueError):
        H.guided(lits([1]), {"a": lits([0]), "b": lits([0])}, {"a": 1.0, "b": 2.0}, "joint", 0, 0.5, 0.0, 1.0)


def test_metrics(spark):
    df = spark.createDataFrame([(True, True, 1.0, 2.0), (True, False, 3.0, 4.0), (None, True, 5.0, 6.0)], "s boolean, c boolean, l double, e double")
    got = {r.cohort: (r.loss, r.mae, r.n) for r in X.cohort_metrics(df, "s", "c", "l", "e").collect()}
    assert got["speaker"] == (2.0, 3.0, 2) and got["caption"] == (3.0, 4.0, 2) and got["speaker_caption"] == (1.0, 2.0, 1)
    assert got["no_speaker"] == (0.0, 0.0, 0) and got["no_speaker_caption"] == (0.0, 0.0, 0) and len(got) == 8
    names = spark.createDataFrame([("checkpoint_0000100.pt",), ("checkpoint_0000200",), ("checkpoint_best_val_loss_0000600_-1.5.pt",), ("checkpoint_final.pt",), ("checkpoint_7.speaker.safetensors",), ("xcheckpoint_1",)], "n string")
    assert [tuple(r) for r in names.select(*X.parse_checkpoint(F.col("n"))).collect()] == [("periodic", 100, None), ("periodic", 200, None), ("best", 600, -1.5), (None, None, None), ("periodic", 7, None), (None, None, None)]
    h = spark.createDataFrame([(0.1,), (-0.2,)], "e double").select(X.huber(F.col("e"))).collect()
    assert abs(h[0][0] - 0.005) < 1e-12 and abs(h[1][0] - 0.1 * 0.15) < 1e-12


def upgma(x, t):
    groups = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), ai, bi) for ai, a in enumerate(groups) for bi, b in enumerate(groups) if ai < bi))
        if best[0] > t:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


def test_average_linkage_against_definition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = C.average_linkage(x, 0.7)
    assert sorted(sorted(np.flatnonzero(labels == k).tolist()) for k in set(labels)) == upgma(x, 0.7)
    df = spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(30)], "b int, i int, x array<double>")
    assert C.cluster_blocks(df, "b", "i", "x", 0.7).count() == 30


def test_linkage_in_linear_memory(spark):
    rng = np.random.default_rng(8)
    for n, width, t in ((1, 3, 0.7), (40, 4, 0.3), (60, 5, 0.7), (80, 3, 1.1), (50, 6, 3.0)):
        x = rng.normal(size=(n, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert C.linkage_below(x, t).tolist() == C.average_linkage(x, t).tolist()
    same = np.tile(x[:5], (4, 1))
    assert C.linkage_below(same, 1e-9).tolist() == [0, 1, 2, 3, 4] * 4
    # clusters join vectors of different labels, and more than 4,000 vectors are clustered
    df = spark.createDataFrame([(f"spk{i}", i, x[i % 3].tolist()) for i in range(6)], "label string, vec_id int, x array<double>")
    got = {r.vec_id: r.cluster for r in C.cluster_all(df, "label", "vec_id", "x", 1e-6).collect()}
    assert got == {i: i % 3 for i in range(6)}
    assert C.linkage_below(np.tile(x[:2], (2100, 1)), 1e-9).tolist() == [0, 1] * 2100


def test_distances_to_all_labels(spark, tmp_path):
    from kikitori.plans import array_queries

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64)).astype(np.float32)
    spark.createDataFrame([(i, f"spk{i % 7}", x[i].tolist()) for i in range(60)], "vec_id bigint, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.distance for r in array_queries.queries()["pairwise_cosine"](spark, str(tmp_path)).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert set(got) == {(a, b) for a in (0, 20, 40) for b in range(60) if a != b}
    assert all(abs(got[a, b] - (1 - u[a] @ u[b])) < 2e-6 for a, b in got)


def test_lookup_of_all_rows(spark, tmp_path):
    from kikitori.plans import array_queries

    ids = [0, 1, 124, 250, 499, 500, 501, 1999, 19_999]
    spark.createDataFrame([(i,) for i in ids], "vec_id bigint").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.red for r in array_queries.queries()["lut_map"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ids and got[500] == got[0] == 0 and got[501] == got[1] and got[499] == got[1999] == got[19_999] == 252
