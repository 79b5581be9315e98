"""Queries over arrays, schedules and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kikitori.functions import arrays as A
from kikitori.functions import schedules as H
from kikitori.operators import cluster as C
from kikitori.operators.checks import REQUEST_RULES, first_broken, first_broken_sql
from kikitori.operators.prefix import hash_bucket
from kikitori.plans.base import Book
from kikitori.plans.tables import table

book = Book()
queries, oracle_sql = book.queries, book.oracle_sql
E_SQL = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"

SALTS = 16


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def r9(x):
    return F.transform(x, lambda v: F.round(v, 9))


def rows8(x):
    """A vector of 64 as a sequence of 8 rows of 8."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, F.lit(8)))


@book.query("l2_normalize", E_SQL + "SELECT vec_id, list_transform(x, lambda v: round(v / sqrt(list_sum(list_transform(x, lambda u: u * u))), 9)) AS unit FROM e")
def q_l2(spark, d):
    return vectors(spark, d).select("vec_id", r9(A.l2_normalize(F.col("x"))).alias("unit"))


@book.query("nan_zero_filter", "SELECT count(*) AS n FROM embeddings WHERE list_sum(list_transform(embedding, lambda v: v * v)) > 0")
def q_usable(spark, d):
    return C.usable(vectors(spark, d), "x").agg(F.count(F.lit(1)).alias("n"))


@book.query("pairwise_cosine", E_SQL + ", q AS (SELECT * FROM e WHERE vec_id % 20 = 0) SELECT q.vec_id AS a, e.vec_id AS b, round(1 - list_dot_product(q.x, e.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(e.x, e.x))), 6) AS distance FROM q JOIN e ON q.vec_id <> e.vec_id")
def q_pairs_all(spark, d):
    # against all rows, whatever their label; the queries are copied to each salt
    e = vectors(spark, d).select("vec_id", A.l2_normalize(F.col("x")).alias("x")).withColumn("salt", hash_bucket(F.col("vec_id"), buckets=SALTS))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return q.join(e, "salt").where("a <> vec_id").select("a", F.col("vec_id").alias("b"), F.round(1 - A.dot(F.col("y"), F.col("x")), 6).alias("distance"))


@book.query("cluster_embeddings")
def q_cluster(spark, d):
    # label is the original speaker, which clustering is to correct: all vectors stand in one tree
    return C.cluster_all(C.usable(vectors(spark, d), "x"), "label", "vec_id", "x", 0.7)


@book.query("patchify", E_SQL + "SELECT vec_id, 2 AS patches, list_transform(x[1:24], lambda v: round(v, 9)) AS first FROM e")
def q_patch(spark, d):
    p = A.patchify(rows8(F.col("x")), 3)
    return vectors(spark, d).select("vec_id", F.size(p).alias("patches"), r9(p[0]).alias("first"))


@book.query("unpatchify", E_SQL + "SELECT vec_id, list_transform(x[1:48], lambda v: round(v, 9)) AS x FROM e")
def q_unpatch(spark, d):
    return vectors(spark, d).select("vec_id", r9(F.flatten(A.unpatchify(A.patchify(rows8(F.col("x")), 3), 3, 8))).alias("x"))


@book.query("patch_mask", E_SQL + "SELECT vec_id, list_transform(range(0, 16), lambda i: x[i * 4 + 1] > 0 OR x[i * 4 + 2] > 0) AS m FROM e")
def q_patch_mask(spark, d):
    # a patch of two positions is kept if both are; each position stands for two entries
    either = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.get(F.col("x"), F.floor(i / 2) * 4) > 0) | (F.get(F.col("x"), F.floor(i / 2) * 4 + 1) > 0))
    return vectors(spark, d).select("vec_id", A.patch_mask(either, 2).alias("m"))


@book.query(
    "pad_latents",
    E_SQL + ", b AS (SELECT vec_id, x, vec_id // 8 AS batch, 40 + vec_id * 7 % 24 AS n FROM e), m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS most FROM b) SELECT vec_id, list_transform(range(0, most), lambda i: CASE WHEN i < n THEN round(x[i + 1], 9) ELSE 0 END) AS padded, n AS n_valid FROM m",
)
def q_pad(spark, d):
    """Rows of a batch padded to the longest of the batch."""
    n = (40 + F.col("vec_id") * 7 % 24).cast("int")
    b = vectors(spark, d).select("vec_id", F.floor(F.col("vec_id") / 8).alias("batch"), n.alias("n"), F.slice("x", F.lit(1), n).alias("x"))
    return A.pad_batches(b, "batch", "x").select("vec_id", r9(F.col("padded")).alias("padded"), F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n_valid"))


@book.query("coerce_layout", E_SQL + "SELECT vec_id, list_transform(range(0, 16), lambda i: round(x[i + 1], 9)) AS first_row FROM e")
def q_layout(spark, d):
    by4 = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("x"), i * 16 + 1, F.lit(16)))
    turned = A.coerce_layout(A.transpose(by4), 16)
    return vectors(spark, d).select("vec_id", r9(turned[0]).alias("first_row"))


@book.query("mono_mix", E_SQL + "SELECT vec_id, list_transform(range(0, 32), lambda i: round((x[i + 1] + x[i + 33]) / 2, 9)) AS mono FROM e")
def q_mono(spark, d):
    return vectors(spark, d).select("vec_id", r9(A.mono_mix(F.array(F.slice("x", 1, 32), F.slice("x", 33, 32)))).alias("mono"))


_MASK = "list_filter(x, lambda v: v > 0)"


@book.query("masked_mean", E_SQL + f"SELECT vec_id, round(coalesce(list_sum({_MASK}), 0) / greatest(len({_MASK}), 1), 9) AS m FROM e")
def q_masked(spark, d):
    return vectors(spark, d).select("vec_id", F.round(A.masked_mean(F.col("x"), F.transform("x", lambda v: v > 0)), 9).alias("m"))


@book.query("mean_token", E_SQL + f"SELECT vec_id, round(coalesce(list_sum({_MASK}), 0) / greatest(len({_MASK}), 1), 9) AS first, 65 AS n, len({_MASK}) > 0 AS any_valid FROM e")
def q_mean_token(spark, d):
    x, m = A.with_mean_token(F.col("x"), F.transform("x", lambda v: v > 0))
    return vectors(spark, d).select("vec_id", F.round(x[0], 9).alias("first"), F.size(x).alias("n"), m[0].alias("any_valid"))


@book.query("safe_mask", E_SQL + "SELECT vec_id, CASE WHEN len(list_filter(x, lambda v: v > 0.2)) = 0 THEN 1 ELSE len(list_filter(x, lambda v: v > 0.2)) END AS n_valid FROM e")
def q_safe(spark, d):
    _, m = A.safe_mask(F.col("x"), F.transform("x", lambda v: v > 0.2))
    return vectors(spark, d).select("vec_id", F.size(F.filter(m, lambda v: v)).cast("bigint").alias("n_valid"))


_RMS = "sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))"


@book.query("rms", E_SQL + f"SELECT vec_id, round({_RMS}, 9) AS rms FROM e")
def q_rms(spark, d):
    return vectors(spark, d).select("vec_id", F.round(A.rms(F.col("x")), 9).alias("rms"))


@book.query("peak_limit", E_SQL + ", y AS (SELECT vec_id, list_transform(x, lambda v: v * 4) AS x FROM e), p AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS p FROM y) SELECT vec_id, list_transform(x, lambda v: round(CASE WHEN p > 1 THEN v / p ELSE v END, 9)) AS x FROM p")
def q_peak(spark, d):
    return vectors(spark, d).withColumn("x", F.transform("x", lambda v: v * 4)).select("vec_id", r9(A.peak_limit(F.col("x"))).alias("x"))


@book.query("chunk_standardize", E_SQL + ", s AS (SELECT vec_id, x, list_avg(x) AS m, list_stddev_samp(x) AS sd FROM e) SELECT vec_id, list_transform(x, lambda v: round((v - m) / (sd + 1e-8), 6)) AS x FROM s")
def q_standard(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(A.standardize(F.col("x")), lambda v: F.round(v, 6)).alias("x"))


@book.query("minmax_scale", E_SQL + "SELECT vec_id, list_transform(x, lambda v: round((v - list_min(x)) / (list_max(x) - list_min(x)), 9)) AS x FROM e")
def q_minmax(spark, d):
    return vectors(spark, d).select("vec_id", r9(A.minmax_scale(F.col("x"))).alias("x"))


@book.query("db_scale", E_SQL + ", b AS (SELECT vec_id, list_transform(x, lambda v: 10 * log10(greatest(v * v, 1e-10))) AS x FROM e) SELECT vec_id, list_transform(x, lambda v: round(greatest(v, list_max(x) - 20), 6)) AS x FROM b")
def q_db(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(A.db_scale(F.transform("x", lambda v: v * v), 20.0), lambda v: F.round(v, 6)).alias("x"))


@book.query("band_energies", E_SQL + "SELECT vec_id, list_transform(range(0, 7), lambda i: round(list_avg(x[i * 9 + 1 : CASE WHEN i < 6 THEN i * 9 + 9 ELSE 64 END]), 9)) AS bands FROM e")
def q_bands(spark, d):
    return vectors(spark, d).select("vec_id", r9(A.band_means(F.col("x"), 7)).alias("bands"))


@book.query("lut_map", "WITH i AS (SELECT vec_id, floor((vec_id % 500) * 255 / 499.0) / 255.0 AS v FROM embeddings) SELECT vec_id, CASE WHEN v <= 0.25 THEN 0 + CAST(trunc(v / 0.25 * 79) AS INTEGER) WHEN v <= 0.5 THEN 79 + CAST(trunc((v - 0.25) / 0.25 * 103) AS INTEGER) ELSE 182 + CAST(trunc((v - 0.5) / 0.5 * 70) AS INTEGER) END AS red FROM i")
def q_lut(spark, d):
    v = F.col("vec_id") % 500 / 499.0
    return table(spark, d, "embeddings").select("vec_id", A.lut_map(v, [(0.0, 0), (0.25, 79), (0.5, 182), (1.0, 252)]).alias("red"))


@book.query("speech_end", E_SQL + ", w AS (SELECT vec_id, x, unnest(range(0, 13)) AS k FROM e), l AS (SELECT vec_id, 64 - k * 5 AS e, x[greatest(64 - k * 5 - 5, 0) + 1 : 64 - k * 5] AS s FROM w) SELECT vec_id, coalesce(max(e) FILTER (sqrt(list_sum(list_transform(s, lambda v: v * v)) / len(s)) > 0.177827941), 64) AS speech_end FROM l GROUP BY 1")
def q_speech_end(spark, d):
    return vectors(spark, d).select("vec_id", A.speech_end(F.col("x"), 250, -15.0).cast("bigint").alias("speech_end"))


@book.query("tail_fade_pad")
def q_fade(spark, d):
    return vectors(spark, d).select("vec_id", r9(A.tail_fade_pad(F.col("x"), 250, 40.0, 20.0)).alias("x"))


@book.query("flattening_point", E_SQL + ", r AS (SELECT vec_id, unnest(range(0, 8)) AS i, x FROM e), w AS (SELECT vec_id, i, coalesce(x[i * 8 + 1 : least(i + 3, 8) * 8], []) AS v FROM r), s AS (SELECT vec_id, i, coalesce(list_sum(v), 0) / 24 AS m, coalesce(list_sum(list_transform(v, lambda u: u * u)), 0) / 24 AS q FROM w) SELECT vec_id, coalesce(min(i) FILTER (sqrt(greatest(q - m * m, 0)) < 0.11 AND abs(m) < 0.02), 8) AS flat FROM s GROUP BY 1")
def q_flat(spark, d):
    return vectors(spark, d).select("vec_id", A.flattening_point(rows8(F.col("x")), 3, 0.11, 0.02).cast("bigint").alias("flat"))


@book.query(
    "ema_peak_hold",
    "WITH RECURSIVE " + E_SQL.strip().removeprefix("WITH") + """, s AS (SELECT vec_id, list_transform(x, lambda v: (v - list_min(x)) / (list_max(x) - list_min(x))) AS x FROM e),
r AS (SELECT vec_id, x, 0 AS pos, 0.0::DOUBLE AS level, 0.0::DOUBLE AS peak, 0.0::DOUBLE AS fall FROM s
UNION ALL SELECT vec_id, x, pos + 1, nl, CASE WHEN h > peak THEN h ELSE greatest(0.0, peak - (fall + 0.15)) END, CASE WHEN h > peak THEN 0.0 ELSE fall + 0.15 END
FROM (SELECT *, 0.35 * x[pos + 1] + 0.65 * level AS nl, floor((0.35 * x[pos + 1] + 0.65 * level) * 100.0) AS h FROM r WHERE pos < 64))
SELECT vec_id, pos - 1 AS pos, round(level, 9) AS level, round(peak, 9) AS peak FROM r WHERE pos > 0""",
)
def q_ema(spark, d):
    levels = A.ema_peak_hold(A.minmax_scale(F.col("x")))
    return vectors(spark, d).select("vec_id", F.posexplode(levels).alias("pos", "l")).select("vec_id", "pos", F.round("l.level", 9).alias("level"), F.round("l.peak", 9).alias("peak"))


@book.query("token_sum_duration", E_SQL + "SELECT vec_id, round(ln(1 + list_sum(list_transform(x[1:40], lambda v: ln(1 + exp(v))))), 9) AS log_frames FROM e")
def q_token_sum(spark, d):
    return vectors(spark, d).select("vec_id", F.round(A.token_sum_duration(F.col("x"), F.transform("x", lambda v, i: i < 40)), 9).alias("log_frames"))


@book.query("lr_schedule", "WITH s AS (SELECT CAST(range AS BIGINT) AS step FROM range(0, 1000)) SELECT step, round(CASE WHEN step < 100 THEN (step + 1) / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((step - 100) / 900.0, 0), 1))) END, 9) AS cosine, round(CASE WHEN step < 100 THEN (step + 1) / 100.0 WHEN step < 400 THEN 1 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((step - 400) / 600.0, 0), 1))) END, 9) AS wsd FROM s")
def q_lr(spark, d):
    s = spark.range(1000).withColumnRenamed("id", "step")
    return s.select("step", F.round(H.lr_scale(F.col("step"), "cosine", 1000, 100, 0, 0.1), 9).alias("cosine"), F.round(H.lr_scale(F.col("step"), "wsd", 1000, 100, 300, 0.1), 9).alias("wsd"))


@book.query("t_schedule", "SELECT CAST(i AS INTEGER) AS i, round((1 - i / 40.0) * 0.999, 9) AS linear, round((1 - least(greatest(i / 40.0 - 0.5 * (cos(0.5 * pi() * i / 40.0) + i / 40.0 - 1), 0), 1)) * 0.999, 9) AS sway FROM range(0, 41) r(i)")
def q_t(spark, d):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(H.t_schedule(40), H.t_schedule(40, -0.5)))]
    return spark.createDataFrame(rows, "i int, linear double, sway double").select("i", F.round("linear", 9).alias("linear"), F.round("sway", 9).alias("sway"))


_U = "(CAST(concat('0x', left(md5('{0}|' || CAST(vec_id AS VARCHAR)), 8)) AS BIGINT) + 0.5) / 4294967296.0"


@book.query("logit_normal_t", f"WITH u AS (SELECT vec_id, {_U.format(7)} AS a, {_U.format(8)} AS b FROM embeddings) SELECT vec_id, round(least(greatest(1 / (1 + exp(-(sqrt(-2 * ln(a)) * cos(2 * pi() * b)))), 0.001), 0.999), 9) AS t FROM u")
def q_logit(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(H.logit_normal_t(7, F.col("vec_id")), 9).alias("t"))


@book.query("stratified_t")
def q_strat(spark, d):
    return table(spark, d, "embeddings").select("vec_id", H.stratified_t((F.col("vec_id") % 64).cast("double"), F.lit(0.5), 64).alias("t"))


_FLOW = E_SQL + ", f AS (SELECT vec_id, x[1:32] AS a, x[33:64] AS z, 0.1 + (vec_id % 8) / 10.0 AS t FROM e)"


def flow(spark, d):
    return vectors(spark, d).select("vec_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("z"), (0.1 + (F.col("vec_id") % 8) / 10.0).alias("t"))


@book.query("rf_flow", _FLOW + "SELECT vec_id, list_transform(range(1, 33), lambda i: round((1 - t) * a[i] + t * z[i], 9)) AS xt, list_transform(range(1, 33), lambda i: round(z[i] - a[i], 9)) AS v, list_transform(a, lambda q: round(q, 9)) AS x0 FROM f")
def q_flow(spark, d):
    f = flow(spark, d)
    xt, v = H.interpolate(F.col("a"), F.col("z"), F.col("t")), H.velocity(F.col("a"), F.col("z"))
    return f.select("vec_id", r9(xt).alias("xt"), r9(v).alias("v"), r9(H.predicted_x0(xt, v, F.col("t"))).alias("x0"))


@book.query("cfg_combine", _FLOW + "SELECT vec_id, list_transform(range(1, 33), lambda i: round(a[i] + 2 * (a[i] - z[i]) + 3 * (a[i] - 0.5 * z[i]), 9)) AS independent, list_transform(range(1, 33), lambda i: round(a[i] + 3 * (a[i] - 0.5 * z[i]), 9)) AS alternating FROM f")
def q_cfg(spark, d):
    f = flow(spark, d).withColumn("h", F.transform("z", lambda v: v * 0.5))
    un = {"text": F.col("z"), "speaker": F.col("h")}
    make = lambda mode: H.guided(F.col("a"), un, {"text": 2.0, "speaker": 3.0}, mode, 1, 0.6, 0.5, 1.0)
    return f.select("vec_id", r9(make("independent")).alias("independent"), r9(make("alternating")).alias("alternating"))


@book.query("euler_step", _FLOW + "SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: a[i] * z[i])), 9) AS x FROM f")
def q_euler(spark, d):
    return flow(spark, d).select("vec_id", F.round(H.euler(F.lit(0.0), F.zip_with("a", "z", lambda v, dt: F.struct(v.alias("v"), dt.alias("dt")))), 9).alias("x"))


@book.query("score_rescale", _FLOW + ", r AS (SELECT vec_id, a[1] AS x, z[1] AS v, t, ((1 - t) ** 2 / t ** 2 * 0.25 + 1) / ((1 - t) ** 2 / t ** 2 * 0.25 / 1.5 + 1) AS k FROM f) SELECT vec_id, round((k * ((1 - t) * v + x) - x) / (1 - t), 9) AS v FROM r")
def q_rescale(spark, d):
    return flow(spark, d).select("vec_id", F.round(H.score_rescale(F.get("z", F.lit(0)), F.get("a", F.lit(0)), F.col("t"), 1.5, 0.5), 9).alias("v"))


@book.query("resolve_cfg_scales", "SELECT row_id, CAST(2.0 AS DOUBLE) AS text, CAST(CASE WHEN speaker_id IS NULL THEN 0.0 WHEN row_id % 3 = 0 THEN 2.0 ELSE 3.0 END AS DOUBLE) AS speaker, CAST(2.0 AS DOUBLE) AS caption, (speaker_id IS NULL OR row_id % 3 = 0) AS ok FROM manifest")
def q_scales(spark, d):
    s = H.guidance_scales(F.lit("joint"), F.lit(2.0), F.when(F.col("row_id") % 3 == 0, 2.0).otherwise(3.0), F.lit(2.0), F.lit(None).cast("double"), F.col("speaker_id").isNotNull(), F.lit(True))
    return table(spark, d, "manifest").select("row_id", s.alias("s")).select("row_id", "s.*")


@book.query("clip_duration", "SELECT row_id, least(greatest(coalesce(CAST(round_even(CAST(num_frames AS DOUBLE) * CAST(1.1 AS DOUBLE), 0) AS BIGINT), 750), 13), 750) AS frames FROM manifest")
def q_clip(spark, d):
    return table(spark, d, "manifest").select("row_id", H.clip_frames(F.col("num_frames").cast("double"), 1.1, 48000, 1920, 0.5, 30.0).alias("frames"))


_REQUEST = """SELECT row_id, CAST(num_frames % 60 - 1 AS DOUBLE) AS seconds, CAST(row_id % 23 AS DOUBLE) / 10 AS duration_scale, CAST(row_id % 29 AS DOUBLE) / 10 AS min_seconds,
CAST(row_id % 31 AS DOUBLE) AS max_seconds, row_id % 17 AS num_candidates, CASE WHEN row_id % 19 = 0 THEN 'tree' WHEN row_id % 2 = 0 THEN ' Batch' ELSE 'sequential' END AS decode_mode,
coalesce(text, '') AS clean_text, CASE WHEN row_id % 5 = 0 THEN row_id % 37 END AS max_text_len, caption IS NOT NULL AS uses_caption, CASE WHEN row_id % 7 = 0 THEN row_id % 11 END AS max_caption_len,
CASE WHEN row_id % 3 = 0 THEN CAST(row_id % 13 AS DOUBLE) END AS truncation_factor, CASE WHEN row_id % 8 <> 1 THEN CAST(row_id % 41 AS DOUBLE) END AS rescale_k,
CASE WHEN row_id % 8 NOT IN (1, 2) THEN CAST(row_id % 43 AS DOUBLE) END AS rescale_sigma, speaker_id IS NOT NULL AS uses_speaker, CASE WHEN row_id % 4 = 0 THEN CAST(row_id % 14 AS DOUBLE) END AS speaker_kv_scale,
CASE WHEN row_id % 6 = 0 THEN CAST(row_id % 9 AS DOUBLE) / 4 END AS speaker_kv_min_t, row_id % 10 - 2 AS speaker_kv_max_layers, CASE WHEN row_id % 12 = 5 THEN 'serial' ELSE 'Joint' END AS cfg_guidance_mode FROM {0}"""


@book.query("request_validation", f"WITH r AS ({_REQUEST.format('manifest')}) SELECT row_id, {first_broken_sql(REQUEST_RULES)} AS reason FROM r")
def q_request(spark, d):
    requests = spark.sql(_REQUEST.format("{m}"), m=table(spark, d, "manifest"))
    return requests.select("row_id", first_broken(REQUEST_RULES).alias("reason"))
