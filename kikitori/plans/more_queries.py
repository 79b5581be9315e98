"""The remaining queries: small filters, counts, names, settings and checks, each under its own name."""

from __future__ import annotations

import dataclasses
import io
import json
import wave

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from kikitori.functions import arrays as A
from kikitori.functions import text as T
from kikitori.operators import manifest as M
from kikitori.operators import segments as S
from kikitori.operators.boundary import with_model
from kikitori.operators.checks import SETTINGS_RULES, first_broken, first_broken_sql
from kikitori.plans import config
from kikitori.plans.array_queries import E_SQL, r9, vectors
from kikitori.plans.base import Book
from kikitori.plans.segment_queries import MET, SEG, _LONG, _WORDS, losses, q_mse, q_parse, segs, words
from kikitori.plans.source_queries import place
from kikitori.plans.tables import table
from kikitori.plans.text_queries import COUNTS, _CAND, _cap
from kikitori.sources import readers as R
from kikitori.sources import writers as W
from kikitori.session import drop_table

book = Book()
queries, oracle_sql = book.queries, book.oracle_sql
n_rows = lambda: F.count(F.lit(1)).alias("n")


@book.query("parse_speaker_columns", "SELECT 'source' AS name, count(source) AS n FROM manifest UNION ALL SELECT 'speaker_id', count(speaker_id) FROM manifest")
def q_columns(spark, d):
    names = R.parse_speaker_columns(["source, speaker_id"])
    m = R.require_columns(table(spark, d, "manifest"), *names)
    return m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names])).alias("x")).groupBy("x.name").agg(F.count("x.v").alias("n"))


@book.query("required_columns", "SELECT count(*) AS n FROM manifest")
def q_required(spark, d):
    return R.require_columns(table(spark, d, "manifest"), "text", "latent_path").agg(n_rows())


@book.query("scan_manifest_jsonl", "SELECT count(*) AS n, count(DISTINCT latent_path) AS paths, CAST(sum(num_frames) AS BIGINT) AS frames FROM manifest WHERE text IS NOT NULL")
def q_scan_jsonl(spark, d):
    to = place(spark, "manifest")
    W.write_manifest(table(spark, d, "manifest").where("text IS NOT NULL").select("text", "latent_path", "num_frames", "caption", "speaker_id"), to)
    return R.read_manifest(spark, to).agg(n_rows(), F.count_distinct("latent_path").alias("paths"), F.sum("num_frames").alias("frames"))


@book.query("scan_csv", "SELECT count(*) AS n, CAST(sum(length(audio_file)) AS BIGINT) AS chars FROM diarization")
def q_scan_csv(spark, d):
    to = place(spark, "clips")
    W.write_clips(table(spark, d, "diarization").select(F.col("audio_file").alias("file_name"), F.lit('says "a, b"').alias("transcription")), to)
    return R.read_clips(spark, to).where(F.col("transcription") == 'says "a, b"').agg(n_rows(), F.sum(F.length("file_name")).alias("chars"))


@book.query("index_cache_name", "SELECT '.index.style_caption_2' AS suffix, '.index' AS usual")
def q_index_name(spark, d):
    return spark.createDataFrame([(T.index_name("style caption 2"), T.index_name("caption"))], "suffix string, usual string")


@book.query("manifest_cache_key", "SELECT source, '.index.' || regexp_replace(source, '[^\\p{L}\\p{N}_-]', '_', 'g') AS suffix FROM manifest WHERE source IS NOT NULL GROUP BY 1")
def q_cache_key(spark, d):
    clean = F.regexp_replace("source", "[^\\p{L}\\p{N}_-]", "_")
    return table(spark, d, "manifest").where("source IS NOT NULL").select("source").distinct().select("source", F.concat(F.lit(".index."), clean).alias("suffix"))


def _wav(frames: int, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes(b"\x80" * frames)
    return out.getvalue()


@book.query("wav_duration", "SELECT diar_id, CASE WHEN diar_id % 10 = 0 THEN 0.0 ELSE round((diar_id % 100) * 80 / 8000.0, 6) END AS seconds FROM diarization")
def q_wav(spark, d):
    def make(_, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"diar_id": pdf.diar_id, "content": [b"broken" if i % 10 == 0 else _wav(int(i % 100) * 80) for i in pdf.diar_id]})

    made = with_model(table(spark, d, "diarization").select("diar_id"), lambda: None, make, "diar_id bigint, content binary")
    return made.select("diar_id", F.round(R.wav_seconds(F.col("content")), 6).alias("seconds"))


@book.query("min_duration_filter", "SELECT diar_id FROM diarization WHERE diar_id % 10 <> 0 AND (diar_id % 100) * 80 / 8000.0 >= 0.5")
def q_min_duration(spark, d):
    return q_wav(spark, d).where("seconds >= 0.5").select("diar_id")


@book.query("min_clip_filter", SEG + "SELECT diar_id, pos FROM seg WHERE NOT b - a < 1.5")
def q_min_clip(spark, d):
    return segs(spark, d).where(~(F.col("b") - F.col("a") < 1.5)).select("diar_id", "pos")


@book.query("scan_checkpoints", "SELECT 3 AS n, 2 AS best")
def q_scan_checkpoints(spark, d):
    to = place(spark, "checkpoints")
    for name in ("checkpoint_0000100", "checkpoint_best_val_loss_0000600_1.007564", "checkpoint_best_val_loss_0000900_-0.5", "checkpoint_final", "other"):
        spark.range(1).coalesce(1).write.parquet(f"{to}/{name}")
    c = R.scan_checkpoints(spark, to)
    return c.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("kind") == "best").cast("int").alias("best"))


_YAML = """# settings
train:
  steps: 5
  rate: 1.0e-4
  mode: 'rf'   # a comment
  splits: [train, valid]
model:
  layers:
    - 2
    - 4
  name: "base: v1"
"""


@book.query("scan_yaml", "SELECT unnest(['model.layers', 'model.name', 'train.mode', 'train.rate', 'train.splits', 'train.steps']) AS name, unnest(['[2, 4]', '\"base: v1\"', '\"rf\"', '0.0001', '[\"train\", \"valid\"]', '5']) AS value")
def q_yaml(spark, d):
    flat = [(f"{part}.{k}", json.dumps(v)) for part, own in config.load_mapping(_YAML).items() for k, v in own.items()]
    return spark.createDataFrame(flat, "name string, value string")


@dataclasses.dataclass
class Settings:
    steps: int = 10
    ratio: float = 0.1
    batch: int = 4


@book.query("config_overlay", "SELECT 7 AS steps, CAST(0.2 AS DOUBLE) AS ratio, 4 AS batch")
def q_overlay(spark, d):
    s = config.overlay(Settings(), {"steps": 5, "ratio": 0.2}, {"steps": 7})
    return spark.createDataFrame([dataclasses.astuple(s)], "steps int, ratio double, batch int")


_SETTINGS = """SELECT p_partkey, p_partkey % 2 = 0 AS speaker_inversion_enabled, p_partkey % 11 <> 0 AS use_speaker_condition, CASE WHEN p_partkey % 5 <> 0 THEN 'base' END AS init_checkpoint,
CASE WHEN p_partkey % 9 = 0 THEN 'last' END AS resume, p_partkey % 7 = 0 AS lora_enabled, CASE WHEN p_partkey % 13 = 0 THEN 'duration_only' ELSE 'rf' END AS train_mode, p_partkey % 17 = 0 AS caption_warmup,
p_partkey % 19 AS speaker_inversion_tokens, p_partkey % 23 - 1 AS speaker_inversion_init_std, (p_partkey % 29) / 27.0 AS caption_condition_dropout, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 31 END AS fixed_target_latent_steps,
p_partkey % 37 = 0 AS fixed_target_full_mask, CASE WHEN p_partkey % 41 = 0 THEN 'mse' ELSE 'Echo ' END AS rf_loss_mode, p_partkey % 43 - 1 AS duration_loss_weight, (p_partkey % 47) / 45.0 AS duration_speaker_dropout,
(p_partkey % 53) / 51.0 AS duration_caption_dropout, p_partkey % 59 AS duration_huber_delta, p_partkey % 4 <> 1 AS use_duration_predictor, p_partkey % 61 AS duration_aux_dim, p_partkey % 67 AS duration_hidden_dim,
p_partkey % 71 AS duration_layers, (p_partkey % 73) / 71.0 AS duration_dropout, p_partkey % 8 AS duration_attention_heads, 840 + p_partkey % 2 * 3 AS text_dim, p_partkey % 79 AS duration_token_init_frames,
p_partkey % 83 - 1 AS caption_warmup_steps, p_partkey % 89 AS dataloader_prefetch_factor, (p_partkey % 22) / 20.0 AS valid_ratio, p_partkey % 12 - 1 AS valid_every, p_partkey % 97 - 1 AS checkpoint_best_n,
(p_partkey % 15) / 13.0 AS lora_dropout, p_partkey % 16 AS lora_r, p_partkey % 18 AS lora_alpha FROM {0}"""


@book.query("config_validation", f"WITH s AS ({_SETTINGS.format('part')}) SELECT p_partkey, {first_broken_sql(SETTINGS_RULES)} AS problem FROM s")
def q_validation(spark, d):
    return spark.sql(_SETTINGS.format("{p}"), p=table(spark, d, "part")).select("p_partkey", first_broken(SETTINGS_RULES).alias("problem"))


@book.query("unknown_keys", "SELECT unnest(['speed', 'tempo']) AS name")
def q_unknown(spark, d):
    known, given = F.array(*map(F.lit, ("steps", "ratio"))), F.array(*map(F.lit, ("tempo", "steps", "speed")))
    return spark.range(1).select(F.explode(F.array_sort(F.array_except(given, known))).alias("name"))


@book.query("sink_ranked_shards", "SELECT row_id % 12 AS rank, count(*) AS n FROM manifest GROUP BY 1")
def q_ranked(spark, d):
    to = place(spark, "ranked")
    W.write_shards(table(spark, d, "manifest").select("row_id", F.pmod("row_id", F.lit(12)).alias("rank")), "rank", to)
    return spark.read.schema("row_id bigint, rank bigint").parquet(to).groupBy("rank").agg(n_rows())


@book.query("merge_shards", "SELECT row_id, row_id % 3 AS rank FROM manifest WHERE row_id % 3 <> 1")
def q_merge(spark, d):
    to = place(spark, "shards")
    W.write_shards(table(spark, d, "manifest").select("row_id", F.pmod("row_id", F.lit(3)).alias("rank")), "rank", to)
    drop_table(spark, f"{to}/rank=1")  # a missing shard adds nothing
    return W.merged_shards(spark.read.schema("row_id bigint, rank bigint").parquet(to), "rank", "row_id")


@book.query("global_order", "SELECT row_id, row_id % 3 AS rank FROM manifest")
def q_order(spark, d):
    return W.merged_shards(table(spark, d, "manifest").select("row_id", F.pmod("row_id", F.lit(3)).alias("rank")), "rank", "row_id")


@book.query("reason_order", "SELECT coalesce(source, 'unknown') AS reason, count(*) AS n FROM manifest GROUP BY 1")
def q_reason_order(spark, d):
    return M.skip_counts(table(spark, d, "manifest"), "source")


@book.query("sink_segments", SEG + "SELECT diar_id, speaker, speaker || '_' || printf('%04d', row_number() OVER (PARTITION BY diar_id, speaker ORDER BY pos)) || '.wav' AS name FROM seg WHERE CAST(trunc(b * 16000) AS BIGINT) - CAST(trunc(a * 16000) AS BIGINT) >= 16000")
def q_sink_segments(spark, d):
    kept = S.numbered(segs(spark, d).where(S.long_enough(F.col("a"), F.col("b"), 1.0, 16000)), ["diar_id", "speaker"], ["pos"])
    return kept.select("diar_id", "speaker", F.concat("speaker", F.lit("_"), F.format_string("%04d", "idx"), F.lit(".wav")).alias("name"))


@book.query("sink_candidates", "SELECT unnest(['out_001.wav', 'out_002.wav', 'out_003.wav']) AS name")
def q_candidate_names(spark, d):
    return spark.createDataFrame([(x,) for x in W.candidate_names("out", ".wav", 3)], "name string")


@book.query("sink_metrics", MET + "SELECT batch AS step, unnest(['loss', 'err']) AS name, unnest([round(avg(loss), 9), round(avg(err), 9)]) AS value FROM los GROUP BY batch")
def q_metrics_table(spark, d):
    g = losses(spark, d).groupBy(F.col("batch").alias("step")).agg(F.round(F.avg("loss"), 9).alias("loss"), F.round(F.avg("err"), 9).alias("err"))
    return g.unpivot("step", ["loss", "err"], "name", "value")


@book.query("stage_timing", "SELECT event_type AS stage, round(sum(value), 4) AS seconds, count(*) AS n FROM events GROUP BY 1")
def q_stages(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("seconds"), n_rows())


@book.query("speaker_namespace", "WITH s AS (SELECT DISTINCT source FROM manifest) SELECT source, CASE WHEN trim(coalesce(source, '')) = '' THEN 'dataset' ELSE 'org-' || trim(regexp_replace(regexp_replace(trim(source), '[^A-Za-z0-9_.-]+', '-', 'g'), '-{2,}', '-', 'g'), '-_.') || '-v1' END AS namespace FROM s")
def q_namespace(spark, d):
    raw = F.concat(F.lit("org/"), F.col("source"), F.lit(":v1"))
    return table(spark, d, "manifest").select("source").distinct().select("source", T.sanitize_id(F.when(F.trim("source") != "", raw), "dataset").alias("namespace"))


@book.query("trim_seconds", E_SQL + "SELECT vec_id, list_transform(x[1:37], lambda v: round(v, 9)) AS x FROM e")
def q_trim(spark, d):
    return vectors(spark, d).select("vec_id", r9(F.slice("x", 1, int(0.1497 * 250))).alias("x"))


@book.query("candidate_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 23 AND l_discount >= 0.055 AND l_tax >= 0.01")
def q_predicate(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 23 AND l_discount >= 0.055 AND l_tax >= 0.01").select("l_orderkey", "l_linenumber")


_VOICED = "list_filter(x, lambda v: v > 0.1)"


@book.query("voiced_min_frames", E_SQL + f"SELECT vec_id FROM e WHERE len({_VOICED}) >= 5")
def q_voiced(spark, d):
    return vectors(spark, d).where(F.size(F.filter("x", lambda v: v > 0.1)) >= 5).select("vec_id")


@book.query("voiced_ratio", E_SQL + f"SELECT vec_id, round(len({_VOICED}) / 64.0, 9) AS ratio FROM e")
def q_ratio(spark, d):
    return vectors(spark, d).select("vec_id", F.round(A.mean(F.transform("x", lambda v: (v > 0.1).cast("double"))), 9).alias("ratio"))


@book.query("f0_median", E_SQL + f", u AS (SELECT vec_id, unnest({_VOICED}) AS v FROM e) SELECT vec_id, round(median(v), 9) AS f0 FROM u GROUP BY 1")
def q_median(spark, d):
    voiced = vectors(spark, d).select("vec_id", F.explode(F.filter("x", lambda v: v > 0.1)).alias("v"))
    return voiced.groupBy("vec_id").agg(F.round(F.percentile("v", F.lit(0.5)), 9).alias("f0"))


@book.query("f0_bucket", "SELECT row_id, CASE WHEN num_frames IS NULL THEN '' WHEN num_frames >= 165 THEN 'high' WHEN num_frames >= 85 THEN 'mid' ELSE 'low' END AS bucket FROM manifest")
def q_bucket(spark, d):
    return table(spark, d, "manifest").select("row_id", T.f0_bucket(F.col("num_frames").cast("double")).alias("bucket"))


@book.query("has_caption", f"SELECT row_id, len({_CAND}) > 0 AS has_caption FROM manifest")
def q_has_caption(spark, d):
    return table(spark, d, "manifest").select("row_id", (F.size(T.caption_candidates(F.col("caption"))) > 0).alias("has_caption"))


def _count_query(name: str, key: str) -> None:
    @book.query(name, f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{COUNTS[key]}')) AS INTEGER) AS n FROM documents")
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(COUNTS[key])).alias("n"))


for _name, _key in (("kana_count", "n_kana"), ("kanji_count", "n_kanji"), ("alnum_count", "n_alnum"), ("emoji_count", "n_emoji")):
    _count_query(_name, _key)


@book.query("punctuation_sets", _WORDS + "SELECT count(*) FILTER (regexp_matches(t, '[。？！?!…♪]$')) AS ja, count(*) FILTER (regexp_matches(t, '[.?!…]$')) AS en FROM w")
def q_enders(spark, d):
    return words(spark, d).agg(F.count_if(F.rlike("t", F.lit("[。？！?!…♪]$"))).alias("ja"), F.count_if(F.rlike("t", F.lit("[.?!…]$"))).alias("en"))


@book.query("log1p_cap", f"SELECT row_id, round({_cap('length(text)', 512)}, 9) AS v FROM manifest WHERE text IS NOT NULL")
def q_cap(spark, d):
    return table(spark, d, "manifest").where("text IS NOT NULL").select("row_id", F.round(T.log1p_cap(F.length("text"), 512), 9).alias("v"))


@book.query("param_prefix_filter", "SELECT CASE WHEN starts_with(p_name, 'part 1') THEN 'head' WHEN contains(p_name, '7') THEN 'body' ELSE 'rest' END AS kind, count(*) AS n FROM part GROUP BY 1")
def q_prefix(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").groupBy(F.when(n.startswith("part 1"), "head").when(n.contains("7"), "body").otherwise("rest").alias("kind")).agg(n_rows())


@book.query("param_counts", "SELECT CAST(sum(p_size) FILTER (p_partkey % 2 = 0) AS BIGINT) AS trainable, CAST(sum(p_size) FILTER (p_partkey % 2 <> 0) AS BIGINT) AS frozen FROM part")
def q_params(spark, d):
    return table(spark, d, "part").agg(F.sum(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))).alias("trainable"), F.sum(F.when(F.col("p_partkey") % 2 != 0, F.col("p_size"))).alias("frozen"))


_SIDES = "WITH x AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey % 3 <> 0), y AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 4 <> 0) "


def _sides(spark, d):
    p = table(spark, d, "part")
    x = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("sx"))
    y = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("sy"))
    return x, y


@book.query("shape_filter_merge", _SIDES + "SELECT y.k, CASE WHEN x.s = y.s THEN x.s ELSE y.s END AS size, x.s IS NOT NULL AND x.s = y.s AS loaded FROM y LEFT JOIN x USING (k)")
def q_shapes(spark, d):
    x, y = _sides(spark, d)
    same = F.coalesce(F.col("sx") == F.col("sy"), F.lit(False))
    return y.join(x, "k", "left").select("k", F.when(same, F.col("sx")).otherwise(F.col("sy")).alias("size"), same.alias("loaded"))


@book.query("state_key_except", _SIDES + "SELECT k, 'extra' AS kind FROM x WHERE k NOT IN (SELECT k FROM y) UNION ALL SELECT k, 'missing' FROM y WHERE k NOT IN (SELECT k FROM x)")
def q_keys(spark, d):
    x, y = _sides(spark, d)
    return x.join(y, "k", "left_anti").select("k", F.lit("extra").alias("kind")).unionByName(y.join(x, "k", "left_anti").select("k", F.lit("missing").alias("kind")))


@book.query("others_except", SEG + "SELECT diar_id, count(*) AS n FROM seg x WHERE NOT EXISTS (SELECT 1 FROM seg t WHERE t.speaker = 'SPEAKER_00' AND t.diar_id = x.diar_id AND t.a = x.a AND t.b = x.b) GROUP BY 1")
def q_others(spark, d):
    s = segs(spark, d)
    return S.others_of(s, s.where("speaker = 'SPEAKER_00'"), ["diar_id"], "a", "b").groupBy("diar_id").agg(n_rows())


@book.query("distinct_speakers", "SELECT DISTINCT source, speaker_id FROM manifest")
def q_distinct(spark, d):
    return table(spark, d, "manifest").select("source", "speaker_id").distinct()


@book.query("allreduce_sum", MET + "SELECT rank, count(*) AS n, round(sum(err), 4) AS total FROM los GROUP BY 1")
def q_sum(spark, d):
    return losses(spark, d).groupBy("rank").agg(n_rows(), F.round(F.sum("err"), 4).alias("total"))


@book.query("rank_shard", "SELECT row_id, row_id % 4 AS stride, CAST(floor(row_id / CAST(ceil((SELECT max(row_id) + 1 FROM manifest) / 4.0) AS BIGINT)) AS BIGINT) AS contiguous, CASE WHEN row_id // 4 >= 10 THEN row_id % 4 END AS stream FROM manifest")
def q_shard(spark, d):
    m = table(spark, d, "manifest")
    total = m.agg(F.max("row_id")).first()[0] + 1
    r = F.col("row_id")
    return m.select("row_id", M.rank_stride(r, 0, 4).alias("stride"), M.rank_contiguous(r, 0, total, 4).alias("contiguous"), M.rank_stream(r, 10, 4).alias("stream"))


@book.query("strategy_auto", "SELECT 'contiguous' AS map_style, 'dataset' AS stream, 'stride' AS named")
def q_strategy(spark, d):
    return spark.createDataFrame([(config.shard_strategy("auto", True), config.shard_strategy("auto", False), config.shard_strategy("stride", True))], "map_style string, stream string, named string")


@book.query("keep_policy", "SELECT 1 AS validating, 4 AS plain")
def q_keep(spark, d):
    return spark.createDataFrame([(config.keep_policy(True, 3), config.keep_policy(False, 3))], "validating int, plain int")


def _regroup_part(name: str, condition: str, column) -> None:
    sql = _WORDS + f", c AS (SELECT *, CASE WHEN coalesce({condition}, true) THEN 1 ELSE 0 END AS c FROM w WINDOW o AS (PARTITION BY rec ORDER BY a, b, t)), g AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY a, b, t ROWS UNBOUNDED PRECEDING) AS seg FROM c) SELECT rec, min(a) AS start, max(b) AS end, count(*) AS n FROM g GROUP BY rec, seg"

    @book.query(name, sql)
    def run(spark, d):
        w = Window.partitionBy("rec").orderBy("a", "b", "t")
        marked = words(spark, d).withColumn("c", F.when(F.coalesce(column(w), F.lit(True)), 1).otherwise(0))
        g = marked.withColumn("seg", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return g.groupBy("rec", "seg").agg(F.min("a").alias("start"), F.max("b").alias("end"), n_rows()).drop("seg")


_regroup_part("merge_by_gap", "NOT a - lag(b) OVER o <= 0.15", lambda w: ~(F.col("a") - F.lag("b").over(w) <= 0.15))
_regroup_part("split_by_gap", "a - lag(b) OVER o > 0.5", lambda w: F.col("a") - F.lag("b").over(w) > 0.5)
_regroup_part("split_by_punctuation", "regexp_matches(lag(t) OVER o, '[。？！?!…♪]$')", lambda w: F.rlike(F.lag("t").over(w), F.lit("[。？！?!…♪]$")))


@book.query("split_by_duration", _WORDS + ", g AS (SELECT *, floor((a - min(a) OVER (PARTITION BY rec)) / 12.0) AS part FROM w) SELECT rec, min(a) AS start, max(b) AS end, count(*) AS n FROM g GROUP BY rec, part")
def q_split_duration(spark, d):
    first = F.min("a").over(Window.partitionBy("rec"))
    g = words(spark, d).withColumn("part", F.floor((F.col("a") - first) / F.lit(12.0)))
    return g.groupBy("rec", "part").agg(F.min("a").alias("start"), F.max("b").alias("end"), n_rows()).drop("part")


@book.query("cosine_distance", E_SQL + ", p AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM e) SELECT vec_id, round(1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 9) AS distance FROM p WHERE y IS NOT NULL")
def q_cosine(spark, d):
    e = vectors(spark, d).withColumn("y", F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))).where("y IS NOT NULL")
    return e.select("vec_id", F.round(A.cosine_distance(F.col("x"), F.col("y")), 9).alias("distance"))


@book.query("huber", MET + "SELECT row_id, round(loss, 9) AS loss FROM los")
def q_huber(spark, d):
    return losses(spark, d).select("row_id", F.round("loss", 9).alias("loss"))


@book.query("mae_frames", MET + "SELECT row_id, round(err, 6) AS err FROM los")
def q_mae(spark, d):
    return losses(spark, d).select("row_id", F.round("err", 6).alias("err"))


@book.query("echo_mse", _LONG + "SELECT round((sum(s) / sum(t)) / greatest(sum(m) / sum(t), 1e-6), 9) AS echo FROM p")
def q_echo(spark, d):
    return q_mse(spark, d).select("echo")


@book.query("utterance_mse", _LONG + "SELECT round(avg(s / greatest(m, 1)), 9) AS utterance FROM p")
def q_utterance(spark, d):
    return q_mse(spark, d).select("utterance")


def _flow(name: str, expr: str, build) -> None:
    @book.query(name, E_SQL + f", f AS (SELECT vec_id, x[1:32] AS a, x[33:64] AS z, 0.1 + (vec_id % 8) / 10.0 AS t FROM e) SELECT vec_id, list_transform(range(1, 33), lambda i: round({expr}, 9)) AS x FROM f")
    def run(spark, d):
        f = vectors(spark, d).select("vec_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("z"), (0.1 + (F.col("vec_id") % 8) / 10.0).alias("t"))
        return f.select("vec_id", r9(build(F.col("a"), F.col("z"), F.col("t"))).alias("x"))


def _register_flows() -> None:
    from kikitori.functions import schedules as H

    _flow("rf_interpolate", "(1 - t) * a[i] + t * z[i]", H.interpolate)
    _flow("rf_velocity", "z[i] - a[i]", lambda a, z, t: H.velocity(a, z))
    _flow("rf_x0", "a[i] - t * z[i]", H.predicted_x0)


_register_flows()


@book.query("coerce_audio_shape", E_SQL + "SELECT vec_id, 2 AS channels, 32 AS frames, round(x[3], 9) AS second FROM e")
def q_audio(spark, d):
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("x", i * 2 + 1, F.lit(2)))  # (T, C) with few channels
    v = vectors(spark, d).select("vec_id", pairs.alias("p"))
    c = F.when((F.size(F.col("p")[0]) <= 8) & (F.size("p") > F.size(F.col("p")[0])), A.transpose(F.col("p"))).otherwise(F.col("p"))
    return v.select("vec_id", F.size(c).alias("channels"), F.size(c[0]).alias("frames"), F.round(c[0][1], 9).alias("second"))


@book.query("scan_wav_dir", "SELECT r_name AS label, count(*) AS n, round(sum((n_nationkey + 1) * 0.01), 6) AS seconds FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 4 GROUP BY 1")
def q_wav_dir(spark, d):
    """One WAV file for each nation, in a folder for each region, written and scanned; those under 0.05 s are left out."""
    to = place(spark, "wavs")
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in named.select("r_name", "n_nationkey").collect():  # 25 rows at every scale
        out = fs.create(path(f"{to}/{r['r_name']}/{r['r_name']}_{r['n_nationkey']:04d}.wav"))
        out.write(bytearray(_wav((r["n_nationkey"] + 1) * 80)))
        out.close()
    return R.scan_wav_folders(spark, to, 0.05).groupBy("label").agg(n_rows(), F.round(F.sum("seconds"), 6).alias("seconds"))


@book.query("best_val_names", "SELECT count(*) FILTER (o_orderkey % 4 = 1) AS best, count(*) FILTER (o_orderkey % 4 IN (0, 2)) AS periodic FROM orders")
def q_kinds(spark, d):
    return q_parse(spark, d).agg(F.count_if(F.col("kind") == "best").alias("best"), F.count_if(F.col("kind") == "periodic").alias("periodic"))
