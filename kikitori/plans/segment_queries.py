"""Queries over segments, metrics and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kikitori.operators import metrics as X
from kikitori.operators import segments as S
from kikitori.plans.base import Book
from kikitori.plans.source_queries import place
from kikitori.plans.tables import table
from kikitori.sources import readers as R

book = Book()
queries, oracle_sql = book.queries, book.oracle_sql

SEG = """
WITH raw AS (SELECT diar_id, audio_file, duration, unnest(segments) AS s, generate_subscripts(segments, 1) AS pos FROM diarization),
seg AS (SELECT diar_id, audio_file, duration, CAST(pos AS INTEGER) AS pos, s.speaker AS speaker, s.start_s AS a, s.end_s AS b FROM raw WHERE s.speaker IS NOT NULL AND s.end_s > s.start_s)
"""


def segs(spark, d):
    t = table(spark, d, "diarization").select("diar_id", "audio_file", "duration", F.posexplode("segments").alias("p", "s"))
    t = t.select("diar_id", "audio_file", "duration", (F.col("p") + 1).alias("pos"), F.col("s.speaker").alias("speaker"), F.col("s.start_s").alias("a"), F.col("s.end_s").alias("b"))
    return t.where("speaker IS NOT NULL AND b > a")


@book.query("scan_diarization_json", SEG + "SELECT diar_id, speaker, pos, a, b FROM seg")
def q_scan(spark, d):
    """Documents written as JSON lines and read back; the id travels in the name."""
    to = place(spark, "diarization")
    t = table(spark, d, "diarization")
    names = F.transform("segments", lambda s: F.struct(s["speaker"].alias("speaker"), s["start_s"].alias("start"), s["end_s"].alias("end"), s["duration"].alias("duration")))
    t.select(F.concat_ws("|", "diar_id", "audio_file").alias("audio_file"), "duration", "num_speakers", "model", names.alias("segments")).write.json(to)
    back = R.read_diarization(spark, to, lines=True).where("speaker IS NOT NULL AND `end` > start")
    return back.select(F.substring_index("audio_file", "|", 1).cast("bigint").alias("diar_id"), "speaker", (F.col("pos") + 1).alias("pos"), F.col("start").alias("a"), F.col("end").alias("b"))


@book.query("segment_numbering", SEG + "SELECT diar_id, speaker, pos, CAST(row_number() OVER (PARTITION BY diar_id, speaker ORDER BY pos) AS INTEGER) AS idx FROM seg WHERE CAST(trunc(b * 16000) AS BIGINT) - CAST(trunc(a * 16000) AS BIGINT) >= 16000")
def q_number(spark, d):
    kept = segs(spark, d).where(S.long_enough(F.col("a"), F.col("b"), 1.0, 16000))
    return S.numbered(kept, ["diar_id", "speaker"], ["pos"]).select("diar_id", "speaker", "pos", "idx")


@book.query("segment_sample_filter", SEG + "SELECT speaker, count(*) AS n FROM seg WHERE CAST(trunc(b * 16000) AS BIGINT) - CAST(trunc(a * 16000) AS BIGINT) >= 16000 GROUP BY 1")
def q_sample(spark, d):
    return segs(spark, d).where(S.long_enough(F.col("a"), F.col("b"), 1.0, 16000)).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))


@book.query("duration_range", SEG + "SELECT diar_id, pos FROM seg WHERE b - a BETWEEN 6 AND 12")
def q_range(spark, d):
    return segs(spark, d).where((F.col("b") - F.col("a")).between(6, 12)).select("diar_id", "pos")


def _island_sql(cmp: str) -> str:
    return (
        SEG
        + f""", m AS (SELECT *, max(b) OVER (PARTITION BY diar_id, speaker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM seg),
g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a - pb {cmp} 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY diar_id, speaker ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT diar_id, speaker, min(a) AS s, max(b) AS e, count(*) AS n FROM g GROUP BY diar_id, speaker, i"""
    )


@book.query("merge_gap_spans", _island_sql(">="))
def q_spans(spark, d):
    return S.islands(segs(spark, d), ["diar_id", "speaker"], "a", "b", 0.5)


@book.query("merge_gap_clips", _island_sql(">"))
def q_clips(spark, d):
    return S.islands(segs(spark, d), ["diar_id", "speaker"], "a", "b", 0.5, True)


TARGET = "SPEAKER_01"


@book.query("target_antijoin", SEG + f"SELECT diar_id, pos, speaker FROM seg x WHERE NOT EXISTS (SELECT 1 FROM seg t WHERE t.speaker = '{TARGET}' AND t.diar_id = x.diar_id AND t.a = x.a AND t.b = x.b)")
def q_anti(spark, d):
    s = segs(spark, d)
    return S.others_of(s, s.where(F.col("speaker") == TARGET), ["diar_id"], "a", "b").select("diar_id", "pos", "speaker")


def target_spans(spark, d):
    s = segs(spark, d)
    target = s.where(F.col("speaker") == TARGET)
    spans = S.islands(target, ["diar_id"], "a", "b", 0.5)
    return S.nearest_bounds(spans, S.others_of(s, target, ["diar_id"], "a", "b"), ["diar_id"], "a", "b")


_SPANS = (
    SEG
    + f""", tgt AS (SELECT * FROM seg WHERE speaker = '{TARGET}'), oth AS (SELECT * FROM seg x WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.diar_id = x.diar_id AND t.a = x.a AND t.b = x.b)),
m AS (SELECT *, max(b) OVER (PARTITION BY diar_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM tgt),
g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a - pb >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY diar_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m),
sp AS (SELECT diar_id, min(a) AS s, max(b) AS e, count(*) AS n FROM g GROUP BY diar_id, i),
nb AS (SELECT sp.*, (SELECT max(o.b) FROM oth o WHERE o.diar_id = sp.diar_id AND o.b <= sp.s) AS prev_end, (SELECT min(o.a) FROM oth o WHERE o.diar_id = sp.diar_id AND o.a >= sp.e) AS next_start FROM sp)
"""
)


@book.query("asof_prev_end", _SPANS + "SELECT diar_id, s, e, prev_end FROM nb")
def q_prev(spark, d):
    return target_spans(spark, d).select("diar_id", "s", "e", "prev_end")


@book.query("asof_next_start", _SPANS + "SELECT diar_id, s, e, next_start FROM nb")
def q_next(spark, d):
    return target_spans(spark, d).select("diar_id", "s", "e", "next_start")


@book.query("pad_spans", _SPANS + "SELECT diar_id, n, round(greatest(s - 0.1, coalesce(prev_end, 0), 0), 6) AS s, round(greatest(least(e + 0.3, coalesce(next_start, 1e308)), e), 6) AS e FROM nb")
def q_padded(spark, d):
    return S.padded(target_spans(spark, d), 0.1, 0.3).select("diar_id", "n", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


@book.query("span_summary", _SPANS + "SELECT count(*) AS spans, count(*) FILTER (n > 1) AS merged, round(sum(e - s) / 60, 6) AS minutes FROM sp")
def q_span_summary(spark, d):
    return target_spans(spark, d).agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("n") > 1).alias("merged"), F.round(F.sum(F.col("e") - F.col("s")) / 60, 6).alias("minutes"))


@book.query("speaker_summary", SEG + "SELECT speaker, round(sum(b - a), 6) AS seconds, count(*) AS n FROM seg GROUP BY 1")
def q_speakers(spark, d):
    return segs(spark, d).groupBy("speaker").agg(F.round(F.sum(F.col("b") - F.col("a")), 6).alias("seconds"), F.count(F.lit(1)).alias("n"))


@book.query("speaker_extract_summary", SEG + "SELECT speaker, count(*) FILTER (ok) AS files, round(coalesce(sum(b - a) FILTER (ok), 0), 6) AS seconds FROM (SELECT *, CAST(trunc((b - a) * 16000) AS BIGINT) >= 16000 AS ok FROM seg) GROUP BY 1")
def q_extract(spark, d):
    length = F.col("b") - F.col("a")
    ok = (length * 16000).cast("bigint") >= 16000
    return segs(spark, d).groupBy("speaker").agg(F.count_if(ok).alias("files"), F.round(F.coalesce(F.sum(F.when(ok, length)), F.lit(0.0)), 6).alias("seconds"))


@book.query("doc_rollup", SEG + "SELECT diar_id, count(DISTINCT speaker) AS num_speakers, max(b) AS extent, count(*) AS n FROM seg GROUP BY 1")
def q_rollup(spark, d):
    return segs(spark, d).groupBy("diar_id").agg(F.count_distinct("speaker").alias("num_speakers"), F.max("b").alias("extent"), F.count(F.lit(1)).alias("n"))


@book.query("sink_json_doc", SEG + """SELECT diar_id, CAST(to_json(list({'speaker': speaker, 'start': round_even(a, 3), 'end': round_even(b, 3)} ORDER BY a, b, speaker)) AS VARCHAR) AS segments FROM seg GROUP BY 1""")
def q_docs(spark, d):
    one = F.struct(F.bround("a", 3).alias("a"), F.bround("b", 3).alias("b"), "speaker")
    g = segs(spark, d).groupBy("diar_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return g.select("diar_id", F.to_json(F.transform("s", lambda s: F.struct(s["speaker"].alias("speaker"), s["a"].alias("start"), s["b"].alias("end")))).alias("segments"))


_WORDS = """WITH w AS (SELECT transcript_id AS rec, s.start_s AS a, s.end_s AS b, s.text AS t, i FROM (SELECT transcript_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM transcripts) WHERE s.text <> '' AND s.end_s > s.start_s)"""


def words(spark, d):
    t = table(spark, d, "transcripts").select(F.col("transcript_id").alias("rec"), F.posexplode("segments").alias("i", "s"))
    t = t.select("rec", (F.col("i") + 1).alias("i"), F.col("s.start_s").alias("a"), F.col("s.end_s").alias("b"), F.col("s.text").alias("t"))
    return t.where("t <> '' AND b > a")


@book.query("get_bounds", _WORDS + "SELECT rec, round(greatest(min(a) - 0.05, 0), 6) AS start, round(max(b) + 1.2, 6) AS end FROM w GROUP BY 1")
def q_bounds(spark, d):
    return words(spark, d).groupBy("rec").agg(F.round(F.greatest(F.min("a") - 0.05, F.lit(0.0)), 6).alias("start"), F.round(F.max("b") + 1.2, 6).alias("end"))


@book.query(
    "regroup_words",
    _WORDS
    + """, c AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(t) OVER o, '[。？！?!…♪]$'), true) OR coalesce(a - lag(b) OVER o > 0.5, true) THEN 1 ELSE 0 END AS c FROM w WINDOW o AS (PARTITION BY rec ORDER BY a, b, t)),
g AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY a, b, t ROWS UNBOUNDED PRECEDING) AS seg FROM c),
p AS (SELECT *, floor((a - min(a) OVER (PARTITION BY rec, seg)) / 12.0) AS part FROM g)
SELECT rec, min(a) AS start, max(b) AS end, string_agg(t, '' ORDER BY a, b, t) AS text FROM p GROUP BY rec, seg, part""",
)
def q_regroup(spark, d):
    w = words(spark, d)
    return S.regroup_words(w, ["rec"], "a", "b", "t", 0.5, 12.0, "。？！?!…♪")


@book.query("validate_join", SEG + ", n AS (SELECT diar_id, speaker, pos, b - a AS seconds FROM seg), f AS (SELECT diar_id, speaker, pos, CASE WHEN pos % 50 = 0 THEN seconds + 0.2 ELSE seconds + 0.01 END AS s2 FROM n WHERE pos % 97 <> 0), j AS (SELECT n.*, s2 FROM n LEFT JOIN f USING (diar_id, speaker, pos)), r AS (SELECT count(*) FILTER (s2 IS NOT NULL) AS checked, count(*) FILTER (s2 IS NULL OR abs(s2 - seconds) > 0.05) AS mismatch FROM j) SELECT checked, mismatch, checked > 0 AND mismatch <= greatest(1, checked * 0.01) AS ok FROM r")
def q_validate(spark, d):
    want = segs(spark, d).select("diar_id", "speaker", "pos", (F.col("b") - F.col("a")).alias("seconds"))
    files = want.where("pos % 97 <> 0").withColumn("seconds", F.when(F.col("pos") % 50 == 0, F.col("seconds") + 0.2).otherwise(F.col("seconds") + 0.01))
    return S.mapping_report(want, files, ["diar_id", "speaker", "pos"], 0.05)


@book.query("cluster_segment_join", SEG + ", k AS (SELECT diar_id, speaker, pos, row_number() OVER (PARTITION BY diar_id, speaker ORDER BY pos) AS idx FROM seg) SELECT diar_id, speaker, pos FROM k JOIN (SELECT row_id % 20 + 1 AS idx, count(*) AS c FROM manifest GROUP BY 1) f USING (idx)")
def q_cluster_segments(spark, d):
    k = S.numbered(segs(spark, d), ["diar_id", "speaker"], ["pos"])
    f = table(spark, d, "manifest").select((F.col("row_id") % 20 + 1).cast("int").alias("idx")).distinct()
    return k.join(f, "idx").select("diar_id", "speaker", "pos")


@book.query("csv_file_join", "SELECT count(*) FILTER (d.audio_file IS NOT NULL) AS found, count(*) FILTER (d.audio_file IS NULL) AS missing FROM (SELECT * FROM manifest WHERE audio_file IS NOT NULL) m LEFT JOIN (SELECT DISTINCT audio_file FROM diarization) d USING (audio_file)")
def q_files(spark, d):
    have = table(spark, d, "diarization").select("audio_file", F.lit(1).alias("hit")).distinct()
    m = table(spark, d, "manifest").where("audio_file IS NOT NULL").select("audio_file")
    return m.join(have, "audio_file", "left").agg(F.count("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missing"))


@book.query("mask_apply", SEG + ", m AS (SELECT *, max(b) OVER (PARTITION BY diar_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM seg) SELECT diar_id, round(sum(greatest(b - greatest(a, coalesce(pb, a)), 0)) / max(duration), 6) AS speech_ratio FROM m GROUP BY 1")
def q_mask(spark, d):
    i = S.islands(segs(spark, d), ["diar_id", "duration"], "a", "b", 0.0)
    return i.groupBy("diar_id").agg(F.round(F.sum(F.col("e") - F.col("s")) / F.max("duration"), 6).alias("speech_ratio"))


@book.query(
    "word_speaker_assign",
    "WITH w AS (SELECT transcript_id, audio_file, i, s.start_s AS ws, s.end_s AS we FROM (SELECT transcript_id, audio_file, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM transcripts) WHERE s.end_s > s.start_s), t AS (SELECT DISTINCT audio_file, s.speaker AS speaker, s.start_s AS ts, s.end_s AS te FROM (SELECT audio_file, unnest(segments) AS s FROM diarization) WHERE s.end_s > s.start_s), o AS (SELECT w.transcript_id, w.i, t.speaker, sum(least(we, te) - greatest(ws, ts)) AS o FROM w JOIN t ON w.audio_file = t.audio_file AND ts < we AND te > ws GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, i ORDER BY round(o, 6) DESC, speaker NULLS FIRST) AS k FROM o) SELECT w.transcript_id, CAST(w.i AS INTEGER) AS i, r.speaker FROM w LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (transcript_id, i)",
)
def q_assign(spark, d):
    w = table(spark, d, "transcripts").select("transcript_id", "audio_file", F.posexplode("segments").alias("p", "s"))
    w = w.select("transcript_id", "audio_file", (F.col("p") + 1).alias("i"), F.col("s.start_s").alias("ws"), F.col("s.end_s").alias("we")).where("we > ws")
    w = w.withColumn("word_id", F.struct("transcript_id", "i"))
    t = table(spark, d, "diarization").select("audio_file", F.explode("segments").alias("s")).select("audio_file", F.col("s.speaker").alias("speaker"), F.col("s.start_s").alias("ts"), F.col("s.end_s").alias("te"))
    return S.assign_speakers(w, t, ["audio_file"]).select("transcript_id", "i", "speaker")


# metric rows: frames and a prediction for every manifest row
MET = """WITH met AS (SELECT row_id, CAST(coalesce(num_frames, 50) AS DOUBLE) AS frames, ln(1 + coalesce(num_frames, 50)) + ((row_id * 7919) % 200 - 100) / 400.0 AS pred, CASE WHEN row_id % 11 = 0 THEN NULL ELSE speaker_id IS NOT NULL END AS sp, caption IS NOT NULL AS cap, row_id % 64 AS batch, row_id % 4 AS rank FROM manifest),
los AS (SELECT *, CASE WHEN abs(pred - ln(1 + frames)) <= 0.1 THEN 0.5 * (pred - ln(1 + frames)) ** 2 ELSE 0.1 * (abs(pred - ln(1 + frames)) - 0.05) END AS loss, abs(greatest(exp(pred) - 1, 0) - frames) AS err FROM met) """


def losses(spark, d):
    m = table(spark, d, "manifest")
    n = F.coalesce("num_frames", F.lit(50)).cast("double")
    r = m.select("row_id", n.alias("frames"), (F.log1p(n) + (F.col("row_id") * 7919 % 200 - 100) / 400.0).alias("pred"), F.when(F.col("row_id") % 11 != 0, F.col("speaker_id").isNotNull()).alias("sp"), F.col("caption").isNotNull().alias("cap"), (F.col("row_id") % 64).alias("batch"), (F.col("row_id") % 4).alias("rank"))
    return r.withColumns({"loss": X.huber(F.col("pred") - F.log1p("frames")), "err": X.frames_error(F.col("pred"), F.col("frames"))})


@book.query("huber_mae", MET + "SELECT row_id, round(loss, 9) AS loss, round(err, 6) AS err FROM los")
def q_huber(spark, d):
    return losses(spark, d).select("row_id", F.round("loss", 9).alias("loss"), F.round("err", 6).alias("err"))


_COHORT_SQL = MET + ", ".join(["" + ", g AS (SELECT unnest(['speaker','no_speaker','caption','no_caption','speaker_caption','speaker_no_caption','no_speaker_caption','no_speaker_no_caption']) AS cohort)"]) + """
, j AS (SELECT cohort, loss, err FROM g LEFT JOIN los ON CASE cohort WHEN 'speaker' THEN sp WHEN 'no_speaker' THEN NOT sp WHEN 'caption' THEN cap WHEN 'no_caption' THEN NOT cap WHEN 'speaker_caption' THEN sp AND cap WHEN 'speaker_no_caption' THEN sp AND NOT cap WHEN 'no_speaker_caption' THEN NOT sp AND cap ELSE NOT sp AND NOT cap END)
SELECT cohort, round(coalesce(avg(loss), 0), 9) AS loss, round(coalesce(avg(err), 0), 6) AS mae, count(loss) AS n FROM j GROUP BY 1"""


@book.query("duration_groups", _COHORT_SQL)
def q_cohorts(spark, d):
    c = X.cohort_metrics(losses(spark, d), "sp", "cap", "loss", "err")
    return c.select("cohort", F.round("loss", 9).alias("loss"), F.round("mae", 6).alias("mae"), "n")


@book.query("duration_groups_log", "SELECT string_agg(x, ' ' ORDER BY x) AS line FROM (SELECT cohort || ':n=' || n AS x FROM (" + _COHORT_SQL + ") WHERE n > 0)")
def q_cohort_log(spark, d):
    c = q_cohorts(spark, d).where("n > 0").select(F.concat("cohort", F.lit(":n="), F.col("n").cast("string")).alias("x"))
    return c.agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias("line"))


@book.query("weighted_mean_metrics", MET + ", b AS (SELECT batch, avg(loss) AS v, count(*) AS n FROM los GROUP BY 1) SELECT round(sum(v * n) / greatest(sum(n), 1), 9) AS mean, CAST(sum(n) AS BIGINT) AS n FROM b")
def q_weighted(spark, d):
    b = losses(spark, d).groupBy("batch").agg(F.avg("loss").alias("v"), F.count(F.lit(1)).alias("n"))
    return X.weighted_mean(b, "v", "n").withColumn("mean", F.round("mean", 9))


@book.query("allreduce_mean", MET + ", r AS (SELECT rank, avg(loss) AS v FROM los GROUP BY 1) SELECT round(avg(v), 9) AS mean, round(sum(v), 9) AS total FROM r")
def q_allreduce(spark, d):
    r = losses(spark, d).groupBy("rank").agg(F.avg("loss").alias("v"))
    return r.agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.sum("v"), 9).alias("total"))


@book.query("grad_accum_mean", MET + "SELECT row_id // 8 AS step, round(avg(loss), 9) AS loss FROM los GROUP BY 1")
def q_accum(spark, d):
    return losses(spark, d).groupBy(F.floor(F.col("row_id") / 8).alias("step")).agg(F.round(F.avg("loss"), 9).alias("loss"))


@book.query("moving_average", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 8) AS moving FROM orders")
def q_moving(spark, d):
    return X.moving_average(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_orderkey", F.round("moving", 8).alias("moving"))


@book.query("throughput", "WITH x AS (SELECT user_id, event_id, epoch(ts) AS t FROM events), y AS (SELECT *, (event_id - lag(event_id) OVER w) / greatest(t - lag(t) OVER w, 1e-6) AS r FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(r, 4) AS steps_per_s, round(r * 32, 4) AS samples_per_s, round(event_id * 100.0 / 1000000, 6) AS percent FROM y")
def q_throughput(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    r = X.throughput(e, ["user_id"], "event_id", "t", 32, 1000000)
    return r.select("event_id", F.round("steps_per_s", 4).alias("steps_per_s"), F.round("samples_per_s", 4).alias("samples_per_s"), F.round("percent", 6).alias("percent"))


_LONG = "WITH x AS (SELECT l_orderkey, (l_discount - l_tax) ** 2 AS sq, l_returnflag <> 'R' AS v FROM lineitem), p AS (SELECT l_orderkey, sum(CASE WHEN v THEN sq ELSE 0 END) AS s, count(*) FILTER (v) AS m, count(*) AS t FROM x GROUP BY 1)"


@book.query("masked_mse", _LONG + "SELECT round(avg(s / greatest(m, 1)), 9) AS utterance, round((sum(s) / sum(t)) / greatest(sum(m) / sum(t), 1e-6), 9) AS echo FROM p")
def q_mse(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.pow(F.col("l_discount") - F.col("l_tax"), 2).alias("sq"), (F.col("l_returnflag") != "R").alias("v"))
    r = X.masked_mse(li, "l_orderkey", "sq", "v")
    return r.select(F.round("utterance", 9).alias("utterance"), F.round("echo", 9).alias("echo"))


_NAMES = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN printf('checkpoint_%07d.pt', o_orderkey) WHEN 1 THEN printf('checkpoint_best_val_loss_%07d_%.6f', o_orderkey, o_totalprice / 1000) WHEN 2 THEN printf('checkpoint_%07d.speaker.safetensors', o_orderkey) ELSE 'checkpoint_final.pt' END AS name FROM orders"


def checkpoints(spark, d):
    k = F.col("o_orderkey")
    name = (
        F.when(k % 4 == 0, F.format_string("checkpoint_%07d.pt", k))
        .when(k % 4 == 1, F.format_string("checkpoint_best_val_loss_%07d_%.6f", k, F.col("o_totalprice") / 1000))
        .when(k % 4 == 2, F.format_string("checkpoint_%07d.speaker.safetensors", k))
        .otherwise("checkpoint_final.pt")
    )
    return table(spark, d, "orders").select(k.alias("k"), name.alias("name"))


_PARSED = f"WITH n AS ({_NAMES}), p AS (SELECT k, regexp_extract(name, '{X.BEST_CHECKPOINT}', 1) AS b, regexp_extract(name, '{X.BEST_CHECKPOINT}', 2) AS s, regexp_extract(name, '{X.CHECKPOINT}', 1) AS c FROM n), r AS (SELECT k, CASE WHEN b <> '' THEN 'best' WHEN c <> '' THEN 'periodic' END AS kind, CAST(CASE WHEN b <> '' THEN b WHEN c <> '' THEN c END AS BIGINT) AS step, CAST(nullif(s, '') AS DOUBLE) AS score FROM p) "


@book.query("parse_checkpoint_name", _PARSED + "SELECT * FROM r")
def q_parse(spark, d):
    return checkpoints(spark, d).select("k", *X.parse_checkpoint(F.col("name")))


@book.query("best_n_retention", _PARSED + "SELECT step, min(score) AS score FROM r WHERE kind = 'best' GROUP BY 1 ORDER BY score, step LIMIT 5")
def q_best(spark, d):
    return X.best_n(q_parse(spark, d).where("kind = 'best'"), "score", "step", 5)


@book.query("latest_k_retention", _PARSED + "SELECT step FROM r WHERE kind = 'periodic' ORDER BY step DESC LIMIT 3")
def q_latest(spark, d):
    return X.latest_k(q_parse(spark, d).where("kind = 'periodic'").select("step"), "step", 3)


@book.query("topn_per_cluster", "SELECT source, row_id, CAST(k AS INTEGER) AS rank FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(num_frames, 0) DESC, row_id) AS k FROM manifest) WHERE k <= 5")
def q_topn(spark, d):
    m = table(spark, d, "manifest").select("source", "row_id", F.coalesce("num_frames", F.lit(0)).alias("n"))
    return X.top_n_per(m, ["source"], [F.desc("n"), F.col("row_id")], 5).select("source", "row_id", "rank")


@book.query("topn_candidates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 23 AND l_discount >= 0.05 ORDER BY round(l_discount * ln(1 + l_extendedprice), 9) DESC, l_orderkey, l_linenumber LIMIT 8")
def q_top_candidates(spark, d):
    score = F.round(F.col("l_discount") * F.log1p("l_extendedprice"), 9)
    return table(spark, d, "lineitem").where("l_quantity >= 23 AND l_discount >= 0.05").orderBy(F.desc(score), "l_orderkey", "l_linenumber").limit(8).select("l_orderkey", "l_linenumber")


@book.query("cluster_totals", "WITH t AS (SELECT source, sum(coalesce(num_frames, 0)) AS total FROM manifest WHERE source IS NOT NULL GROUP BY 1) SELECT source, CAST(total AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY total DESC, source) - 1 AS INTEGER) AS cluster FROM t")
def q_totals(spark, d):
    t = table(spark, d, "manifest").where("source IS NOT NULL").groupBy("source").agg(F.sum(F.coalesce("num_frames", F.lit(0))).alias("total"))
    return t.withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "source")) - 1)  # one row per cluster


@book.query("cluster_summary", "SELECT source, count(*) AS n, round(sum(coalesce(num_frames, 0)) / 25.0 / 60, 6) AS minutes, median(CAST(num_frames AS DOUBLE)) AS median_frames, CASE WHEN median(CAST(num_frames AS DOUBLE)) >= 165 THEN 'high' WHEN median(CAST(num_frames AS DOUBLE)) >= 85 THEN 'mid' WHEN median(CAST(num_frames AS DOUBLE)) IS NULL THEN '' ELSE 'low' END AS bucket FROM manifest GROUP BY 1")
def q_summary(spark, d):
    from kikitori.functions.text import f0_bucket

    g = table(spark, d, "manifest").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("num_frames", F.lit(0))) / 25.0 / 60, 6).alias("minutes"), F.percentile(F.col("num_frames").cast("double"), F.lit(0.5)).alias("median_frames"))
    return g.withColumn("bucket", f0_bucket(F.col("median_frames")))


@book.query("state_dict_diff", "WITH a AS (SELECT p_name AS name, p_size AS shape FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS shape FROM part WHERE p_partkey % 4 <> 0), x AS (SELECT name, min(shape) AS shape FROM a GROUP BY 1), y AS (SELECT name, min(shape) AS shape FROM b GROUP BY 1) SELECT CASE WHEN y.name IS NULL THEN 'missing' WHEN x.name IS NULL THEN 'extra' WHEN x.shape <> y.shape THEN 'shape' ELSE 'matched' END AS state, count(*) AS n FROM x FULL JOIN y ON x.name = y.name GROUP BY 1")
def q_state(spark, d):
    p = table(spark, d, "part")
    x = p.where("p_partkey % 3 <> 0").groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("sx"))
    y = p.where("p_partkey % 4 <> 0").groupBy(F.col("p_name").alias("name")).agg(F.min(F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("sy"))
    j = x.join(y, "name", "full")
    state = F.when(F.col("sy").isNull(), "missing").when(F.col("sx").isNull(), "extra").when(F.col("sx") != F.col("sy"), "shape").otherwise("matched")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
