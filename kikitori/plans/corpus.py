"""Queries of the general training-data problems: skewed keys (p4) and time intervals (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kikitori.operators.eager import compact_state, eager_join_aggregate, heavy_keys, join_states
from kikitori.operators.runs import periods_and_gaps, to_ms
from kikitori.plans.tables import table

HEAVY_SHARE = 0.025


def speaker_totals(manifest: DataFrame) -> DataFrame:
    """Per speaker (the null speaker too): rows, frames, captions (non-null elements). Rows and exploded captions are two
    inputs, each reduced by speaker before any shuffle; only their compact states are joined."""
    rows = compact_state(manifest, ["speaker_id"], {"n_frames": F.col("num_frames").cast("bigint")}, "n_rows")
    captions = manifest.select("speaker_id", F.explode("caption").alias("c")).where(F.col("c").isNotNull())
    return join_states(rows, compact_state(captions, ["speaker_id"], {}, "n_captions"), ["speaker_id"], ["n_captions"])


def speaker_recordings(manifest: DataFrame, segments: DataFrame) -> DataFrame:
    """Per speaker, what ``manifest JOIN segments USING (audio_file) GROUP BY speaker_id`` gives: joined rows, frames (once
    for each segment met), milliseconds of segments (once for each row met). Neither input is joined row by row."""
    return eager_join_aggregate(
        manifest,
        segments.select("audio_file", "s_ms", "e_ms"),
        ["audio_file"],
        ["speaker_id"],
        {"row_frames": F.col("num_frames").cast("bigint")},
        {"segment_ms": F.when(F.col("e_ms") > F.col("s_ms"), F.col("e_ms") - F.col("s_ms"))},
    ).select(
        "speaker_id", *[F.col(c).cast("bigint").alias(c) for c in ("joined_rows", "row_frames", "segment_ms")]
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    totals = speaker_totals(table(spark, d, "manifest"))
    return heavy_keys(totals, "speaker_id", "n_rows", HEAVY_SHARE).select("speaker_id")


def p4_speaker_totals(spark: SparkSession, d: str) -> DataFrame:
    return speaker_totals(table(spark, d, "manifest"))


def p4_speaker_recordings(spark: SparkSession, d: str) -> DataFrame:
    return speaker_recordings(table(spark, d, "manifest"), diarization_segments(spark, d))


def diarization_segments(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "diarization")
        .select("audio_file", F.explode("segments").alias("s"))
        .select("audio_file", F.col("s.speaker").alias("speaker"), to_ms(F.col("s.start_s")).alias("s_ms"), to_ms(F.col("s.end_s")).alias("e_ms"))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(diarization_segments(spark, d), ["audio_file", "speaker"], "s_ms", "e_ms")


def queries():
    return {"p4_found": p4_found, "p4_speaker_totals": p4_speaker_totals, "p4_speaker_recordings": p4_speaker_recordings, "p6_found": p6_found}


P4_FOUND = """
SELECT speaker_id FROM manifest WHERE speaker_id IS NOT NULL GROUP BY speaker_id
HAVING count(*) >= 0.025 * (SELECT count(*) FROM manifest)
"""

P4_TOTALS = """
SELECT speaker_id, count(*) AS n_rows, CAST(coalesce(sum(num_frames), 0) AS BIGINT) AS n_frames,
  CAST(coalesce(sum(len(list_filter(caption, lambda x: x IS NOT NULL))), 0) AS BIGINT) AS n_captions
FROM manifest GROUP BY speaker_id
"""

P4_RECORDINGS = """
WITH seg AS (
  SELECT audio_file, CAST(round(s.start_s * 1000) AS BIGINT) AS a, CAST(round(s.end_s * 1000) AS BIGINT) AS b
  FROM (SELECT audio_file, unnest(segments) AS s FROM diarization)
)
SELECT speaker_id, CAST(count(*) AS BIGINT) AS joined_rows, CAST(sum(coalesce(num_frames, 0)) AS BIGINT) AS row_frames,
  CAST(sum(CASE WHEN b > a THEN b - a ELSE 0 END) AS BIGINT) AS segment_ms
FROM manifest JOIN seg USING (audio_file) GROUP BY speaker_id
"""

P6_FOUND = """
WITH seg AS (
  SELECT audio_file, s.speaker AS speaker, CAST(round(s.start_s * 1000) AS BIGINT) AS a, CAST(round(s.end_s * 1000) AS BIGINT) AS b
  FROM (SELECT audio_file, unnest(segments) AS s FROM diarization)
), ok AS (SELECT * FROM seg WHERE audio_file IS NOT NULL AND speaker IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND b > a),
m AS (SELECT *, max(b) OVER (PARTITION BY audio_file, speaker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM ok),
g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY audio_file, speaker ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM m),
p AS (SELECT audio_file, speaker, isl, min(a) AS s, max(b) AS e FROM g GROUP BY ALL),
n AS (SELECT *, lead(s) OVER (PARTITION BY audio_file, speaker ORDER BY s) AS ns FROM p)
SELECT audio_file, speaker, 'period' AS kind, s AS start_ms, e AS end_ms FROM n
UNION ALL SELECT audio_file, speaker, 'gap', e, ns FROM n WHERE ns IS NOT NULL
"""


def oracle_sql():
    return {"p4_found": P4_FOUND, "p4_speaker_totals": P4_TOTALS, "p4_speaker_recordings": P4_RECORDINGS, "p6_found": P6_FOUND}
