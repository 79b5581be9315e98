"""Queries that go through sources, sinks and streams: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kikitori.functions import text as T
from kikitori.operators import manifest as M
from kikitori.plans.base import Book
from kikitori.plans.tables import table
from kikitori.session import shared_folder
from kikitori.sources import readers as R
from kikitori.sources import writers as W
from kikitori.streaming import pipeline as P

book = Book()
queries, oracle_sql = book.queries, book.oracle_sql


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@book.query("scan_dataset", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def q_dataset(spark, d):
    docs = R.scan_dataset(spark, "parquet", R.parse_data_files([f"{d}/documents.parquet"]), ["doc_id", "text", "source"])
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@book.query("parse_data_files", "SELECT split, count(*) AS n FROM (SELECT 'train' AS split FROM documents UNION ALL SELECT 'valid' FROM documents) GROUP BY 1")
def q_splits(spark, d):
    files = R.parse_data_files([f"train={d}/documents.parquet", f"valid={d}/documents.parquet"])
    return R.scan_dataset(spark, "parquet", files, ["doc_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@book.query("sink_jsonl", "SELECT row_id % 100 AS k, count(*) AS n, count(speaker_id) AS speakers, count(caption) AS captions, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(caption)) AS BIGINT) AS elements FROM manifest WHERE text IS NOT NULL GROUP BY 1")
def q_jsonl(spark, d):
    to = place(spark, "jsonl")
    m = table(spark, d, "manifest").where("text IS NOT NULL")
    W.write_manifest(m.select("text", F.concat(F.col("row_id").cast("string"), F.lit("|"), "latent_path").alias("latent_path"), "num_frames", "caption", "speaker_id"), to)
    back = R.read_manifest(spark, to)
    k = F.substring_index("latent_path", "|", 1).cast("bigint") % 100
    return back.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count("speaker_id").alias("speakers"), F.count("caption").alias("captions"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("caption")).alias("elements"))


@book.query("sink_csv", "SELECT latent_path AS file_name, text AS transcription FROM manifest WHERE text IS NOT NULL")
def q_csv(spark, d):
    to = place(spark, "csv")
    m = table(spark, d, "manifest").where("text IS NOT NULL")
    W.write_clips(m.select(F.col("latent_path").alias("file_name"), F.col("text").alias("transcription")), to)
    return R.read_clips(spark, to)


@book.query("csv_to_arrow", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM manifest WHERE text IS NOT NULL")
def q_piped(spark, d):
    to = place(spark, "piped")
    W.write_piped(table(spark, d, "manifest").where("text IS NOT NULL"), to, "latent_path", "text")
    return R.read_piped(spark, to).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@book.query("union_shards", "SELECT row_id % 4 AS rank, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM manifest GROUP BY 1")
def q_shards(spark, d):
    to = place(spark, "shards")
    W.write_shards(table(spark, d, "manifest").select("row_id", M.rank_stride(F.col("row_id"), 0, 4).alias("rank")), "rank", to)
    back = W.merged_shards(spark.read.schema("row_id bigint, rank bigint").parquet(to), "rank", "row_id")
    return back.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@book.query("sink_latent", "SELECT row_id, 'rank' || lpad(CAST(row_id % 4 AS VARCHAR), 2, '0') || '_' || printf('%08d_%08d.pt', row_id // 4, row_id) AS name FROM manifest")
def q_latent(spark, d):
    r = F.col("row_id")
    return table(spark, d, "manifest").select("row_id", W.latent_name(F.floor(r / 4), r, r % 4, 4).alias("name"))


@book.query("copy_sink", "SELECT latent_path AS src, 'out/cluster_' || lpad(CAST(row_id % 7 AS VARCHAR), 2, '0') || '/' || regexp_extract(latent_path, '[^/]*$') AS dest FROM manifest")
def q_copy(spark, d):
    m = table(spark, d, "manifest").withColumn("c", F.col("row_id") % 7)
    return W.copy_plan(m, "latent_path", "c", "out")


@book.query("index_cache", "SELECT count(*) AS n, 1 AS built, 1 AS reused FROM manifest")
def q_cache(spark, d):
    to = place(spark, "index")
    m = table(spark, d, "manifest").select("row_id", "speaker_id")
    stamp = {"version": 1, "key": T.index_name("caption")}
    first = R.cached_index(m, to, stamp).count()
    again = R.cached_index(m.where("false"), to, stamp)  # not read: the written one is reused
    return again.agg(F.count(F.lit(1)).alias("n"), F.lit(int(first > 0)).alias("built"), F.lit(int(again.count() == first)).alias("reused"))


@book.query("chunked_scan", "SELECT diar_id, CAST(unnest(range(0, CAST(ceil(duration / 60.0) AS BIGINT))) * 60 AS DOUBLE) AS start FROM diarization WHERE duration > 0")
def q_chunks(spark, d):
    return table(spark, d, "diarization").select("diar_id", F.explode(R.chunks(F.col("duration"), 60.0).cast("array<double>")).alias("start"))


@book.query("stream_skip_counts", "SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty_text' ELSE 'ok' END AS reason, count(*) AS n FROM manifest GROUP BY 1")
def q_stream(spark, d):
    m = table(spark, d, "manifest")
    rows = P.stream_files(spark, "parquet", f"{d}/manifest.parquet*", m._jdf.schema().toDDL())
    marked = rows.select("row_id", F.when(F.coalesce("text", F.lit("")) == "", "empty_text").otherwise("ok").alias("reason"))
    done = P.run_once(marked, place(spark, "stream"), place(spark, "stream-state"))
    return done.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@book.query("stream_best_n", "SELECT o_orderkey AS step, min(o_totalprice) AS score FROM orders GROUP BY 1 ORDER BY score, step LIMIT 5")
def q_stream_best(spark, d):
    o = table(spark, d, "orders")
    s = P.stream_files(spark, "parquet", f"{d}/orders.parquet*", o._jdf.schema().toDDL()).select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("score"))
    return P.retain_best(s, "score", "step", 5, place(spark, "best-state"))()
