"""Queries of the text problems over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kikitori.llm import oracle
from kikitori.llm.abuse import CATEGORIES, THRESHOLD, fitted_weights, found_categories, review_agreement, score_content, score_rows
from kikitori.llm.groups import ComponentTable, bound_speakers, row_splits
from kikitori.llm.lookalike import canonicalize, lookalike_classes, lookalike_pairs, stored_values
from kikitori.llm.mixing import draw_mix, letter_share, reached_shares
from kikitori.llm.mojibake import find_garbled
from kikitori.llm.packing import pack
from kikitori.llm.pieces import oversized_rows, recording_pieces
from kikitori.llm.tokens import token_count
from kikitori.llm.turns import fit_sample, speaker_turns, transcript_findings
from kikitori.plans.tables import table
from kikitori.session import shared_folder


def _fitted(spark: SparkSession, d: str) -> dict[str, float]:
    return fitted_weights(table(spark, d, "manifest"), table(spark, d, "review_labels"), "row_id", "text", "caption")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return found_categories(score_content(table(spark, d, "manifest"), "row_id", "text", "caption", _fitted(spark, d)), "row_id")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score for every row: the highest of its text and captions in each category."""
    s = score_rows(table(spark, d, "manifest"), "row_id", "text", "caption", _fitted(spark, d))
    return s.select("row_id", *[F.greatest(f"text_{c}", f"caption_{c}").alias(c) for c in CATEGORIES])


def p1_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source (the null source too): rows, and the share of rows found in each category."""
    keyed = table(spark, d, "manifest").select(F.struct("row_id", "source").alias("k"), "text", "caption")
    s = score_rows(keyed, "k", "text", "caption", _fitted(spark, d))
    hit = [(F.greatest(f"text_{c}", f"caption_{c}") >= THRESHOLD).cast("int") for c in CATEGORIES]
    return s.groupBy(F.col("k.source").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(h).alias(f"{c}_rate") for h, c in zip(hit, CATEGORIES)])


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement with the reviewers' verdicts that the weights weren't fitted to."""
    return review_agreement(table(spark, d, "manifest"), table(spark, d, "review_labels"), "row_id", "text", "caption", _fitted(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return transcript_findings(table(spark, d, "transcripts"), "transcript_id", "segments")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """Segments without a label join the turn that pauses and lexical continuity speak for."""
    t = table(spark, d, "transcripts")
    return speaker_turns(t, "transcript_id", "segments", fit_sample(t, "transcript_id", "segments"), uncertain=True)


def _component_table(spark: SparkSession) -> ComponentTable:
    """A new table in the shared folder; a pipeline names a path of its own and loads into it again and again."""
    return ComponentTable(spark, f"{shared_folder(spark)}/component-table-{uuid.uuid4().hex}")


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return [(r["split_name"], r["target_share"]) for r in table(spark, d, "split_targets").orderBy("split_name").collect()]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m, components = table(spark, d, "manifest"), _component_table(spark)
    components.load("all", m, "row_id", "speaker_id", "audio_file", _targets(spark, d))
    return bound_speakers(components, m, "speaker_id")


FIRST_LOAD_UNTIL = "2024-06-01"


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    """row_id, split_name, status after two loads: the rows written before FIRST_LOAD_UNTIL, then those written later."""
    m, components = table(spark, d, "manifest"), _component_table(spark)
    early = F.coalesce(F.col("written_at") < F.lit(FIRST_LOAD_UNTIL).cast("timestamp_ntz"), F.lit(False))
    for name, rows in (("early", m.where(early)), ("late", m.where(~early))):
        components.load(name, rows, "row_id", "speaker_id", "audio_file", _targets(spark, d))
    return row_splits(components, m, "row_id", "speaker_id", "audio_file")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split_rows(spark, d)


def p3_split_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = _split_rows(spark, d).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.sum("n_rows")).scalar()
    return rows.join(table(spark, d, "split_targets"), "split_name", "left").select(
        "split_name", "n_rows", (F.col("n_rows") / total).alias("share"), "target_share"
    )


def _manifest_values(spark: SparkSession, d: str) -> DataFrame:
    return stored_values(table(spark, d, "manifest"), ["text", "speaker_id"], ["caption"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(_manifest_values(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return (
        lookalike_classes(_manifest_values(spark, d))
        .groupBy("field_name")
        .agg(F.count_distinct("canonical").alias("n_classes"), F.count(F.lit(1)).alias("n_values"))
    )


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """One row for each value that has look-alikes: its class and the number of its members."""
    return lookalike_classes(_manifest_values(spark, d))


def p5_canonical_speakers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("row_id", "speaker_id")
    return canonicalize(m, "row_id", ["speaker_id"]).groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n_rows"))


def p5_canonical_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every row of manifest, with text, captions and speaker in their consistent form."""
    return canonicalize(table(spark, d, "manifest"), "row_id", ["text", "speaker_id"], ["caption"])


def _size_limit(spark: SparkSession, d: str, kind: str):
    return table(spark, d, "size_limits").where(F.col("item_kind") == kind).first()


def _pieces(spark: SparkSession, d: str, limit) -> DataFrame:
    return recording_pieces(table(spark, d, "manifest"), table(spark, d, "diarization"), limit["max_size"], limit["overlap_size"], limit["units_per_second"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    limit = _size_limit(spark, d, "latent")
    return oversized_rows(_pieces(spark, d, limit), limit["max_size"], limit["units_per_second"])


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, _size_limit(spark, d, "latent")).drop("longest_talk_ms")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, part_no, start_token, end_token, bin_id: every document, in bins of the token_bin size."""
    docs = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    packed = pack(docs, "doc_id", "n_tokens", _size_limit(spark, d, "token_bin")["max_size"])
    return packed.select(F.col("item").alias("doc_id"), "part_no", F.col("start_unit").alias("start_token"), F.col("end_unit").alias("end_token"), "bin_id")


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """bin_id, n_parts, n_tokens, free_tokens."""
    limit = _size_limit(spark, d, "token_bin")["max_size"]
    sums = p8_packed(spark, d).groupBy("bin_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("end_token") - F.col("start_token")).alias("n_tokens"))
    return sums.withColumn("free_tokens", F.lit(limit) - F.col("n_tokens"))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "mix_targets").select("source"), "source", "left_semi")
    sized = docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), letter_share(F.col("text")).alias("weight"))
    return draw_mix(sized, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached_shares(_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"), "doc_id", "text")


def queries():
    from kikitori.llm import rules

    return {
        "p1_found": p1_found,
        "p1_scores": p1_scores,
        "p1_source_rates": p1_source_rates,
        "p1_agreement": p1_agreement,
        "p2_found": p2_found,
        "p2_turns": p2_turns,
        "p3_found": p3_found,
        "p3_splits": p3_splits,
        "p3_split_shares": p3_split_shares,
        "p5_found": p5_found,
        "p5_classes": p5_classes,
        "p5_members": p5_members,
        "p5_canonical_speakers": p5_canonical_speakers,
        "p5_canonical_manifest": p5_canonical_manifest,
        "p7_found": p7_found,
        "p7_pieces": p7_pieces,
        "p8_packed": p8_packed,
        "p8_bins": p8_bins,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_restored": p10_restored,
        **rules.queries(),
    }


def oracle_sql():
    from kikitori.llm import rules

    return {**oracle.SQL, **rules.oracle_sql()}
