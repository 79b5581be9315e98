"""Rules the results of the text problems keep, as counts of what breaks them: each query gives rule, n_broken, and every
count is to be 0. They stand beside queries that SQL can't express."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kikitori.llm import queries as Q
from kikitori.llm.abuse import CATEGORIES
from kikitori.llm.groups import QUARANTINE, person_key
from kikitori.llm.mixing import reached_shares
from kikitori.llm.tokens import token_count
from kikitori.plans.tables import table
from kikitori.session import cut

SHARE_OFF = 0.02  # most a split's share may be off its target
FILL_OFF = 0.02  # most a packing may need beyond the least number of bins, as a share


def _counted(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, n_broken: for each rule the rows of ``df`` that break it."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_broken")) for n in rules])))


def _gap(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
    """rule, n_broken: by how many rows two tables differ in number."""
    counts = a.select(F.lit(1).alias("w")).unionByName(b.select(F.lit(-1).alias("w"))).agg(F.sum("w").alias("w"))
    return counts.select(F.lit(rule).alias("rule"), F.abs(F.coalesce("w", F.lit(0))).cast("bigint").alias("n_broken"))


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    s, _ = cut(Q.p1_scores(spark, d), "scores")
    bad = {f"{c}_below_zero": F.coalesce(F.col(c) < 0, F.lit(True)) for c in CATEGORIES}
    return _counted(s, bad).unionByName(_gap(s, table(spark, d, "manifest"), "rows_without_score"))


def p2_rules(spark: SparkSession, d: str) -> DataFrame:
    t, _ = cut(Q.p2_turns(spark, d), "turns")
    w = Window.partitionBy("transcript_id").orderBy("turn_no")
    t = t.withColumns({"before": F.lag("speaker").over(w), "place": F.row_number().over(w) - 1})
    return _counted(
        t,
        {
            "neighbours_of_one_speaker": F.col("before") == F.col("speaker"),
            "numbers_with_gaps": F.col("place") != F.col("turn_no"),
            "ends_before_start": F.col("end_s") < F.col("start_s"),
            "without_text": F.trim(F.coalesce("text", F.lit(""))) == "",
        },
    )


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("row_id", "speaker_id", "audio_file")
    s, _ = cut(Q.p3_splits(spark, d).join(m, "row_id"), "splits")
    speakers = s.where("speaker_id IS NOT NULL").select("speaker_id", "split_name").distinct()
    people = speakers.select(person_key(F.col("speaker_id")).alias("k"), "split_name")
    recordings = s.where("audio_file IS NOT NULL").select(F.col("audio_file").alias("k"), "split_name")
    torn = {"people_torn": people, "recordings_torn": recordings}
    out = _gap(s, m, "rows_without_split")
    for rule, pairs in torn.items():
        out = out.unionByName(_counted(pairs.groupBy("k").agg(F.count_distinct("split_name").alias("n")), {rule: F.col("n") > 1}))
    kept = s.where(F.col("split_name") != QUARANTINE)
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = table(spark, d, "split_targets").join(kept.groupBy("split_name").agg(F.count(F.lit(1)).alias("n")), "split_name", "full_outer")
    off = F.abs(F.coalesce("n", F.lit(0)) / total - F.coalesce("target_share", F.lit(0.0))) > SHARE_OFF
    return out.unionByName(_counted(shares, {"shares_off": off}))


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    limit = Q._size_limit(spark, d, "latent")
    p, _ = cut(Q.p7_pieces(spark, d), "pieces")
    w = Window.partitionBy("row_id").orderBy("piece_no")
    p = p.withColumns({"next_start": F.lead("start_frame").over(w), "place": F.row_number().over(w) - 1})
    pieces = _counted(
        p,
        {
            "over_limit": F.col("end_frame") - F.col("start_frame") > limit["max_size"],
            "not_forward": F.col("end_frame") <= F.col("start_frame"),
            "first_not_at_0": (F.col("piece_no") == 0) & (F.col("start_frame") != 0),
            "overlap_off": F.col("next_start") != F.col("end_frame") - limit["overlap_size"],
            "numbers_with_gaps": F.col("place") != F.col("piece_no"),
        },
    )
    ends = p.groupBy("row_id").agg(F.max("end_frame").alias("last"))
    rows = ends.join(table(spark, d, "manifest").select("row_id", "num_frames"), "row_id")
    return pieces.unionByName(_counted(rows, {"last_not_at_the_end": F.col("num_frames").isNotNull() & (F.col("last") != F.col("num_frames"))}))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    size = Q._size_limit(spark, d, "token_bin")["max_size"]
    p, _ = cut(Q.p8_packed(spark, d).withColumn("n", F.col("end_token") - F.col("start_token")), "packed")
    docs = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).cast("bigint").alias("n_tokens"))
    parts = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("start_token").alias("lo"), F.max("end_token").alias("hi"))
    j = docs.join(parts, "doc_id", "left")
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_tokens"))
    bins = p.groupBy("bin_id").agg(F.sum("n").alias("n"))
    used = bins.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return (
        _counted(j, {"documents_not_whole": ~F.coalesce(whole, F.lit(False)), "split_without_need": (F.col("k") > 1) & (F.col("n_tokens") <= size)})
        .unionByName(_counted(bins, {"bins_over_capacity": F.col("n") > size}))
        .unionByName(_counted(used, {"more_bins_than_allowed": F.col("k") > F.ceil(F.col("n") / size * (1 + FILL_OFF)) + 1}))
    )


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mix_targets")
    mix, _ = cut(Q.p9_mix(spark, d), "mix")
    rows = mix.join(t, "source", "left")
    by_source = mix.groupBy("source").agg((F.max("repeats") - F.min("repeats")).alias("spread"))
    # documents aren't cut, so a source may miss its tokens by half of its largest one, and the whole by the sum of that
    largest = mix.groupBy("source").agg(F.max("n_tokens").alias("most"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n"))
    allowed = largest.agg(F.sum("most") / F.sum("n")).scalar()
    shares = reached_shares(mix, t)
    return (
        _counted(rows, {"repeats_over_cap": F.col("repeats") > F.col("max_repeats"), "repeats_below_one": F.col("repeats") < 1, "sources_without_target": F.col("target_share").isNull()})
        .unionByName(_counted(by_source, {"epochs_incomplete": F.col("spread") > 1}))
        .unionByName(_counted(shares, {"shares_off": F.abs(F.col("reached_share") - F.col("target_share")) > allowed}))
        .unionByName(_counted(mix.groupBy("doc_id").count(), {"documents_twice": F.col("count") > 1}))
    )


def p10_rules(spark: SparkSession, d: str) -> DataFrame:
    r, _ = cut(Q.p10_restored(spark, d), "restored")
    j = r.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left")
    partly = F.col("chains").contains("?")
    return _counted(
        j,
        {
            "unknown_documents": F.col("text").isNull(),
            "nothing_restored": (F.col("n_passages") > 0) & ~partly & (F.col("restored") == F.col("text")),
            "changed_without_passage": (F.col("n_passages") == 0) & (F.col("restored") != F.col("text")),
            "lost_misstated": F.col("lost") != F.col("restored").contains("�"),
        },
    ).unionByName(_counted(r.groupBy("doc_id").count(), {"documents_twice": F.col("count") > 1}))


RULES = {
    "p1_rules": (p1_rules, "abuse_below_zero hate_below_zero sexual_below_zero rows_without_score"),
    "p2_rules": (p2_rules, "neighbours_of_one_speaker numbers_with_gaps ends_before_start without_text"),
    "p3_rules": (p3_rules, "rows_without_split people_torn recordings_torn shares_off"),
    "p7_rules": (p7_rules, "over_limit not_forward first_not_at_0 overlap_off numbers_with_gaps last_not_at_the_end"),
    "p8_rules": (p8_rules, "documents_not_whole split_without_need bins_over_capacity more_bins_than_allowed"),
    "p9_rules": (p9_rules, "repeats_over_cap repeats_below_one sources_without_target epochs_incomplete shares_off documents_twice"),
    "p10_rules": (p10_rules, "unknown_documents nothing_restored changed_without_passage lost_misstated documents_twice"),
}


def queries():
    return {name: run for name, (run, _) in RULES.items()}


def oracle_sql():
    return {name: "SELECT unnest([" + ", ".join(f"'{r}'" for r in rules.split()) + "]) AS rule, CAST(0 AS BIGINT) AS n_broken" for name, (_, rules) in RULES.items()}
