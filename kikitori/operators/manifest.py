"""Building a manifest: why a row is rejected, what is written, index, shards, splits, references of the same speaker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kikitori.functions.text import keyed_number, keyed_order
from kikitori.operators.prefix import bucket_count, hash_bucket, prefix_sum
from kikitori.session import cut

REASONS_AUDIO = ("audio_decode", "trimmed_empty", "prepare_error", "encode_error", "dataset_iter_error")


def skip_reason(text: Column, decodes: Column, rate: Column, samples: Column, min_rate: int = 0, max_seconds: float | None = None) -> Column:
    """The first reason that applies, null for rows to keep: empty_text, audio_decode, low_sample_rate, trimmed_empty."""
    reason = F.when(text == "", "empty_text").when(~F.coalesce(decodes, F.lit(False)), "audio_decode")
    if min_rate > 0:
        reason = reason.when(rate < min_rate, "low_sample_rate")
    if max_seconds is not None:
        reason = reason.when(F.least(samples, (F.lit(max_seconds) * rate).cast("bigint")) == 0, "trimmed_empty")
    return reason


def skip_counts(rows: DataFrame, reason: str = "skip_reason") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def skip_rollup(rows: DataFrame, reason: str = "skip_reason") -> DataFrame:
    r = F.col(reason)
    return rows.agg(
        F.count_if(r == "empty_text").alias("empty"),
        F.count_if(r == "missing_speaker").alias("speaker"),
        F.count_if(r == "low_sample_rate").alias("low_sr"),
        F.count_if(r == "max_samples_limit").alias("max"),
        F.count_if(r.isin(*REASONS_AUDIO)).alias("audio"),
    )


def rank_stride(idx: Column, start: int, world: int) -> Column:
    """Rank of a source row where ranks take turns; null before ``start``."""
    return F.when(idx >= start, F.pmod(idx, F.lit(world)))


def rank_stream(idx: Column, skip: int, world: int) -> Column:
    """Rank of a row of a stream that is sharded first: each rank skips the first ``skip`` rows of its own; null for those."""
    return F.when(F.floor(idx / F.lit(world)) >= skip, F.pmod(idx, F.lit(world)))


def rank_contiguous(idx: Column, start: int, total: int, world: int) -> Column:
    """Rank where each rank takes a block of ceil(rows / world); the last block may be short."""
    per = -(-max(total - start, 0) // world) or 1
    return F.when((idx >= start) & (idx < total), F.floor((idx - start) / F.lit(per)))


def number_bucket(df: DataFrame, number: str) -> Column:
    """A bucket that follows a whole number from its minimum to its maximum; their count follows the number of rows."""
    low, high, n = df.agg(F.min(number), F.max(number), F.count(F.lit(1))).first()
    if low is None:
        return F.lit(0)
    width = max(1, -(-(high - low + 1) // bucket_count(n)))
    return F.floor((F.coalesce(F.col(number), F.lit(low)) - F.lit(low)) / F.lit(width)).cast("int")


def first_accepted(rows: DataFrame, rank: str, idx: str, ok: Column, most: int) -> DataFrame:
    """Per rank, the rows up to its ``most``-th accepted one: what a reader that stops there has seen. Ranks are few, so the
    running count is taken over buckets of positions."""
    counted = rows.withColumns({"__ok": ok.cast("int"), "__bk": number_bucket(rows, idx)})
    run = prefix_sum(counted, [rank], "__bk", [idx], "__ok", "__n")
    return run.where(F.col("__n") < most).drop("__n", "__ok", "__bk")


def line_offsets(df: DataFrame, line_no: str, line: Column) -> DataFrame:
    """Byte offset of each line: the sum of the lengths before, by buckets of line numbers."""
    sized = df.withColumns({"__len": (F.octet_length(line) + 1).cast("bigint"), "__bk": number_bucket(df, line_no)})
    return prefix_sum(sized, [], "__bk", [line_no], "__len", "byte_offset").drop("__len", "__bk")


def split_train_valid(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """``df`` with ``split``: exactly int(n * ratio) rows, at least 1 and at most n - 1, are ``valid``: the first in keyed
    order. Counts are exact; the rank is a running sum over hash buckets, not a sort in one task."""
    n = df.count()
    if ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    if n < 2:
        raise ValueError("a validation split needs at least 2 rows")
    valid = min(max(1, int(n * ratio)), n - 1)
    order = keyed_order(seed, F.col(key))
    # hexadecimal order keys: their first seven digits follow the order
    bucket = F.floor(F.conv(F.substring(order, 1, 7), 16, 10).cast("bigint") * bucket_count(n) / (1 << 28)).cast("int")
    bucketed = df.withColumns({"__o": order, "__bk": bucket, "__one": F.lit(1)})
    ranked = prefix_sum(bucketed, [], "__bk", ["__o", key], "__one", "__rank")
    return ranked.withColumn("split", F.when(F.col("__rank") < valid, "valid").otherwise("train")).drop("__o", "__bk", "__one", "__rank")


def reference_pairs(df: DataFrame, key: str, groups: Sequence[str], seed: int) -> DataFrame:
    """``df`` with ``ref``: another row of the same group, uniform over the others; the row itself where it is alone or a
    group column is null, with ``has_ref`` false.

    Rows get positions in their group from running sums over buckets (a group with a third of all rows is spread over
    them); position p draws p' <> p from a keyed number, and one equi-join on (group, position) finds the row: no pairs are
    made, and no group is gathered in a task."""
    known = df.where(" AND ".join(f"{g} IS NOT NULL" for g in groups)).select(key, *groups)
    known = known.withColumns({"__bk": hash_bucket(F.col(key), buckets=bucket_count(df.count())), "__one": F.lit(1)})
    # written once, as the rows that draw and the rows drawn are the same; sizes come with the sums of buckets
    placed, _ = cut(prefix_sum(known, groups, "__bk", [key], "__one", "__pos", "__n").drop("__bk", "__one"), "positions")
    sized = placed.where("__n > 1")
    step = 1 + keyed_number(seed, F.col(key), F.col("__n") - 1)
    drawn = sized.withColumn("__want", F.pmod(F.col("__pos") + step, F.col("__n"))).select(F.col(key).alias("__key"), *[F.col(g).alias(f"__g_{g}") for g in groups], "__want")
    targets = placed.select(F.col(key).alias("__ref"), *[F.col(g).alias(f"__t_{g}") for g in groups], F.col("__pos").alias("__at"))
    on = [F.col(f"__g_{g}") == F.col(f"__t_{g}") for g in groups] + [F.col("__want") == F.col("__at")]
    refs = drawn.join(targets, on).select("__key", "__ref")
    out = df.join(refs, F.col(key) == F.col("__key"), "left")
    return out.withColumns({"ref": F.coalesce("__ref", key), "has_ref": F.col("__ref").isNotNull()}).drop("__key", "__ref")
