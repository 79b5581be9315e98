"""Time segments: numbering, islands, nearest neighbours in time, padding, validation, regrouping of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_enough(start: Column, end: Column, least_seconds: float, rate: int) -> Column:
    """Both bounds cut to whole samples first, then compared."""
    return (end * rate).cast("bigint") - (start * rate).cast("bigint") >= int(least_seconds * rate)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, inclusive: bool = False) -> DataFrame:
    """keys, s, e, n: intervals of a key joined while the next starts less than ``gap`` (or at most, ``inclusive``) after
    the furthest end so far. One exchange and one sort by key and start."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) - before
    new = F.when(before.isNull() | ((apart > gap) if inclusive else (apart >= gap)), 1).otherwise(0)
    marked = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count(F.lit(1)).alias("n")).drop("__island")


def others_of(segments: DataFrame, targets: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Segments whose (start, end) is no target's, whoever speaks."""
    return segments.join(targets.select(*keys, start, end).distinct(), [*keys, start, end], "left_anti")


def nearest_bounds(spans: DataFrame, others: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """``spans`` (keys, s, e, ...) with prev_end, the latest end of another segment at or before s, and next_start, the
    earliest start at or after e. Union and running extremes instead of a join by inequality."""
    rest = [c for c in spans.columns if c not in keys]
    w = Window.partitionBy(*keys)
    mark = spans.select(*keys, F.col("s").alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast("double").alias("__v"), F.struct(*rest).alias("__row"))
    ends = others.select(*keys, F.col(end).alias("__t"), F.lit(0).alias("__k"), F.col(end).cast("double").alias("__v"), F.lit(None).cast(mark.schema["__row"].dataType).alias("__row"))
    back = mark.unionByName(ends).withColumn("prev_end", F.max("__v").over(w.orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0))).where("__k = 1")
    mark2 = back.select(*keys, F.col("__row.e").alias("__t"), F.lit(0).alias("__k"), F.lit(None).cast("double").alias("__v"), F.struct(*[F.col(f"__row.{c}").alias(c) for c in rest], "prev_end").alias("__row"))
    starts = others.select(*keys, F.col(start).alias("__t"), F.lit(1).alias("__k"), F.col(start).cast("double").alias("__v"), F.lit(None).cast(mark2.schema["__row"].dataType).alias("__row"))
    ahead = mark2.unionByName(starts).withColumn("next_start", F.min("__v").over(w.orderBy("__t", "__k").rowsBetween(0, Window.unboundedFollowing))).where("__k = 0")
    return ahead.select(*keys, "__row.*", "next_start")


def padded(spans: DataFrame, before: float, after: float) -> DataFrame:
    """s and e moved apart, but not into other segments, below zero, or inside the span."""
    s = F.greatest(F.col("s") - before, F.coalesce("prev_end", F.lit(0.0)), F.lit(0.0))
    e = F.greatest(F.least(F.col("e") + after, F.coalesce("next_start", F.lit(float("inf")))), F.col("e"))
    return spans.withColumns({"s": s, "e": e})


def mapping_report(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """checked, mismatch, ok: ``expected`` keys with ``seconds``, of which ``actual`` should have each within tolerance."""
    have = actual.select(*keys, F.col("seconds").alias("__have"))
    j = expected.join(have, list(keys), "left")
    off = F.col("__have").isNull() | F.col("seconds").isNull() | (F.abs(F.col("__have") - F.col("seconds")) > tolerance)
    r = j.agg(F.count_if(F.col("__have").isNotNull() & F.col("seconds").isNotNull()).alias("checked"), F.count_if(off).alias("mismatch"))
    return r.withColumn("ok", (F.col("checked") > 0) & (F.col("mismatch") <= F.greatest(F.lit(1.0), F.col("checked") * 0.01)))


def regroup_words(words: DataFrame, keys: Sequence[str], start: str, end: str, text: str, split_gap: float, most_seconds: float, enders: str) -> DataFrame:
    """keys, seg, start, end, text: words grouped into segments. A segment ends at a sentence-ending mark or before a gap
    above ``split_gap``; one longer than ``most_seconds`` is cut into equal stretches of time."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    ends_here = F.rlike(F.lag(text).over(w), F.lit(f"[{enders}]$"))
    far = F.col(start) - F.lag(end).over(w) > split_gap
    cut = F.when(F.coalesce(ends_here, F.lit(True)) | F.coalesce(far, F.lit(True)), 1).otherwise(0)
    marked = words.withColumn("__c", cut).withColumn("__seg", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy(*keys, "__seg")
    first = F.min(start).over(span)
    part = F.floor((F.col(start) - first) / F.lit(most_seconds))
    parts = marked.withColumn("__part", part)
    return (
        parts.groupBy(*keys, "__seg", "__part")
        .agg(F.min(start).alias("start"), F.max(end).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(start), F.col(end), F.col(text)))), lambda x: x[text]), "").alias("text"))
        .drop("__seg", "__part")
    )


def assign_speakers(words: DataFrame, turns: DataFrame, keys: Sequence[str], bucket_seconds: float = 10.0) -> DataFrame:
    """``words`` (keys, word_id, ws, we) with the speaker of the turn (keys, speaker, ts, te) they overlap most; ties go to
    the smaller name, no overlap gives null.

    Times are cut into buckets, 256 of which are a bucket of the next level. A stretch belongs to the first level at which it
    touches at most two buckets, and is listed there and on the levels above, so it makes at most two rows a level, however
    long it is; a word and a turn meet on the higher of their levels, in an equi-join."""
    levels = 6

    def buckets(df, a, b):
        first, last = F.floor(F.col(a) / bucket_seconds).cast("bigint"), F.floor(F.col(b) / bucket_seconds).cast("bigint")
        rows, own = [], F.lit(levels - 1)
        for level in reversed(range(levels)):
            own = F.when(F.shiftright(last, 8 * level) - F.shiftright(first, 8 * level) <= 1, F.lit(level)).otherwise(own)
        for level in range(levels):
            lo, hi = F.shiftright(first, 8 * level), F.shiftright(last, 8 * level)
            rows += [F.when(own <= level, F.struct(F.lit(level).alias("__l"), lo.alias("__b"), own.alias("own"))), F.when((own <= level) & (hi > lo), F.struct(F.lit(level).alias("__l"), hi.alias("__b"), own.alias("own")))]
        listed = df.select("*", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("__r"))
        return listed.select(*df.columns, "__r.__l", "__r.__b", F.col("__r.own").alias(f"__own_{a}"))

    t = buckets(turns.where("te > ts").select(*keys, "speaker", "ts", "te").distinct(), "ts", "te")
    met = buckets(words, "ws", "we").join(t, [*keys, "__l", "__b"]).where("ts < we AND te > ws AND __l = greatest(__own_ws, __own_ts)")
    pairs = met.drop("__l", "__b", "__own_ws", "__own_ts").distinct()
    best = pairs.groupBy(*keys, "word_id", "speaker").agg(F.sum(F.least("we", "te") - F.greatest("ws", "ts")).alias("o"))
    best = best.groupBy(*keys, "word_id").agg(F.min_by("speaker", F.struct(-F.col("o"), "speaker")).alias("speaker"))
    return words.join(best, [*keys, "word_id"], "left")
