"""Evaluation: losses, cohorts, weighted and moving means, throughput, retention of checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COHORTS = "speaker no_speaker caption no_caption speaker_caption speaker_no_caption no_speaker_caption no_speaker_no_caption".split()


def huber(error: Column, delta: float = 0.1) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))


def frames_error(predicted_log: Column, frames: Column) -> Column:
    return F.abs(F.greatest(F.expm1(predicted_log), F.lit(0.0)) - frames)


def cohort_metrics(rows: DataFrame, speaker: str, caption: str, loss: str, error: str) -> DataFrame:
    """cohort, loss, mae, n: the 8 overlapping cohorts by two flags from one grouping-sets pass, 0 for empty ones. A null
    flag belongs to no cohort that asks for it."""
    base = rows.select(F.col(speaker).alias("sp"), F.col(caption).alias("cap"), F.col(loss).alias("l"), F.col(error).alias("e"))
    g = base.groupingSets([["sp"], ["cap"], ["sp", "cap"]], "sp", "cap").agg(
        F.sum("l").alias("l"), F.sum("e").alias("e"), F.count(F.lit(1)).alias("n"), F.grouping("sp").alias("gs"), F.grouping("cap").alias("gc")
    )
    g = g.where("(gs = 1 OR sp IS NOT NULL) AND (gc = 1 OR cap IS NOT NULL)")
    part = lambda flag, grouped, name: F.when(F.col(grouped) == 1, F.lit(None)).when(F.col(flag), name).otherwise("no_" + name)
    g = g.withColumn("cohort", F.concat_ws("_", part("sp", "gs", "speaker"), part("cap", "gc", "caption")))
    names = rows.sparkSession.createDataFrame([(c,) for c in COHORTS], "cohort string")
    return names.join(g, "cohort", "left").select(
        "cohort", F.coalesce(F.col("l") / F.col("n"), F.lit(0.0)).alias("loss"), F.coalesce(F.col("e") / F.col("n"), F.lit(0.0)).alias("mae"), F.coalesce("n", F.lit(0)).alias("n")
    )


def weighted_mean(batches: DataFrame, value: str, size: str) -> DataFrame:
    return batches.agg((F.sum(F.col(value) * F.col(size)) / F.greatest(F.sum(size), F.lit(1))).alias("mean"), F.sum(size).alias("n"))


def moving_average(series: DataFrame, keys: list[str], step: str, value: str, last: int = 20) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(-(last - 1), 0)
    return series.withColumn("moving", F.avg(value).over(w))


def throughput(series: DataFrame, keys: list[str], step: str, seconds: str, batch: int, total_steps: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(step)
    dt = F.greatest(F.col(seconds) - F.lag(seconds).over(w), F.lit(1e-6))
    per_s = (F.col(step) - F.lag(step).over(w)) / dt
    return series.withColumns({"steps_per_s": per_s, "samples_per_s": per_s * batch, "percent": F.col(step) * 100.0 / total_steps})


def masked_mse(long: DataFrame, sample: str, sq: str, valid: str) -> DataFrame:
    """utterance: mean over samples of their masked mean (at least 1 valid); echo: sum of masked errors over positions by
    the share of valid ones (at least 1e-6). ``long``: one row per sample and position."""
    per = long.groupBy(sample).agg(F.sum(F.when(F.col(valid), F.col(sq)).otherwise(0.0)).alias("s"), F.count_if(F.col(valid)).alias("m"), F.count(F.lit(1)).alias("t"))
    return per.agg(
        F.avg(F.col("s") / F.greatest("m", F.lit(1))).alias("utterance"),
        ((F.sum("s") / F.sum("t")) / F.greatest(F.sum("m") / F.sum("t"), F.lit(1e-6))).alias("echo"),
    )


# fixed values: names of checkpoints
CHECKPOINT = r"^checkpoint_(\d+)(?:\.pt|\.speaker\.safetensors)?$"
BEST_CHECKPOINT = r"^checkpoint_best_val_loss_(\d+)_(-?\d+(?:\.\d+)?)(?:\.pt|\.speaker\.safetensors)?$"


def parse_checkpoint(name: Column) -> list[Column]:
    """kind (periodic, best), step, score; null for other names."""
    best, periodic = F.regexp_extract(name, BEST_CHECKPOINT, 1), F.regexp_extract(name, CHECKPOINT, 1)
    return [
        F.when(best != "", "best").when(periodic != "", "periodic").alias("kind"),
        F.when(best != "", best).when(periodic != "", periodic).cast("bigint").alias("step"),
        F.when(best != "", F.regexp_extract(name, BEST_CHECKPOINT, 2)).cast("double").alias("score"),
    ]


def best_n(df: DataFrame, score: str, step: str, n: int) -> DataFrame:
    """The n lowest (score, step), one for each step: a bounded top-k, no global sort."""
    one = df.groupBy(step).agg(F.min(score).alias(score))
    return one.orderBy(score, step).limit(n)


def latest_k(df: DataFrame, step: str, k: int) -> DataFrame:
    return df if k <= 0 else df.orderBy(F.desc(step)).limit(k)


def top_n_per(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """Spark turns this filter on row_number into a group limit before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
