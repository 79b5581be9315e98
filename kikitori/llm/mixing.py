"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / weight with u from a hash of its id, so sorting a source by key is weighted sampling
without replacement. A source's token budget is its share of the total; it is met by complete epochs over all its documents,
then by a fractional selection: the prefix, in key order, whose tokens fill what is left. Running sums are taken over
ranges of (source, key) of about equally many documents, so a source holding a third of all rows is spread over many tasks,
whatever its weights.

Defined results: sources without target take no part; null and non-positive weights count as the least weight; documents
without tokens are drawn in complete epochs only; the reached share of a source without documents is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kikitori.operators.prefix import prefix_sum, range_buckets
from kikitori.session import cut

LEAST_WEIGHT = 0.05


def uniform(seed: int, *ids: Column) -> Column:
    """A number in (0, 1) from a hash of the id."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def sampling_key(seed: int, doc_id: Column, weight: Column) -> Column:
    w = F.when(weight.isNull() | F.isnan(weight) | (weight < LEAST_WEIGHT), F.lit(LEAST_WEIGHT)).otherwise(weight)
    return -F.log(uniform(seed, doc_id)) / w


def letter_share(text: Column) -> Column:
    """A plain quality weight: letters and digits among the characters."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", "")) / n)


def draw_mix(documents: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats (at least 1, at most the source's ``max_repeats``).

    ``documents``: doc_id, source, n_tokens, weight; ``targets``: source, target_share, max_repeats. Without
    ``total_tokens`` the mix is as large as the caps allow."""
    docs, _ = cut(documents.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), "weight"), "tokens")
    held = docs.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    budgets = targets.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    if total_tokens is None:
        most = budgets.where("target_share > 0 AND held > 0").agg(F.min(F.col("held") * F.col("max_repeats") / F.col("target_share"))).scalar()
    else:
        most = F.lit(float(total_tokens))
    budget = F.least(F.col("target_share") * most, (F.col("held") * F.col("max_repeats")).cast("double"))
    budgets = budgets.withColumn("budget", budget).select(
        "source",
        F.floor(F.col("budget") / F.greatest("held", F.lit(1)) + F.lit(1e-12)).cast("int").alias("epochs"),
        (F.col("budget") - F.floor(F.col("budget") / F.greatest("held", F.lit(1)) + F.lit(1e-12)) * F.col("held")).alias("open"),
        "max_repeats",
    )
    drawn = docs.join(budgets, "source").withColumn("key", sampling_key(seed, F.col("doc_id"), F.col("weight")))
    drawn = range_buckets(drawn, ["source", "key", "doc_id"], "bucket", docs.count())
    run = prefix_sum(drawn, ["source"], "bucket", ["key", "doc_id"], "n_tokens", "before")
    part = (F.col("n_tokens") > 0) & (F.col("before") + F.col("n_tokens") / 2 <= F.col("open")) & (F.col("epochs") < F.col("max_repeats"))
    return run.select("doc_id", "source", "n_tokens", (F.col("epochs") + part.cast("int")).alias("repeats")).where("repeats > 0")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, reached_share, n_tokens, n_docs, most_repeats for every target."""
    got = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats")
    )
    got, _ = cut(got, "mix-sums")
    total = got.agg(F.sum("n_tokens")).scalar()
    return targets.join(got, "source", "left").select(
        "source",
        "target_share",
        F.coalesce(F.col("n_tokens") / total, F.lit(0.0)).alias("reached_share"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_docs", "most_repeats")],
    )
