"""Filling fixed-capacity containers by linear grouping.

Large items are sorted by size and put into groups of equal cardinality; each group's sizes are rounded up to its largest.
The few rounded sizes are packed as configurations (multisets of groups that fit a bin) on the driver: its input is a
histogram with at most ``capacity`` sizes, never the items. Items are then substituted for the slots of their group by rank,
which only frees space; small items fill the true remainders best-fit in bounded shards. An item larger than the capacity is
split into full containers and a rest, no other is ever split.

Defined results: null sizes count as 0; items of size 0 are packed like small ones; an empty table gives an empty table;
every item comes out once (a split one once for each part).
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kikitori.operators.prefix import bucket_count, hash_bucket, prefix_sum
from kikitori.session import cut

GROUPS = 64
SMALL_SHARE = 0.125  # items up to this share of the capacity are small
SHARD_ITEMS = 20_000  # bins and small items of one best-fit task


def linear_groups(histogram: dict[int, int], groups: int = GROUPS) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, items) of groups of about equal cardinality, largest first. Equal sizes stay together; a
    size that fills a group by itself is one, so that it isn't rounded up at all. At most twice ``groups`` come out."""
    total, out = sum(histogram.values()), []
    high, low, items = None, 0, 0
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        if n * groups >= total:
            if high is not None:
                out.append((low, high, items))
            out.append((size, size, n))
            high, items = None, 0
            continue
        high, low, items = (size if high is None else high), size, items + n
        if items * groups >= total:
            out.append((low, high, items))
            high, items = None, 0
    if high is not None:
        out.append((low, high, items))
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {group: slots}): each configuration holds the largest size left and is the fullest one that the items left
    allow (bounded subset sum); it is used until a group in it runs short. Sizes are in falling order."""
    left, out = list(counts), []
    while any(left):
        top = next(g for g, n in enumerate(left) if n)
        room = capacity - sizes[top]
        reach = np.full(room + 1, -1, dtype=np.int32)  # group that first reached a total
        reach[0] = -2
        steps = [(g, k) for g in range(len(sizes)) if 0 < sizes[g] <= room for k in [min(left[g] - (g == top), room // sizes[g])] if k > 0]
        uses: dict[int, np.ndarray] = {}
        for g, most in steps:
            used = np.where(reach != -1, 0, most + 1)
            for t in range(sizes[g], room + 1):
                if reach[t] == -1 and used[t - sizes[g]] < most and reach[t - sizes[g]] != -1:
                    reach[t], used[t] = g, used[t - sizes[g]] + 1
            uses[g] = used
            if reach[room] != -1:
                break
        t = int(np.flatnonzero(reach != -1)[-1])
        slots = {top: 1}
        while t:
            g = int(reach[t])
            slots[g] = slots.get(g, 0) + 1
            t -= sizes[g]
        times = min(left[g] // k for g, k in slots.items())
        for g, k in slots.items():
            left[g] -= k * times
        out.append((times, slots))
    return out


def best_fit(rest: list[tuple[int, int]], items: list[tuple[int, int]], capacity: int, first_new: int) -> list[tuple[int, int]]:
    """(item, bin): items (key, size), largest first, go where the least space is left over; bins (rest, bin) and, where
    none fits, new ones numbered from ``first_new``."""
    free, out = sorted(rest), []
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        at = bisect_left(free, (size, -1))
        if at == len(free):
            room, where, first_new = capacity, first_new, first_new + 1
        else:
            room, where = free.pop(at)
        out.append((key, where))
        if room > size:
            insort(free, (room - size, where))
    return out


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """item, part_no, start_unit, end_unit, bin_id. ``items``: a unique bigint key and a size in units."""
    spark = items.sparkSession
    base = items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    whole = F.floor(F.col("size") / capacity).cast("int")
    ends = F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(0))), lambda i: F.struct(i.alias("part_no"), (i * F.lit(capacity)).cast("bigint").alias("start_unit"), F.least(F.col("size"), (i + 1) * F.lit(capacity)).cast("bigint").alias("end_unit")))
    parts = base.select("item", "size", F.inline(ends)).where("end_unit > start_unit OR size = 0")
    parts, _ = cut(parts.withColumn("size", F.col("end_unit") - F.col("start_unit")), "parts")
    small_most = int(capacity * SMALL_SHARE)
    # at most `capacity` rows, whatever the data
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    large_histogram = {s: n for s, n in histogram.items() if s > small_most}
    groups = linear_groups(large_histogram)
    plan = configurations([g[1] for g in groups], [g[2] for g in groups], capacity)
    slots: list[list[tuple[int, int, int]]] = [[] for _ in groups]  # of each group: (first rank, first bin, slots a bin)
    ranks, bins = [0] * len(groups), 0
    for times, config in plan:
        for g, k in config.items():
            slots[g].append((ranks[g], bins, k))
            ranks[g] += k * times
        bins += times
    lows = np.array([g[0] for g in groups][::-1] or [0])
    starts = [np.array([s[0] for s in x]) for x in slots]
    firsts = [np.array([s[1] for s in x]) for x in slots]
    every = [np.array([s[2] for s in x]) for x in slots]

    def group_of(part: pd.Series) -> np.ndarray:
        return len(lows) - np.searchsorted(lows, part.to_numpy(), side="right")

    @F.pandas_udf(LongType())
    def to_group(part: pd.Series) -> pd.Series:
        return pd.Series(group_of(part))

    @F.pandas_udf(LongType())
    def to_bin(group: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(group), dtype=np.int64)
        g_all, r_all = group.to_numpy(), rank.to_numpy()
        for g in np.unique(g_all):
            at = g_all == g
            r = r_all[at]
            p = np.searchsorted(starts[g], r, side="right") - 1
            out[at] = firsts[g][p] + (r - starts[g][p]) // every[g][p]
        return pd.Series(out)

    large = parts.where(F.col("size") > small_most).withColumns({"g": to_group("size"), "one": F.lit(1), "b": hash_bucket(F.col("item"), F.col("part_no"), buckets=bucket_count(sum(large_histogram.values())))})
    ranked = prefix_sum(large, ["g"], "b", ["item", "part_no"], "one", "rank")
    placed, _ = cut(ranked.select("item", "part_no", "start_unit", "end_unit", "size", to_bin("g", "rank").alias("bin_id")), "placed")

    # small items: best fit within shards of bounded size
    n_small = sum(n for s, n in histogram.items() if s <= small_most)
    shards = max(1, -(-(n_small + bins) // SHARD_ITEMS))
    rest = placed.groupBy("bin_id").agg((F.lit(capacity) - F.sum("size")).alias("room")).where("room > 0")
    small = parts.where(F.col("size") <= small_most)
    pool = rest.select(F.pmod(F.xxhash64("bin_id"), F.lit(shards)).cast("int").alias("shard"), F.col("bin_id").alias("key"), F.col("room").alias("size"), F.lit(True).alias("is_bin"), F.lit(0).alias("part_no"), F.lit(0).cast("bigint").alias("start_unit")).unionByName(
        small.select(F.pmod(F.xxhash64("item", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), F.col("item").alias("key"), "size", F.lit(False).alias("is_bin"), "part_no", "start_unit")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        free, docs = pdf[pdf.is_bin], pdf[~pdf.is_bin].reset_index(drop=True)
        order = docs.sort_values(["key", "part_no"]).reset_index(drop=True)
        got = best_fit(
            list(zip(free["size"].tolist(), free["key"].tolist())), list(enumerate(order["size"].tolist())), capacity, bins + int(pdf.shard.iloc[0]) * (SHARD_ITEMS * 64)
        )
        at = [i for i, _ in got]
        return pd.DataFrame({"item": order.key.to_numpy()[at], "part_no": order.part_no.to_numpy()[at], "start_unit": order.start_unit.to_numpy()[at], "end_unit": (order.start_unit + order["size"]).to_numpy()[at], "bin_id": [b for _, b in got]})

    fitted = pool.groupBy("shard").applyInPandas(fit, "item bigint, part_no int, start_unit bigint, end_unit bigint, bin_id bigint")
    return placed.select("item", "part_no", "start_unit", "end_unit", "bin_id").unionByName(fitted)
