"""Continuous periods and gaps per entity, by compressed run bitmaps.

Time is cut into exact units (milliseconds) and time shards of ``2**SHARD_BITS`` units. Each interval becomes run
containers: a run (lo, hi) stands for the set bits lo..hi-1 of a shard's bitmap. An interval sets bits in the shards where it
begins and ends; the whole shards between them are a run in a coarser bitmap, whose bits are shards, and so on for four
levels. So an interval makes at most seven runs, however long it is. The bitmaps of one entity and shard are united; their
set runs are the covered stretches and their clear runs the gaps.

Stitching across shard edges goes over blocks of shards: each block's state (first and last set bit, the run open at its
end) is one row, only these rows of an entity meet in one window, and what they carry is joined back to the blocks.

Bounds: before runs of a shard are gathered they are reduced, map-side too, to one run per start (the longest), so a
gathered shard holds at most ``2**SHARD_BITS`` runs however often an interval is repeated; an entity holding a third of
all segments is spread over its shards and blocks. The union is one pass over sorted runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kikitori.session import cut

SHARD_BITS = 16
LEVELS = 4
BLOCK_BITS = 23  # units of a block of shards: about 2.3 hours


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, half up; NaN and infinities become null."""
    bad = seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) > F.lit(9e15))
    return F.when(~bad, F.round(seconds * 1000).cast("bigint"))


def _runs_of(start: Column, end: Column) -> Column:
    """The runs of an interval: array of (level, shard, lo, hi), at most two a level; null entries where there are none."""
    size, out = F.lit(1 << SHARD_BITS), []
    kind = "struct<level:int,shard:bigint,lo:int,hi:int>"

    def run(level, shard, lo, hi):
        return F.struct(F.lit(level).alias("level"), shard.alias("shard"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")).cast(kind)

    s, e, there = start, end, F.lit(True)
    for level in range(LEVELS):
        first, last = F.shiftright(s, SHARD_BITS), F.shiftright(e - 1, SHARD_BITS)
        in_one = first == last
        edge = F.shiftleft(first, SHARD_BITS)
        out.append(F.when(there, run(level, first, s - edge, F.when(in_one, e - edge).otherwise(size))))
        out.append(F.when(there & ~in_one, run(level, last, F.lit(0), e - F.shiftleft(last, SHARD_BITS))))
        s, e, there = first + 1, last, there & (last > first + 1)
    return F.filter(F.array(*out), lambda r: r.isNotNull())


def run_bitmaps(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """Entity, level, shard, runs: the united run bitmap of each entity and shard; a bit of level l stands for
    ``2**(l * SHARD_BITS)`` units. Bounds are bigint units; rows with a null entity column, a null bound or an end not after
    the start are left out. Negative times are fine."""
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start))
    for k in entity:
        ok = ok & F.col(k).isNotNull()
    base = df.where(ok).select(*entity, F.col(start).alias("__s"), F.col(end).alias("__e"))
    near = F.shiftright("__s", SHARD_BITS) == F.shiftright(F.col("__e") - 1, SHARD_BITS)
    edge = F.shiftleft(F.shiftright("__s", SHARD_BITS), SHARD_BITS)
    one = F.array(
        F.struct(
            F.lit(0).alias("level"), F.shiftright("__s", SHARD_BITS).alias("shard"), (F.col("__s") - edge).cast("int").alias("lo"), (F.col("__e") - edge).cast("int").alias("hi")
        ).cast("struct<level:int,shard:bigint,lo:int,hi:int>")
    )
    runs = base.select(*entity, F.inline(F.when(near, one).otherwise(_runs_of(F.col("__s"), F.col("__e")))))
    shard = [*entity, "level", "shard"]
    longest = runs.groupBy(*shard, "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy(*shard).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reached = longest.withColumn("before", F.max("hi").over(before))
    opens = F.when(F.col("before").isNull() | (F.col("lo") > F.col("before")), F.struct("lo", "before"))
    packed = reached.groupBy(*shard).agg(F.sort_array(F.collect_list(opens)).alias("o"), F.max("hi").alias("top"))
    # a run ends where the bits set before the next one opens end
    united = F.transform("o", lambda x, i: F.struct(x["lo"].alias("lo"), F.coalesce(F.get(F.col("o"), i + 1)["before"], F.col("top")).alias("hi")))
    return packed.select(*shard, united.alias("runs"))


def _items(maps: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Entity, block, at, level, cover, upto, r: the set runs of each shard of level 0 in units, and each run of a coarser
    level, which covers all up to ``cover``, as an item of its own. ``upto`` is where the item's shard or run ends."""
    run = "array<struct<s:bigint,e:bigint>>"
    edge = F.shiftleft("shard", SHARD_BITS)

    def at(level: int, x: Column) -> Column:
        return F.shiftleft(edge + x, level * SHARD_BITS)

    fine = F.array(
        F.struct(
            edge.alias("at"),
            F.lit(None).cast("bigint").alias("cover"),
            (edge + F.lit(1 << SHARD_BITS)).alias("upto"),
            F.transform("runs", lambda r: F.struct((edge + r["lo"]).alias("s"), (edge + r["hi"]).alias("e"))).cast(run).alias("r"),
        )
    )

    def coarse(level: int) -> Column:
        return F.transform(
            "runs",
            lambda r: F.struct(
                at(level, r["lo"]).alias("at"),
                at(level, r["hi"]).alias("cover"),
                at(level, r["hi"]).alias("upto"),
                F.array(F.struct(at(level, r["lo"]).alias("s"), at(level, r["hi"]).alias("e"))).cast(run).alias("r"),
            ),
        )

    kind = "array<struct<at:bigint,cover:bigint,upto:bigint,r:array<struct<s:bigint,e:bigint>>>>"
    chosen = F.when(F.col("level") == 0, fine.cast(kind))
    for level in range(1, LEVELS):
        chosen = chosen.when(F.col("level") == level, coarse(level).cast(kind))
    return maps.select(*entity, "level", F.inline(chosen)).withColumn("block", F.shiftright("at", BLOCK_BITS))


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """Entity, kind (``period`` or ``gap``), start, end (bigint units): the set runs of an entity's bitmap, touching ones
    joined, and the clear runs between two successive set runs. Before the first and after the last there is no gap. An
    empty table, or an entity without a valid interval, gives no rows. Repeated rows make no difference."""
    entity = list(entity)
    keys = [*entity, "block"]
    # written once: windows and summaries below all read it
    items, _ = cut(_items(run_bitmaps(df, entity, start, end), entity), "run-items")
    own = Window.partitionBy(*keys).orderBy("at", F.desc("level"))
    of_entity = Window.partitionBy(*entity).orderBy("block")

    def carry(states: DataFrame, columns: dict[str, Column], values: dict[str, Column], then: dict[str, Column] | None = None) -> DataFrame:
        """``states`` with values made of its blocks' summaries: one row a block, windows over those of an entity. What
        ``then`` makes is made of the values, which it reads under names with ``__``."""
        summary = states.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])
        summary = summary.select(*keys, *[c.alias(f"__{n}") for n, c in values.items()])
        summary = summary.withColumns({n: (then or {}).get(n, F.col(f"__{n}")) for n in values})
        summary = summary.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *values)
        return states.join(summary, [F.col(k) == F.col(f"__k_{k}") for k in keys]).drop(*[f"__k_{k}" for k in keys])

    blocks_before = Window.partitionBy(*entity).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # what a coarser run covers is dropped
    covered = F.max("cover").over(own.rowsBetween(Window.unboundedPreceding, -1))
    items = carry(items, {"cover_b": F.max("cover")}, {"cover_before": F.max("cover_b").over(blocks_before)})
    open_items = items.withColumn("covered", covered)
    open_items = open_items.where(F.coalesce(F.greatest("covered", "cover_before") < F.col("upto"), F.lit(True)))
    states = open_items.select(
        *keys, "at", "level", "r", F.col("r")[0]["s"].alias("first_s"), F.element_at("r", -1)["s"].alias("last_s"), F.element_at("r", -1)["e"].alias("last_e")
    )
    order = F.struct("at", -F.col("level"))
    states = states.withColumn("prev_e", F.lag("last_e").over(own))
    # start of the set run that is open at an item's right edge, where it begins in the item; of a block's first item this
    # depends on the block before, unless it holds several runs
    opens = F.when((F.size("r") > 1) | (F.col("prev_e") < F.col("first_s")), F.col("last_s"))
    states = states.withColumn("open_s", opens)
    after = F.lag("b_last").over(of_entity)
    b_open = F.coalesce("b_open", F.when(F.coalesce(after < F.col("b_first"), F.lit(True)), F.col("b_first_last")))
    states = carry(
        states,
        {
            "b_first": F.min_by("first_s", order),
            "b_first_last": F.min_by("last_s", order),
            "b_last": F.max_by("last_e", order),
            "b_open": F.max_by("open_s", F.when(F.col("open_s").isNotNull(), order)),
        },
        {"b_prev_e": after, "b_next_s": F.lead("b_first").over(of_entity), "b_carried": b_open},
        {"b_carried": F.last("__b_carried", ignorenulls=True).over(blocks_before)},
    )
    first_opens = F.coalesce(F.col("b_prev_e") < F.col("first_s"), F.lit(True))
    states = states.withColumns(
        {
            "open_s": F.coalesce("open_s", F.when(F.col("prev_e").isNull() & first_opens, F.col("last_s"))),
            "prev_e": F.coalesce("prev_e", "b_prev_e"),
            "next_s": F.coalesce(F.lead("first_s").over(own), "b_next_s"),
        }
    )
    in_block = F.last("open_s", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    states = states.withColumn("carried", F.when(F.col("prev_e") == F.col("first_s"), F.coalesce(in_block, "b_carried")))
    # a run that goes on in the next item is closed there
    goes_on = F.coalesce(F.col("last_e") == F.col("next_s"), F.lit(False))
    closed = F.when(goes_on, F.slice("r", 1, F.size("r") - 1)).otherwise(F.col("r"))
    periods = F.transform(
        closed,
        lambda x, i: F.struct(
            F.lit("period").alias("kind"),
            F.when((i == 0) & F.col("carried").isNotNull(), F.col("carried")).otherwise(x["s"]).alias("s"),
            x["e"].alias("e"),
        ),
    )
    inner = F.transform(
        F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))),
        lambda x, i: F.struct(F.lit("gap").alias("kind"), F.get(F.col("r"), i)["e"].alias("s"), x["s"].alias("e")),
    )
    before = F.when(
        F.col("prev_e") < F.col("first_s"),
        F.array(F.struct(F.lit("gap").alias("kind"), F.col("prev_e").alias("s"), F.col("first_s").alias("e"))),
    ).otherwise(F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>"))
    return states.select(*entity, F.inline(F.concat(periods, before, inner))).select(
        *entity, "kind", F.col("s").alias("start_ms"), F.col("e").alias("end_ms")
    )
