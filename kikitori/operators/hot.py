"""Joining rows to a table with one row per key, where a few keys may hold most rows.

Keys holding at least ``HOT_SHARE`` of the rows are at most ``1 / HOT_SHARE``, so the table's rows for them are broadcast and
their rows stay where they are; rows with a null key match nothing and aren't moved either; all other rows meet the table in
an ordinary shuffled join, where no key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys holding at least ``share`` of all rows: at most ``1 / share`` values, counted map-side first."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    # the largest 1 / share counts and the total, in one pass over the counts
    top = counts.orderBy(F.desc("__n")).limit(int(1 / share) + 1).collect()
    if len(top) <= 1 / share:
        total = sum(r["__n"] for r in top)
    else:
        total = counts.agg(F.sum("__n")).first()[0]
    return [r[key] for r in top if r[key] is not None and r["__n"] >= share * total]


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per ``key``; its other names must differ from those of ``rows``).

    ``how`` is ``inner`` or ``left``. Null keys match nothing. Repeated rows stay; an empty table gives no rows (``inner``)
    or nulls (``left``)."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot = hot_keys(rows, key, share)
    added = [c for c in table.columns if c != key]
    rest = rows.where(F.col(key).isNotNull())
    out = None
    if hot:
        kind = f"`{key}` {rows.schema[key].dataType.simpleString()}"
        few = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], kind))  # at most 1 / share rows
        out = rest.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
        rest = rest.join(few, key, "left_anti")
    # by name, so that a hint or statistics don't decide how the rest is joined
    cold = rest.join(table, key, how)
    out = cold if out is None else out.unionByName(cold)
    if how == "left":
        nulls = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in added])
        out = out.unionByName(nulls)
    return out.select(*rows.columns, *added)
