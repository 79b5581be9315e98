"""Per-key results without skew: eager aggregation through joins.

A plain ``left JOIN right ON key`` followed by GROUP BY makes ``n_left(key) * n_right(key)`` rows for each key, so a key
holding a third of the rows makes one task run for ever. Here both inputs are first aggregated by the join key (map-side
partial aggregation: a hot key is one row for each map task before any shuffle), only the compact states meet in the join,
and the joined states are combined algebraically:

    count(*) of the join      = n_left * n_right
    sum(left measure)         = sum_left * n_right
    sum(right measure)        = sum_right * n_left
    sum(left m * right m')    = sum_left(m) * sum_right(m')
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kikitori.session import cut


def compact_state(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], count_name: str) -> DataFrame:
    """One row per ``keys``: the number of rows and the sum of each measure (nulls add nothing)."""
    sums = [F.sum(F.coalesce(expr, F.lit(0))).alias(name) for name, expr in measures.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name), *sums)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    join_keys: Sequence[str],
    group_keys: Sequence[str],
    left_measures: Mapping[str, Column],
    right_measures: Mapping[str, Column],
    how: str = "inner",
    pairs_name: str = "joined_rows",
) -> DataFrame:
    """``SELECT group_keys, count(*), sum(l..), sum(r..) FROM left JOIN right USING (join_keys) GROUP BY group_keys``.

    ``group_keys`` are columns of ``left`` (they may be the join keys). ``how`` is ``inner`` or ``left``; with ``left``, a
    left row without partner counts once and has no right sums. Null join keys match nothing (SQL equality): ``inner``
    drops them, ``left`` keeps them. Empty inputs give an empty result. Other columns are not carried, so clashing names
    outside the keys do no harm. Result: group_keys, ``pairs_name``, one column per measure (sums over the joined rows),
    ``left_rows`` (left rows in the group that take part)."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    shared = set(left_measures) & set(right_measures)
    if shared:
        raise ValueError(f"measures of both sides need different names: {sorted(shared)}")
    lkeys = list(dict.fromkeys([*group_keys, *join_keys]))
    a = compact_state(left, lkeys, left_measures, "__nl")
    b = compact_state(right, list(join_keys), right_measures, "__nr")
    b = b.select(*[F.col(k).alias(f"__r_{k}") for k in join_keys], "__nr", *right_measures)
    on = [F.col(k) == F.col(f"__r_{k}") for k in join_keys]
    joined = a.join(b, on, how)
    # products of two counts outgrow bigint on hot keys
    n_left, n_right = F.col("__nl").cast("decimal(19,0)"), F.coalesce(F.col("__nr"), F.lit(1)).cast("decimal(19,0)")
    return joined.groupBy(*group_keys).agg(
        F.sum(n_left * n_right).alias(pairs_name),
        *[F.sum(_wide(a, m) * n_right).alias(m) for m in left_measures],
        *[F.sum(n_left * F.coalesce(_wide(b, m), F.lit(0))).alias(m) for m in right_measures],
        F.sum("__nl").alias("left_rows"),
    )


def _wide(df: DataFrame, name: str) -> Column:
    """Whole numbers as decimals, so that products are exact; doubles as they are."""
    return F.col(name) if df.schema[name].dataType.typeName() in ("double", "float") else F.col(name).cast("decimal(19,0)")


def join_states(left: DataFrame, right: DataFrame, keys: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """Two tables of compact states, one row per key each, joined by key (null keys are equal to each other here): every
    key of ``left`` with its state and that of ``right``, 0 where ``right`` has none."""
    b = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *right_columns)
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    rest = [c for c in left.columns if c not in right_columns]
    return left.select(*rest).join(b, on, "left").select(*rest, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in right_columns])


def heavy_keys(states: DataFrame, key: str, count_col: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of all rows. ``states``: one row per key with its row count, the null key among
    them, as it counts towards all rows. At most ``1 / share`` rows come out; the null key is no key and never does. The
    states are written once, so that total and keys come from one run of what makes them."""
    states, _ = cut(states, "states")
    total = states.agg(F.sum(count_col) * F.lit(share)).scalar()
    return states.where(F.col(key).isNotNull() & (F.col(count_col) >= total))
