"""All queries of the core, by name, and their SQL. Array columns come out element by element in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from kikitori.plans import array_queries, corpus, more_queries, segment_queries, source_queries, text_queries

MODULES = (corpus, text_queries, segment_queries, array_queries, source_queries, more_queries)
#: array columns by query: numbers, truth values, strings
NUMBERS = {
    "duration_features": ["features"],
    "set_has_speaker": ["features"],
    "l2_normalize": ["unit"],
    "patchify": ["first"],
    "unpatchify": ["x"],
    "pad_latents": ["padded"],
    "coerce_layout": ["first_row"],
    "mono_mix": ["mono"],
    "peak_limit": ["x"],
    "chunk_standardize": ["x"],
    "minmax_scale": ["x"],
    "db_scale": ["x"],
    "band_energies": ["bands"],
    "rf_flow": ["xt", "v", "x0"],
    "cfg_combine": ["independent", "alternating"],
    "trim_seconds": ["x"],
    "rf_interpolate": ["x"],
    "rf_velocity": ["x"],
    "rf_x0": ["x"],
}
FLAGS = {"patch_mask": ["m"]}
STRINGS = {"caption_candidates": ["candidates"], "manifest_rows": ["caption"]}


ARRAYS = {k: NUMBERS.get(k, []) + FLAGS.get(k, []) + STRINGS.get(k, []) for k in (*NUMBERS, *FLAGS, *STRINGS)}


def _by_element(name, run):
    """Array columns element by element: ``pos`` and one column of elements for each, so that their values and types are
    compared. An empty or null array is one row of nulls."""
    arrays = ARRAYS.get(name)
    if not arrays:
        return run

    def wrapped(spark, d):
        df = run(spark, d)
        zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c) for c in arrays])
        flat = df.select(*[c for c in df.columns if c not in arrays], F.posexplode_outer(zipped).alias("pos", "__z"))
        for c in arrays:
            v = F.col("__z")[c]
            # + 0.0 makes a negative zero plain
            flat = flat.withColumn(c, F.round(v.cast("double"), 9) + 0.0 if c in NUMBERS.get(name, []) else v)
        return flat.drop("__z")

    return wrapped


def _by_element_sql(name, sql):
    arrays = ARRAYS.get(name)
    if not arrays:
        return sql
    longest = "greatest(" + ", ".join(f"coalesce(len({c}), 0)" for c in arrays) + ")"
    parts = [f"unnest(CASE WHEN {longest} > 0 THEN CAST(range({longest}) AS INTEGER[]) ELSE [NULL::INTEGER] END) AS pos"]
    for c in arrays:
        value = f"list_transform({c}, lambda v: round(CAST(v AS DOUBLE), 9) + 0.0)" if c in NUMBERS.get(name, []) else c
        parts.append(f"unnest(CASE WHEN len({c}) > 0 THEN {value} ELSE [NULL] END) AS {c}")
    return f"SELECT * EXCLUDE ({', '.join(arrays)}), {', '.join(parts)} FROM ({sql.strip()})"


def queries():
    return {name: _by_element(name, run) for m in MODULES for name, run in m.queries().items()}


def oracle_sql():
    return {name: _by_element_sql(name, sql) for m in MODULES for name, sql in m.oracle_sql().items()}
