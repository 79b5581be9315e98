"""Sequences as arrays: patches, padding, masks, layouts, norms, levels. Column expressions over higher-order functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """0..n-1; none for n = 0 (``sequence(0, -1)`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2_normalize(x: Column) -> Column:
    """Null for the zero vector and for vectors with NaN."""
    return let(norm(x), lambda n: F.when((n > 0) & ~F.isnan(n), F.transform(x, lambda v: v.cast("double") / n)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def patchify(x: Column, p: int) -> Column:
    """(T, D) to (T // p, D * p); the tail is dropped."""
    return F.transform(indices(F.floor(F.size(x) / p).cast("int")), lambda i: F.flatten(F.slice(x, i * p + 1, F.lit(p))))


def unpatchify(x: Column, p: int, d: int) -> Column:
    return F.flatten(F.transform(x, lambda row: F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.slice(row, i * d + 1, F.lit(d)))))


def patch_mask(mask: Column, p: int) -> Column:
    return F.transform(indices(F.floor(F.size(mask) / p).cast("int")), lambda i: F.forall(F.slice(mask, i * p + 1, F.lit(p)), lambda m: m))


def pad_rows(x: Column, length: Column | int, filler: Column) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(x, F.array_repeat(filler, n)), F.lit(1), n)


def valid_mask(n: Column, length: Column | int) -> Column:
    m = F.lit(length) if isinstance(length, int) else length
    return F.transform(indices(m), lambda i: i < n)


def transpose(x: Column) -> Column:
    return F.transform(indices(F.size(x[0])), lambda j: F.transform(x, lambda row: F.get(row, j)))


def coerce_layout(x: Column, d: int) -> Column:
    """(T, D) as it is, where rows already have D entries; (D, T) transposed; else null."""
    return F.when(F.size(x[0]) == d, x).when(F.size(x) == d, transpose(x))


def mono_mix(channels: Column) -> Column:
    return F.transform(transpose(channels), mean)


def masked_mean(x: Column, mask: Column) -> Column:
    kept = F.zip_with(x, mask, lambda v, m: F.when(m, v.cast("double")).otherwise(0.0))
    return total(kept) / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def with_mean_token(x: Column, mask: Column) -> tuple[Column, Column]:
    return F.concat(F.array(masked_mean(x, mask)), x), F.concat(F.array(F.exists(mask, lambda m: m)), mask)


def safe_mask(x: Column, mask: Column) -> tuple[Column, Column]:
    """Where nothing is masked in: zeros, and the first position."""
    none = ~F.exists(mask, lambda m: m)
    return F.when(none, F.transform(x, lambda v: F.lit(0.0))).otherwise(x), F.when(none, F.transform(mask, lambda m, i: i == 0)).otherwise(mask)


def rms(x: Column) -> Column:
    return F.sqrt(F.when(F.size(x) > 0, dot(x, x) / F.size(x)))


def peak_limit(x: Column) -> Column:
    loud = lambda peak: (peak > 1) & ~F.isnan(peak) & (peak < float("inf"))
    return let(F.array_max(F.transform(x, F.abs)), lambda peak: F.when(loud(peak), F.transform(x, lambda v: v / peak)).otherwise(x))


def standardize(x: Column) -> Column:
    """(x - mean) / (sample deviation + 1e-8)."""
    squares = lambda m: total(F.transform(x, lambda v: (v - m) * (v - m)))
    deviation = lambda m: F.sqrt(F.when(F.size(x) > 1, squares(m) / (F.size(x) - 1)).otherwise(0.0))
    both = let(mean(x), lambda m: F.struct(m.alias("m"), deviation(m).alias("sd")))
    return let(both, lambda b: F.transform(x, lambda v: (v - b["m"]) / (b["sd"] + 1e-8)))


def minmax_scale(x: Column) -> Column:
    ends = F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"))
    return let(ends, lambda e: F.transform(x, lambda v: F.when(e["hi"] - e["lo"] < 1e-10, 0.0).otherwise((v - e["lo"]) / (e["hi"] - e["lo"]))))


def db_scale(power: Column, top_db: float = 80.0) -> Column:
    levels = F.transform(power, lambda v: 10 * F.log10(F.greatest(v, F.lit(1e-10))))
    return let(levels, lambda db: let(F.array_max(db) - top_db, lambda floor: F.transform(db, lambda v: F.greatest(v, floor))))


def band_means(mel: Column, bands: int) -> Column:
    """Rows of a (mels, ...) column vector averaged in bands of mels // bands; the last band takes the rest."""
    per = F.floor(F.size(mel) / bands).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: mean(F.slice(mel, i * per + 1, F.when(i < bands - 1, per).otherwise(F.size(mel) - i * per))))


def lut_map(v: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear, cut to whole numbers, over 256 steps of 0..1."""
    x = F.floor(F.least(F.greatest(v * 255, F.lit(0.0)), F.lit(255.0))) / 255.0
    out = F.lit(None).cast("int")
    for (a, ya), (b, yb) in reversed(list(zip(points, points[1:]))):
        out = F.when((x >= a) & (x <= b), F.expr(f"cast({ya} as int)") + ((x - a) / (b - a) * (yb - ya)).cast("int")).otherwise(out)
    return out


def speech_end(x: Column, rate: int, threshold_db: float = -45.0) -> Column:
    """End of the last 20 ms window, counted back from the end, louder than the threshold; the length if there is none."""
    win, n = max(1, int(0.02 * rate)), F.size(x)
    ends = F.transform(indices(F.ceil(n / win).cast("int")), lambda k: n - k * win)
    loud = F.filter(ends, lambda e: rms(F.slice(x, F.greatest(e - win, F.lit(0)) + 1, F.least(F.lit(win), e))) > 10 ** (threshold_db / 20))
    return F.coalesce(F.get(loud, F.lit(0)), n)


def tail_fade_pad(x: Column, rate: int, fade_ms: float, pad_ms: float) -> Column:
    """Squared-cosine fade that ends where speech ends, cut there, then zeros."""
    fade_n, pad_n = int(fade_ms / 1000 * rate), int(pad_ms / 1000 * rate)

    def faded(end: Column) -> Column:
        start = F.greatest(end - fade_n, F.lit(0))
        curve = lambda i: F.pow(F.cos(F.lit(math.pi / 2) * (i - start) / F.greatest(end - start - 1, F.lit(1))), 2)
        return F.transform(F.slice(x, F.lit(1), end), lambda v, i: F.when(i < start, v).otherwise(v * curve(i)))

    body = F.when(F.size(x) > fade_n, let(speech_end(x, rate), faded)).otherwise(x) if fade_n > 0 else x
    return F.concat(body, F.array_repeat(F.lit(0.0), pad_n)) if pad_n > 0 else body


def flattening_point(rows: Column, window: int = 20, std_below: float = 0.05, mean_below: float = 0.1) -> Column:
    """First row from which ``window`` rows (zeros past the end) are flat and near zero; the length if there is none. Sums of
    rows are running sums, so a window is two look-ups."""
    n, d = F.size(rows), F.size(rows[0])
    sums = F.transform(rows, lambda r: F.struct(total(F.transform(r, lambda v: v.cast("double"))).alias("s"), dot(r, r).alias("q")))
    run = F.aggregate(
        sums,
        F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))),
        lambda acc, v: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["s"] + v["s"]).alias("s"), (F.element_at(acc, -1)["q"] + v["q"]).alias("q")))),
    )
    k = F.lit(float(window)) * d

    def flat(acc: Column) -> Column:
        def test(i: Column) -> Column:
            a, b = F.get(acc, i), F.get(acc, F.least(i + window, n))
            m = (b["s"] - a["s"]) / k
            var = F.greatest((b["q"] - a["q"]) / k - m * m, F.lit(0.0))
            return (F.sqrt(var) < std_below) & (F.abs(m) < mean_below)

        return F.get(F.filter(indices(n), test), F.lit(0))

    # the running sums are one value bound by a one-element transform, not repeated in every test
    return F.coalesce(F.get(F.transform(F.array(run), flat), F.lit(0)), n)


def ema_peak_hold(x: Column, alpha: float = 0.35, gravity: float = 0.15, height: float = 100.0) -> Column:
    """Smoothed levels and falling peaks, folded in order: array of (level, peak)."""
    zero = F.struct(F.array().cast("array<struct<level:double,peak:double>>").alias("out"), *[F.lit(0.0).alias(c) for c in ("level", "peak", "fall")])

    def step(acc: Column, v: Column) -> Column:
        level = alpha * v + (1 - alpha) * acc["level"]
        h = F.floor(level * height).cast("double")
        fall = F.when(h > acc["peak"], 0.0).otherwise(acc["fall"] + gravity)
        peak = F.when(h > acc["peak"], h).otherwise(F.greatest(F.lit(0.0), acc["peak"] - (acc["fall"] + gravity)))
        return F.struct(F.concat(acc["out"], F.array(F.struct(level.alias("level"), peak.alias("peak")))).alias("out"), level.alias("level"), peak.alias("peak"), fall.alias("fall"))

    return F.aggregate(x, zero, step, lambda acc: acc["out"])


def token_sum_duration(logits: Column, mask: Column) -> Column:
    soft = F.transform(logits, lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))))
    return F.log1p(F.greatest(total(F.zip_with(soft, mask, lambda v, m: F.when(m, v).otherwise(0.0))), F.lit(0.0)))


def pad_batches(df: DataFrame, batch: str, x: str) -> DataFrame:
    """``df`` with ``padded`` (``x`` and zeros up to the longest of its batch) and ``mask`` (true where ``x`` reaches): what a
    collate step hands to a model. Null arrays are empty; batches are reduced to their longest row before the join."""
    longest = df.groupBy(batch).agg(F.max(F.size(F.coalesce(F.col(x), F.array().cast("array<double>")))).alias("__most"))
    own = F.coalesce(F.col(x), F.array().cast("array<double>"))
    most = F.greatest("__most", F.lit(0))
    out = df.join(longest.withColumnRenamed(batch, "__batch"), F.col(batch).eqNullSafe(F.col("__batch")))
    padded = F.concat(own, F.array_repeat(F.lit(0.0), most - F.size(own)))
    return out.withColumns({"padded": padded, "mask": F.concat(F.array_repeat(F.lit(True), F.size(own)), F.array_repeat(F.lit(False), most - F.size(own)))}).drop("__batch", "__most")
