"""Schedules and flow arithmetic: learning rates, time steps, guidance, rescaling, clip durations, request checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lr_scale(step: Column, kind: str, most: int, warmup: int = 0, stable: int = 0, least: float = 0.0) -> Column:
    """Factor of the learning rate: linear warm-up, then cosine, or a stable stretch and then cosine (``wsd``)."""
    if kind not in ("cosine", "wsd"):
        raise ValueError(f"unknown schedule {kind}")
    least, most, hold = min(max(least, 0.0), 1.0), max(1, most), (stable if kind == "wsd" else 0)
    progress = F.least(F.greatest((step - warmup - hold) / float(max(1, most - warmup - hold)), F.lit(0.0)), F.lit(1.0))
    decayed = least + (1 - least) * 0.5 * (1 + F.cos(progress * math.pi))
    out = F.when(step < warmup + hold, 1.0).otherwise(decayed) if hold else decayed
    return F.when(step < warmup, (step + 1) / float(warmup)).otherwise(out) if warmup > 0 else out


def t_schedule(steps: int, sway: float | None = None) -> list[float]:
    """steps + 1 times falling from 0.999 to 0; sway bends them. Not strictly falling is an error."""
    us = [i / steps for i in range(steps + 1)]
    if sway is not None:
        us = [min(max(u + sway * (math.cos(0.5 * math.pi * u) + u - 1.0), 0.0), 1.0) for u in us]
    ts = [(1.0 - u) * 0.999 for u in us]
    if any(a <= b for a, b in zip(ts, ts[1:])):
        raise ValueError("the times must fall strictly; change the number of steps or the sway")
    return ts


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clamped_t(z: Column, low: float = 1e-3, high: float = 0.999) -> Column:
    return F.least(F.greatest(sigmoid(z), F.lit(low)), F.lit(high))


def keyed_uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from a digest of seed and key: the same whatever the partitioning."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def logit_normal_t(seed: int, key: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """Logit-normal draws, keyed: two uniform numbers of a key make a normal one."""
    normal = F.sqrt(-2 * F.ln(keyed_uniform(seed, key))) * F.cos(F.lit(2 * math.pi) * keyed_uniform(seed + 1, key))
    return clamped_t(normal * sigma + mu)


@F.pandas_udf(DoubleType())
def probit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    inverse = NormalDist().inv_cdf
    for part in parts:
        yield part.map(lambda u: None if pd.isna(u) else inverse(u))


def stratified_t(stratum: Column, noise: Column, count: int, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """One draw from each of ``count`` strata: stratum 0..count-1, noise in [0, 1)."""
    u = F.least(F.greatest((stratum + noise) / float(count), F.lit(1e-6)), F.lit(1 - 1e-6))
    return clamped_t(probit(u) * sigma + mu)


def interpolate(x0: Column, noise: Column, t: Column) -> Column:
    return F.zip_with(x0, noise, lambda a, z: (1 - t) * a + t * z)


def velocity(x0: Column, noise: Column) -> Column:
    return F.zip_with(x0, noise, lambda a, z: z - a)


def predicted_x0(xt: Column, v: Column, t: Column) -> Column:
    return F.zip_with(xt, v, lambda x, w: x - t * w)


def guided(cond: Column, uncond: dict[str, Column], scales: dict[str, float], mode: str, step: int, t: float, low: float, high: float) -> Column:
    """Guidance: each branch added (independent), one for all (joint), or one by turns (alternating); outside low..high, or
    without an enabled branch, the conditional output."""
    names = [n for n, s in scales.items() if s > 0]
    if not names or not low <= t <= high:
        return cond
    if mode == "joint":
        if max(scales[n] for n in names) - min(scales[n] for n in names) > 1e-6:
            raise ValueError("joint guidance needs equal scales")
        names = names[:1]
    elif mode == "alternating":
        names = [names[step % len(names)]]
    elif mode != "independent":
        raise ValueError(f"unknown guidance mode {mode}")
    out = cond
    for n in names:
        push = F.zip_with(cond, uncond[n], lambda c, u: c - u)
        out = F.zip_with(out, F.transform(push, _times(scales[n])), lambda a, b: a + b)
    return out


def _times(s: float):
    return lambda v: v * s


def euler(x: Column, steps: Column) -> Column:
    """x + sum of v * dt over an array of (v, dt)."""
    return F.aggregate(steps, x, lambda acc, s: acc + s["v"] * s["dt"])


def score_rescale(v: Column, x: Column, t: Column, k: float, sigma: float) -> Column:
    rest = 1 - t
    snr = rest * rest / (t * t) * sigma * sigma
    ratio = (snr + 1) / (snr / k + 1)
    return F.when(t >= 1, v).otherwise((ratio * (rest * v + x) - x) / rest)


def guidance_scales(mode: Column, text: Column, speaker: Column, caption: Column, shared: Column, use_speaker: Column, use_caption: Column) -> Column:
    """struct(text, speaker, caption, ok): one scale for all where ``shared`` is set, 0 for a disabled speaker; ``ok`` is
    false where joint mode has unequal enabled scales."""
    t, c = F.coalesce(shared, text), F.coalesce(shared, caption)
    s = F.when(use_speaker, F.coalesce(shared, speaker)).otherwise(0.0)
    on = F.filter(F.array(t, s, F.when(use_caption, c).otherwise(0.0)), lambda v: v > 0)
    ok = (F.lower(F.trim(mode)) != "joint") | (F.size(on) == 0) | (F.array_max(on) - F.array_min(on) <= 1e-6)
    return F.struct(t.alias("text"), s.alias("speaker"), c.alias("caption"), ok.alias("ok"))


def clip_frames(predicted: Column, scale: float, rate: int, hop: int, low: float, high: float) -> Column:
    """Predicted frames, scaled, rounded half to even, kept within the seconds allowed; 30 s where nothing is predicted."""
    least, most = max(1, math.ceil(low * rate / hop)), max(1, math.floor(high * rate / hop))
    n = F.coalesce(F.bround(predicted * scale).cast("bigint"), F.lit(int(30 * rate / hop)))
    return F.least(F.greatest(n, F.lit(least)), F.lit(most))
