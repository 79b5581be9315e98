"""String functions: coercion, trimming, normalization, identifiers, counts, byte tokens.

All are JVM-side column expressions; Unicode compatibility forms and balanced brackets have no built-in, so those two share
one Arrow call, fed with nulls where a string needs neither.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: white space as Python's str.strip sees it
WHITE = "\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
# fixed values of the normalization rules
DELETED = "　;▼♀♂《》≪≫\ue63e①②③④⑤⑥˗‐‑‒–—―⁃−⎯⏤─━⸺⸻"
REPLACED = {"？": "?", "！": "!", "♥": "♡", "●": "○", "◯": "○", "〇": "○", "～": "ー", "〜": "ー"}
BRACKETS = {"「": "」", "『": "』", "（": "）", "【": "】", "(": ")"}
# fixed values: emojis that annotate a style of speaking
EMOJIS = (
    "⏩ ⏱️ ⏸️ 🌬️ 🍭 🎛️ 🎭 🎵 🐢 🐱 👂 👃 👅 👌 👏 💋 💥 💦 💪 📄 📞 📢 📣 😆 😊 😌 😎 😏 😒 😖 😟 😠 😪 😭 😮 😮‍💨 😰 😱 😲 😴 "
    "🙄 🙏 🤐 🤔 🤢 🤧 🤭 🥤 🥱 🥴 🥵 🥹 🥺 🫣 🫶 📖"
).split()
KANA = "[\\x{3040}-\\x{30FF}]"
KANJI = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}]"
ALNUM = "[A-Za-z0-9]"


def ustrip(c: Column) -> Column:
    """Strip Unicode white space from both ends; null stays null."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def coerce_text(c: Column, is_array: bool = False) -> Column:
    """Null to empty; an array's elements joined by a space, null elements written ``None``."""
    return F.coalesce(F.array_join(c, " ", "None") if is_array else c.cast("string"), F.lit(""))


def peel_brackets(text: str) -> str:
    """Remove bracket pairs as long as one pair encloses everything: its depth returns to 0 only at the end."""
    while len(text) > 1 and BRACKETS.get(text[0]) == text[-1]:
        opening, closing, depth = text[0], text[-1], 0
        first_close = next((i for i, ch in enumerate(text) if (depth := depth + (ch == opening) - (ch == closing)) == 0), -1)
        if first_close != len(text) - 1:
            break
        text = text[1:-1]
    return text


@F.pandas_udf(StringType())
def _peel_and_compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: None if x is None else unicodedata.normalize("NFKC", peel_brackets(x)))


@F.pandas_udf(StringType())
def _peel(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: None if x is None else peel_brackets(x))


@F.pandas_udf(StringType())
def _compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _only_where(call, needs: Column, c: Column) -> Column:
    """Rows that need no Python get their value without it: the call sees nulls there."""
    return F.coalesce(call(F.when(needs, c)), c)


def strip_outer_brackets(c: Column) -> Column:
    return _only_where(_peel, F.rlike(c, F.lit("^[「『（【(]")), c)


def nfkc(c: Column) -> Column:
    return _only_where(_compose, F.rlike(c, F.lit("[^\\x00-\\x7F]")), c)


def before_brackets(c: Column) -> Column:
    """Rules 1 to 5 of the normalization: deletions, replacements, long vowels, runs of ellipses."""
    x = F.replace(F.replace(F.translate(c, "\t", ""), F.lit("[n]"), F.lit("")), F.lit("\\[n\\]"), F.lit(""))
    keep = "".join(REPLACED)
    x = F.translate(x, keep + DELETED, "".join(REPLACED.values()))
    return F.regexp_replace(x, "…{3,}", "……")


def normalize_text(c: Column) -> Column:
    """The normalization rules in order: deletions and replacements, outer brackets, NFKC, dots to ellipses."""
    x = before_brackets(c)
    x = _only_where(_peel_and_compose, F.rlike(x, F.lit("[^\\x00-\\x7F]|^\\(")), x)
    return F.replace(F.replace(x, F.lit("..."), F.lit("…")), F.lit(".."), F.lit("…"))


def sanitize_id(c: Column, fallback: str = "") -> Column:
    """An identifier component: trimmed, NFKC, white space to ``_``, separators and other characters to ``-``, a digest
    where nothing is left or where it is longer than 96 characters; blank gives ``fallback``."""
    raw = ustrip(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(nfkc(raw), f"[{WHITE}]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "[:/\\\\]+", "-"), "[\\x00-\\x1f\\x7f]", "")
    s = F.regexp_replace(F.regexp_replace(s, "(?U)[^\\w.\\-]+", "-"), "-{2,}", "-")
    s = F.regexp_replace(s, "^[-_.]+|[-_.]+$", "")
    s = F.when(s == "", F.substring(F.sha1(raw), 1, 16)).otherwise(s)
    s = F.when(F.length(s) > 96, F.concat(F.substring(s, 1, 80), F.lit("-"), F.substring(F.sha1(s), 1, 10))).otherwise(s)
    return F.when(raw == "", F.lit(fallback)).otherwise(s)


def speaker_id(namespace: str, *columns: Column) -> Column:
    """``namespace:a__b`` from the non-blank components; all blank gives null."""
    parts = F.filter(F.array(*[sanitize_id(c) for c in columns]), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit(namespace + ":"), F.array_join(parts, "__")))


def index_name(key: str, default: str = "caption") -> str:
    """File suffix of an index: the default key has none of its own."""
    return ".index" if key == default else ".index." + "".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in key)


def adapter_name(path: Column) -> Column:
    return F.concat(F.lit("runtime_"), F.substring(F.sha1(path), 1, 16))


def emoji_pattern() -> str:
    return "|".join(sorted(EMOJIS, key=len, reverse=True))


def count_of(c: Column, *marks: str) -> Column:
    """Occurrences of single characters."""
    return F.length(c) - F.length(F.translate(c, "".join(marks), ""))


def log1p_cap(c: Column, cap: float) -> Column:
    return F.log1p(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(float(cap)))) / F.log1p(F.lit(float(cap)))


def duration_features(text: Column, tokens: Column, most_tokens: int, has_speaker: Column) -> Column:
    """The 14 numbers a duration model reads from a text."""
    if most_tokens <= 0:
        raise ValueError("the token limit must be positive")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    t = tokens.cast("double")
    return F.array(
        F.least(F.greatest(t, F.lit(0.0)), F.lit(float(most_tokens))) / F.lit(float(most_tokens)),
        log1p_cap(n, 512),
        t / n,
        log1p_cap(count_of(text, "。", "."), 8),
        log1p_cap(count_of(text, "、", ","), 16),
        log1p_cap(count_of(text, "ー"), 8),
        log1p_cap(count_of(text, "…"), 8),
        log1p_cap(count_of(text, "！", "!"), 8),
        log1p_cap(count_of(text, "？", "?"), 8),
        log1p_cap(F.regexp_count(text, F.lit(emoji_pattern())), 8),
        F.regexp_count(text, F.lit(KANA)) / n,
        F.regexp_count(text, F.lit(KANJI)) / n,
        F.regexp_count(text, F.lit(ALNUM)) / n,
        F.when(has_speaker, 1.0).otherwise(0.0),
    )


def set_has_speaker(features: Column, has_speaker: Column) -> Column:
    return F.concat(F.slice(features, 1, F.size(features) - 1), F.array(F.when(has_speaker, 1.0).otherwise(0.0)))


def byte_tokens(text: Column, vocabulary: int = 256) -> Column:
    """UTF-8 bytes as ids, the start id first (0 for 256 ids, else the last one)."""
    if vocabulary < 256:
        raise ValueError("a byte vocabulary has at least 256 ids")
    n = F.octet_length(text)
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    ids = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))
    start = F.array(F.lit(0 if vocabulary == 256 else vocabulary - 1))
    return F.when(n > 0, F.concat(start, ids)).otherwise(start)


def pad_truncate(ids: Column, length: int, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def pad_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(length) - n))


def caption_candidates(captions: Column) -> Column:
    """Trimmed non-empty captions; null gives none."""
    return F.coalesce(F.filter(F.transform(captions, ustrip), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def keyed_number(seed: int, key: Column, modulus: Column) -> Column:
    """A number in 0..modulus-1 from md5 of seed and key: the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), modulus)


def keyed_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?$"


def parse_optional_float(c: Column) -> Column:
    """A finite number; the words for none, and what is no finite number, are null."""
    s = F.lower(ustrip(c))
    v = F.expr("cast(null as double)")
    digits = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
    plain = F.translate(s, "".join(digits), "".join(str(unicodedata.digit(c)) for c in digits))
    # the cast alone also takes suffixes of types, as in 1d and 2f, but no underscore between digits
    number = F.when(F.rlike(plain, F.lit(NUMBER)), F.replace(plain, F.lit("_"), F.lit(""))).try_cast("double")
    return F.when(s.isin("none", "null", "off", "disable", "disabled") | F.isnan(number) | (F.abs(number) == float("inf")), v).otherwise(number)


def f0_bucket(hz: Column) -> Column:
    return F.when(hz.isNull() | F.isnan(hz), "").when(hz >= 165, "high").when(hz >= 85, "mid").otherwise("low")
