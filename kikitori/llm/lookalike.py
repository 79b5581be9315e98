"""Visually identical text with different characters: classes, canonical members, pairs.

Values are mapped to a look-alike form by JVM-side string functions (width, radicals, look-alike letters, invisible
characters, white space) and then grouped under Spark's accent-sensitive ``UNICODE`` collation, to which canonically
equivalent compositions are equal while case, voicing marks and small kana are not. Comparing under a collation is dear, so
it is confined to values that share a coarse hash key (form without any marks) with some other value; the key is coarser
than the collation, so no pair is lost.

Defined results: nulls belong to no class; values that show nothing (empty, white space, invisible only) form one class;
repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kikitori.operators.hot import spread_join
from kikitori.session import cut

# fixed values: letters of other scripts that look like a Latin letter, and the letter
LATIN_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "ο": "o", "ν": "v", "α": "a", "ι": "i", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i",
}
# fixed values: ideographs and hiragana that look like a katakana sign
KANA_LOOKALIKES = {"夕": "タ", "力": "カ", "口": "ロ", "卜": "ト", "二": "ニ", "八": "ハ", "工": "エ", "才": "オ", "一": "ー", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ"}
# fixed values: marks of other width or code with the same look
MARK_LOOKALIKES = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "〜": "~", "゙": "゙"}
COLLATION = "UNICODE"


def _width(ch: str) -> str | None:
    """The ordinary form of a full-width, half-width or radical form, if it is one character."""
    d = unicodedata.decomposition(ch)
    if d.startswith(("<wide>", "<narrow>")) or (d.startswith("<compat>") and 0x2E80 <= ord(ch) <= 0x2FDF):
        form = unicodedata.normalize("NFKC", ch)
        return form if len(form) == 1 else None
    if d and not d.startswith("<") and " " not in d:  # canonical singletons: compatibility ideographs and the like
        return unicodedata.normalize("NFC", ch)
    return None


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """For ``translate``: characters, and what replaces them; those beyond the second string's length are deleted."""
    pairs: dict[str, str] = {}
    for cp in (*range(0x80, 0x3400), *range(0xF900, 0xFB00), *range(0xFE30, 0x10000), *range(0x2F800, 0x2FA20)):
        if 0xD800 <= cp < 0xE000:
            continue
        if (form := _width(ch := chr(cp))) and form != ch:
            pairs[ch] = form
    pairs["ﾞ"], pairs["ﾟ"] = "゙", "゚"
    pairs |= LATIN_LOOKALIKES | KANA_LOOKALIKES | {k: v for k, v in MARK_LOOKALIKES.items() if k != v}
    for ch in list(pairs):  # a look-alike may stand behind another width
        pairs[ch] = pairs.get(pairs[ch], pairs[ch])
    gone = []
    for cp in (*range(0, 0x3400), *range(0xFE00, 0x10000), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85":
            pairs[ch] = " "
        elif cat in ("Cc", "Cf") or 0xFE00 <= cp <= 0xFE0F or cp >= 0xE0000 or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0):
            gone.append(ch)
            pairs.pop(ch, None)
    pairs.pop(" ", None)
    return "".join(pairs) + "".join(gone), "".join(pairs.values())


@lru_cache(1)
def unmark_table() -> tuple[str, str]:
    """For ``translate``: composed characters to their first one, Hangul syllables to their initial letter; all combining marks
    and the letters of Hangul that aren't initials are deleted."""
    pairs, gone = {}, [chr(cp) for cp in (*range(0x1160, 0x1200), *range(0xD7B0, 0xD7FC))]
    for n in range(19 * 588):  # syllables in blocks by their initial letter
        pairs[chr(0xAC00 + n)] = chr(0x1100 + n // 588)
    for cp in (*range(0x80, 0xAC00), *range(0xF900, 0x10000)):
        ch = chr(cp)
        if 0x1160 <= cp < 0x1200 or 0xD7B0 <= cp < 0xD7FC or 0xAC00 <= cp < 0xD7A4:
            continue
        if unicodedata.category(ch) in ("Mn", "Mc", "Me"):
            gone.append(ch)
        elif (d := unicodedata.decomposition(ch)) and not d.startswith("<"):
            pairs[ch] = unicodedata.normalize("NFD", ch)[0]
    return "".join(pairs) + "".join(gone), "".join(pairs.values())


def fold(value: Column) -> Column:
    """The look-alike form, by built-in functions. Compositions stay as they are: equal ones are equal under COLLATION."""
    source, target = fold_table()
    x = F.trim(F.translate(value, source, target))
    return F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x)


def coarse_key(field: Column, form: Column) -> Column:
    """64 bits, equal for all forms equal under COLLATION: without marks, Hangul by its initial letters (a syllable and its
    letters are equal)."""
    source, target = unmark_table()
    return F.xxhash64(field, F.translate(form, source, target))


def compose(values):
    """NFC, for small distinct columns."""
    return values.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def stored_values(df: DataFrame, strings: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """field_name, value: one row per stored value of the string columns and per element of the array columns."""
    parts = [F.array(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value"))) for c in strings]
    kind = "array<struct<field_name:string,value:string>>"

    def elements(name: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(name).alias("field_name"), x.alias("value")))

    parts += [F.coalesce(elements(c), F.array().cast(kind)) for c in arrays]
    return df.select(F.inline(F.concat(*parts))).where(F.col("value").isNotNull())


def shared_forms(values: DataFrame) -> DataFrame:
    """field_name, value, form, k: the distinct values whose coarse key another value shares."""
    keyed = values.distinct().withColumn("form", fold(F.col("value")))
    keyed = keyed.withColumn("k", coarse_key(F.col("field_name"), F.col("form")))
    counted = keyed.selectExpr("*", "count(1) OVER (PARTITION BY k) AS __n")
    return counted.where("__n > 1").drop("__n")


def lookalike_classes(values: DataFrame) -> DataFrame:
    """field_name, value, canonical, n_members for every distinct value that has look-alikes. The canonical member is the one
    that is its own form already, and the smallest of several or of none. A class of n members has n - 1 links to it."""
    return values.sparkSession.sql(
        f"""
        SELECT field_name, value, canonical.value AS canonical, n_members FROM (
          SELECT field_name, value, count(1) OVER same AS n_members, min(struct(value <> form AS changed, value)) OVER same AS canonical
          FROM {{shared}} WINDOW same AS (PARTITION BY field_name, form COLLATE {COLLATION})
        ) WHERE n_members > 1
        """,
        shared=shared_forms(values),
    )


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """field_name, value_a, value_b: every pair of different values of one class, the smaller first."""
    c = lookalike_classes(values)
    a = c.select("field_name", "canonical", F.col("value").alias("value_a"))
    b = c.select("field_name", "canonical", F.col("value").alias("value_b"))
    return a.join(b, ["field_name", "canonical"]).where("value_a < value_b").select("field_name", "value_a", "value_b")


def _value_key(field: Column, value: Column) -> Column:
    return F.xxhash64(field, value)


def _elements(column: str, change: Callable[[str, Column], Column]) -> Column:
    """``change(column, element)`` of every element. (A function of two parameters would be given the position.)"""
    return F.transform(column, lambda x: change(column, x))


def canonicalize(df: DataFrame, key: str, columns: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """``df`` with each string column, and each element of the array columns, in one consistent form: values with look-alikes
    become their class's canonical member, all others stay.

    What is shuffled is narrow: ``key`` and a hash for each value, joined to the values that change (their rows are spread where
    a value is hot); the few rows with a change are then brought to ``df`` by ``key``, in one join. Hashes only find values:
    each is compared before it is replaced. Rows with a null key stay as they are; rows that share a key share their changes,
    which are by value, too."""
    values = stored_values(df, columns, arrays)
    changed = lookalike_classes(values).where("value <> canonical")
    entry = F.struct("field_name", "value", "canonical")
    changed = changed.groupBy(_value_key(F.col("field_name"), F.col("value")).alias("__h")).agg(F.collect_list(entry).alias("__entries"))
    changed, _ = cut(changed, "changed-values")
    parts = [F.array(_value_key(F.lit(c), F.col(c))) for c in columns]
    parts += [F.coalesce(_elements(c, lambda field, x: _value_key(F.lit(field), x)), F.array().cast("array<bigint>")) for c in arrays]
    hashes = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.explode(F.concat(*parts)).alias("__h"))
    met = spread_join(hashes, changed, "__h").select("__key", F.explode("__entries").alias("e"))
    # of a row: its changed values, each once
    of_row = met.groupBy("__key").agg(F.collect_set("e").alias("__changes"))

    def replaced(field: str, value: Column) -> Column:
        own = F.filter("__changes", lambda e: (e["field_name"] == field) & (e["value"] == value))
        return F.coalesce(F.get(own, F.lit(0))["canonical"], value)

    out = df.join(of_row, F.col(key) == F.col("__key"), "left")
    has = F.col("__changes").isNotNull()
    for c in columns:
        out = out.withColumn(c, F.when(has, replaced(c, F.col(c))).otherwise(F.col(c)))
    for c in arrays:
        out = out.withColumn(c, F.when(has, _elements(c, replaced)).otherwise(F.col(c)))
    return out.drop("__key", "__changes")
