import hashlib

import pytest
from pyspark.sql import functions as F

from kikitori.functions import text as T

NORMALIZED = [
    ("a\tb", "ab"),
    ("x[n]y", "xy"),
    ("x\\[n\\]y", "xy"),
    ("？！", "?!"),
    ("♥●◯〇", "♡○○○"),
    ("a;b", "ab"),
    ("a；b", "a;b"),
    ("①⑥⑦", "7"),
    ("a–b-c", "ab-c"),
    ("す〜", "すー"),
    ("す～", "すー"),
    ("……………", "……"),
    ("....", "….") ,
    ("「『あ』」", "あ"),
    ("「あ」「い」", "「あ」「い」"),
    (" 「あ」", " 「あ」"),
    ("ｱＡ１", "アA1"),
    ("", ""),
    (None, None),
]


def test_normalization(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NORMALIZED)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.normalize_text(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(NORMALIZED))] == [b for _, b in NORMALIZED]


def test_identifiers(spark):
    cases = [(None, "none"), ("  ", "none"), ("org/data:v1", "org-data-v1"), ("a  b", "a_b"), ("話者１", "話者1"), ("--x--", "x"), ("###", hashlib.sha1(b"###").hexdigest()[:16]), ("a" * 100, "a" * 80 + "-" + hashlib.sha1(b"a" * 100).hexdigest()[:10])]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.sanitize_id(F.col("t"), "none").alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
    row = df.limit(1).select(T.speaker_id("ns", F.lit("a b"), F.lit(None).cast("string"), F.lit("c")).alias("x"), T.speaker_id("ns", F.lit(" ")).alias("y")).first()
    assert (row.x, row.y) == ("ns:a_b__c", None)


def test_counts_features_tokens(spark):
    t = "あア漢𠮟aZ9。.、ー…！?😮‍💨⏩"
    df = spark.createDataFrame([(t,), ("",)], "t string")
    r = df.select(
        F.regexp_count("t", F.lit(T.KANA)).alias("kana"), F.regexp_count("t", F.lit(T.KANJI)).alias("kanji"), F.regexp_count("t", F.lit(T.ALNUM)).alias("alnum"),
        F.regexp_count("t", F.lit(T.emoji_pattern())).alias("emoji"), T.duration_features(F.col("t"), F.lit(10), 100, F.lit(True)).alias("f"), T.byte_tokens(F.col("t")).alias("b"),
    ).collect()
    assert (r[0].kana, r[0].kanji, r[0].alnum, r[0].emoji) == (3, 2, 3, 2)
    assert len(r[0].f) == 14 and r[0].f[0] == 0.1 and r[0].f[13] == 1.0
    assert r[0].b == [0, *t.encode()] and r[1].b == [0]
    assert r[1].f[2] == 10.0
    with pytest.raises(ValueError):
        T.duration_features(F.col("t"), F.lit(1), 0, F.lit(True))
    assert df.limit(1).select(T.pad_truncate(F.array(F.lit(1), F.lit(2)), 4), T.pad_mask(F.array(F.lit(1), F.lit(2)), 4)).first()[:] == ([1, 2, 0, 0], [True, True, False, False])


def test_captions_and_floats(spark):
    df = spark.createDataFrame([([" a ", None, "", "　"],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(T.caption_candidates(F.col("c"))).collect()] == [["a"], []]
    f = spark.createDataFrame([(" 1.5 ",), ("OFF",), ("nan",), ("inf",), ("x",), (None,)], "s string")
    assert [r[0] for r in f.select(T.parse_optional_float(F.col("s"))).collect()] == [1.5, None, None, None, None, None]
    hz = spark.createDataFrame([(165.0,), (85.0,), (84.9,), (float("nan"),), (None,)], "h double")
    assert [r[0] for r in hz.select(T.f0_bucket(F.col("h"))).collect()] == ["high", "mid", "low", "", ""]
    assert T.index_name("caption") == ".index" and T.index_name("my key") == ".index.my_key"


def test_floats_and_brackets_of_all_rows(spark, tmp_path):
    import math

    from kikitori.plans import text_queries

    def number(raw):
        s = (raw or "").strip().lower()
        try:
            v = float(s)
        except ValueError:
            return None
        return v if math.isfinite(v) else None

    pairs = {"「": "」", "『": "』", "（": "）", "【": "】", "(": ")"}

    def peeled(t):
        while t and len(t) > 1 and pairs.get(t[0]) == t[-1]:
            depth, ends = 0, []
            for i, ch in enumerate(t):
                depth += (ch == t[0]) - (ch == t[-1])
                ends += [i] if depth == 0 else []
            if not ends or ends[0] != len(t) - 1:
                break
            t = t[1:-1]
        return t

    ids = ["1.5", " 2 ", "1d", "2f", "1e3", "-.5", "5.", "１２", "1_000", "1__0", "nan", "inf", "none", "OFF", "SPK_01", "0x10", "1e999", "", None, "話者", "1 2"]
    texts = ["「全部」", "「甲」と「乙」", "「『中』」", "（（二重））", "「開く", "閉じる」", "(a)(b)", "【「x」】", "「」", "「", "", None, "plain", "「a（b」", "『「』」", "((a)", "「「a」", " 「a」", "a「b」", "（x)", "「改\n行」"]
    spark.createDataFrame([(i, *r) for i, r in enumerate(zip(ids, texts, strict=True))], "row_id int, speaker_id string, text string").write.parquet(f"{tmp_path}/manifest.parquet")
    q = text_queries.queries()
    assert [r.v for r in q["parse_optional_float"](spark, str(tmp_path)).orderBy("row_id").collect()] == [number(x) for x in ids]
    assert [r.peeled for r in q["strip_outer_brackets"](spark, str(tmp_path)).orderBy("row_id").collect()] == [peeled(t) for t in texts]
