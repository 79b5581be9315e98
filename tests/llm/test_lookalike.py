import itertools
import random
import re
import unicodedata

from pyspark.sql import functions as F

from kikitori.llm.lookalike import canonicalize, fold_table, lookalike_classes, lookalike_pairs, shared_forms, stored_values


def python_form(x):
    source, target = fold_table()
    table = {ord(a): (target[i] if i < len(target) else None) for i, a in enumerate(source)}
    return unicodedata.normalize("NFC", re.sub(" +", " ", x.translate(table).strip(" ")))


SAME = [
    ("ハルタ", "ﾊﾙﾀ", "八ルタ", "ハル夕", "ハ​ルタ", " ハルタ　", "ハルタ︀"),
    ("バス", "ﾊﾞｽ", "バス"),
    ("café", "café", "саfé", "ｃａｆé"),
    ("a b", "a  b", "a b"),
    ("", " ", "​"),
]
DIFFERENT = [("ハス", "バス"), ("ツ", "ッ"), ("a", "A"), ("ab", "a b"), ("は", "ハ"), ("カー", "カア"), ("1", "①")]


def frame(spark, values):
    return spark.createDataFrame([(v, "clash") for v in values], "text string, value string")


def test_pairs_of_look_alikes(spark):
    values = [v for group in SAME for v in group] + [v for pair in DIFFERENT for v in pair] + [None, "ハルタ"]
    got = {(r.value_a, r.value_b) for r in lookalike_pairs(stored_values(frame(spark, values), ["text"])).collect()}
    want = {tuple(sorted(p, key=lambda x: x.encode())) for group in SAME for p in itertools.combinations(group, 2)}
    want |= {tuple(sorted(p, key=lambda x: x.encode())) for p in itertools.combinations(sorted(set(values) - {None}), 2) if python_form(p[0]) == python_form(p[1])}
    assert got == want
    assert not {p for p in DIFFERENT} & got


def test_random_against_python(spark):
    rng = random.Random(7)
    alphabet = "タ夕カ力ﾊﾞバaаé́e ​　１1ッツ"
    values = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(400)})
    got = {(r.value_a, r.value_b) for r in lookalike_pairs(stored_values(frame(spark, values), ["text"])).collect()}
    forms = {}
    for v in values:
        forms.setdefault(python_form(v), []).append(v)
    want = {tuple(sorted(p, key=lambda x: x.encode())) for g in forms.values() for p in itertools.combinations(g, 2)}
    assert got == want


def test_canonical_member_arrays_and_empty(spark):
    df = spark.createDataFrame([(1, ["ﾊﾙﾀ", None, "ハルタ"]), (2, None), (3, [])], "id int, caption array<string>")
    c = lookalike_classes(stored_values(df, [], ["caption"])).collect()
    assert {(r.field_name, r.value, r.canonical) for r in c} == {("caption", "ﾊﾙﾀ", "ハルタ"), ("caption", "ハルタ", "ハルタ")}
    t = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(["ﾊﾙﾀ", "ハルタ", "x", None, "ﾊﾙﾀ"])] + [(None, "ﾊﾙﾀ", "kept")], "id int, text string, value string")
    got = canonicalize(t, "id", ["text"])
    assert got.columns == t.columns and sorted(str(r.text) for r in got.collect()) == ["None", "x", "ハルタ", "ハルタ", "ハルタ", "ﾊﾙﾀ"]
    assert lookalike_pairs(stored_values(t.where("false"), ["text"])).count() == 0


def test_long_text(spark):
    long = "あいうえおか" * 20_000
    got = lookalike_pairs(stored_values(frame(spark, [long, long.replace("か", "か⁠"), long[:-1]]), ["text"])).collect()
    assert len(got) == 1


def test_columns_of_the_same_name_dont_meet(spark):
    df = spark.createDataFrame([("ﾊ", "ハ")], "text string, speaker_id string")
    assert lookalike_pairs(stored_values(df, ["text", "speaker_id"])).count() == 0
    assert F is not None


def test_canonical_rows_of_manifest(spark, tmp_path):
    from kikitori.llm.queries import queries

    rows = [(1, "ﾊﾙﾀ", ["b", None, "ﾊﾙﾀ", "a", "ﾊﾙﾀ"], "ｃａｆé"), (2, "ハルタ", ["ハルタ"], "café"), (2, "ハルタ", ["ハルタ"], "café"), (3, None, None, None), (4, "x", [], "y"), (5, "ﾊﾙﾀ", ["ﾊﾙﾀ"], None)]
    spark.createDataFrame(rows, "row_id bigint, text string, caption array<string>, speaker_id string").write.parquet(f"{tmp_path}/manifest.parquet")
    got = sorted(((r.row_id, r.text, r.caption, r.speaker_id) for r in queries()["p5_canonical_manifest"](spark, str(tmp_path)).collect()), key=lambda r: r[0])
    want = [(1, "ハルタ", ["b", None, "ハルタ", "a", "ハルタ"], "café"), (2, "ハルタ", ["ハルタ"], "café"), (2, "ハルタ", ["ハルタ"], "café"), (3, None, None, None), (4, "x", [], "y"), (5, "ハルタ", ["ハルタ"], None)]
    assert got == want


def test_hangul_by_letters_and_syllables(spark):
    words = ["한국어", unicodedata.normalize("NFD", "한국어"), "나라", "학교", unicodedata.normalize("NFD", "학교"), "하교", "가", "각"]
    values = stored_values(frame(spark, words), ["text"])
    got = {(r.value_a, r.value_b) for r in lookalike_pairs(values).collect()}
    assert got == {tuple(sorted((w, unicodedata.normalize("NFD", w)), key=lambda x: x.encode())) for w in ("한국어", "학교")}
    # words of other initials never meet
    assert {r.value for r in shared_forms(values).collect()}.isdisjoint({"나라"})
    assert {r.n_members for r in lookalike_classes(values).collect()} == {2}
