import random

import pytest

from kikitori.llm.mojibake import batch_candidates, candidates, find_garbled, margin_table, restore, stretch_starts, train_model, training_text, validated_margin
from kikitori.llm.mojibake import DOUBLE, _UTF8, _single, text_features
from kikitori.llm.mojibake import BIGRAMS, UNIGRAMS, BigramModel, _codes, _hash1, _hash2
from kikitori.llm import mojibake

import numpy as np

SUBJECTS = "港の倉庫 図書室 古い映画館 灯台 音楽室 川沿いの駅 展望台 工房".split()
SENTENCES = ["{}の灯りまで録れそうだ。", "番組では{}からのお便りを待っています。", "次の角を右に曲がると、{}が見えてきます。", "「聞こえますか。こちらは{}、全員無事です。」", "『{}』という曲を今朝初めて歌いました。"]
LATIN = ["My café order was a déjà vu.", "C’est une scène légère, où l’élève chuchote.", "“Hold the score closer,” he said.", "Größe und Übung: die Stimme übt täglich.", "PÃO, MAÇÃ E LIMÃO: leia a lista."]
KEPT = ["ﾃｽﾄ収録ﾌｧｲﾙ､ﾏｲｸ2本｡", "├── latents\n└── wavs", "繧繝という色の技法について話す。", "糸が縺れるように話が縺れていく。", "Привет, говорит студия.", "ΔF0 ≈ 12 Hz、σ = 0.8", "音声合成⇄変換、±3 dB まで。", "Ångström と Ærø の読み分け。", "発音メモ: [ˈɸɯɾʲi]"]
CHAINS = [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp932"), ("utf-8", "gbk"), ("euc_jp", "latin-1"), ("euc_jp", "cp932"), ("cp932", "latin-1")]


def corpus(n, seed):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(SENTENCES).format(rng.choice(SUBJECTS)) if rng.random() < 0.8 else rng.choice(LATIN) for _ in range(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    c = _codes("\n".join(corpus(400, 1) + KEPT * 10))
    return BigramModel(np.bincount(_hash1(c), minlength=UNIGRAMS), np.bincount(_hash2(c), minlength=BIGRAMS))


@pytest.mark.parametrize("right,wrong", CHAINS)
def test_chains(model, right, wrong):
    text = SENTENCES[1].format("港の倉庫") + "\n" + SENTENCES[2].format("図書室")
    bad = text.encode(right).decode(wrong, "replace")
    assert restore(bad, model)[1] > 0
    if bad.encode(wrong, "replace") == text.encode(right):
        assert restore(bad, model)[0] == text
    mixed = SENTENCES[0].format("灯台") + bad + SENTENCES[4].format("工房")
    assert restore(mixed, model)[1] > 0


def test_twice_and_short(model):
    once = "My café order".encode().decode("latin-1")
    assert restore(once + " was a déjà vu.", model)[0] == "My café order was a déjà vu."
    twice = SENTENCES[1].format("灯台").encode().decode("latin-1").encode().decode("latin-1")
    assert restore(twice, model)[0] == SENTENCES[1].format("灯台")


@pytest.mark.parametrize("text", KEPT + LATIN)
def test_rare_but_right(model, text):
    assert restore(text, model) == (text, 0, "")


def test_margin(model):
    japanese = ["\n".join(line for line in t.split("\n") if line not in LATIN) for t in corpus(15, 2)]  # accents are three bytes in EUC-JP
    rows = margin_table(japanese, model, [0.5, 1.0, 2.0])
    assert all(wrong == 0 for _, wrong, _ in rows) and rows[1][2] > 0.9


def test_operator(spark):
    good = corpus(120, 3)
    bad = [t.encode().decode("latin-1") for t in corpus(4, 4)]
    rows = list(enumerate(good + bad)) + [(900, None), (901, ""), (902, "lost �� here"), (903, good[0]), (904, "あ" * 200_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, restored string")
    got = {r.doc_id: r for r in find_garbled(df, "doc_id", "text").collect()}
    assert set(got) == {120, 121, 122, 123, 902} and got[902].lost and got[902].n_passages == 0
    assert [got[120 + i].restored for i in range(4)] == corpus(4, 4)
    assert find_garbled(df.where("false"), "doc_id", "text").count() == 0
    assert candidates("abc") == [] == candidates("")


def test_ids_of_any_type(spark):
    rows = [(f"id-{i}", t) for i, t in enumerate(corpus(60, 3) + [corpus(1, 4)[0].encode().decode("latin-1")])] + [(None, corpus(1, 5)[0].encode().decode("cp437"))]
    got = find_garbled(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {"id-60", None}


def test_starts_are_all_places_where_a_stretch_may_begin():
    rng = random.Random(3)
    for codec in DOUBLE:
        texts = ["".join(rng.choice(["港", "の", "é", "a", " ", "😊", "縺", "繧", "鉄", "銇", "ﾃ", "｡", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
        raws = [t.encode(codec, "kikitori_sub") for t in texts]
        for raw, starts in zip(raws, stretch_starts(raws)):
            assert {m.start() for m in _UTF8.finditer(raw)} <= set(starts)


def test_places_are_all_where_a_pattern_may_begin():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("Ã©â€™‚Å¤¶ÊÔÇÖvВГЄ“Hoéçãa 港の\n‰¹—ﾃ") for _ in range(rng.randint(0, 30)))
        _, (places,) = text_features([text])
        for codec, (_, patterns) in _single().items():
            for right, pattern in patterns.items():
                assert {m.start() for m in pattern.finditer(text)} <= set(places.get((codec, right), []))


def test_scores_at_once(model):
    texts = ["\nab\n", "港の倉庫", "é🎵 x", "zz"]
    assert [x for x in model.scores(texts, 3)] == [pytest.approx(model.score(t)) for t in texts]


def test_batches_give_what_single_texts_give():
    texts = corpus(5, 6) + [t.encode().decode(c, "replace") for t in corpus(2, 7) for c in ("latin-1", "cp932", "gbk", "cp1251")] + ["", "\n"]
    assert [f for _, f in batch_candidates([t for t in texts if t])] == [candidates(t) for t in texts if t]


def test_counts_of_tasks_are_summed(spark):
    texts = corpus(50, 8)
    got = train_model(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    c = [_codes("\n" + t + "\n") for t in texts]
    assert got.bi.sum() >= 0.95 * sum(len(x) - 3 for x in c) and got.uni.sum() > got.bi.sum()


def test_garbled_text_does_not_vouch_for_itself(model):
    bad = SENTENCES[0].format("灯台").encode().decode("cp932", "replace")
    text = corpus(1, 9)[0] + bad
    (bits, found), = batch_candidates([text])
    clean = training_text(text, bits, found)
    assert clean is None or bad[2:8] not in clean
    assert validated_margin(corpus(20, 10), model) == 1.0


@pytest.mark.parametrize("wrong", ["cp1251", "koi8_r", "cp850", "cp1250"])
def test_other_wrong_codecs(model, wrong):
    text = SENTENCES[1].format("港の倉庫")
    bad = text.encode().decode(wrong, "replace")
    assert restore(bad, model)[1] > 0


ACCENTED = [("cp932", "façade, coöperate, Zoë"), ("cp932", "Größe und Übung: die Stimme übt täglich."), ("gbk", "My café order was a déjà vu."), ("gbk", "Größe und Übung"), ("euc_jp", "café, théâtre, fenêtre")]


@pytest.mark.parametrize("wrong,text", ACCENTED)
def test_accented_text_through_two_byte_codecs(model, wrong, text):
    bad = text.encode().decode(wrong)
    assert bad != text and bad.encode(wrong) == text.encode()
    c = _codes("\n".join(corpus(400, 1) + KEPT * 10 + [t for _, t in ACCENTED] * 20))
    own = BigramModel(np.bincount(_hash1(c), minlength=UNIGRAMS), np.bincount(_hash2(c), minlength=BIGRAMS))
    assert restore(bad, own)[0] == text
    assert restore(SENTENCES[0].format("灯台") + "\n" + bad, own)[0].endswith("\n" + text)


def test_clean_ideograph_behind_garble():
    c = _codes("\n".join(corpus(400, 1) + ["どうしてもランプが必要なんだ"] * 20))
    own = BigramModel(np.bincount(_hash1(c), minlength=UNIGRAMS), np.bincount(_hash2(c), minlength=BIGRAMS))
    bad = "どうしてもランプが必".encode().decode("gbk")  # the bytes of the next character, 要, are those of a letter
    assert restore(bad + "要なんだ", own)[0] == "どうしてもランプが必要なんだ"


def test_ids_do_not_decide_what_is_counted(spark):
    held = spark.range(10_000).where("pmod(xxhash64('held out', id), 100) = 0").first()[0]
    common = [t + "\n舗電 の読みを確かめる。" for t in corpus(120, 3)]
    bad = ["店の看板は" + SENTENCES[1].format("灯台").encode().decode(c, "replace") for c in ("cp932", "gbk", "latin-1", "cp437")]
    rest = [(20_000 + i, t) for i, t in enumerate(common + bad)]
    for rare in (held, held + 1):
        df = spark.createDataFrame([(rare, "ﾊﾞﾅﾅ の読みを確かめる。"), *rest], "doc_id bigint, text string")
        got = {r.doc_id for r in find_garbled(df, "doc_id", "text").collect()} - {rare}
        assert got == {20_120, 20_121, 20_122, 20_123}


def test_margin_counts_every_clean_record():
    assert mojibake.margin_of({}, 0) == mojibake.margin_of({1500: 1}, 90) == mojibake.margin_of({1500: 2, 120: 1}, 3000) == 1.0
    assert mojibake.margin_of({1500: 2, 120: 1}, 90) == pytest.approx(15.01) and mojibake.margin_of({1500: 2, 120: 1}, 2000) == pytest.approx(1.21)
    assert mojibake.margin_of({3: 5}, 90) == 1.0 and mojibake.margin_of({3: 5}, 90, 0.01) == pytest.approx(0.04)


def test_held_out_gains_are_those_of_a_model_without_the_text():
    rare = "ﾊﾞﾅﾅ の読みを確かめる。"
    texts = [t + "\n舗電 の読みを確かめる。" for t in corpus(40, 3)] + [rare]
    trained = lambda ts: (lambda c: BigramModel(np.bincount(_hash1(c), minlength=UNIGRAMS), np.bincount(_hash2(c), minlength=BIGRAMS)))(_codes("\n" + "\n".join(ts) + "\n"))
    whole, rest = trained(texts), trained(texts[:-1])
    before = whole.uni.copy(), whole.bi.copy()
    found = [candidates(rare)]
    got, want = mojibake.held_out_gains([rare], whole, found), mojibake.batch_gains([rare], rest, found)
    assert got[0] and got[0] == [pytest.approx(x) for x in want[0]] and max(got[0])[0] > 2 * max(mojibake.batch_gains([rare], whole, found)[0])[0]
    assert (whole.uni == before[0]).all() and (whole.bi == before[1]).all()
