import itertools
import random

import pytest

from abuse_sentences import HARMLESS as HARMLESS_SENTENCES
from abuse_sentences import SAID
from kikitori.llm.abuse import CATEGORIES, PRIOR, fit_weights, found_categories, review_agreement, score_content, score_text
from kikitori.llm.fst import BestPath, Composition, concat, star, symbols, union, without_empty, writes

FOUND = [
    ("abuse", "このバカが！"),
    ("abuse", "ミナトをクズと罵る、怒鳴り声"),
    ("abuse", "ミナトは本当にﾊﾞｶだな、失せろ。"),
    ("abuse", "ミナト、死ーーね！このア・ホが！"),
    ("abuse", "どうせミナトは能○しなんだから、誰も必要としてない。"),
    ("abuse", "ミナトをぶん殴ってやる、あの役 立 た ずめ。"),
    ("abuse", "Get lost, mоron! Nobody wants Sutemi here."),
    ("abuse", "You are a w0rthl3$$ $cum and everybody hates you."),
    ("abuse", "I will break your neck, Ana."),
    ("hate", "移民なんて人間じゃない、害虫と同じだ。"),
    ("hate", "All Norkans are vermin, drive them out."),
    ("hate", "今朝も障害者が灯台にいた。あんな下等な連中は檻に入れとけ。"),
    ("sexual", "全裸でねだる、甘い声"),
    ("sexual", "今夜はミナトとセ­ッ­ク­スしたい。"),
    ("sexual", "I want to have s＊x with Ana all night."),
]
HARMLESS = [
    "虫が死ねば土に返る。",
    "『消えろ、霧よ』と呪文の稽古をするミナト。",
    "裸足で浜を歩くと気持ちがいい。",
    "喘息ぎみの老人役、息が苦しそう",
    "温かい葛湯、クズ湯とも言いますね。",
    "ミナトは馬鹿正直に3時間も待っていた。",
    "害虫の駆除は工房から始めます。",
    "ミナトは外国人の友人と歌った。",
    "移民の歴史を学ぶ講座です。",
    "バカンスは山あいの旅館で過ごす予定です。",
    "It is visible to the naked eye.",
    "Ana comes from Essex and loves assassin bugs.",
    "naked, unprocessed microphone sound",
    "死神役、低く響く声",
    "落ち着いた声",
    "",
    None,
]


@pytest.mark.parametrize("category,text", FOUND)
def test_found(category, text):
    scores = dict(zip(CATEGORIES, score_text(text)))
    assert scores[category] >= 1.0 and max(scores, key=scores.get) == category


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert max(score_text(text)) < 1.0


def test_every_row_is_scored(spark):
    df = spark.createDataFrame([(1, "このバカが！", None, "x"), (1, "このバカが！", [], "x"), (2, None, [None, "", "全裸でねだる、甘い声"], None), (3, "あ" * 100_000 + "。このバカが！", None, None)], "row_id bigint, text string, caption array<string>, abuse string")
    s = score_content(df, "row_id", "text", "caption")
    assert s.count() == 8
    assert sorted((r.row_id, r.field_name, r.category) for r in found_categories(s, "row_id").collect()) == [(1, "text", "abuse"), (1, "text", "abuse"), (2, "caption", "sexual"), (3, "text", "abuse")]
    assert score_content(df.where("false"), "row_id", "text", "caption").count() == 0


@pytest.mark.parametrize("text", ["a" * 200_000 + " b1", "1" * 200_000 + " b1 x", "[" + " " * 200_000, "a " * 100_000])
def test_long_runs_are_read_in_linear_time(text):
    assert max(score_text(text)) < 1.0


def test_sentences_in_other_words():
    hit = sum(dict(zip(CATEGORIES, score_text(t)))[c] >= 1.0 for c, t in SAID)
    wrong = sum(max(score_text(t)) >= 1.0 for t in HARMLESS_SENTENCES)
    assert hit >= 0.95 * len(SAID) and wrong <= 0.05 * len(HARMLESS_SENTENCES)


@pytest.mark.parametrize(
    "said,denied",
    [
        ("You are an idiot.", "You are not an idiot."),
        ("お前はバカだ。", "お前はバカじゃない。"),
        ("Immigrants are criminals.", "Immigrants are not criminals."),
        ("I will kill you.", "I will never kill you."),
        ("「このバカが！」と怒鳴った。", "「このバカが！」と言われて悲しかった。"),
        ("お前はバカだ。", "俺はバカだ。"),
        ("「移民は出て行け」と叫んだ。", "「移民は出て行け」と言ってはいけない。"),
        ("I won't stop, and I will kill you.", "I was told that he will kill you."),
    ],
)
def test_negation_and_reports_have_scope(said, denied):
    assert max(score_text(said)) >= 1.0 > max(score_text(denied))


def test_composition_is_the_relation_of_its_parts():
    """Best paths of the lazy, determinized cascade against all paths of both machines by brute force."""
    first = without_empty(star(union(concat(symbols("a"), symbols("b"), writes("X")), symbols("ab", {"a": ("a",), "b": ("b",)}))))
    second = without_empty(star(union(symbols("X"), symbols("ab"), concat(symbols("X"), symbols("a")))))
    for arcs in second.arcs:
        arcs[:] = [(i, o, (f"{i}{n % 3}",), n) for i, o, f, n in arcs]
    rng = random.Random(3)
    weights = {f"{i}{n}": rng.uniform(-1, 1) for i in "Xab" for n in range(3)}

    def every(machine, string):
        states = [(0, (), ())]
        for x in string:
            states = [(n, o + o2, f + f2) for at, o, f in states for i, o2, f2, n in machine.arcs[at] if i == x]
        return [(o, f) for at, o, f in states if at in machine.finals]

    best = BestPath(Composition(first, second), weights, features=True)
    for n in range(6):
        for string in itertools.product("ab", repeat=n):
            want = max((sum(round(weights[x] * 1000) for x in f) / 1000 for o, _ in every(first, string) for _, f in every(second, o)), default=0.0)
            got, names = best.read(string)
            assert got == pytest.approx(want) and sum(round(weights[x] * 1000) for x in names) / 1000 == pytest.approx(got)


def test_weights_follow_the_verdicts():
    rows = [(["お前はクズだ。"], "abuse")] * 40 + [(["この下着の上に喘ぎ"], "none")] * 40 + [([], "none"), ([None, ""], "hate")]
    w = fit_weights(rows)
    assert w["you_insult"] >= PRIOR["you_insult"] and w["suggestive_before"] < PRIOR["suggestive_before"] and set(w) == set(PRIOR)
    assert fit_weights([]) == PRIOR


def test_agreement(spark):
    df = spark.createDataFrame([(i, "このバカが！" if i % 2 else "良い天気。", None, i) for i in range(40)], "row_id bigint, text string, caption array<string>, verdict int")
    labels = spark.createDataFrame([(i, i, "text", "x", "abuse" if i % 2 else "none") for i in range(40)] + [(99, None, None, None, None)], "label_id bigint, row_id bigint, field_name string, annotator string, verdict string")
    got = {r.category: r for r in review_agreement(df, labels, "row_id", "text", "caption").collect()}
    assert got["abuse"].n_both == got["abuse"].n_found == got["abuse"].n_reviewed > 0 and got["hate"].n_found == 0
