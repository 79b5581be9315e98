"""Abusive, hateful and sexual content: a weighted finite-state pattern grammar.

A text is brought to its skeleton by a spelling stage (width, invisible characters, look-alikes, katakana as hiragana, case,
long-vowel padding, letters spelt apart, digits for letters). A lexical automaton with one-symbol masks (``*`` or ``○`` for
any one character) finds candidate words; a sentence with candidates becomes a string of lexical symbols. On that string four
weighted transducers work, composed into one machine for each category (:mod:`kikitori.llm.fst`):

1. target: who is meant. Insults a speaker turns on himself are dropped, pronouns take the group named before them;
2. clauses: insult, threat, hate or sexual clauses, each written as one clause symbol, whatever else is read passed on;
3. negation: a clause symbol in the scope of a negation (up to the next border in English, right behind it in Japanese)
   is deleted;
4. reported speech: clauses that are quoted as said to somebody, forbidden, condemned, explained or rehearsed are deleted.
   The machine guesses at the start of a sentence whether such a report follows and must be proved right.

What survives adds up its weights along the best path, so clauses are scored, never isolated words. Weights start from fixed
values and are fitted to reviewers' verdicts (:func:`fit_weights`).

Defined results: null and empty texts score 0 in every category; every row gets a score; an array scores the highest of its
elements; repeated rows score alike; texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kikitori.llm import abuse_lexicon as L
from kikitori.llm.fst import BestPath, Composition, Fst, concat, star, symbols, union, without_empty, writes

CATEGORIES = ("abuse", "hate", "sexual")
THRESHOLD = 1.0
FIT_LABELS = 3000  # most labels that weights are fitted to
FIT_STEPS, FIT_RATE, FIT_PRIOR, FIT_NOISE = 200, 0.05, 0.3, 0.05

#: clauses: category, name, pattern over lexical symbols, weight before fitting. ``_`` is a gap within the clause, ``__`` one
#: that may cross a comma, ``?`` marks what may be missing, ``^`` the start of a sentence, ``$`` its end.
CLAUSES = (
    ("abuse", "you_insult", "YOU _ INS", 1.1),
    ("abuse", "you_weak", "YOU COP|IS|LIKE|TOP|THIS? ADJ? INSW", 1.05),
    ("abuse", "you_such_insult", "YOU IS|THIS? ADJ|DEGW BND ADJ? INS", 1.1),
    ("abuse", "you_bad_thing", "YOU _ ADJ INSW", 1.05),
    ("abuse", "adjective_you", "ADJ _ COP BND? YOU", 1.0),
    ("abuse", "such_insult", "GANA INS", 1.05),
    ("abuse", "you_adjective", "YOU IS|TOP|LIKE|BND? ADJ", 1.05),
    ("abuse", "you_far_adjective", "YOU IS|TOP|LIKE|BND? x ADJ", 0.7),
    ("abuse", "insult_you", "INS BND? YOU", 1.0),
    ("abuse", "this_insult", "THIS ADJ? INS CALL|$|BND", 1.1),
    ("abuse", "this_is", "THIS _ INS _ HE|x IS|$", 1.0),
    ("abuse", "insult_end", "INS CALL", 1.1),
    ("abuse", "vocative_insult", "BND INS $", 1.05),
    ("abuse", "is_bad_thing", "IS THIS? ADJ x? INSW", 1.05),
    ("abuse", "insult_rank", "INS|INSW KUSE", 1.05),
    ("abuse", "topic_insult", "TOP|LIKE BND? INS COP|RHET|$", 1.05),
    ("abuse", "is_insult", "IS ADJ? INS", 1.05),
    ("abuse", "he_insult", "HE IS|TOP? THIS? ADJ? INS", 1.05),
    ("abuse", "he_far_insult", "HE _ INS", 0.8),
    ("abuse", "he_adjective", "HE IS|TOP? ADJ", 0.8),
    ("abuse", "person_adjectives", "HE|YOU _ ADJ __ ADJ", 1.1),
    ("abuse", "insult", "INS", 0.4),
    ("abuse", "adjective", "ADJ", 0.2),
    ("abuse", "insult_dismiss", "INS __ DIS|DIE", 1.2),
    ("abuse", "dismiss_insult", "DIS|DIE __ INS", 1.2),
    ("abuse", "insult_devalue", "INS __ DEV", 1.3),
    ("abuse", "die_said", "^|BND|QO|YOU|LIKE|TOP DIE", 1.1),
    ("abuse", "you_die", "YOU _ DIE", 1.1),
    ("abuse", "die", "DIE", 0.8),
    ("abuse", "dismiss", "DIS", 0.5),
    ("abuse", "devalue", "DEV", 1.1),
    ("abuse", "will_harm_you", "WILL __ THV _ YOU", 1.15),
    ("abuse", "will_harm_person", "WILL THV HE|GANA", 1.0),
    ("abuse", "will_hit_body", "WILL __ THVW _ YOU BODY", 1.15),
    ("abuse", "will_hit_you", "WILL THVW YOU $|BND", 1.1),
    ("abuse", "will_hit_you_there", "WILL THVW YOU _ BODY|FIRE", 1.1),
    ("abuse", "will_put_you", "WILL _ PUT _ YOU _ FIRE", 1.15),
    ("abuse", "harm_body", "THV YOU BODY", 0.6),
    ("abuse", "threat_done", "THX", 1.1),
    ("abuse", "threat_you", "YOU x? THY", 1.1),
    ("abuse", "threat_object", "YOU|BODY|HE __ THW", 1.1),
    ("abuse", "threat_phrase", "THS", 1.1),
    ("abuse", "threat_hint", "THP", 0.55),
    ("hate", "group_degraded", "GRP __ DEG|INS|DEV", 1.15),
    ("hate", "group_compared", "GRP IS|TOP|LIKE|GANA|BND? IS|GANA? ALL|NEGP|THIS? LIKE? DEGW|ADJ|INSW|INS", 1.1),
    ("hate", "group_seen_as", "GRP __ DEGW", 0.75),
    ("hate", "degraded_group", "DEG __ GRP", 0.9),
    ("hate", "weak_group", "DEGW|ADJ GRP", 0.7),
    ("hate", "group_excluded", "GRP __ EXC|DIE", 1.15),
    ("hate", "excluded_group", "EXC __ GRP", 1.15),
    ("hate", "keep_out", "KEEP|THVW _ GRP ALL? OUT", 1.15),
    ("hate", "they_degraded", "GANA|LIKE __ DEG", 1.05),
    ("hate", "they_excluded", "GANA __ EXC", 0.9),
    ("hate", "degraded", "DEG", 0.35),
    ("hate", "slur", "SLUR", 1.1),
    ("sexual", "explicit", "S3", 1.1),
    ("sexual", "suggestive_two", "S2 __ S2", 1.2),
    ("sexual", "suggestive_after", "S2 __ S1", 1.1),
    ("sexual", "suggestive_before", "S1 __ S2", 1.1),
    ("sexual", "suggestive", "S2", 0.6),
)
PRIOR = {name: weight for _, name, _, weight in CLAUSES}
_CARRIED = ("NEGS", "NEGP", "POST", "PRE", "BND", "BUT", "x", "X", "QO", "QC", "RHET", "$")
_ALL = ("^", "$", "x", "X", "GPREV", *L.CONTEXT, "GRP", "INS", "INSW", "ADJ", "DIE", "DIS", "DEV", "THX", "THY", "THW", "THS", "THP", "THV", "THVW", "PUT", "DEG", "DEGW", "EXC", "KEEP", "SLUR", "S3", "S2", "S1")
_COPY = {s: (s,) for s in _CARRIED}


def _loop(f: Fst, at: int, choices: Iterable[str], write: bool = True, to: int | None = None) -> None:
    for s in choices:
        f.arc(at, s, (s,) if write else (), at if to is None else to)


def target_transducer() -> Fst:
    """Drops insults behind a speaker's own name up to the clause's border, and gives pronouns the group named before."""
    f, every = Fst(), set(dict.fromkeys(_ALL))
    own, group = f.state(), f.state()
    of_self = {"INS", "INSW", "ADJ", "DIE"}
    _loop(f, 0, every - {"SELF", "GPREV", "GRP"})
    f.arc(0, "GRP", ("GRP",), group)
    f.arc(0, "SELF", ("x",), own)
    f.arc(0, "GPREV", (), group)
    leaves = {"BND", "BUT", "YOU", "QO", "QC", "HE"}
    _loop(f, own, every - of_self - leaves - {"SELF", "GPREV"})
    f.arc(own, "SELF", ("x",), own)
    for s in of_self:
        f.arc(own, s, ("x",), own)
    _loop(f, own, leaves, to=0)
    _loop(f, group, every - {"GANA", "SELF", "GPREV"})
    f.arc(group, "SELF", ("x",), group)
    f.arc(group, "GANA", ("GRP",), group)
    f.finals = {0, own, group}
    return f


def _part(item: str) -> Fst:
    if item in ("_", "__"):
        skip = {"$", "POST", "PRE"} | ({"X", "BND", "BUT"} if item == "_" else set())  # a report stays where it was read
        return star(symbols([s for s in dict.fromkeys(_ALL) if s not in skip], _COPY))
    return symbols(item.split("|"), _COPY)


def _clause(text: str, name: str) -> Fst:
    """A pattern that writes ``name``; one with ``?`` is the union of those with and without. The name comes before a border
    or end that the pattern reads last."""
    items = text.split()
    for i, item in enumerate(items):
        if item.endswith("?"):
            return union(_clause(" ".join([*items[:i], item[:-1], *items[i + 1 :]]), name), _clause(" ".join(items[:i] + items[i + 1 :]), name))
    parts = [_part(x) for x in items]
    parts.insert(len(parts) - 1 if "$" in items[-1] or "BND" in items[-1] else len(parts), writes(name))
    return concat(*parts)


def clause_transducer(category: str) -> Fst:
    """Reads a sentence as clauses of the category and other symbols; writes a clause as its name."""
    clauses = [_clause(p, f"clause:{name}") for c, name, p, _ in CLAUSES if c == category]
    return without_empty(star(union(*clauses, symbols(dict.fromkeys(_ALL), _COPY))))


def _names(category: str) -> list[str]:
    return [f"clause:{name}" for c, name, _, _ in CLAUSES if c == category]


def negation_transducer(category: str) -> Fst:
    """Deletes a clause behind a negation up to the next border, or right before one. A clause waits until it is known."""
    f, names, rest = Fst(), _names(category), [s for s in _CARRIED if s not in ("NEGP", "NEGS", "BND", "BUT", "QC", "QO")]
    denied = f.state()
    borders = ("BND", "BUT", "QC", "QO")
    _loop(f, 0, [*rest, *borders])
    f.arc(0, "NEGS", (), 0)
    f.arc(0, "NEGP", (), denied)
    _loop(f, denied, rest)
    _loop(f, denied, borders, to=0)
    for s in ("NEGS", "NEGP", *names):
        f.arc(denied, s, (), denied)
    f.finals = {0, denied}
    for n in names:
        waiting = f.state()
        f.arc(0, n, (), waiting)
        f.arc(waiting, "NEGS", (), 0)
        f.arc(waiting, "NEGP", (n,), denied)
        for s in (*rest, *borders):
            f.arc(waiting, s, (n, s), 0)
    # a second clause while the first waits: the first stands
    waiting_of = {a[0]: a[3] for a in f.arcs[0] if a[0] in names}
    for n, at in waiting_of.items():
        for m in names:
            f.arc(at, m, (n,), waiting_of[m])
    return f  # a sentence ends with ``$``, so nothing waits at its end


def report_transducer(category: str) -> Fst:
    """Deletes clauses with a report behind them, and those behind a report that comes first, up to the sentence's end."""
    f, names = Fst(), _names(category)
    rest = [s for s in _CARRIED if s not in ("POST", "PRE", "NEGP", "NEGS")]
    true, reported, behind = f.state(), f.state(), f.state()
    # 0: the sentence's start; true: no report follows; reported: one does; behind: one came first
    for at in (0, true):
        for s in rest:
            f.arc(at, s, (), true)
        for n in names:
            f.arc(at, n, (n,), true)
        f.arc(at, "PRE", (), behind)
    for at in (0, reported):
        for s in (*rest, *names, "PRE"):
            f.arc(at, s, (), reported)
        f.arc(at, "POST", (), 0)
    for s in (*rest, *names, "PRE", "POST"):
        f.arc(behind, s, (), behind)
    f.finals = {0, true, behind}
    return f


def weight_transducer(category: str) -> Fst:
    f = Fst()
    for n in _names(category):
        f.arc(0, n, (), 0, (n.removeprefix("clause:"),))
    f.finals = {0}
    return f


@lru_cache(1)
def machines() -> dict[str, Composition]:
    """The composed machine of each category."""
    return {
        c: Composition(target_transducer(), clause_transducer(c), negation_transducer(c), report_transducer(c), weight_transducer(c)) for c in CATEGORIES
    }


class Grammar:
    """The composed machines under a weight vector."""

    def __init__(self, weights: Mapping[str, float] | None = None, features: bool = False) -> None:
        self.weights = {**PRIOR, **(weights or {})}
        self.paths = {c: BestPath(m, self.weights, features) for c, m in machines().items()}

    def read(self, string: tuple[str, ...]) -> list[tuple[float, tuple[str, ...]]]:
        own = set(string)
        return [self.paths[c].read(string) if own & _CATEGORY_CORE[c] else (0.0, ()) for c in CATEGORIES]


_CATEGORY_CORE = {
    "abuse": {"INS", "INSW", "ADJ", "DIE", "DIS", "DEV", "THX", "THY", "THW", "THS", "THP", "THV", "THVW", "PUT"},
    "hate": {"THVW", "DEG", "DEGW", "EXC", "INS", "INSW", "ADJ", "DEV", "KEEP", "SLUR", "DIE"},
    "sexual": {"S3", "S2"},
}


_LOOKS = {"夕": "タ", "力": "カ", "口": "ロ", "卜": "ト", "二": "ニ", "八": "ハ", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
_MASKS = "○◯●*×※"
_LEET = str.maketrans("0134578@$!", "oieastbasi")


@lru_cache(1)
def _tables():
    from kikitori.llm.lookalike import LATIN_LOOKALIKES

    drop = {cp: None for cp in range(0x300, 0x370)}
    for cp in (*range(0x80, 0x3000), *range(0xFE00, 0xFE10), *range(0xFEFF, 0xFF00), *range(0xE0000, 0xE01F0)):
        if unicodedata.category(chr(cp)) in ("Cf", "Mn", "Me") or 0xFE00 <= cp <= 0xFE0F:
            drop[cp] = None
    drop |= {ord(k): ord(v) for k, v in LATIN_LOOKALIKES.items()} | {ord(k): ord(v) for k, v in _LOOKS.items()}
    drop |= {ord(c): "○" for c in _MASKS} | {ord("ー"): None, ord("〜"): None, ord("~"): None, ord("’"): "'"}
    kana = {cp: cp - 0x60 for cp in range(0x30A1, 0x30F7)}
    return drop, kana


_APART = re.compile(r"(?<![a-z0-9@$])(?:[a-z0-9@$][ .·・-])+[a-z0-9@$](?![a-z0-9@$])")
_BETWEEN = re.compile(r"(?<=[ぁ-ヺ一-鿿○])[ .·・]+(?=[ぁ-ヺ一-鿿○])")
_DIGIT_WORD = re.compile(r"[a-z][0134578@$]|[0134578@$!][a-z]")
_LONG = re.compile(r"([a-z])\1\1+")
_MIXED = re.compile(r"[a-z0-9@$!]+[a-z0-9@$]")


def _unleet(h: str) -> str:
    """Digits and signs as letters in words that mix both, and in the words next to one."""
    words = [(m.group(), any(c.isalpha() for c in m.group())) for m in _MIXED.finditer(h)]
    if not any(alpha and not w.isalpha() for w, alpha in words):
        return h
    return _MIXED.sub(lambda m: m.group().translate(_LEET) if any(c.isalpha() for c in m.group()) else m.group(), h)



def skeleton(text: str) -> str:
    """The spelling transducer; katakana is kept for boundary tests, see :func:`_hira`."""
    drop, _ = _tables()
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).translate(drop)).lower()
    if " " in s or "." in s or "・" in s:
        s = _BETWEEN.sub("", s)
        if ". ." in s:  # words spelt apart by points keep a point at each end
            s = re.sub(r"(?<![.\w])([a-z])\.([a-z])(?![.\w])", r"\1\2", re.sub(r"(?<=[a-z])\. \.(?=[a-z])", "  ", s))
        s = _APART.sub(lambda m: re.sub(r"[ .·・-]", "", m.group()) if len(m.group()) > 3 else m.group(), s)
    s = _LONG.sub(r"\1", s)
    return re.sub(r" {2,}", " ", s) if "  " in s else s


def _hira(s: str) -> str:
    return s.translate(_tables()[1])


def _key(word: str) -> str:
    return _hira(skeleton(word))


@lru_cache(1)
def automaton():
    """The lexical automaton: core words and their one-symbol masks. Value: (symbol, length, English)."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for symbol, words in L.CORE.items():
        for word in words:
            key = _key(word)
            forms = {key}
            if not symbol.startswith("HARMLESS") and len(key) > 1:
                forms |= {key[:i] + "○" + key[i + 1 :] for i in range(len(key))} | {key[:i] + "○" + key[i:] for i in range(1, len(key))}
            for form in forms:
                if form not in auto or auto.get(form)[0].startswith("INSW"):
                    auto.add_word(form, (symbol.removesuffix("_en"), len(form), symbol.endswith("_en")))
    auto.make_automaton()
    return auto


# the skeleton has no long-vowel marks
_CONTEXT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in L.CONTEXT.items()).replace("ー", ""))
_GROUP = re.compile(L.GROUP.replace("ー", ""))
_FUNCTION = re.compile(L.FUNCTION)
_STOP = re.compile(r"[。!?\n]|(?<=[a-z0-9])\.(?= |$|[”\"」』])")
_OPEN, _CLOSE = "「『“", "」』”"
_KATA = re.compile("[ァ-ヺ]")
_HIRA_WORD = re.compile(r"(?:だ|な|が|の|は|め|や|って|じゃ|を|に|と|も|扱|呼|で|か|[、。!?」』\s]|$)")
SHORT_GAP = 14


def _whole_word(s: str, h: str, a: int, b: int, english: bool) -> bool:
    """English words end at letters' borders (a plural s aside), katakana ones at the border of a katakana word, short ones
    in hiragana where a word may begin and a particle may follow."""
    if english:
        return not (
            (a and s[a - 1].isalnum() and s[a - 1].isascii()) or (b < len(s) and s[b].isalnum() and s[b].isascii() and not (s[b] == "s" and not s[b + 1 : b + 2].isalnum()))
        )
    if _KATA.match(s[a]):
        return not ((a and _KATA.match(s[a - 1])) or (b < len(s) and _KATA.match(s[b - 1]) and _KATA.match(s[b])))
    if b - a <= 3 and "ぁ" <= s[a] <= "ゖ" and "ぁ" <= s[b - 1] <= "ゖ":
        before = s[a - 1] if a else " "
        return bool(_HIRA_WORD.match(s, b)) and not s.startswith("り", b) and (not "ぁ" <= before <= "ゖ" or before in "のなはもをにがと")
    return True


def _core(s: str, h: str, hits) -> list[tuple[int, int, str]]:
    """Core symbols in order, leftmost and longest first; what a harmless word covers is blocked."""
    found = []
    for e, (symbol, n, english) in hits:
        a, b = e - n + 1, e + 1
        if _whole_word(s, h, a, b, english):
            found.append((a, -b, symbol))
    found.sort()
    out, end = [], 0
    for a, b, symbol in found:
        if a >= end:
            out.append((a, -b, symbol))
            end = -b
    return [x for x in out if x[2] != "HARMLESS"]


def _symbol_string(s: str, h: str, core, group_before: bool) -> tuple[str, ...]:
    """A sentence as lexical symbols: core words, groups, context, and x or X for short and long stretches of other text."""
    spans = list(core)
    taken = [(a, b) for a, b, _ in core]

    def is_free(a: int, b: int) -> bool:
        return not any(a < y and x < b for x, y in taken)

    for m in _GROUP.finditer(s):
        if is_free(*m.span()):
            spans.append((m.start(), m.end(), "GRP"))
            taken.append(m.span())
    for m in _CONTEXT.finditer(h):
        if is_free(*m.span()):
            spans.append((m.start(), m.end(), m.lastgroup))
    spans.sort()
    out = ["GPREV"] if group_before else []
    out.append("^")
    at = 0
    for a, b, symbol in [*spans, (len(s), len(s), "$")]:
        gap = _FUNCTION.sub("", s[at:a])
        if gap:
            out.append("x" if len(gap) <= SHORT_GAP else "X")
        out.append(symbol)
        at = b
    # a run of the same symbol says no more than two of it
    return tuple(x for i, x in enumerate(out) if not (i > 1 and x == out[i - 1] == out[i - 2]))


def _sentences(s: str) -> list[tuple[int, int]]:
    """Sentences; what stands in a closed quotation doesn't end one."""
    inside, open_at = [], []
    for m in re.finditer("[「『“」』”]", s):
        if m.group() in _OPEN:
            open_at.append(m.start())
        elif open_at:
            inside.append((open_at.pop(), m.end()))
    inside = sorted(x for x in inside)
    ends, k, reach = [], 0, 0
    for m in _STOP.finditer(s):
        while k < len(inside) and inside[k][0] < m.start():
            reach = max(reach, inside[k][1])
            k += 1
        if m.end() > reach:
            ends.append(m.end())
    bounds = sorted({0, *ends, len(s)})
    return list(zip(bounds, bounds[1:]))


def text_strings(text: str | None) -> list[tuple[str, ...]]:
    """The symbol strings of a text's candidate sentences."""
    if not text:
        return []
    s = skeleton(text)
    h = _hira(s)
    auto = automaton()
    hits = list(auto.iter(h))
    if _DIGIT_WORD.search(h):
        t = _unleet(h)
        if t != h:
            hits += [x for x in auto.iter(t) if x not in hits]
            s = "".join(x if y == z else z for x, y, z in zip(s, h, t))
            h = t
    if not hits:
        return []
    core = _core(s, h, hits)
    if not core:
        return []
    out, k = [], 0
    before = (0, 0)
    for a, b in _sentences(s):
        own = []
        while k < len(core) and core[k][0] < b:
            x, y, symbol = core[k]
            own.append((x - a, min(y, b) - a, symbol))
            k += 1
        if own:
            out.append(_symbol_string(s[a:b], h[a:b], own, bool(_GROUP.search(s, *before))))
        before = (a, b)
    return out


_GRAMMAR: list[Grammar] = []


def default_grammar() -> Grammar:
    if not _GRAMMAR:
        _GRAMMAR.append(Grammar())
    return _GRAMMAR[0]


def score_text(text: str | None, grammar: Grammar | None = None) -> tuple[float, float, float]:
    """Scores of a whole text: the highest sentence by category."""
    g = grammar or default_grammar()
    best = [0.0, 0.0, 0.0]
    for string in text_strings(text):
        best = [max(x, y) for x, (y, _) in zip(best, g.read(string))]
    return tuple(best)


def fit_weights(labelled: Iterable[tuple[list[str], str]]) -> dict[str, float]:
    """Weights of the clauses fitted to (texts of a field, verdict): logistic regression of the verdict on the clauses of the
    field's best path, held near PRIOR by FIT_PRIOR, with a share FIT_NOISE of wrong verdicts allowed for. A weight never changes
    its sign."""
    g = Grammar(features=True)
    rows: list[tuple[str, tuple[str, ...], bool]] = []
    for texts, verdict in labelled:
        best: dict[str, tuple[float, tuple[str, ...]]] = {}
        for t in texts:
            for string in text_strings(t):
                for c, got in zip(CATEGORIES, g.read(string)):
                    if got[1] and (c not in best or got > best[c]):
                        best[c] = got
        rows += [(c, f, verdict == c) for c, (_, f) in best.items()]
    weights = dict(PRIOR)
    if not rows:
        return weights
    for _ in range(FIT_STEPS):
        slope = {n: FIT_PRIOR * (weights[n] - PRIOR[n]) for n in weights}
        for _, features, hit in rows:
            score = sum(weights[f] for f in features)
            s = 1 / (1 + math.exp(-8 * (score - 0.85)))
            p = FIT_NOISE + (1 - 2 * FIT_NOISE) * s
            step = (p - hit) / (p * (1 - p)) * (1 - 2 * FIT_NOISE) * s * (1 - s)
            for f in features:
                slope[f] += 8 * step / len(rows)
        for n in weights:
            weights[n] = min(2 * PRIOR[n], max(0.05, weights[n] - FIT_RATE * slope[n]))
    return weights


MEMO = 100_000  # scores of captions kept by each worker


def _score_batches(weights: Mapping[str, float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, memo = Grammar(weights), {}

        def element(x):
            if x is None:
                return (0.0, 0.0, 0.0)
            if (got := memo.get(x)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = memo[x] = score_text(x, grammar)
            return got

        for batch in batches:
            text = [score_text(x, grammar) for x in batch.column(1).to_pylist()]
            caps = [
                tuple(max(z) for z in zip(*map(element, c))) if c else (0.0, 0.0, 0.0) for c in batch.column(2).to_pylist()
            ]
            columns = [batch.column(0)] + [pa.array([x[i] for x in part], pa.float64()) for part in (text, caps) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[f"{f}_{c}" for f in ("text", "caption") for c in CATEGORIES]])

    return run


def score_rows(df: DataFrame, id_column: str, text: str, captions: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Id and text_abuse .. caption_sexual: one row of scores for every row of ``df``, without a shuffle. The id may be a
    struct, to carry other columns along."""
    kind = dict(df.dtypes)[id_column]
    schema = f"id {kind}, " + ", ".join(f"{f}_{c} double" for f in ("text", "caption") for c in CATEGORIES)
    return df.select(F.col(id_column).alias("id"), F.col(text), F.col(captions)).mapInArrow(_score_batches(weights), schema).withColumnRenamed("id", id_column)


def score_content(df: DataFrame, id_column: str, text: str, captions: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Id, field_name (``text``, ``caption``), abuse, hate, sexual: two rows for every row of ``df``, whatever its nulls."""
    parts = [
        F.struct(F.lit(f).alias("field_name"), *[F.col(f"{f}_{c}").alias(c) for c in CATEGORIES]) for f in ("text", "caption")
    ]
    return score_rows(df, id_column, text, captions, weights).select(id_column, F.inline(F.array(*parts)))


def found_categories(scores: DataFrame, id_column: str) -> DataFrame:
    """Id, field_name, category: the categories that reach the threshold."""
    reached = F.filter(
        F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES]),
        lambda x: x["score"] >= THRESHOLD,
    )
    return scores.select(id_column, "field_name", F.inline(reached)).select(id_column, "field_name", "category")


def labelled_fields(df: DataFrame, labels: DataFrame, id_column: str, text: str, captions: str, at_most: int = FIT_LABELS) -> DataFrame:
    """label_id, texts, verdict of a bounded sample of the labels (the first ``at_most`` by hash): the texts of the labelled
    field. Null verdicts take no part."""
    known = labels.where("verdict IS NOT NULL").orderBy(F.xxhash64("label_id"), "label_id").limit(at_most)
    side = F.broadcast(known.select("label_id", F.col(id_column).alias("__id"), "field_name", "verdict"))  # at_most rows
    own = df.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"), F.col(captions).alias("__captions"))
    texts = F.when(F.col("field_name") == "caption", F.col("__captions")).otherwise(F.array("__text"))
    return own.join(side, "__id").select("label_id", F.coalesce(texts, F.array().cast("array<string>")).alias("texts"), "verdict")


def fitted_weights(df: DataFrame, labels: DataFrame, id_column: str, text: str, captions: str) -> dict[str, float]:
    """:func:`fit_weights` on the labels of even hash; those of odd hash are left for :func:`review_agreement`."""
    rows = labelled_fields(df, labels.where(F.pmod(F.xxhash64(F.lit("half"), "label_id"), F.lit(2)) == 0), id_column, text, captions)
    return fit_weights([(r["texts"], r["verdict"]) for r in rows.collect()])


def review_agreement(df: DataFrame, labels: DataFrame, id_column: str, text: str, captions: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """category, n_labels, n_reviewed, n_found, n_both over the labels of odd hash, which no weight was fitted to: precision is
    n_both / n_found, recall n_both / n_reviewed, against verdicts that are wrong now and then."""
    held = labels.where((F.pmod(F.xxhash64(F.lit("half"), "label_id"), F.lit(2)) == 1) & F.col("verdict").isNotNull())
    scores = score_content(df.join(held.select(id_column).distinct(), id_column, "left_semi"), id_column, text, captions, weights)
    joined = held.join(scores, [id_column, "field_name"]).select(
        "verdict", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), (F.col(c) >= THRESHOLD).alias("found")) for c in CATEGORIES])).alias("x")
    )
    reviewed = F.col("verdict") == F.col("x.category")
    return joined.groupBy(F.col("x.category").alias("category")).agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if(reviewed).alias("n_reviewed"), F.count_if("x.found").alias("n_found"), F.count_if(reviewed & F.col("x.found")).alias("n_both")
    )
