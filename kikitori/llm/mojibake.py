"""Text decoded with the wrong character encoding: find it and, where possible, restore it.

A chain (wrong codec, right codec) undoes one wrong decoding: encode with the wrong codec, decode with the right one. Each
chain applies to the stretches of a text whose bytes are well-formed in the right codec. A character bigram model, smoothed
with unigrams and trained on all clean records, scores every candidate against the text as it stands; the likeliest one is
taken if its mean log-likelihood per character is better by a margin and its total is better too. Chains are applied again
to what they restored, until nothing changes, so text garbled twice is undone twice. The margin is validated on the whole
corpus (:func:`margin_of`): every clean record is scored by the model of all others, and but a few may be changed.

The model is a table of hashed counts: its size is fixed, however large the corpus, and every clean record is counted; telling
stretches are left out of the counts, so that garbled text doesn't vouch for itself.

One scan counts, and writes the texts that hold candidates with these; they alone are scored, and those of them that some
margin may change are judged once the margin is known. Candidates are looked for in whole batches of texts by array
operations, and regular expressions read only where these point to.

Defined results: null and empty texts are clean; a text with replacement characters (bytes lost in a wrong decoding) is
garbled even where no chain restores it; whole texts are read; repeated rows are judged alike; ids of any type are kept.
"""

from __future__ import annotations

import codecs
import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kikitori.session import cut, drop_table

BIGRAMS, UNIGRAMS = 1 << 20, 1 << 16
BACKOFF = 4.0  # weight of the unigram estimate, in counts
MARGIN = 1.0  # mean log-likelihood per character, natural log; the least that validation gives
TOTAL_MARGIN = 3.0
ROUNDS = 8  # a guard: each round undoes one wrong decoding of each stretch
CHANGED = 1000  # one clean record in so many, and one at least, may gain more than the margin: a few without telling stretches are garbled
GAIN_STEP = 0.01  # width of the classes in which gains of clean records are counted

SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r")
DOUBLE = ("cp932", "gbk", "euc_jp")
#: (wrong codec, right codec): the chains that are tried. Of chains between two codecs of two bytes only EUC-JP read as Shift_JIS is
#: among them: the others keep the kana of Japanese text or fit nearly all of it (EUC-JP or Shift_JIS read as GBK). UTF-8 read as
#: Big5 or EUC-KR loses bytes nearly everywhere, so it is found by its replacement characters.
CHAINS = [(w, r) for w in SINGLE for r in ("utf-8", "euc_jp", "cp932")] + [(w, "utf-8") for w in DOUBLE] + [("cp932", "euc_jp")]
LOST = "�"


def _single_table(codec: str) -> dict[str, int]:
    """Characters of the bytes 0x80..0xFF; undefined bytes, and those of Latin-1, stand for themselves where free."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
        if codec == "cp1252":
            table.setdefault(chr(b), b)
    return table


def _class(table: dict[str, int], lo: int, hi: int, ascii_too: str = "") -> str:
    return "[" + ascii_too + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"


@lru_cache(1)
def _single():
    """For each one-byte codec: byte table, and patterns of stretches that are well-formed UTF-8, EUC-JP, Shift_JIS."""
    out = {}
    for codec in SINGLE:
        t = _single_table(codec)
        cont = _class(t, 0x80, 0xBF)
        utf8 = f"(?:{_class(t, 0xC2, 0xDF)}{cont}|{_class(t, 0xE0, 0xEF)}{cont}{{2}}|{_class(t, 0xF0, 0xF4)}{cont}{{3}})+"
        pair = _class(t, 0xA1, 0xFE)
        euc = f"(?:{pair}{{2}})+"
        low = "@-~"
        lead = f"(?:{_class(t, 0x81, 0x9F)}|{_class(t, 0xE0, 0xFC)})"
        # one character alone counts only where its second byte isn't ASCII either
        unit = f"(?:{lead}{_class(t, 0x80, 0xFC, low)}|{_class(t, 0xA1, 0xDF)})"
        sjis = f"{unit}{{2,}}|{lead}{_class(t, 0x80, 0xFC)}"
        out[codec] = (t, {"utf-8": re.compile(utf8), "euc_jp": re.compile(euc), "cp932": re.compile(sjis)})
    return out


#: characters of two bytes (accented Latin, Greek, Cyrillic) and of three; an ASCII character may stand between two of them.
#: As any ideograph may be a character of two bytes, fewer than four, without two neighbours of three bytes, count only next
#: to an ASCII letter, or with ASCII or an end of the text on both sides.
_TWO, _THREE = rb"[\xc2-\xdf][\x80-\xbf]", rb"[\xe2-\xef][\x80-\xbf]{2}"
_ONE = rb"(?:" + _TWO + rb"|" + _THREE + rb")"
_MORE = rb"(?:[\x00-\x7f]?" + _ONE + rb")"
_FEW = _ONE + _MORE + rb"{0,2}+"
_UTF8 = re.compile(
    rb"(?:" + _TWO + rb"[\x00-\x7f]?)*+" + _THREE + rb"[\x00-\x7f]?" + _THREE + _MORE + rb"*+|" + _ONE + _MORE + rb"{3,}+"
    rb"|(?<=[A-Za-z])" + _FEW + rb"|" + _FEW + rb"(?=[A-Za-z])|(?<![\x80-\xff])" + _FEW + rb"(?![\x80-\xff])"
)
_IDEOGRAPHS = re.compile(_THREE + rb"[\x00-\x7f]?" + _THREE)
_CORE = re.compile(_THREE + rb"(?:[\x00-\xff]*" + _THREE + rb")?")


@lru_cache(1)
def _double():
    """For each two-byte codec: the characters without which it can't hold UTF-8. And, for EUC-JP read as Shift_JIS, where
    bytes don't synchronise themselves, the pattern of characters all of whose bytes may belong to EUC-JP."""
    utf8: dict[str, set[str]] = {codec: set() for codec in DOUBLE}
    euc = []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        for codec in DOUBLE:
            try:
                b = chr(cp).encode(codec)
            except UnicodeEncodeError:
                continue
            if len(b) == 2 and (0xC2 <= b[0] <= 0xDF or 0xE2 <= b[0] <= 0xEF) and 0x80 <= b[1] <= 0xBF or len(b) == 1 and 0xC2 <= b[0] <= 0xDF:
                utf8[codec].add(chr(cp))
            if codec == "cp932" and min(b) >= 0xA1:
                euc.append(chr(cp))
    return {k: frozenset(v) for k, v in utf8.items()}, re.compile("[" + "".join(map(re.escape, euc)) + "]{2,}")


#: classes of bytes: lead and continuation of UTF-8, half of a pair of EUC-JP, lead and single byte of Shift_JIS, any high byte of it
_BYTES = {"lead": (0xC2, 0xF4), "cont": (0x80, 0xBF), "pair": (0xA1, 0xFE), "low": (0x81, 0x9F), "high": (0xE0, 0xFC), "half": (0xA1, 0xDF), "trail": (0x80, 0xFC)}


def _features() -> dict[str, int]:
    """A bit for every question asked of a character."""
    names = [f"{kind}:{c}" for c in SINGLE for kind in _BYTES] + [f"signal:{c}" for c in DOUBLE] + ["half", "lost", "stray", "tail"]
    return {n: 1 << i for i, n in enumerate(names)}


BITS = _features()
_SINGLE_BITS = sum(b for n, b in BITS.items() if n.split(":")[-1] in SINGLE)


@lru_cache(1)
def _feature_table() -> np.ndarray:
    """Bits of every character of the first plane; the rest has none."""
    table = np.zeros(0x10001, np.int64)
    for codec in SINGLE:
        for c, byte in _single_table(codec).items():
            for kind, (lo, hi) in _BYTES.items():
                if lo <= byte <= hi:
                    table[ord(c)] |= BITS[f"{kind}:{codec}"]
    for codec, signal in _double()[0].items():
        table[[ord(c) for c in signal]] |= BITS[f"signal:{codec}"]
    table[0xFF61:0xFFA0] |= BITS["half"]
    table[0xFFFD] |= BITS["lost"]
    table[0x80:0xA0] |= BITS["stray"]
    table[0xE000:0xF900] |= BITS["stray"]
    table[0x40:0x7F] |= BITS["tail"]
    return table


def text_features(texts: list[str]) -> tuple[list[int], list[dict[tuple[str, str], list[int]]]]:
    """The bits of each text, and for each chain from a one-byte codec the places where a stretch may begin, by one pass over all
    of them. Everything a pattern of _single matches begins at such a place."""
    codes = np.frombuffer("\n".join([*texts, "\n\n"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    flags = _feature_table()[np.minimum(codes, 0x10000)]
    bits = np.bitwise_or.reduceat(flags, starts[:-1]) if texts else np.zeros(0, np.int64)
    places: list[dict[tuple[str, str], list[int]]] = [{} for _ in texts]
    at = np.flatnonzero(flags & _SINGLE_BITS)
    here, after, third = flags[at], flags[at + 1], flags[np.minimum(at + 2, len(flags) - 1)]
    # all but a few characters have no neighbour of their kind
    some = ((after & _SINGLE_BITS) != 0) | ((after & BITS["tail"]) != 0) & ((third & _SINGLE_BITS) != 0)
    at, here, after, third = at[some], here[some], after[some], third[some]
    if not len(at):
        return bits.tolist(), places
    for codec in SINGLE:
        bit = {k: BITS[f"{k}:{codec}"] for k in _BYTES}
        opens = bit["low"] | bit["high"]
        unit = opens | bit["half"]
        fits = {
            "utf-8": (here & bit["lead"] != 0) & (after & bit["cont"] != 0),
            "euc_jp": (here & bit["pair"] != 0) & (after & bit["pair"] != 0),
            "cp932": (here & opens != 0) & ((after & bit["trail"] != 0) | (after & BITS["tail"] != 0) & (third & unit != 0)) | (here & bit["half"] != 0) & (after & unit != 0),
        }
        for right, ok in fits.items():
            own = at[ok]
            for i, p in zip((np.searchsorted(starts, own, side="right") - 1).tolist(), own.tolist()):
                places[i].setdefault((codec, right), []).append(p - int(starts[i]))
    return bits.tolist(), places


def stretch_starts(raws: list[bytes]) -> list[list[int]]:
    """For each encoded text the places where a stretch of UTF-8 may begin: a well-formed character of two or three bytes that
    is followed by another one, with at most one ASCII byte between, or has an ASCII byte or an end of the text beside it.
    Everything _UTF8 matches begins at such a place."""
    arr = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n\0\0\0\0\0", dtype=np.uint8)
    n = len(arr) - 5
    cont = (arr & 0xC0) == 0x80
    ascii_ = arr < 0x80
    two = (arr[:n] >= 0xC2) & (arr[:n] <= 0xDF) & cont[1 : n + 1]
    three = (arr[:n] >= 0xE2) & (arr[:n] <= 0xEF) & cont[1 : n + 1] & cont[2 : n + 2]
    at = np.flatnonzero(two | three)
    if not len(at):
        return [[] for _ in raws]
    size = np.zeros(len(arr) + 8, np.int8)  # of the character that begins at a place
    size[at] = np.where(three[at], 3, 2)
    letter = np.zeros(len(arr) + 8, bool)
    letter[: len(arr)] = ((arr | 0x20) >= 0x61) & ((arr | 0x20) <= 0x7A)
    plain = np.zeros(len(arr) + 8, bool)
    plain[: len(arr)] = ascii_

    def following(end: np.ndarray) -> np.ndarray:
        """Place of the next character, at most one ASCII byte on; the last place, where none begins, if there is none."""
        return np.where(size[end] > 0, end, np.where(plain[end] & (size[end + 1] > 0), end + 1, len(size) - 3))

    end = at + size[at]
    second = following(end)
    end2 = second + size[second]
    third = following(end2)
    has2, has3 = size[second] > 0, (size[second] > 0) & (size[third] > 0)
    before, word = plain[at - 1], letter[at - 1]
    alone = plain[end] & (letter[end] | before)
    pair = has2 & ((size[at] == 3) & (size[second] == 3) | plain[end2] & (letter[end2] | before))
    at = at[has3 | pair | alone | word]
    bounds = np.cumsum([1, *[len(r) + 1 for r in raws]])
    cuts = np.searchsorted(at, bounds)
    return [(at[cuts[i] : cuts[i + 1]] - bounds[i]).tolist() for i in range(len(raws))]


def _sub(error):
    # a byte that is no part of UTF-8 and no ASCII either
    return (b"\xff" * (error.end - error.start), error.end)


codecs.register_error("kikitori_sub", _sub)


def _decoded(raw: bytes, codec: str) -> str | None:
    """The longest well-formed part from the start, if the stretch isn't well-formed as a whole."""
    try:
        return raw.decode(codec)
    except UnicodeDecodeError as e:
        return raw[: e.start].decode(codec) or None


def _stretches(raw: bytes, starts: list[int]) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of every stretch that may be UTF-8. An ideograph of clean text next to it may look like a character
    of two bytes: a stretch that begins or ends with such comes without them too."""
    end = 0
    for at in starts:
        if at < end or not (m := _UTF8.match(raw, at)):
            continue
        start, stretch, end = at, m.group(), m.end()
        yield start, stretch
        if (core := _CORE.search(stretch)) and len(core.group()) < len(stretch):
            yield start + core.start(), core.group()


def _single_candidates(text: str, places: dict[tuple[str, str], list[int]]) -> Iterator[tuple[int, int, str, str]]:
    for (codec, right), starts in places.items():
        table, patterns = _single()[codec]
        pattern, end = patterns[right], 0
        for at in starts:
            if at < end or not (m := pattern.match(text, at)):
                continue
            end = m.end()
            raw = bytes(table.get(c) or ord(c) for c in m.group())
            got = _decoded(raw, right)
            if not got:
                continue
            used = len(got.encode(right))
            yield at, at + used, got, f"{codec}>{right}"
            if right == "utf-8":  # decoded wrongly twice
                again = pattern.sub(lambda x: _decoded(bytes(table.get(c) or ord(c) for c in x.group()), right) or x.group(), got)
                if again != got:
                    yield at, at + used, again, f"{codec}>{right}>{right}"


def _double_candidates(text: str, codec: str, raw: bytes, starts: list[int]) -> Iterator[tuple[int, int, str, str]]:
    at, at_char = 0, 0  # start of a line, in bytes and in characters
    for start, stretch in _stretches(raw, starts):
        got = _decoded(stretch, "utf-8")
        if not got or len(got) == 1 and not "\u00a0" <= got < "\u0250":  # alone, only a letter or mark of Latin tells
            continue
        end = start + len(got.encode("utf-8"))
        # positions in characters; a stretch that cuts a character in two is garbled, but not restored here
        if (line := raw.rfind(b"\n", at, start) + 1) > at:
            at, at_char = line, at_char + len(raw[at:line].decode(codec, "replace"))
        a = at_char + len(raw[at:start].decode(codec, "replace"))
        b = a + len(raw[start:end].decode(codec, "replace"))
        back = text[a:b].encode(codec, "kikitori_sub")
        if back == raw[start:end]:
            yield a, b, got, f"{codec}>utf-8"
        elif back == raw[start : end + 1] and back[-1] < 0x80:
            # the last byte took the ASCII character behind it for its second half
            yield a, b, got + chr(back[-1]), f"{codec}>utf-8"
        elif _IDEOGRAPHS.search(stretch):
            yield max(a - 1, 0), min(b + 1, len(text)), got, f"{codec}>utf-8?"


def _shifted_candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """EUC-JP read as Shift_JIS."""
    for m in _double()[1].finditer(text):
        raw = m.group().encode("cp932", "kikitori_sub")
        for skip in (0, 1):  # behind a lost byte the pairs are out of step
            got = _decoded(raw[skip:], "euc_jp")
            if not got:
                continue
            if skip == 0 and len(got.encode("euc_jp")) == len(raw):
                yield m.start(), m.end(), got, "cp932>euc_jp"
            elif len(got) >= 2:
                whole = raw[: skip + len(got.encode("euc_jp"))].decode("cp932", "replace")
                yield m.start(), min(m.start() + len(whole), m.end()), got, "cp932>euc_jp?"


def batch_candidates(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, str, str]]]]:
    """For each text its feature bits and (start, end, restored, chain) of every stretch some chain applies to."""
    bits, places = text_features(texts)
    found: list[list[tuple[int, int, str, str]]] = [list(_single_candidates(t, p)) if p else [] for t, p in zip(texts, places)]
    for codec in DOUBLE:
        which = [i for i, b in enumerate(bits) if b & BITS[f"signal:{codec}"]]
        raws = [texts[i].encode(codec, "kikitori_sub") for i in which]
        for i, raw, starts in zip(which, raws, stretch_starts(raws)):
            if starts:
                found[i] += _double_candidates(texts[i], codec, raw, starts)
    for i, b in enumerate(bits):
        if b & BITS["half"]:
            found[i] += _shifted_candidates(texts[i])
    return zip(bits, found)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, restored, chain) of every stretch some chain applies to."""
    return next(batch_candidates([text]))[1] if text else []


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hash1(c: np.ndarray) -> np.ndarray:
    return ((c * np.uint64(0x9E3779B1)) >> np.uint64(7)).astype(np.int64) & (UNIGRAMS - 1)


def _hash2(c: np.ndarray) -> np.ndarray:
    x = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(40)).astype(np.int64) & (BIGRAMS - 1)


class BigramModel:
    """Log-likelihoods from hashed counts, unigram-smoothed."""

    def __init__(self, unigrams: np.ndarray, bigrams: np.ndarray):
        self.uni, self.bi = unigrams.astype(np.float64), bigrams.astype(np.float64)
        self.total = float(self.uni.sum())

    def _logs(self, c: np.ndarray) -> np.ndarray:
        """log P(c | c before) of all characters but the first."""
        h1 = _hash1(c)
        uni = self.uni[h1]
        p1 = (uni[1:] + 0.5) / (self.total + 0.5 * UNIGRAMS)
        return np.log((self.bi[_hash2(c)] + BACKOFF * p1) / (uni[:-1] + BACKOFF))

    def score(self, text: str) -> tuple[float, int]:
        """Sum of log P(c | c before) over the text but its first character, and the number of terms."""
        c = _codes(text)
        if len(c) < 2:
            return 0.0, 0
        return float(self._logs(c).sum()), len(c) - 1

    def scores(self, texts: list[str], at_once: int = 50_000) -> Iterator[tuple[float, int]]:
        """:meth:`score` of many texts of at least two characters."""
        for i in range(0, len(texts), at_once):
            part = texts[i : i + at_once]
            lengths = np.array([len(t) for t in part])
            p = self._logs(_codes("".join(part)))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            p = np.append(p, 0.0)
            p[starts[1:] - 1] = 0.0  # from the end of one text to the next
            yield from zip(np.add.reduceat(p, starts).tolist(), (lengths - 1).tolist())


def _sides(text: str, found: list[tuple[int, int, str, str]]) -> list[str]:
    """Each candidate as it stands and restored, with a character around it."""
    strings: list[str] = []
    for a, b, got, _ in found:
        left, right = text[max(a - 1, 0) : a] or "\n", text[b : b + 1] or "\n"
        strings += (left + text[a:b] + right, left + got + right)
    return strings


def _paired(sums: Iterator[tuple[float, int]], found: list[list[tuple[int, int, str, str]]]) -> list[list[tuple[float, float]]]:
    out = []
    for own in found:
        pairs = []
        for _ in own:
            (as_is, n), (better, m) = next(sums), next(sums)
            pairs.append((better / m - as_is / n, better - as_is))
        out.append(pairs)
    return out


def batch_gains(texts: list[str], model: BigramModel, found: list[list[tuple[int, int, str, str]]]) -> list[list[tuple[float, float]]]:
    """For the candidates of each text (gain a character, total gain), scored in one pass."""
    return _paired(iter(model.scores([s for t, own in zip(texts, found) for s in _sides(t, own)])), found)


def held_out_gains(texts: list[str], model: BigramModel, found: list[list[tuple[int, int, str, str]]]) -> list[list[tuple[float, float]]]:
    """:func:`batch_gains` of texts that were counted whole, each by the model of all text but itself."""
    return _paired((s for t, own in zip(texts, found) for s in _scores_without(t, model, _sides(t, own))), found)


def _scores_without(text: str, model: BigramModel, strings: list[str]) -> Iterator[tuple[float, int]]:
    if not strings:
        return
    own = _codes("\n" + text + "\n")
    own1, own2 = _hash1(own[:-1]), _hash2(own)
    np.subtract.at(model.uni, own1, 1.0)
    np.subtract.at(model.bi, own2, 1.0)
    rest, model.total = model.total, model.total - len(own1)
    got = list(model.scores(strings))
    model.total = rest
    np.add.at(model.uni, own1, 1.0)
    np.add.at(model.bi, own2, 1.0)
    yield from got


def _gains(text: str, model: BigramModel, found: list[tuple[int, int, str, str]]) -> Iterator[tuple[float, float, int, int, str, str]]:
    """(gain a character, total gain, start, end, restored, chain) of candidates, each with a character around it."""
    for gained, candidate in zip(batch_gains([text], model, [found])[0], found):
        yield *gained, *candidate


def judge(text: str, model: BigramModel, found: list[tuple[int, int, str, str]], margin: float = MARGIN) -> list[tuple[int, int, str, str]]:
    """The accepted stretches: of overlapping candidates the one that gains most."""
    scored = [(total, a, b, got, chain) for gain, total, a, b, got, chain in _gains(text, model, found) if gain > margin and total > TOTAL_MARGIN]
    taken: list[tuple[int, int, str, str]] = []
    for _, a, b, got, chain in sorted(scored, key=lambda x: -x[0]):
        if all(b <= x or y <= a for x, y, *_ in taken):
            taken.append((a, b, got, chain))
    return sorted(taken)


def restore(text: str, model: BigramModel, margin: float = MARGIN, found: list[tuple[int, int, str, str]] | None = None) -> tuple[str, int, str]:
    """The text with every accepted stretch restored, their number, and the chains used. ``found``: its candidates, if known."""
    count, chains = 0, []
    for _ in range(ROUNDS):
        taken = judge(text, model, candidates(text) if found is None else found, margin)
        found = None
        if not taken:
            break
        count += len(taken)
        chains += [t[3] for t in taken]
        parts, at = [], 0
        for a, b, got, chain in taken:
            parts += [text[at:a], text[a:b] if chain.endswith("?") else got]
            at = b
        changed = "".join([*parts, text[at:]])
        if changed == text:
            break
        text = changed
    return text, count, ",".join(sorted(set(chains)))


_KANA = re.compile("[\u3041-\u30ff]")


def _is_telling(text: str, a: int, b: int, got: str, chain: str) -> bool:
    """A stretch that clean text hardly ever holds. Ideographs of clean text often fit UTF-8 read as GBK and the like, accented
    letters EUC-JP or Shift_JIS: these tell only where kana come out, or accented letters next to a plain one."""
    wrong, right = chain.split(">")[0], chain.rstrip("?").split(">")[-1]
    kana = len(got) > 1 and bool(_KANA.search(got))
    if right == "utf-8" and (wrong in SINGLE or wrong == "cp932"):
        return len(got) > 1 or "\u00a0" <= got < "\u0250" or got >= "\u2000"
    if wrong in SINGLE or wrong == "cp932":
        return kana or len(got) > 3
    return kana or _in_latin_word(text, a, b, got)


def _in_latin_word(text: str, a: int, b: int, got: str) -> bool:
    """A stretch that would be accented letters, next to a plain one."""
    return any("\u00c0" <= c < "\u0250" for c in got) and any(c.isascii() and c.isalpha() for c in text[max(a - 1, 0) : a] + text[b : b + 1])


def training_text(text: str, bits: int, found: list[tuple[int, int, str, str]]) -> str | None:
    """What of a text is clean beyond doubt: telling stretches, with two characters around them, are cut out. None for a text
    with lost, stray control or private characters."""
    if bits & (BITS["lost"] | BITS["stray"]):
        return None
    parts, at = [], 0
    for a, b, got, chain in sorted(found):
        if _is_telling(text, a, b, got, chain):
            parts.append(text[at : max(at, a - 2)])
            at = max(at, b + 2)
    return "\n".join([*parts, text[at:]]) if parts else text


SUMMERS = 16  # tasks that sum them
RANGES = 64  # parts of the table of counts that are summed by themselves
COUNTS = "part int, counts binary"


def _portions(column: pa.Array, size: int = 1_000_000) -> Iterator[list[tuple[int, str]]]:
    """The texts of a batch with their places, about ``size`` characters at once, as arrays over whole batches take much memory."""
    part: list[tuple[int, str]] = []
    n = 0
    for k, t in enumerate(column.to_pylist()):
        if t:
            part.append((k, t))
            n += len(t)
            if n > size:
                yield part
                part, n = [], 0
    if part:
        yield part


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text that holds candidates or lost characters: id, text, its candidates, whether it was counted whole. Then the
    counts of the clean text of a task, in RANGES rows of compressed counts, and one with the number of texts counted whole."""
    counts = np.zeros(UNIGRAMS + BIGRAMS, np.int64)
    pending: list[str] = []
    size = whole = 0
    kind = None

    def count() -> None:
        nonlocal pending, size
        if pending:
            c = _codes("\n" + "\n".join(pending) + "\n")
            counts[:UNIGRAMS] += np.bincount(_hash1(c), minlength=UNIGRAMS)
            counts[UNIGRAMS:] += np.bincount(_hash2(c), minlength=BIGRAMS)
        pending, size = [], 0

    for batch in batches:
        kind = batch.schema.field(0).type
        at, kept = [], []
        for (k, t), (bits, found) in (x for p in _portions(batch.column(1)) for x in zip(p, batch_candidates([t for _, t in p]))):
            clean = training_text(t, bits, found)
            if clean:
                pending.append(clean)
                whole += clean is t
                size += len(clean)
                if size > 2_000_000:
                    count()
            if found or bits & BITS["lost"]:
                at.append(k)
                kept.append((pickle.dumps(found), clean is t))
        if at:
            place = pa.array(at, pa.int64())
            nothing = [pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())]
            own = [batch.column(0).take(place), batch.column(1).take(place), pa.array([f for f, _ in kept], pa.binary()), pa.array([w for _, w in kept], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*nothing, *own], names=["part", "counts", "id", "text", "found", "whole"])
    count()
    if counts.any():
        rows = _count_rows([*np.split(counts, RANGES), np.array([whole], np.int64)])
        empty = [pa.nulls(rows.num_rows, t) for t in (kind, pa.string(), pa.binary(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*rows.columns, *empty], names=["part", "counts", "id", "text", "found", "whole"])


def _surveyed(named: DataFrame) -> DataFrame:
    kind = dict(named.dtypes)["id"]
    return named.mapInArrow(_survey, f"{COUNTS}, id {kind}, text string, found binary, whole boolean")


def _count_rows(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "counts"]
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each part that comes by; as many are held as there are parts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(blob), np.int64)
            sums[part] = sums[part] + own if part in sums else own
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in sums.values()], pa.binary())], names=["part", "counts"]
        )


def _summed(surveyed: DataFrame) -> tuple[BigramModel, int]:
    """The model, and the number of texts counted whole. Tasks send compressed counts, which are summed part by part;
    UNIGRAMS + BIGRAMS counts come to the driver, whatever the corpus."""
    rows = surveyed.where("part IS NOT NULL").select("part", "counts").repartition(SUMMERS, "part").mapInArrow(_merge, COUNTS).collect()
    parts = {r["part"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows}
    flat = np.concatenate([parts[i] for i in range(RANGES)]) if parts else np.zeros(UNIGRAMS + BIGRAMS, np.int64)
    return BigramModel(flat[:UNIGRAMS], flat[UNIGRAMS:]), int(parts[RANGES][0]) if parts else 0


def train_model(texts: DataFrame) -> BigramModel:
    """The model of all clean text in the one column of ``texts``."""
    return _summed(_surveyed(texts.select(F.lit(0).alias("id"), F.col(texts.columns[0]).alias("text"))))[0]


def validated_margin(texts: list[str], model: BigramModel, least: float = MARGIN) -> float:
    """The smallest margin, ``least`` at least, by which no stretch of the clean records among ``texts``, which the model doesn't
    know, would be changed. Clean are those without telling stretches and lost or stray characters."""
    top = least
    for t, (bits, found) in zip(texts, batch_candidates(texts)):
        if training_text(t, bits, found) is t:
            for gain, total, *_ in _gains(t, model, found):
                if total > TOTAL_MARGIN:
                    top = max(top, gain + 1e-6)
    return top


def margin_of(classes: dict[int, int], n: int, least: float = MARGIN) -> float:
    """The smallest margin, ``least`` at least, that but one in CHANGED of ``n`` clean records exceed, and one at least.
    ``classes``: the number of clean records by gain, in whole steps of GAIN_STEP."""
    beyond = 0
    for step in sorted(classes, reverse=True):
        beyond += classes[step]
        if beyond > max(1, n // CHANGED):
            return max(least, (step + 1) * GAIN_STEP)
    return least


def _scored(shared, least: float, validate: bool):
    """Of surveyed texts those that may gain more than ``least``, or have lost characters: id, text, and their gains a character
    with the candidates that do. With ``validate`` also how many clean records gain how much more by the model of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BigramModel(*shared.value)
        classes: dict[int, int] = {}
        kind = None
        names = ["id", "text", "found", "gain_step", "n"]
        for batch in batches:
            kind = batch.schema.field(0).type
            texts, whole = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            found = [pickle.loads(f) for f in batch.column(2).to_pylist()]
            if validate:
                clean = [k for k, w in enumerate(whole) if w]
                for gained in held_out_gains([texts[k] for k in clean], model, [found[k] for k in clean]):
                    gain = max((g for g, total in gained if total > TOTAL_MARGIN), default=least)
                    if gain > least:
                        step = int(gain // GAIN_STEP)
                        classes[step] = classes.get(step, 0) + 1
            at, better = [], []
            for k, (t, own, gained) in enumerate(zip(texts, found, batch_gains(texts, model, found))):
                gainful = [(g, x) for x, (g, total) in zip(own, gained) if g > least and total > TOTAL_MARGIN]
                if gainful or LOST in t:
                    at.append(k)
                    better.append(pickle.dumps(gainful))
            if at:
                own = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(better, pa.binary()), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], names=names)
        if classes:
            empty = [pa.nulls(len(classes), t) for t in (kind, pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(list(classes), pa.int32()), pa.array(list(classes.values()), pa.int64())], names=names)

    return run


def find_garbled(df: DataFrame, id_column: str, text: str, margin: float | None = None) -> DataFrame:
    """Id, restored, n_passages, chains, lost for every garbled record. ``lost``: replacement characters remain. Every clean
    record is counted; without a given margin every one of them takes part in validating it too."""
    named = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = dict(named.dtypes)["id"]
    surveyed, survey = cut(_surveyed(named), "garbled-survey")
    model, n = _summed(surveyed)
    shared = df.sparkSession.sparkContext.broadcast((model.uni, model.bi))  # UNIGRAMS + BIGRAMS counts
    least = MARGIN if margin is None else margin
    held = surveyed.where("text IS NOT NULL").select("id", "text", "found", "whole")
    scored, _ = cut(held.mapInArrow(_scored(shared, least, margin is None), f"id {kind}, text string, found binary, gain_step int, n bigint"), "garbled-scored")
    drop_table(df.sparkSession, survey)
    if margin is None:
        classes = scored.where("gain_step IS NOT NULL").groupBy("gain_step").agg(F.sum("n").alias("n")).collect()
        margin = margin_of({r["gain_step"]: r["n"] for r in classes}, n)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BigramModel(*shared.value)
        for batch in batches:
            rows, at = [], []
            for k, (t, gainful) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = [x for gain, x in pickle.loads(gainful) if gain > margin]
                restored, n, chains = restore(t, own, margin, found)
                if n or LOST in t:
                    at.append(k)
                    rows.append((restored, n, chains, LOST in restored))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "restored", "n_passages", "chains", "lost"])

    garbled = scored.where("text IS NOT NULL").select("id", "text", "found")
    return garbled.mapInArrow(judged, f"id {kind}, restored string, n_passages int, chains string, lost boolean").withColumnRenamed("id", id_column)


def margin_table(texts: list[str], model: BigramModel, margins: list[float]) -> list[tuple[float, float, float]]:
    """(margin, share of clean texts changed, share of garbled texts restored exactly) on held-out clean texts, each garbled
    by every chain that can garble it without loss."""
    garbled = []
    for t in texts:
        for wrong, right in CHAINS:
            try:
                g = t.encode(right).decode("latin-1" if wrong == "cp1252" else wrong)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            if g != t:
                garbled.append((g, t))
    return [
        (m, sum(restore(t, model, m)[0] != t for t in texts) / max(1, len(texts)), sum(restore(g, model, m)[0] == t for g, t in garbled) / max(1, len(garbled)))
        for m in margins
    ]
