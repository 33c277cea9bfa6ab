"""Text that was decoded in another encoding than it was written in.

Round-trip repair: a passage is encoded again in a candidate legacy encoding and strictly
decoded as the encoding it was written in; the change is kept when a garbling cost drops, and
the steps repeat for nested layers.

The cost has two parts. One is the same for all texts: scripts mixed within a word, controls, symbols
inside words. The other is learned: words and signs with other characters than ASCII are counted over all texts
of the corpus (``learn``), and a passage that no rule can tell from a clean one is taken for garbled when each
of its words and signs is far rarer than what the round trip makes of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..core.session import materialise

#: Encodings that UTF-8 is commonly misread in, most common first.
MISREAD_UTF8 = (
    "cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "cp1253", "cp1257",
    "cp1255", "cp1256", "cp1258", "cp874", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-8", "iso8859-9", "iso8859-15", "cp852", "cp866",
    "koi8-r", "koi8-u", "mac_cyrillic", "mac_greek",
)
#: Encodings of several bytes that UTF-8 is misread in; they have no table of single bytes.
MISREAD_WIDE = ("gb18030", "big5", "shift_jis", "euc_kr")
#: Readings whose lead and continuation bytes are no letters of one script; one sequence in them is evidence enough.
WESTERN = frozenset(("cp1252", "latin-1", "cp1254", "iso8859-9", "iso8859-15", "mac_roman", "cp437", "cp850"))
#: (read as, written in) of single-byte encodings that are mistaken for one another.
MISREAD_BYTES = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"),
    ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp1250", "cp1252"), ("cp1252", "cp1250"),
    ("latin-1", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "koi8-r"), ("cp1253", "cp1252"), ("cp1252", "cp1253"), ("cp1252", "iso8859-7"), ("latin-1", "iso8859-2"), ("cp1252", "cp1254"),
    ("cp1252", "cp866"), ("mac_roman", "cp1251"), ("cp1252", "cp1255"), ("cp1252", "cp1256"), ("cp1252", "cp1257"), ("cp1252", "cp874"),
)
LOST = "\ufffd"
#: Layer of a text whose only trace is U+FFFD: it was read as UTF-8, and what its bytes were is gone.
REPLACED = "utf-8<?"
#: Most words and signs of the learned part, by a threshold on their counts (some 20 MB in a worker).
MAX_FEATURES = 200_000
#: How many times as common a passage's words and signs must become for the learned part to take it for garbled, and in how many texts at least.
CLEARLY = 10
SEEN = 3
#: Longest passage whose cost a worker remembers, and longest word that is learned.
_REMEMBERED = 64
_LONGEST = 24


@lru_cache(None)
def byte_table(encoding: str) -> tuple[tuple[str, ...], dict[str, int]]:
    """Character of each byte and back; bytes the encoding leaves open stand for the control of the same number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return tuple(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def _class(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


@lru_cache(None)
def _utf8_runs(encoding: str) -> re.Pattern:
    """Runs of valid multi-byte UTF-8 sequences as they look when misread in ``encoding``."""
    t = byte_table(encoding)[0]
    c = _class(t[0x80:0xC0])
    two = _class(t[0xC2:0xE0]) + c
    three = "(?:" + _class(t[0xE0]) + _class(t[0xA0:0xC0]) + c + "|" + _class(t[0xE1:0xF0]) + c + "{2})"
    four = "(?:" + _class(t[0xF0]) + _class(t[0x90:0xC0]) + c + "{2}|" + _class(t[0xF1:0xF4]) + c + "{3})"
    return re.compile(f"(?:{four}|{three}|{two})+")


@lru_cache(200_000)
def _kind(ch: str) -> str:
    """Letter of a script (``L`` Latin, ``C`` Cyrillic, ``G`` Greek, ``I`` phonetic, ``X`` others), in
    lower or upper case (``l``/``u``), or mark, digit, blank, opening or closing punctuation, odd symbol, wrong."""
    o = ord(ch)
    cat = unicodedata.category(ch)
    if ch == LOST or 0x7F <= o < 0xA0 and o != 0x85 or o < 32 and ch not in "\t\n\r\f\v":
        return "wrong"
    if cat in ("Co", "Cn", "Cs"):
        return "unknown"
    if cat[0] == "L" or cat == "Nl":
        if 0x250 <= o < 0x2B0:
            script = "I"
        elif cat == "Lm" or ch in "ªº":
            return "modifier" if o not in (0xAA, 0xBA) else "odd"
        elif o < 0x250 or 0x1E00 <= o < 0x1F00:
            script = "L"
        elif 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
            script = "G"
        elif 0x400 <= o < 0x530:
            script = "C"
        elif 0xFB00 <= o < 0xFB07:
            script = "L"
        else:
            script = "X"
        return script + ("u" if cat in ("Lu", "Lt") else "l") + ("" if o < 128 else "n")
    if cat[0] == "M":
        return "mark"
    if cat[0] == "Z" or cat == "Cc":
        return "blank"
    if o < 128:
        return "digit" if cat == "Nd" else "ascii"
    if ch in "«‹“„‘‚¿¡":
        return "open"
    if ch in "»›”’…":
        return "close"
    if ch in "–—―‐‑":
        return "dash"
    if cat == "Cf":
        return "soft" if o == 0xAD else "format"
    if 0x2190 <= o < 0x2200 or 0x2600 <= o < 0x2800 or o >= 0x3000:
        return "wide"
    return "odd"


_LEADS = "ÂÃâ"


#: ASCII characters cost nothing beside one another, so only the surroundings of others are read.
_RUN = re.compile(r"[^\x00-\x7f]+")
_MULTI = re.compile(r"[^\x00-\x7f]{2,}")


def cost(text: str) -> int:
    """How garbled a passage looks; 0 for clean text in common languages."""
    total, start, end, last = 0, -1, 0, 0
    for m in _RUN.finditer(text):
        s, e = m.span()
        if start < 0:
            start = s
        elif s - end > 2:
            total += _cost(text[max(last, start - 2) : end + 2])
            start, last = s, end + 2
        end = e
    return total if start < 0 else total + _cost(text[max(last, start - 2) : end + 2])


def _cost(text: str) -> int:
    return _cost_remembered(text) if len(text) <= _REMEMBERED else _cost_of(text)


def _cost_of(text: str) -> int:
    total = 0
    prev, prev_ch = "blank", " "
    for i, ch in enumerate(text):
        k = "ascii" if ch == "·" and prev_ch in "lL" and text[i + 1 : i + 2] in ("l", "L") else _kind(ch)  # so Catalan is spelt
        if k == "wrong" or k == "unknown":
            total += 3
        pl, l = prev[0] in "LCGIX" and prev[1:2] in ("l", "u"), k[0] in "LCGIX" and k[1:2] in ("l", "u")
        if pl and l:
            a, b = prev[0], k[0]
            if a != b and not ({a, b} == {"L", "I"}) and not ({a, b} == {"G", "I"}):
                total += 3  # scripts mixed in a word
            elif {a, b} == {"L", "I"} and "u" in (prev[1], k[1]):
                total += 3  # phonetic signs beside a capital
            elif prev[1] == "l" and k[1] == "u" and (prev[2:] or k[2:]):
                total += 1  # a capital inside a word
            elif a == "L" and prev[1] == "u" and k == "Lln" and prev[2:]:
                total += 1
            elif a == "L" and prev_ch in "ÂÃ" and k[2:]:
                total += 1
        elif pl and k == "odd":
            total += 2 if prev[2:] else 1
        elif prev == "odd" and l:
            total += 1 if prev_ch not in "°£€¥№µ" or k[2:] else 0
        elif prev == "odd" and k == "odd":
            total += 1
        elif pl and prev[2:] and k == "soft":
            total += 2
        elif k == "soft" and not pl:
            total += 1
        elif pl and k == "open":
            glued = _kind(text[i + 1])[0] in "LCGIX" if i + 1 < len(text) else False
            total += glued or ch not in "“‘" or prev_ch in _LEADS
        elif l and prev in ("close", "dash") and i > 1 and prev_ch != "’" and _kind(text[i - 2])[1:] == "un":
            total += 1  # a mark between an accented capital and a letter
        elif pl and prev_ch in _LEADS and k in ("close", "dash", "wrong"):
            total += 1
        elif prev_ch in "ÂÃ" and ch == "\xa0":
            total += 1
        elif pl and k == "modifier" and ord(ch) in range(0x2C6, 0x2DE) and ch not in "ˈːˌˑʰ" or prev == "modifier" and l and ord(prev_ch) in range(0x2D8, 0x2DE):
            total += 1
        elif k != "ascii" and pl and ch == "·" or prev == "odd" and prev_ch == "·" and l:
            total += 1
        prev, prev_ch = k, ch
    return total


_cost_remembered = lru_cache(100_000)(_cost_of)

_WORD = re.compile(r"[^\W\d_]+|[^\x00-\x7f]")
_BLANK = re.compile(r"[ \t\r\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[^\x00-\x7f]")


def _side(ch: str) -> str:
    return "a" if ch.isalpha() else "0" if ch.isdigit() else " " if ch.isspace() or not ch else ch


def features(text: str) -> list[str]:
    """Words in lower case, letters outside ASCII, and other signs outside ASCII with the kinds of their neighbours."""
    out = []
    for m in _WORD.finditer(text):
        token = m.group()
        if token[0].isalpha():
            if len(token) <= _LONGEST:
                out.append(token.lower())
            if not token.isascii():
                out += [c + "\x01" for c in token if c > "\x7f"]
        else:
            out.append(token + "\x01")
            out.append(_side(text[m.start() - 1 : m.start()]) + token + _side(text[m.end() : m.end() + 1]) + "\x00")
    return out


def text_features(text: str) -> set[str]:
    """The different features of a text, as ``features`` gives them."""
    out = {w for w in _LETTERS.findall(text.lower()) if len(w) <= _LONGEST}
    if not text.isascii():
        for m in _SIGN.finditer(text):
            c, i = m.group(), m.start()
            out.add(c + "\x01")
            if not c.isalpha():
                out.add(_side(text[i - 1 : i]) + c + _side(text[i + 1 : i + 2]) + "\x00")
    return out


@dataclass(frozen=True)
class Learned:
    """In how many texts each word and sign stands."""

    counts: dict[str, int]

    def least(self, text: str, signs: bool = False) -> int:
        """Count of the rarest word or sign; with ``signs`` words of ASCII are left out."""
        return min((self.counts.get(f, 0) for f in features(text) if f[-1] != "\x01" and not (signs and f.isascii())), default=0)


    def commoner(self, before: str, after: str) -> float:
        """By how much the characters outside ASCII become commoner, as a logarithm; signs count with any neighbours."""
        def weight(t: str) -> float:
            chars = {c for c in t if c > "\x7f"}
            return sum(log(1 + self.counts.get(c + "\x01", 0)) for c in chars) / max(1, len(chars))

        return weight(after) - weight(before)


def learn(texts) -> Learned:
    """The learned part from given texts; ``learn_counts`` does the same for a table."""
    counts: dict[str, int] = defaultdict(int)
    for t in set(texts):
        for f in text_features(t or ""):
            counts[f] += 1
    return Learned(dict(counts))


@dataclass(frozen=True)
class Repair:
    """``garbled``: any wrong decoding was seen. ``text``: the original as far as it can be restored.
    ``layers``: (read as, written in) of each step. ``lost``: characters that nothing can restore."""

    garbled: bool
    text: str
    layers: tuple[str, ...]
    lost: int


def _candidates(cluster: str) -> tuple[str, ...]:
    """Encodings in which a run of non-ASCII characters holds a UTF-8 sequence."""
    return _candidates_remembered(cluster) if len(cluster) <= _REMEMBERED else _candidates_of(cluster)


def _candidates_of(cluster: str) -> tuple[str, ...]:
    single = tuple(e for e in MISREAD_UTF8 if _utf8_runs(e).search(cluster))
    wide = any(ord(c) > 0x2E7F for c in cluster)
    return single + tuple(e for e in MISREAD_WIDE if wide and _wide_back(cluster, e) is not None)


_candidates_remembered = lru_cache(100_000)(_candidates_of)


def _wide_back(run: str, encoding: str) -> str | None:
    try:
        return run.encode(encoding).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def _undo_utf8(text: str, encoding: str, learned: Learned | None) -> str:
    """One layer of UTF-8 misread in ``encoding``, undone wherever that lowers the cost."""
    single = encoding not in MISREAD_WIDE
    back = byte_table(encoding)[1] if single else {}
    runs = _utf8_runs(encoding) if single else _MULTI
    western = encoding in WESTERN

    def decoded(run: str) -> str | None:
        if not single:
            return _wide_back(run, encoding)
        try:
            return bytes(back[c] for c in run).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return None

    def native(run: str) -> bool:
        """Whether the text has letters of the same script outside such runs."""
        script = _kind(run[0])[0]
        return script in "GCX" and any(_kind(c)[0] == script for c in runs.sub(" ", text) if c > "\x7f")

    def undo(m: re.Match) -> str:
        run = best = plain = m.group()
        a, b = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
        least = cost(a + run + b)
        glued = any(c.isalpha() and _kind(c)[0] != _kind(run[0])[0] for c in (a[-1:], b[:1]) if c)  # to a letter of another script
        while (plain := decoded(plain)) is not None:  # an outer layer alone may look no better
            now = cost(a + plain + b)
            # three characters that form UTF-8 by chance are rare in readings of several bytes
            if now < least or not single and now == least and len(run) >= 3:
                if len(run) == 2 and not plain.isalpha():
                    # one pair that stands for a sign: no accent by itself, and in other scripts' readings a commoner one
                    if unicodedata.category(plain[0])[0] == "M" and not 0x300 <= ord(plain[0]) < 0x370 or not western and not glued and (native(run) or learned and learned.commoner(run, plain) <= 0):
                        break
                best, least = plain, now
            if plain.isascii() or not single:
                break
        return best

    return runs.sub(undo, text)


_SEGMENT = re.compile(r"[^\n]*?(?:[.!?…][”»\"')\]]*\s+|\n|$)")


class _Change(dict):
    """Characters of one encoding to those that another has for the same bytes; others outside ASCII do not convert."""

    def __missing__(self, c: int) -> int:
        if c < 128:
            return c
        raise ValueError


@lru_cache(None)
def _change(read: str, written: str) -> _Change:
    back, chars = byte_table(read)[1], byte_table(written)[0]
    return _Change({ord(c): chars[b] for c, b in back.items()})


def _convert(part: str, read: str, written: str) -> str | None:
    try:
        return part.translate(_change(read, written))
    except ValueError:
        return None


def _support_of(token: str, learned: Learned) -> tuple[dict[int, float], dict[int, float], frozenset[int]]:
    """Pairs of encodings under which a token becomes clearly commoner, with the gain; those under which its signs
    do, but a word of ASCII beside them is rare; and those that leave it as it is."""
    before = learned.least(f" {token} ") - 1  # elsewhere than here
    least, glued = max(SEEN, CLEARLY * before), None
    gains, weak, same = {}, {}, set()
    for i, (read, written) in enumerate(MISREAD_BYTES):
        plain = _convert(token, read, written)
        if plain == token:
            same.add(i)
        elif plain is not None and (signs := learned.least(whole := f" {plain} ", True)) >= least:
            glued = cost(f" {token} ") if glued is None else glued
            if cost(whole) <= glued:
                every = learned.least(whole)
                (gains if every >= least else weak)[i] = log((every if every >= least else signs) / max(1, before))
    return gains, weak, frozenset(same)


def _undo_bytes(text: str, learned: Learned | None, known: dict) -> tuple[str, tuple[str, ...]]:
    """Sentences read in one single-byte encoding but written in another."""
    layers: list[str] = []
    odd = cost(text) > 0

    def support(part: str) -> tuple[dict[int, float], dict[int, float]]:
        """Pairs under which every token of a sentence becomes commoner or stays; and those with a rare word among them."""
        each = []
        for token in _BLANK.split(part):
            if token.isascii():
                continue
            found = known.get(token)
            if found is None:
                found = _support_of(token, learned)
                if len(token) <= _REMEMBERED:
                    if len(known) >= 200_000:
                        known.clear()
                    known[token] = found
            if not (found[0] or found[1] or found[2]):
                return {}, {}
            each.append(found)
        if not any(gains or some for gains, some, _ in each):
            return {}, {}
        pairs = range(len(MISREAD_BYTES))
        strong = {i: sum(g.get(i, 0.0) for g, _, _ in each) for i in pairs if all(i in g or i in same for g, _, same in each)}
        weak = {i: sum(g.get(i, 0.0) + w.get(i, 0.0) for g, w, _ in each) for i in pairs if all(i in g or i in w or i in same for g, w, same in each)}
        return {i: g for i, g in strong.items() if g > 0}, {i: g for i, g in weak.items() if g > 0}

    def by_count(part: str, sure: set[str]) -> str:
        strong, weak = support(part)
        # a rare word beside common signs needs a second sign, or the same mistake elsewhere in the text
        more = {i: g for i, g in weak.items() if i not in strong and ("<".join(MISREAD_BYTES[i]) in sure or _changes(part, i) > 1)}
        pairs = strong or more
        if not pairs:
            return part
        i = max(pairs, key=lambda i: (pairs[i], -i))
        plain = _convert(part, *MISREAD_BYTES[i])
        if plain is None:
            return part
        layers.append("<".join(MISREAD_BYTES[i]))
        return plain

    def undo(part: str, sure: set[str]) -> str:
        if part.isascii():
            return part
        before = cost(part) if odd else 0
        best, least, name = part, before, ""
        for read, written in MISREAD_BYTES if before else ():
            plain = _convert(part, read, written)
            if plain is not None and (after := cost(plain)) < least:
                best, least, name = plain, after, f"{read}<{written}"
        up = learned.commoner(part, best) if learned and name else 0
        if name and least * 2 < before and (up > 0 or up == 0 and (before - least > 1 or name in sure)):
            layers.append(name)
            return best
        return by_count(part, sure) if learned else part

    now = _SEGMENT.sub(lambda m: undo(m.group(), set()), text)
    if layers:  # the same mistake elsewhere in the text makes less evidence enough
        sure = set(layers)
        now = _SEGMENT.sub(lambda m: undo(m.group(), sure), now)
    return now, tuple(dict.fromkeys(layers))


def _changes(part: str, pair: int) -> int:
    """Different characters that a pair of encodings changes."""
    plain = _convert(part, *MISREAD_BYTES[pair])
    return 0 if plain is None else len({a for a, b in zip(part, plain) if a != b})


#: A sequence of three bytes misread in cp1252 whose last byte has no character there, so that U+FFFD stands for it.
_CUT = re.compile("â[^\\x00-\\x7f]" + LOST)


def _undo_cut(m: re.Match) -> str:
    """The one character of those possible that the legacy encoding itself has, if there is just one."""
    lead = bytes([0xE2, byte_table("cp1252")[1].get(m.group()[1], 0)])
    fit = []
    for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D):  # the bytes cp1252 leaves open
        try:
            fit.append((lead + bytes([b])).decode("utf-8"))
            fit[-1].encode("cp1252")
        except UnicodeDecodeError:
            pass
        except UnicodeEncodeError:
            fit.pop()
    return fit[0] if len(fit) == 1 else m.group()


def _undo_layers(text: str, learned: Learned | None) -> tuple[str, list[str]]:
    """Layers of misread UTF-8, the encoding that undoes most and leaves least garbled first.

    Every step makes the text shorter, or takes a reading of several bytes for the only time, so the steps end by themselves."""
    now, layers = _CUT.sub(_undo_cut, text), []
    if now != text:
        layers.append("cp1252<utf-8")
    taken: set[str] = set()
    while True:
        clusters = set(_MULTI.findall(now))  # a misread sequence has two such characters at least
        wanted = {e for c in clusters for e in _candidates(c)}
        order = [e for e in (*MISREAD_UTF8, *MISREAD_WIDE) if e in wanted - taken]
        steps = [(cost(after) + len(after), i, after) for i, e in enumerate(order) if (after := _undo_utf8(now, e, learned)) != now]
        if not steps:
            break
        _, i, now = min(steps)
        layers.append(f"{order[i]}<utf-8")
        taken |= {order[i]} & set(MISREAD_WIDE)
    return now, layers


#: U+FFFD by itself between quotation marks or brackets: the text speaks of the sign.
_QUOTED = re.compile(f"([“\"'‘«(\\[`]){LOST}([”\"'’»)\\]`])")


def repair(text: str, learned: Learned | None = None, known: dict | None = None) -> Repair:
    """Restore a text; ASCII text comes back as it is.

    UTF-8 layers are undone before single-byte mistakes. If garbling is left, the other order
    is tried too, since misread single bytes may form a UTF-8 sequence by chance. ``learned`` are the counts
    of the corpus; without them only the fixed part of the cost decides. ``known`` remembers what they say.
    """
    if text.isascii():
        return Repair(False, text, (), 0)
    known = {} if known is None else known
    now, layers = _undo_layers(text, learned)
    now, more = _undo_bytes(now, learned, known)
    layers += more
    if layers and (left := cost(now)):
        other, first = _undo_bytes(text, learned, known)
        other, then = _undo_layers(other, learned)
        if first and cost(other) < left:
            now, layers = other, [*first, *then]
    lost = now.count(LOST) - len(_QUOTED.findall(now))
    if lost and not layers:
        layers = [REPLACED]
    return Repair(bool(layers), now, tuple(dict.fromkeys(layers)), lost)


def learn_counts(texts: DataFrame) -> Learned:
    """Counts of words and signs over all texts (column ``t``), the commonest ``MAX_FEATURES`` of those in two texts at least.

    A count is of different texts: copies set the same of 64 bits, and while few bits are set they bound the count.
    Counts are summed map-side; the driver gets the counts of counts and at most ``MAX_FEATURES`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def done() -> pa.RecordBatch:
            n, bits = zip(*held.values())
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(n, pa.int64()), pa.array([b - (1 << 64) if b >> 63 else b for b in bits], pa.int64())], names=["feature", "n", "bits"])

        for batch in batches:
            for t, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bit = 1 << place
                for f in text_features(t):
                    x = held.get(f)
                    if x is None:
                        held[f] = [1, bit]
                    else:
                        x[0] += 1
                        x[1] |= bit
            if len(held) > 300_000:
                yield done()
                held = {}
        if held:
            yield done()

    rows = texts.select("t", F.pmod(F.xxhash64("t"), F.lit(64)).cast("int").alias("place"))
    parts = rows.mapInArrow(run, "feature string, n long, bits long")
    sums = parts.groupBy("feature").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("bits")).alias("set"))
    distinct = F.when(F.col("set") >= 48, F.col("n")).otherwise(F.least("n", F.round(-64.0 * F.log(1 - F.col("set") / 64.0)).cast("long")))
    counts = materialise(sums.select("feature", distinct.alias("n")).where("n >= 2"), "garbled-counts")
    by_size = sorted(((r.size, r["count"]) for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("size")).count().collect()), reverse=True)
    least, total = None, 0
    for size, n in by_size:
        if total + n > MAX_FEATURES:
            break
        least, total = size, total + n
    if least is None:
        return Learned({})
    kept = counts.where(F.floor(F.log2("n") * 4) >= least)
    return Learned({r.feature: r.n for r in kept.collect()})


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a passage decoded in a wrong encoding: ``key``, ``restored``, ``layers``, ``lost``.

    ``restored`` is the text with every passage restored that can be; where characters were
    replaced for good (``lost`` > 0) they stay. A document counts from one wrong character on; where U+FFFD is the
    only trace, ``layers`` is ``utf-8<?``. What is common is learned from all texts of ``df``.
    Null and empty texts are never garbled; repeated rows give one row (a key names one text);
    texts of any length are read whole. Other columns are ignored; an empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField("key", df.schema[key].dataType),
            T.StructField("restored", T.StringType()),
            T.StructField("layers", T.ArrayType(T.StringType())),
            T.StructField("lost", T.IntegerType()),
        ]
    )

    # ASCII texts end in the JVM; only others go to Python
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") > F.length("t")))
    shared = df.sparkSession.sparkContext.broadcast(learn_counts(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, known = shared.value, {}
        for batch in batches:
            found = [(i, r) for i, t in enumerate(batch.column(1).to_pylist()) if (r := repair(t, learned, known)).garbled]
            if found:
                at, rs = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array([r.text for r in rs]),
                        pa.array([list(r.layers) for r in rs], pa.list_(pa.string())),
                        pa.array([r.lost for r in rs], pa.int32()),
                    ],
                    names=["key", "restored", "layers", "lost"],
                )

    return rows.mapInArrow(run, schema).dropDuplicates(["key"]).withColumnRenamed("key", key)
