"""Personal data with offset-preserving deobfuscation.

Two passes over each whole text. The base pass finds e-mail addresses, IP addresses, card and phone numbers as they stand. The second
pass runs a transducer that rewrites disguises to plain characters and remembers where each came from:

* homoglyphs: full-width, Greek and Cyrillic look-alikes, other digits and typographic hyphens, dots and at signs, one for one;
  zero-width characters vanish;
* ``at`` and ``dot`` in brackets, or between words of an address, in several languages: ``name (at) host [dot] org``, ``name AT host DOT org``;
* spelled digits (``four seven``, ``double three``, ``oh``), and figures with spelled dots, in runs;
* the letters O and l or I for 0 and 1, where figures outnumber them twice over.

The same detectors run over the rewritten text; spans that touch rewritten characters are mapped back to the source by the edit list
(two binary searches), and kept unless a base span of their kind has them whole; one that reaches beyond a base span stands beside it.
Base spans are never changed.

Spans are code points, end exclusive. Defined cases: null and empty texts have no spans; a null ``doc_id`` is kept; rows repeat as they
are; an empty table gives no rows; other columns are ignored. Time is linear in the text for every detector.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ID, texts

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a start within a run of digits can't match where the run's start doesn't
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Look-alikes of ASCII characters.
LOOK_ALIKES = {
    "аαɑ": "a", "ϲсⅽ": "c", "ԁⅾ": "d", "еҽ": "e", "һ": "h", "іιⅰ": "i", "јϳ": "j", "κ": "k", "ⅼӏ": "l", "ⅿ": "m", "оοօ": "o", "рρ": "p", "ԛ": "q", "ѕ": "s", "υս": "u", "νѵⅴ": "v", "ԝ": "w", "хχⅹ": "x", "уγ": "y",
    "АΑ": "A", "ВΒ": "B", "СϹ": "C", "ЕΕ": "E", "НΗ": "H", "ІΙ": "I", "Ј": "J", "КΚ": "K", "МΜ": "M", "Ν": "N", "ОΟ": "O", "РΡ": "P", "Ѕ": "S", "ТΤ": "T", "ХΧ": "X", "УΥ": "Y", "Ζ": "Z",
    "‐‑‒–—−﹣－": "-", "․。．｡": ".", "﹫＠": "@", "＋﹢": "+", "   　": " ", "（": "(", "）": ")", "＿": "_",
}
VANISH = "​‌‍⁠﻿­"
#: Look-alikes by rule: decimal digits and full-width letters.
FOLD = {ord(c): v for k, v in LOOK_ALIKES.items() for c in k}
FOLD |= {c: chr(c - 0xFEE0) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}
FOLD |= {c: str(unicodedata.digit(chr(c))) for c in range(0x660, 0x1D800) if unicodedata.category(chr(c)) == "Nd" and c not in FOLD}
STRANGE = re.compile("[" + "".join(map(re.escape, map(chr, FOLD))) + VANISH + "]")

# Words for digits.
DIGITS = {"zero": "0", "oh": "0", "null": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGITS |= {"eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
DIGITS |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
DIGITS |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
REPEATS = {"double": 2, "triple": 3}
_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_UNIT = rf"(?:(?:{'|'.join(REPEATS)})[ -]{_DIGIT}|{_DIGIT}|[0-9]+)"
_GAP = r"(?:[ ,]{1,2}|-|\.|[ ]?(?:dash|hyphen|minus|dot|point|punkt|punto)[ ])"
#: A run with a spelled digit: units with single gaps, perhaps behind a plus.
SPELLED = re.compile(rf"(?<!\w)(?:(?:\+|plus )[ ]?)?{_UNIT}(?:{_GAP}{_UNIT})+(?!\w)", re.I)
#: What tells cheaply that a text may have such a run: two such words side by side.
_WORDS = frozenset(w.encode() for w in DIGITS)
_DOTS = frozenset(w.encode() for w in "dot point punkt punto".split())
_BESIDE = _WORDS | _DOTS | {w.encode() for w in (*REPEATS, *"dash hyphen minus".split())}
_PLAIN = bytes(32 if chr(c) in ",.-+\t\r\n" else c for c in range(256))
SPELLED_PARTS = re.compile(rf"(?P<plus>\+|plus )|(?:(?P<times>{'|'.join(REPEATS)})[ -])?(?P<word>{_DIGIT})(?!\w)|(?P<digits>[0-9]+)|(?P<dot>\.|[ ]?(?:dot|point|punkt|punto)[ ])|(?P<dash>-|[ ]?(?:dash|hyphen|minus)[ ])|(?P<gap>[ ,]+)", re.I)

# Disguised at signs and dots, and the ends of host names that bare words are trusted with.
_ENDS = r"(?:com|org|net|edu|gov|info|biz|io|co|dev|app|me|de|fr|es|uk|us|eu|ch|at|it|nl|example|test)(?![\w-])"
BRACKETED = re.compile(r"[\[({<][ ]*(?:(?P<at>at|ät|arroba|arobase|@)|(?P<dot>dot|punkt|punto|point|\.))[ ]*[\])}>]", re.I)


def _bare(at: str, dot: str) -> re.Pattern:
    # a chain of dotted parts is entered at its beginning only, so that one without a sign is read once
    return re.compile(rf"(?<![\w.%+-])(?<! dot )(?<! punkt )(?<! punto )(?:[\w%+-]+(?:{dot}))*+[\w.%+-]+?(?:{at})[\w-]+(?:(?:{dot})[\w-]+)*(?:{dot}){_ENDS}", re.I)


#: Words for the sign must come with words for the dot: "look at example.com" is prose. A sign set apart by blanks may have either dot.
BARE = (
    ((" dot ", " punkt ", " punto "), _bare("[ ]+(?:at|ät|arroba)[ ]+", "[ ]+(?:dot|punkt|punto)[ ]+")),
    ((" arobase ",), _bare("[ ]+arobase[ ]+", "[ ]+point[ ]+")),
    ((" @", "@ "), _bare("[ ]+@[ ]*|[ ]*@[ ]+", r"[ ]+(?:dot|punkt|punto)[ ]+|[ ]?\.[ ]?")),
    ((" dot ", " punkt ", " punto "), _bare("@", "[ ]+(?:dot|punkt|punto)[ ]+")),
)
BARE_PARTS = re.compile(r"(?P<at>[ ]+(?:at|ät|arroba|arobase)[ ]+|[ ]*@[ ]*)|(?P<dot>[ ]+(?:dot|punkt|punto|point)[ ]+|[ ]+\.[ ]*|[ ]*\.[ ]+)", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each at sign in turn, the whole run of local characters before it that no match has used."""
    used, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > used and text[a - 1] in EMAIL_LOCAL:
            a -= 1
        if a < at and (m := EMAIL_HOST.match(text, at + 1)):
            used = m.end()
            yield a, used
            at = text.find("@", used)
        else:
            at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base pattern."""
    out = [(0, a, z) for a, z in emails(text)] if "@" in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


class Rewritten:
    """A text after edits (start, end, replacement), and the way back to the source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]) -> None:
        out, self.starts, self.sources, at, n = [], [], [], 0, 0
        for a, z, new in edits:
            if not at <= a <= z <= len(source):
                raise ValueError(f"edits must ascend without overlap: {a}:{z} after {at}")
            out += [source[at:a], new]
            n += a - at
            self.starts.append(n)  # of the replacement in the new text
            self.sources.append((a, z, len(new)))
            n += len(new)
            at = z
        out.append(source[at:])
        self.text = "".join(out)

    def source(self, at: int, end: bool) -> int:
        """Where a position of the new text lies in the source; within a replacement its beginning, or its end if ``end``."""
        k = bisect_right(self.starts, at - end) - 1
        if k < 0:
            return at
        a, z, size = self.sources[k]
        over = at - self.starts[k]
        if over < size or end and over == size and size:
            return (z if end else a) if size != z - a else a + over
        return z + over - size


def _spelled(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """Edits that turn a run of spelled digits into figures; gaps between single digits close, other separators become plain."""
    if not any(c.isalpha() for c in m[0]):
        return  # figures as they stand
    parts = list(SPELLED_PARTS.finditer(m[0]))
    units = [bool(p["word"]) for p in parts if p["word"] or p["digits"]]
    if sum(units) == 1 and (units[0] or units[-1]) and not any(p["dot"] for p in parts):
        return  # a single word beside figures may be an article or the next sentence
    for p in parts:
        a, z = m.start() + p.start(), m.start() + p.end()
        if p["plus"]:
            yield a, z, "+"
        elif p["word"]:
            yield a, z, DIGITS[p["word"].lower()] * REPEATS.get((p["times"] or "").lower(), 1)
        elif p["dot"]:
            yield a, z, "."
        elif p["dash"]:
            yield a, z, "-"
        elif p["gap"]:
            yield a, z, ""


def _strange(text: str) -> Iterator[tuple[int, int, str]]:
    if not text.isascii():
        for m in STRANGE.finditer(text):
            yield *m.span(), FOLD.get(ord(m[0]), "")


def _brackets(text: str) -> Iterator[tuple[int, int, str]]:
    used = 0  # blanks between two signs go with the first
    for m in BRACKETED.finditer(text):
        a, z = m.span()
        while a > used and text[a - 1] == " ":
            a -= 1
        while z < len(text) and text[z] == " ":
            z += 1
        yield a, z, "@" if m["at"] else "."
        used = z


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    low, found = text.lower(), []
    for hints, pattern in BARE:
        if any(h in low for h in hints):
            found += [(m.start() + p.start(), m.start() + p.end(), "@" if p["at"] else ".") for m in pattern.finditer(text) for p in BARE_PARTS.finditer(m[0])]
    end = 0
    for a, z, new in sorted(found):
        if a >= end:
            yield a, z, new
            end = z


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    words = text.lower().encode().translate(_PLAIN).split()
    if _WORDS.isdisjoint(words) and _DOTS.isdisjoint(words):
        return
    beside = ((a, b) for x, y in zip(words, words[1:], strict=False) for a, b in ((x, y), (y, x)))
    if not any(a in _WORDS and (b in _BESIDE or b.isdigit()) or a in _DOTS and b.isdigit() for a, b in beside):
        return
    for m in SPELLED.finditer(text):
        yield from _spelled(m)


#: Letters for digits within a long number.
LETTERED_HINT = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
LETTERED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl](?:[\x20().-]{0,2}[0-9OoIl]){7,18}(?![A-Za-z0-9])")
LETTER = re.compile(r"[OoIl]")


def _lettered(text: str) -> Iterator[tuple[int, int, str]]:
    if LETTERED_HINT.search(text):
        for m in LETTERED.finditer(text):
            if len(found := LETTER.findall(m[0])) * 2 < len(NOT_DIGIT.sub("", m[0])):
                yield from ((m.start() + p.start(), m.start() + p.end(), "0" if p[0] in "Oo" else "1") for p in LETTER.finditer(m[0]) if found)


#: The transducer's layers, each over the text that the last one left.
LAYERS = (_strange, _brackets, _addresses, _digits, _lettered)


def rewritten(text: str) -> tuple[str, list[Rewritten]]:
    """The text without disguises, and each layer's way back."""
    now, back = text, []
    for layer in LAYERS:
        if found := list(layer(now)):
            back.append(Rewritten(now, found))
            now = back[-1].text
    return now, back


def hidden(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in the source's positions."""
    now, back = rewritten(text)
    if not back:
        return []
    out = []
    for kind, a, z in detect(now):
        for step in reversed(back):
            a, z = step.source(a, False), step.source(z, True)
        if not any(k == kind and s <= a and z <= e for k, s, e in base):
            out.append((kind, a, z))
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans; all spans."""
    base = detect(text)
    return base, sorted(base + hidden(text, base))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of all spans by kind, ``base_sha256``, ``spans``, ``n_added``, ``n_spans``: one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(8)]
            for text in b.column(1).to_pylist():
                base, spans = find(text)
                for k in range(4):
                    cols[k].append(sum(s[0] == k for s in spans))
                cols[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[5].append(written(spans))
                cols[6].append(len(spans) - len(base))
                cols[7].append(len(spans))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[ID, *NAMES])

    return texts(docs).mapInArrow(run, f"{ID} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


NAMES = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
