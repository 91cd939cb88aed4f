"""Text functions for noisy names.

Spark has no Unicode normalisation: ``nfkc`` is the one Arrow UDF here, to be applied to distinct strings. All else is native.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Small kana and their full-size forms; kanji that readers confuse with katakana; ways to write a gender behind a name.
SMALL_KANA = ("ャュョッァィゥェォゃゅょっぁぃぅぇぉ", "ヤユヨツアイウエオやゆよつあいうえお")
LOOK_ALIKE_KANJI = ("三口力工八卜夕千才厶二", "ミロカエハトタチオムニ")
GENDERS = (("オスのすがた", "♂"), ("メスのすがた", "♀"), ("おすのすがた", "♂"), ("めすのすがた", "♀"))
#: Voiced kana that stay as they are.
_KEPT_VOICED = "ゔヷヸヹヺ"


def _voiced() -> tuple[str, str]:
    """Kana with a voicing mark and their plain forms, by canonical decomposition."""
    pairs = [(c, d[0]) for c in map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)]) if len(d := unicodedata.normalize("NFD", c)) == 2 and c not in _KEPT_VOICED]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FOLD = tuple(a + b for a, b in zip(SMALL_KANA, _voiced(), strict=True))


def fold_text(s: str) -> str:
    """The fold on the driver, for constants and tests."""
    return unicodedata.normalize("NFKC", s).translate(str.maketrans(*FOLD))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def kana_fold(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, small kana to full size, voiced kana to plain, in one pass. ``ascii_only`` spares the UDF where no other text occurs."""
    return c if ascii_only else F.translate(nfkc(c), *FOLD)


def entity_fold(c: Column) -> Column:
    """``kana_fold`` after look-alike kanji, with written genders as signs."""
    out = kana_fold(F.translate(c, *LOOK_ALIKE_KANJI))
    for words, sign in GENDERS:
        out = F.replace(out, F.lit(fold_text(words)), F.lit(sign))
    return out


def base_and_form(c: Column, ascii_only: bool = False) -> tuple[Column, Column]:
    """``name (form)`` as its base and its form, from the first opening bracket to the last closing one; without brackets the form is empty.
    Neither has white space at its ends.
    """
    s = c if ascii_only else nfkc(c)
    pattern = rf"(?s)^([^(]*)\((.*)\){_BLANK}*$"
    has = s.rlike(pattern)
    return strip(F.when(has, F.regexp_extract(s, pattern, 1)).otherwise(s)), strip(F.when(has, F.regexp_extract(s, pattern, 2)).otherwise(""))


#: White space as Python has it: Unicode's, and four separators of ASCII.
_BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


@lru_cache(1)
def _digits() -> tuple[str, str, str]:
    """Digits that aren't decimal (superscripts, circled ones); the decimal ones beyond ASCII, and their values: by Unicode's own properties."""
    found = [c for c in map(chr, range(0x80, 0x20000)) if c.isdigit()]
    decimal = [c for c in found if c.isdecimal()]
    return "".join(c for c in found if not c.isdecimal()), "".join(decimal), "".join(str(unicodedata.decimal(c)) for c in decimal)


def char_category(c: Column) -> Column:
    """The kind of a single character."""
    code = F.ascii(c)
    return (
        F.when(code.between(0x3041, 0x3096), "hiragana")
        .when(code.between(0x30A1, 0x30FA), "katakana")
        .when(c == "ー", "chouon")
        .when(c == "・", "middle_dot")
        .when(c.rlike(rf"^[\p{{Nd}}{_digits()[0]}]$"), "digit")
        .when(c.isin("(", ")", "（", "）"), "paren")
        .when(c.rlike(f"^{_BLANK}$"), "space")
        .otherwise("other")
    )


#: Characters that item names consist of.
ALLOWED = "".join(map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB), *range(0x41, 0x5B)])) + "ー・0123456789" + "".join(map(chr, range(0xFF10, 0xFF1A))) + "()（）"


def only_allowed(c: Column, allowed: str = ALLOWED) -> Column:
    """Without characters outside ``allowed``."""
    quoted = "".join("\\" + x if not x.isalnum() else x for x in allowed)
    return F.regexp_replace(c, f"[^{quoted}]", "")


def int_or_zero(c: Column) -> Column:
    """A whole number in any script's decimal digits, single underscores between them allowed; 0 for what is none or doesn't fit an int."""
    plain = F.translate(strip(c), *_digits()[1:])
    return F.coalesce(F.when(plain.rlike("^[+-]?[0-9]+(?:_[0-9]+)*$"), F.replace(plain, F.lit("_")).try_cast("int")), F.lit(0))


def spelling_key(c: Column, ascii_only: bool = False) -> Column:
    """Equal for spellings that differ in width or blanks; kinds of kana stay apart."""
    return F.translate(c if ascii_only else nfkc(c), " 　", "")


def rank_in(c: Column, order: list[str]) -> Column:
    """Place in a list from 0; -1 for what isn't in it."""
    return F.array_position(F.array(*map(F.lit, order)), c).cast("int") - 1


# Words in a screen's header by kind; the first kind that fits.
LIST_WORDS = ("教える技", "教えるわざ", "選んでくださ", "技を", "わざを")
DETAIL_WORDS = ("能力", "ポイント", "ボイント", "ポイン", "ボイン")


def kind_by_words(c: Column, first: tuple[str, ...] = LIST_WORDS, second: tuple[str, ...] = DETAIL_WORDS) -> Column:
    has = lambda words: F.greatest(*(F.contains(c, F.lit(w)).cast("int") for w in (*words, words[0]))) == 1
    return F.when(has(first), "move_list").when(has(second), "detail").otherwise("other")


def shown(name: Column, score: Column) -> Column:
    """A candidate as reports write it."""
    return F.format_string("%s  (score=%.2f)", name, score)
