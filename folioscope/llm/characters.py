"""Characters that look alike, and the comparison form of words."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that look like a Latin letter (Cyrillic and Greek, small and capital; script g).
LOOKS_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɡ": "g", "ɑ": "a", "K": "K", "Å": "Å",
}

#: Latin letters that look like a Cyrillic one.
LOOKS_CYRILLIC = {latin: c for c, latin in LOOKS_LATIN.items() if "Ѐ" <= c <= "џ"} | {"ο": "о", "Ο": "О", "Α": "А", "Β": "В", "Ε": "Е", "Η": "Н", "Κ": "К", "Μ": "М", "Ρ": "Р", "Τ": "Т", "Χ": "Х"}

#: Signs without any width: joiners, marks of direction, soft hyphen. The zero-width non-joiner has its own rule.
ZERO_WIDTH = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF, *range(0xFE00, 0xFE10)]))
NON_JOINER = "‌"

#: Blanks other than the plain one.
BLANKS = "".join(map(chr, [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Pattern class of every blank.
BLANK_CLASS = r"[ \t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Arabic letters that join to the next one: only after these a non-joiner is seen.
JOINING = "بپتثجچحخسشصضطظعغفقكکگلمنهيیئىـ"


def _wide() -> dict[str, str]:
    """Full-width, half-width and font variants of one character, by Unicode's own mapping."""
    out = {}
    for code in [*range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800), *range(0xFB50, 0xFEFD), *range(0x3000, 0x3001), *range(0xFB13, 0xFB50)]:
        kind = unicodedata.decomposition(chr(code)).split(" ")[0]
        plain = unicodedata.normalize("NFKC", chr(code))
        if kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") and len(plain) == 1:
            out[chr(code)] = plain
    return out


WIDE = _wide()
_BMP_WIDE = {k: v for k, v in WIDE.items() if ord(k) < 0x10000}

def _translate(x: Column, table: dict[str, str], drop: str = "") -> Column:
    return F.translate(x, "".join(table) + drop, "".join(table.values()))


def without_zero_width(x: Column) -> Column:
    """Zero-width signs away, variants of width to the plain form; a non-joiner stays where it is seen."""
    x = _translate(x, _BMP_WIDE, ZERO_WIDTH)
    return F.when(x.contains(NON_JOINER), F.regexp_replace(x, f"(?<![{JOINING}]){NON_JOINER}+|{NON_JOINER}+(?![\\x{{620}}-\\x{{6FF}}])", "")).otherwise(x)


def folded(x: Column) -> Column:
    """Look-alike letters mapped onto one: the key of a class of words that look the same."""
    x = _translate(without_zero_width(x), LOOKS_LATIN)
    arabic = F.regexp_replace(F.translate(x, "ک", "ك"), r"[یى](?=[\x{620}-\x{65F}\x{66E}-\x{6D3}])", "ي")
    return F.when(x.rlike(r"[\x{643}\x{649}\x{6A9}\x{6CC}]"), F.translate(arabic, "ی", "ى")).otherwise(x)


_FOLD = str.maketrans({**{c: None for c in ZERO_WIDTH}, **WIDE, **LOOKS_LATIN, "ک": "ك", "ſ": "s"})
_CAPITALS = str.maketrans({k: v for k, v in LOOKS_CYRILLIC.items() if k.isupper()})
#: A letter that no Latin one looks like, so that the word is a Cyrillic one.
_CYRILLIC = re.compile("[" + "".join(c for c in map(chr, range(0x410, 0x450)) if c not in LOOKS_LATIN) + "]")
_UNSEEN = re.compile(f"(?<![{JOINING}]){NON_JOINER}+|{NON_JOINER}+(?![\u0620-\u06ff])")
_INNER_YEH = re.compile("[یى](?=[\u0620-\u065f\u066e-\u06d3])")
_SMALL_E = re.compile("([aou])\u0364")


def word_form(word: str) -> str:
    """Comparison form of a word: look-alikes folded, composed, lower case, long s as s, a small e
    above as umlaut. Both sides of a comparison must be brought to it."""
    if word.isascii():
        return word.lower()
    w = unicodedata.normalize("NFC", word)
    if _CYRILLIC.search(w):  # capitals and small letters of this script look alike in different ways
        w = w.translate(_CAPITALS).lower()
    w = w.translate(_FOLD)
    if NON_JOINER in w:
        w = _UNSEEN.sub("", w)
    w = _INNER_YEH.sub("ي", w).replace("ی", "ى").lower()
    return _SMALL_E.sub(lambda m: {"a": "ä", "o": "ö", "u": "ü"}[m[1]], w).translate(_FOLD)


def plain_form(value: str, script: str) -> str:
    """The value in plain characters of ``script``: no zero-width signs, plain width, composed, and
    look-alikes from another script replaced if that leaves a word of one script."""
    kept = []
    for i, c in enumerate(value):
        if c in ZERO_WIDTH:
            continue
        if c == NON_JOINER and not (i and value[i - 1] in JOINING and i + 1 < len(value) and "ؠ" <= value[i + 1] <= "ۿ"):
            continue
        kept.append(" " if c in BLANKS else WIDE.get(c, c))
    v = unicodedata.normalize("NFC", "".join(kept))
    if (v.isascii() and script in ("Latn", "none")) or any(c.isdigit() for c in v):
        return v
    if script == "Cyrl":
        new = "".join(LOOKS_CYRILLIC.get(c, c) for c in v)
        return v if any("A" <= c <= "ɏ" and c.isalpha() for c in new) else new
    if script in ("Arab", "Pers"):
        out = []
        for i, c in enumerate(v):
            more = i + 1 < len(v) and "ؠ" <= v[i + 1] <= "ۓ"
            if script == "Arab":
                c = {"ک": "ك", "ی": "ي" if more else "ى"}.get(c, c)
            else:
                c = {"ك": "ک", "ى": "ی"}.get(c, "ی" if c == "ي" and more else c)
            out.append(c)
        return "".join(out)
    new = "".join(LOOKS_LATIN.get(c, c) for c in v)
    return v if any("Ͱ" <= c <= "ӿ" and c.isalpha() for c in new) else new
