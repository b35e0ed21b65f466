"""Character tables for ``translate``: built from Unicode data by rule, except the look-alike list."""

from __future__ import annotations

import unicodedata

# Visually close Greek and Cyrillic letters and the Latin letter each is read as.
LOOKALIKES = {
    "а": "a", "А": "A", "е": "e", "Е": "E", "о": "o", "О": "O",
    "р": "p", "Р": "P", "с": "c", "С": "C", "х": "x", "Х": "X",
    "у": "y", "У": "Y", "і": "i", "І": "I", "ј": "j", "Ј": "J",
    "һ": "h", "Һ": "H", "ԁ": "d", "ԛ": "q", "ɡ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "y", "χ": "x", "K": "K", "ſ": "s",
}

# Digit-for-letter spellings and the word each stands for.
LEET = {
    "p4y": "pay", "p@y": "pay", "tr4nsfer": "transfer", "dep0sit": "deposit",
    "t0pup": "topup", "j0b": "job", "w0rk": "work", "pr0fit": "profit",
    "retrn": "return", "guar4nteed": "guaranteed", "cr7pto": "crypto",
    "wh4tsapp": "whatsapp", "te1egram": "telegram", "c0mmission": "commission",
}

# Format and control characters, without line feed, carriage return and tab.
INVISIBLE = r"[\p{Cf}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"

_PLANES = (range(0xA0, 0xD800), range(0xF900, 0xFFF0), range(0x1D400, 0x1D800), range(0x1F100, 0x1F1A0))


def _compat() -> dict[str, str]:
    """Characters whose compatibility form is one other character (full width, styled letters, no-break space)."""
    out = {}
    for plane in _PLANES:
        for cp in plane:
            ch = chr(cp)
            folded = unicodedata.normalize("NFKC", ch)
            if len(folded) == 1 and folded != ch:
                out[ch] = folded
    return out


def _accents() -> dict[str, str]:
    """Accented Latin letter -> its base letter, from the canonical decomposition; length stays the same."""
    out = {"đ": "d", "Đ": "D"}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and unicodedata.category(parts[1]) == "Mn" and "LATIN" in unicodedata.name(parts[0], ""):
            out[chr(cp)] = parts[0]
    return out


COMPAT = _compat()
ACCENTS = _accents()
# Arabic letter variants read as one letter; the vowel marks and the stretch sign are dropped.
ARABIC_LETTERS = {"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ه"}
ARABIC_MARKS = "".join(map(chr, [*range(0x64B, 0x660), 0x670, 0x640]))


def pair(table: dict[str, str], drop: str = "") -> tuple[str, str]:
    """The (from, to) strings of ``translate``; characters of ``drop`` have no partner and vanish."""
    return "".join(table) + drop, "".join(table.values())


def char_class(chars: str) -> str:
    """A regex class of these characters, written as ranges (a cheap test before ``translate``)."""
    points = sorted(map(ord, set(chars)))
    spans: list[list[int]] = []
    for cp in points:
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"
