"""Column functions over message text. Every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lureline.functions import charmaps as cm
from lureline.functions.patterns import MARK, NOT_WORD
from lureline.functions.rows import let

WORD = r"[\pL\pN\pM_]"
# Coarse tests before ``translate``: a few ranges that hold all keys of a table, since Java walks a class range by range.
_COMPAT_GATE = r"[\x{a0}-\x{bf}\x{130}-\x{10ffff}]"
_LOOK_GATE = r"[\x{17f}\x{261}\x{370}-\x{52f}\x{212a}]"
_LOOK_COARSE = r"[\x{17f}-\x{10ffff}]"
_ACCENT_GATE = r"[\x{c0}-\x{24f}\x{1e00}-\x{1eff}\x{622}-\x{670}]"
_LOOK_CLASS = cm.char_class("".join(cm.LOOKALIKES))
_LEET_ANY = "(?i)(?:" + "|".join(cm.LEET) + ")"
# What every spelling holds, so that most texts are told apart by their signs alone: such a sign between letters, or "trn". Patterns begin
# with what few characters are and look back from there.
_LEET_SIGNS = "[" + "".join(sorted({c for w in cm.LEET for c in w if not c.isalpha()})) + "](?<=[A-Za-z].)[A-Za-z]"
_LEET_PLAIN = "[tT][rR][nN]"
# A coarse class that holds all of INVISIBLE. Characters below 256 stand one by one, since Java then looks them up in a table.
_HIDDEN_GATE = "[" + "".join(rf"\x{i:02x}" for i in (*range(9), 11, 12, *range(14, 32), *range(127, 160), 0xAD)) + r"\x{600}-\x{10ffff}]"
# Cyrillic and Greek lie beyond.
_SCRIPT_GATE = r"[\x{370}-\x{10ffff}]"


def _beyond_ascii(c: Column) -> Column:
    """Has the text characters of more than one byte? Counting is far cheaper than a pattern."""
    return F.octet_length(c) != F.length(c)


def _map_chars(c: Column, gate: str, table: dict[str, str], drop: str = "") -> Column:
    """All keys of the table are beyond ASCII."""
    source, target = cm.pair(table, drop)
    return F.when(_beyond_ascii(c) & c.rlike(gate), F.translate(c, source, target)).otherwise(c)


def _holds(c: Column, *signs: str) -> Column:
    """Does the text hold one of these? A search for bytes, far cheaper than a pattern."""
    out = c.contains(signs[0])
    for sign in signs[1:]:
        out = out | c.contains(sign)
    return out


def fold_compat(c: Column) -> Column:
    """B1, the one-to-one part of compatibility folding (full width, ideographic blank, styled letters)."""
    return _map_chars(c, _COMPAT_GATE, cm.COMPAT)


def strip_invisible(c: Column) -> Column:
    return F.when(c.rlike(_HIDDEN_GATE), F.regexp_replace(c, cm.INVISIBLE, "")).otherwise(c)


def refang(c: Column) -> Column:
    """Hxxp, [.], (dot), {dot}, [at], (at) back to a plain link or address."""
    crossed = _holds(c, "xx", "xX", "Xx", "XX")
    out = F.when(crossed, F.regexp_replace(F.regexp_replace(c, r"(?i)hxxps\s*:\s*//", "https://"), r"(?i)hxxp\s*:\s*//", "http://")).otherwise(c)
    plain = F.regexp_replace(out, r"(?i)\[\s*\.\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}", ".")
    plain = F.regexp_replace(plain, r"(?i)\[\s*at\s*\]|\(\s*at\s*\)", "@")
    return F.when(_holds(c, "[", "(", "{"), plain).otherwise(out)


def map_lookalikes(c: Column) -> Column:
    return F.when(_beyond_ascii(c) & c.rlike(_LOOK_COARSE), _map_chars(c, _LOOK_GATE, cm.LOOKALIKES)).otherwise(c)


def join_spaced_letters(c: Column) -> Column:
    """Drop the blank between two lone characters when a further lone one adjoins on either side."""
    lone, end = rf"(?<!{WORD})[A-Za-z0-9][ \t]", rf"(?!{WORD})"
    inner = rf"[ \t](?:(?<={lone}[A-Za-z0-9][ \t])(?=[A-Za-z0-9]{end})|(?<={lone})(?=[A-Za-z0-9][ \t][A-Za-z0-9]{end}))"
    # Three lone characters, asked from the first blank on: few characters are blanks, most are not.
    run = rf"[ \t][A-Za-z0-9][ \t][A-Za-z0-9]{end}(?<={lone}[A-Za-z0-9][ \t][A-Za-z0-9])"
    return F.when(c.rlike(run), F.regexp_replace(c, inner, "")).otherwise(c)


def decode_leet(c: Column) -> Column:
    out = c
    for source, target in cm.LEET.items():
        out = F.regexp_replace(out, rf"(?i)(?<!{WORD}){source}(?!{WORD})", target)
    return F.when((c.rlike(_LEET_SIGNS) | c.rlike(_LEET_PLAIN)) & c.rlike(_LEET_ANY), out).otherwise(c)


def tidy(c: Column) -> Column:
    """One dash, single blanks, at most one empty line, no outer white space."""
    out = F.when(_beyond_ascii(c), F.regexp_replace(c, r"[\x{2010}-\x{2015}]", "-")).otherwise(c)
    out = let(out, lambda x: F.when(_holds(x, "  ", "\t"), F.regexp_replace(x, r"[ \t]{2,}|\t", " ")).otherwise(x))
    out = let(out, lambda x: F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x))
    return F.btrim(out, F.lit(" \t\n\x0b\f\r"))


def fold_accents(c: Column) -> Column:
    """Latin accents off (same length), Arabic marks dropped and letter variants unified."""
    return _map_chars(c, _ACCENT_GATE, {**cm.ACCENTS, **cm.ARABIC_LETTERS}, cm.ARABIC_MARKS)


def fold_german(c: Column) -> Column:
    return F.regexp_replace(c, r"([aouAOU])[eE]", "$1")


def mark_words(c: Column) -> Column:
    """The sign the patterns start with, before every word."""
    return F.concat(F.lit(MARK), F.regexp_replace(c, NOT_WORD + "+", "$0" + MARK))


def unmark(c: Column) -> Column:
    return F.replace(c, F.lit(MARK), F.lit(""))


def clip(c: Column, n: int) -> Column:
    """B13."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^ | \z", ""), 1, n)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def plain_urls(c: Column) -> Column:
    """Undo the link disguises the corpus variants use."""
    for a, b in (("​", ""), ("：//", "://"), ("hxxps://", "https://"), ("hxxp://", "http://"), ("[.]", ".")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# The writing systems told apart.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Tamil")


def letters_of(c: Column, script: str) -> Column:
    """How many letters of this writing system the text holds."""
    return F.length(F.regexp_replace(c, rf"[^\p{{Is{script}}}]+|[^\pL]+", ""))


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\pL]+", ""))


def has_script(c: Column, script: str) -> Column:
    return c.rlike(rf"[\p{{Is{script}}}&&\pL]")


def invisible_count(c: Column) -> Column:
    return F.length(c) - F.length(strip_invisible(c))


def mixed_scripts(c: Column) -> Column:
    return _beyond_ascii(c) & c.rlike(_SCRIPT_GATE) & has_script(c, "Latin") & (has_script(c, "Cyrillic") | has_script(c, "Greek"))


def has_lookalike(c: Column) -> Column:
    return _beyond_ascii(c) & c.rlike(_LOOK_COARSE) & c.rlike(_LOOK_GATE) & c.rlike(_LOOK_CLASS)
