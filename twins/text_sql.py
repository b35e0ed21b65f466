"""DuckDB text expressions with the meaning of ``lureline.functions.text``, written without look-around."""

from __future__ import annotations

from lureline.functions import charmaps as cm
from lureline.functions.patterns import MARK, NOT_WORD as NW
from lureline.functions.patterns import sql_text as q


def tr(x: str, table: dict[str, str], drop: str = "") -> str:
    a, b = cm.pair(table, drop)
    return f"translate({x}, {q(a)}, {q(b)})"


def rep(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def compat(x: str) -> str:
    return tr(x, cm.COMPAT)


def strip_invisible(x: str) -> str:
    return rep(x, cm.INVISIBLE, "")


def refang(x: str) -> str:
    x = rep(x, r"(?i)hxxps\s*:\s*//", "https://")
    x = rep(x, r"(?i)hxxp\s*:\s*//", "http://")
    x = rep(x, r"(?i)\[\s*\.\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}", ".")
    return rep(x, r"(?i)\[\s*at\s*\]|\(\s*at\s*\)", "@")


def lookalikes(x: str) -> str:
    return tr(x, cm.LOOKALIKES)


def spaced(x: str) -> str:
    """Separators are doubled so that neighbouring lone characters can each be marked; a blank between two marked ones
    becomes a link, single links are undone, and the remaining ones (runs of three and more) are deleted."""
    probe = r"[A-Za-z0-9][ \t][A-Za-z0-9][ \t][A-Za-z0-9]"
    out = rep(f"' ' || {x} || ' '", f"({NW})", r"\1\1")
    out = rep(out, f"({NW})([A-Za-z0-9])({NW})", "\\1\x01\\2\x03\\3")
    out = rep(out, "\x03([ \\t])[ \\t]\x01", "\x04\\1")
    out = rep(out, "\x01([A-Za-z0-9])\x04([ \\t])([A-Za-z0-9])\x03", r"\1\2\2\3")
    out = rep(rep(out, "\x04[ \\t]", ""), "[\x01\x03]", "")
    out = rep(out, f"({NW}){NW}", r"\1")
    return f"CASE WHEN regexp_matches({x}, {q(probe)}) THEN substr({out}, 2, length({out}) - 2) ELSE {x} END"


def leet(x: str) -> str:
    out = x
    for source, target in cm.LEET.items():
        for _ in range(2):
            out = rep(out, rf"(?i)(^|{NW}){source}($|{NW})", rf"\1{target}\2")
    return f"CASE WHEN regexp_matches({x}, {q('(?i)' + '|'.join(cm.LEET))}) THEN {out} ELSE {x} END"


def tidy(x: str) -> str:
    x = rep(x, r"[\x{2010}-\x{2015}]", "-")
    x = rep(x, r"[ \t]+", " ")
    x = rep(x, r"\n{3,}", "\n\n")
    return rep(x, r"^\s+|\s+\z", "")


def accents(x: str) -> str:
    return tr(x, {**cm.ACCENTS, **cm.ARABIC_LETTERS}, cm.ARABIC_MARKS)


def german(x: str) -> str:
    return rep(x, r"([aouAOU])[eE]", r"\1")


def mark(x: str) -> str:
    return f"{q(MARK)} || " + rep(x, NW + "+", "\\0" + MARK)


def unmark(x: str) -> str:
    return f"replace({x}, {q(MARK)}, '')"


def clip(x: str, n: int) -> str:
    return f"substr({rep(rep(x, chr(92) + 's+', ' '), '^ | ' + chr(92) + 'z', '')}, 1, {n})"


def plain_urls(x: str) -> str:
    for a, b in (("​", ""), ("：//", "://"), ("hxxps://", "https://"), ("hxxp://", "http://"), ("[.]", ".")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def letters(x: str, script: str) -> str:
    return f"length(regexp_replace({rep(x, chr(92) + 'PL+', '')}, {q(f'[^{chr(92)}p{{{script}}}]+')}, '', 'g'))"


def normal_ctes(source: str, text: str = "text", keep: str = "message_id") -> str:
    """CTEs n1..n7: one per step, so each expression is written once. ``n7`` holds every stage."""
    steps = (
        ("o", "s1", compat), ("s1", "s2", strip_invisible), ("s2", "s3", refang), ("s3", "s4", lookalikes),
        ("s4", "s5", spaced), ("s5", "s6", leet), ("s6", "normalized", tidy),
    )
    out = [f"n0 AS (SELECT *, coalesce({text}, '') AS o FROM {source})"]
    for i, (a, b, fn) in enumerate(steps, 1):
        out.append(f"n{i} AS (SELECT *, {fn(a)} AS {b} FROM n{i - 1})")
    return ",\n".join(out)
