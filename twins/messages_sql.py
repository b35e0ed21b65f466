"""The message, turn and page views in DuckDB SQL, from the same constant phrases."""

from __future__ import annotations

from lureline.functions.patterns import sql_text
from lureline.plans import messages as m


def lit(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else sql_text(value)


def phrases() -> str:
    rows = ",\n".join(f"({i}, {', '.join(map(lit, p))})" for i, p in enumerate(m.PHRASES))
    return f"phrases(k, {', '.join(m.COLUMNS)}) AS (VALUES {rows})"


def messages() -> str:
    claims = ", ".join(m.COLUMNS[1:])
    return (
        phrases() + ",\nmessages AS (SELECT d.doc_id AS message_id, d.lang, d.source, concat_ws(chr(10), d.text, p.phrase) AS text, "
        f"{claims} FROM documents d LEFT JOIN phrases p ON p.k = d.doc_id % {len(m.PHRASES)})"
    )


def turns() -> str:
    said = "[" + ", ".join(map(lit, m.TURN_PHRASES)) + "]"
    return (
        f"turns AS (SELECT conv_id, turn, role AS sender, concat_ws(chr(10), text, ({said})[(conv_id * 5 + turn) % {len(m.TURN_PHRASES)} + 1]) AS text "
        "FROM conversations)"
    )


def pages() -> str:
    more = "[" + ", ".join(map(lit, m.PAGE_SNIPPETS)) + "]"
    return f"page_view AS (SELECT page_id, url, concat_ws('', html, ({more})[page_id % {len(m.PAGE_SNIPPETS)} + 1]) AS html FROM pages)"
