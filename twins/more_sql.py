"""Checklists, pages and languages in DuckDB SQL."""

from __future__ import annotations

from lureline.functions import languageid as l
from lureline.functions import places as p
from lureline.functions.patterns import NOT_WORD
from lureline.functions.patterns import sql_text as q
from lureline.operators import pages as pg
from lureline.operators import verify as v
from twins import links_sql as ln
from twins import text_sql as t
from twins.messages_sql import messages, pages


def checklist() -> str:
    c = v.CHECKS
    return f"""WITH {messages()}, ent AS (SELECT message_id, claimed_domain, recruiter_email, CAST([] AS VARCHAR[]) AS emails FROM messages), {ln.mail_rows()},
r AS (SELECT message_id, 1 AS o, 'manual' AS status, {q(c['company'])} AS "check", claimed_company AS value FROM messages WHERE claimed_company IS NOT NULL
 UNION ALL SELECT message_id, 2, 'manual', {q(c['licence'])}, claimed_license FROM messages WHERE claimed_license IS NOT NULL
 UNION ALL SELECT message_id, 3, 'manual', {q(c['domain'])}, claimed_domain FROM messages WHERE claimed_domain IS NOT NULL
 UNION ALL SELECT message_id, 4, CASE WHEN points > 0 THEN 'warning' ELSE 'reviewed' END, {q(c['email'])}, email FROM mf
 UNION ALL SELECT message_id, 5, 'manual', {q(c['call'])}, '' FROM messages UNION ALL SELECT message_id, 6, 'manual', {q(c['separate'])}, '' FROM messages)
SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY o) AS INTEGER) AS ord, status, "check", value FROM r"""


def sources() -> str:
    rows = ", ".join(f"({q(code)}, {q(c)}, {q(n)}, {q(u)}, {i})" for code, (c, ls) in p.COUNTRY_SOURCES.items() for i, (n, u) in enumerate(ls, 1))
    world = ", ".join(f"({q(n)}, {q(u)}, {i})" for i, (n, u) in enumerate(p.GLOBAL_SOURCES, 1))
    return f"""WITH {messages()}, dim(code, region, source, url, ord) AS (VALUES {rows}), world(source, url, ord) AS (VALUES {world}),
k AS (SELECT message_id, upper(trim(country_code)) AS code FROM messages),
n AS (SELECT k.message_id, any_value(region) AS region, count(dim.code) AS n FROM k LEFT JOIN dim USING (code) GROUP BY k.message_id)
SELECT k.message_id, region AS region_label, {q(p.NOTE)} AS note, CAST(ord AS INTEGER) AS ord, source, url FROM k JOIN dim USING (code)
UNION ALL SELECT message_id, coalesce(region, ''), CASE WHEN region IS NULL THEN {q(p.NOTE_FALLBACK)} ELSE {q(p.NOTE)} END, CAST(n.n + w.ord AS INTEGER), w.source, w.url FROM n, world w"""


def _plain(x: str) -> str:
    for a, b in pg.ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def inspected() -> str:
    flags = ", ".join(f"regexp_matches(lower(visible), {q(rx)}) AS f{i}" for i, (rx, _, _) in enumerate(pg.SIGNALS))
    names = ", ".join(f"CASE WHEN f{i} THEN {q(n)} END" for i, (_, n, _) in enumerate(pg.SIGNALS))
    points = " + ".join(f"CASE WHEN f{i} THEN {w} ELSE 0 END" for i, (_, _, w) in enumerate(pg.SIGNALS))
    stripped = f"regexp_replace(regexp_replace(h, {q(pg.SCRIPT_OR_STYLE)}, ' ', 'g'), '<[^>]*>', ' ', 'g')"
    return f"""{pages()}, h0 AS (SELECT page_id, url, coalesce(html, '') AS h FROM page_view),
h1 AS (SELECT *, substr({_plain(f"regexp_extract(h, {q(pg.TITLE)}, 1)")}, 1, 200) AS title, {_plain(stripped)} AS visible, len(regexp_extract_all(h, '(?i)<form\\b')) AS forms,
 len(regexp_extract_all(h, {q(pg.PASSWORD)})) AS password_fields, len(regexp_extract_all(h, '(?i)<script\\b')) AS script_tags, regexp_extract_all(h, {q(pg.LINK)}, 1) AS links FROM h0),
h2 AS (SELECT *, {flags}, password_fields > 0 AND NOT starts_with(lower(url), 'https://') AS f5, forms >= 3 AS f6 FROM h1),
h3 AS (SELECT *, concat_ws('; ', {names}, CASE WHEN f5 THEN 'password form without https' END, CASE WHEN f6 THEN 'several forms' END) AS signals,
 least(45, {points} + CASE WHEN f5 THEN 15 ELSE 0 END + CASE WHEN f6 THEN 5 ELSE 0 END) AS risk_points FROM h2)"""


def detected() -> str:
    def rng(span):
        a, b = span.split("-")
        return rf"[^\x{{{a}}}-\x{{{b}}}]+"

    script = ", ".join(f"({i}, {q(c)}, {q(rng(s))}, {n})" for i, (c, s, n) in enumerate(l.RANGES))
    counts = " UNION ALL ".join(f"SELECT message_id, {i} AS o, {q(c)} AS lang, length(regexp_replace(text, {q(rng(s))}, '', 'g')) * {n} AS n FROM lw" for i, (c, s, n) in enumerate(l.RANGES))
    words = ", ".join(f"({i}, {q(c)}, {q(w)})" for i, (c, ws) in enumerate([*l.LEXICONS.items(), ("en", l.ENGLISH_MARKERS)]) for w in ws)
    return f"""{messages()}, lw AS MATERIALIZED (SELECT message_id, text, lower(text) AS v, ' ' || regexp_replace(lower(text), {q(NOT_WORD + '+')}, '  ', 'g') || ' ' AS sp FROM messages),
sc0 AS ({counts}), sc AS (SELECT message_id, arg_max(lang, n * 100 - o) AS lang, max(n) AS n FROM sc0 GROUP BY message_id),
lex(o, lang, w) AS (VALUES {words}),
hx AS (SELECT message_id, o, lang, count(*) AS n FROM lw JOIN lex ON CASE WHEN contains(w, ' ') THEN contains(v, w) ELSE contains(sp, ' ' || w || ' ') END GROUP BY ALL),
bx AS (SELECT message_id, arg_max(lang, n * 100 - o) AS lang FROM hx WHERE lang <> 'en' GROUP BY message_id),
det AS MATERIALIZED (SELECT lw.message_id, v, CASE WHEN regexp_matches(text, '[{l.URDU}]') THEN 'ur' WHEN sc.n > 0 THEN sc.lang WHEN bx.lang IS NOT NULL THEN bx.lang WHEN regexp_matches(v, '[a-z]') THEN 'en' ELSE 'unknown' END AS language
 FROM lw JOIN sc USING (message_id) LEFT JOIN bx USING (message_id)),
al AS (SELECT message_id, -1 AS o, language AS lang FROM det WHERE language <> 'unknown' UNION ALL SELECT h.message_id, o, lang FROM hx h JOIN det USING (message_id) WHERE n >= 2 AND lang <> language),
la AS (SELECT message_id, string_agg(lang, ',' ORDER BY o) AS languages FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY o) AS k FROM al) WHERE k <= 4 GROUP BY message_id)"""


def evidence() -> str:
    rows = ", ".join(f"({i}, {q(c)}, {q(x)})" for i, (c, x) in enumerate((c, x) for c, xs in l.SIGNALS.items() for x in xs))
    deny = " OR ".join(f"contains(bf, {q(n)})" for n in l.NEGATIONS)
    aware = ", ".join(f"({i}, {q(a)})" for i, a in enumerate(l.AWARENESS))
    return f"""WITH {detected()}, ph(o, lang, phrase) AS (VALUES {rows}), aw(o, phrase) AS (VALUES {aware}),
e0 AS (SELECT message_id, o, lang <> language AS f, phrase, substr(v, greatest(instr(v, phrase) - 36, 1), least(instr(v, phrase) - 1, 36)) AS bf FROM det JOIN ph ON contains(v, phrase)),
e1 AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY f, o) AS k FROM e0 WHERE NOT ({deny})),
e2 AS (SELECT message_id, string_agg(phrase, ' | ' ORDER BY k) AS evidence FROM e1 WHERE k <= 3 GROUP BY message_id),
a1 AS (SELECT message_id, phrase, row_number() OVER (PARTITION BY message_id ORDER BY o) AS k FROM det JOIN aw ON contains(v, phrase)),
a2 AS (SELECT message_id, string_agg(phrase, ' | ' ORDER BY k) AS awareness FROM a1 WHERE k <= 3 GROUP BY message_id)
SELECT message_id, coalesce(evidence, '') AS evidence, coalesce(awareness, '') AS awareness FROM det LEFT JOIN e2 USING (message_id) LEFT JOIN a2 USING (message_id)"""


def names() -> str:
    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in l.NAMES.items())
    return f"WITH n(code, name) AS (VALUES {rows}) SELECT code, name, count(doc_id) AS documents FROM n LEFT JOIN documents d ON d.lang = n.code GROUP BY code, name"


def sql() -> dict[str, str]:
    return {
        "l1_checklist": checklist(),
        "l2_official_sources": sources(),
        "m_page_findings": f"WITH {inspected()} SELECT page_id, title, substr(visible, 1, 1000) AS excerpt, CAST(forms AS INTEGER) AS forms, CAST(password_fields AS INTEGER) AS password_fields, CAST(script_tags AS INTEGER) AS script_tags, signals, risk_points FROM h3",
        "m4_page_links": f"WITH {inspected()} SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM (SELECT page_id, unnest(links) AS link, unnest(range(1, len(links) + 1)) AS pos FROM h3)",
        "n2_language": f"WITH {detected()} SELECT message_id, language, coalesce(languages, 'unknown') AS languages FROM det LEFT JOIN la USING (message_id)",
        "n4_localized_evidence": evidence(),
        "n6_language_names": names(),
    }
