"""Entities, links, domains and mail identity in DuckDB SQL, row per entity."""

from __future__ import annotations

from lureline.functions import places as p
from lureline.functions.patterns import sql_text as q
from lureline.operators import links as l
from twins import text_sql as t


def listed(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def first_seen(values: str) -> str:
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


def urls(x: str) -> str:
    bare = t.rep("u", r"[.,;:!?)\]}]+\z", "")
    return f"list_transform({found(x, l.URL)}, lambda u: CASE WHEN starts_with(lower({bare}), 'www.') THEN 'https://' || {bare} ELSE {bare} END)"


def arrays(source: str, key: str = "message_id") -> str:
    """CTE ent: arrays of entities, first seen first, at most twenty per kind."""
    wallets = " || ".join(f"list_transform({found('normalized', rx)}, lambda w: {{'subtype': {q(n)}, 'value': w}})" for n, rx in l.WALLETS)
    phones = f"list_transform({found('normalized', l.PHONE, 1)}, lambda v: {t.clip('v', 220)})"
    return f"""ent0 AS (SELECT *, {urls('normalized')} AS u0, {found('normalized', l.EMAIL)} AS m0, {phones} AS p0, {found('normalized', l.HANDLE, 1)} AS h0, {wallets} AS w0 FROM {source}),
ent AS MATERIALIZED (SELECT *, ({first_seen('u0')}) AS urls, ({first_seen('m0')}) AS emails, ({first_seen('p0')}) AS phones, ({first_seen('h0')}) AS handles, w0 AS wallets FROM ent0)"""


def entity_rows() -> str:
    parts = [f"SELECT message_id, {q(k)} AS kind, '' AS subtype, unnest({c}) AS value, unnest(range(1, len({c}) + 1)) AS pos FROM ent" for k, c in (("url", "urls"), ("email", "emails"), ("phone", "phones"), ("handle", "handles"))]
    parts.append("SELECT message_id, 'wallet' AS kind, w.subtype AS subtype, w.value AS value, pos FROM (SELECT message_id, unnest(wallets) AS w, unnest(range(1, len(wallets) + 1)) AS pos FROM ent)")
    return " UNION ALL ".join(parts)


def domains(source: str, host: str, out: str) -> str:
    """CTE ``out``: distinct hosts of ``source`` with valid, domain and suffix, from suffix rows joined on equality."""
    return f"""{out}_h AS (SELECT DISTINCT {host} AS raw, lower(regexp_replace(coalesce({host}, ''), '^[\\s.]+|[\\s.]+\\z', '', 'g')) AS h FROM {source}),
{out}_l AS (SELECT raw, h, string_split(h, '.') AS labels, len(string_split(h, '.')) AS n FROM {out}_h),
{out}_s AS (SELECT raw, h, n, unnest(range(0, n)) AS i, labels FROM {out}_l),
{out}_m AS (SELECT raw, max(CASE WHEN array_to_string(labels[i + 1:], '.') IN {listed(p.EXCEPTIONS)} THEN n - i - 1 ELSE 0 END) AS barred,
  max(CASE WHEN array_to_string(labels[i + 1:], '.') IN {listed(p.SUFFIXES)} OR (i + 1 < n AND array_to_string(labels[i + 2:], '.') IN {listed(p.WILDCARDS)}) THEN n - i ELSE 1 END) AS hit FROM {out}_s GROUP BY raw),
{out}_z AS (SELECT l.*, CASE WHEN barred > 0 THEN barred ELSE hit END AS size, regexp_matches(h, {q(l.IPV4)}) OR contains(h, ':') AS ip,
  n < 2 OR regexp_matches(h, '^\\.|\\.\\.|\\.$') AS bad FROM {out}_l l JOIN {out}_m m ON l.raw IS NOT DISTINCT FROM m.raw),
{out} AS (SELECT raw, ip OR NOT bad AS valid, CASE WHEN ip THEN h WHEN bad THEN '' WHEN n > size THEN array_to_string(labels[n - size:], '.') ELSE h END AS domain,
  CASE WHEN ip OR bad THEN '' ELSE array_to_string(labels[n - size + 1:], '.') END AS suffix FROM {out}_z)"""


def brand_rows(source: str, out: str) -> str:
    """CTE ``out``: (domain, brand) for each distinct domain that looks like a brand it is not."""
    rows = ", ".join(f"({q(b)}, {q(b.replace(' ', ''))}, [{', '.join(map(q, o))}], {i})" for i, (b, o) in enumerate(p.BRANDS.items()))
    return f"""{out}_b(brand, name, official, ord) AS (VALUES {rows}),
{out}_d AS (SELECT DISTINCT domain, replace(split_part(domain, '.', 1), '-', '') AS label FROM {source} WHERE domain <> ''),
{out} AS (SELECT domain, brand, ord FROM {out}_d JOIN {out}_b ON (contains(label, name) OR levenshtein(label, name) <= CASE WHEN length(name) < 7 THEN 1 ELSE 2 END)
  WHERE NOT list_contains(official, domain))"""


def host_of(url: str) -> str:
    """The host of a link that has a scheme."""
    authority = f"regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1)"
    return f"regexp_replace(lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', '')), '\\.+$', '')"


def link_rows(source: str, out: str = "lf") -> str:
    """CTE ``out``: one row per (message_id, pos, raw link) of ``source`` with its parts, signals and points."""
    bare = t.rep("raw_url", r"^\s+|\s+\z", "")
    return f"""{out}_0 AS (SELECT *, CASE WHEN regexp_matches({bare}, '(?i)^https?://') THEN {bare} ELSE 'https://' || {bare} END AS url FROM {source}),
{out}_1 AS (SELECT *, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS authority, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM {out}_0),
{out}_2 AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '\\.+$', '') AS host FROM {out}_1),
{domains(out + '_2', 'host', out + '_dom')},
{brand_rows(out + '_dom', out + '_br')},
{out}_bl AS (SELECT domain, string_agg(brand, ',' ORDER BY ord) AS brands FROM {out}_br GROUP BY domain),
{out}_3 AS (SELECT x.*, d.valid AS dvalid, d.domain, d.suffix, b.brands, regexp_matches(authority, '\\[[^\\]]*$|^[^\\[]*\\]') OR regexp_matches(host, '^\\.|\\.\\.') AS bad
  FROM {out}_2 x JOIN {out}_dom d ON x.host = d.raw LEFT JOIN {out}_bl b ON b.domain = d.domain),
{out}_4 AS (SELECT *, [CASE WHEN scheme <> 'https' THEN 'no https' END, CASE WHEN contains(authority, '@') THEN 'credentials in the link' END,
  CASE WHEN regexp_matches(host, {q(l.IPV4)}) THEN 'address instead of a domain' END, CASE WHEN host IN {listed(p.SHORTENERS)} THEN 'shortened link' END,
  CASE WHEN string_split(suffix, '.')[-1] IN {listed(p.RISKY_ENDINGS)} THEN 'often abused ending' END, CASE WHEN contains(host, 'xn--') THEN 'punycode host' END,
  CASE WHEN len(string_split(host, '.')) - 1 >= 4 THEN 'many host levels' END, CASE WHEN length(url) > 180 THEN 'very long link' END,
  CASE WHEN regexp_matches(host || path, {q(l.LURES)}) THEN 'lure terms' END, CASE WHEN brands IS NOT NULL THEN 'looks like a brand' END] AS s FROM {out}_3),
{out} AS MATERIALIZED (SELECT *, NOT bad AND host <> '' AND (contains(host, '.') OR dvalid) AS valid,
  CASE WHEN bad THEN 'malformed link' ELSE array_to_string(list_filter(s, lambda v: v IS NOT NULL), '; ') END AS signals,
  CASE WHEN bad THEN 20 ELSE least(40, CASE WHEN s[1] IS NULL THEN 0 ELSE 6 END + CASE WHEN s[2] IS NULL THEN 0 ELSE 20 END + CASE WHEN s[3] IS NULL THEN 0 ELSE 12 END
   + CASE WHEN s[4] IS NULL THEN 0 ELSE 10 END + CASE WHEN s[5] IS NULL THEN 0 ELSE 7 END + CASE WHEN s[6] IS NULL THEN 0 ELSE 8 END + CASE WHEN s[7] IS NULL THEN 0 ELSE 5 END
   + CASE WHEN s[8] IS NULL THEN 0 ELSE 5 END + CASE WHEN s[9] IS NULL THEN 0 ELSE 7 END + CASE WHEN s[10] IS NULL THEN 0 ELSE 22 END) END AS points FROM {out}_4)"""


def message_links() -> str:
    """CTE ml: links of each message, the given one first, at most ten."""
    return """ml0 AS (SELECT message_id, CASE WHEN coalesce(source_url, '') <> '' AND NOT list_contains(urls, source_url) THEN [source_url] || urls ELSE urls END AS links FROM ent),
ml AS (SELECT message_id, unnest(links) AS raw_url, unnest(range(1, len(links) + 1)) AS pos FROM ml0)"""


def mail_rows() -> str:
    """CTE mf: addresses of each message with signals and points."""
    return f"""mm0 AS (SELECT message_id, claimed_domain, CASE WHEN coalesce(recruiter_email, '') <> '' AND NOT list_contains(emails, recruiter_email) THEN [recruiter_email] || emails ELSE emails END AS mails FROM ent),
mm1 AS (SELECT message_id, claimed_domain, unnest(mails) AS email, unnest(range(1, len(mails) + 1)) AS pos FROM mm0),
mm2 AS (SELECT *, regexp_replace(lower(regexp_extract(email, '@([^@\\s]+)$', 1)), '^\\.+|\\.+$', '', 'g') AS host,
  regexp_replace(regexp_replace(coalesce(claimed_domain, ''), '^[A-Za-z]+://', ''), '[/?#].*$|:[0-9]+.*$', '') AS wanted FROM mm1),
{domains('mm2', 'host', 'md')},
{domains('mm2', 'wanted', 'mc')},
{brand_rows('md', 'mb')},
mf0 AS (SELECT x.*, d.domain, c.domain AS claimed, regexp_matches(email, '^[^@\\s]+@[^@\\s]+$') AS good, d.domain IN {listed(p.FREE_MAIL)} AS free,
  c.domain <> '' AND c.domain <> d.domain AS other, d.domain IN (SELECT domain FROM mb) AS alike
  FROM mm2 x JOIN md d ON x.host = d.raw JOIN mc c ON x.wanted = c.raw),
mf AS MATERIALIZED (SELECT message_id, pos, email, CASE WHEN good THEN domain ELSE '' END AS domain,
  CASE WHEN NOT good THEN 'malformed address' ELSE concat_ws('; ', CASE WHEN free THEN 'free mail' END, CASE WHEN other THEN 'not the claimed domain' END, CASE WHEN alike THEN 'looks like a brand' END) END AS signals,
  CASE WHEN NOT good THEN 8 ELSE least(35, CASE WHEN free THEN 10 ELSE 0 END + CASE WHEN other THEN 22 ELSE 0 END + CASE WHEN alike THEN 22 ELSE 0 END) END AS points FROM mf0)"""
