"""Stages, the n-gram classifier and the verdict in DuckDB SQL."""

from __future__ import annotations

from lureline.functions.patterns import sql_text as q
from lureline.functions.seeds import ORDINARY, RISKY
from lureline.operators import bayes as b
from lureline.operators import stages as s
from lureline.operators.rules import ALL_RULES
from twins import links_sql as ln
from twins import rules_sql as r
from twins import text_sql as t
from twins.messages_sql import turns

STAGE_ROWS = ", ".join(f"({i}, {q(n)}, {q(rx)})" for i, (n, rx) in enumerate(s.STAGES))


def tagged() -> str:
    hits = " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS ord, {q(n)} AS stage FROM n7 WHERE regexp_matches(lower(normalized), {q(rx)})" for i, (n, rx) in enumerate(s.STAGES))
    return f"{turns()},\n{t.normal_ctes('turns')},\nhits AS MATERIALIZED ({hits})"


def escalated(source: str, key: str) -> str:
    """CTE esc from rows (key, ord, stage, first)."""
    return f"""esc0 AS (SELECT *, lag(first) OVER (PARTITION BY {key} ORDER BY ord) AS before FROM {source}),
esc AS (SELECT {key}, count(*) AS stages, count(*) FILTER (WHERE before <= first) AS pairs, string_agg(stage, ' -> ' ORDER BY ord) AS pattern FROM esc0 GROUP BY {key})"""


def conversations() -> str:
    return f"""WITH {tagged()},
firsts AS (SELECT conv_id, ord, stage, min(turn) + 1 AS first FROM hits GROUP BY conv_id, ord, stage),
{escalated('firsts', 'conv_id')}
SELECT c.conv_id, c.message_count, CAST(coalesce(stages, 0) AS INTEGER) AS stage_count, CAST(coalesce(pairs, 0) AS INTEGER) AS ordered_pairs,
  CAST(least(30, 4 * coalesce(stages, 0) + 2 * coalesce(pairs, 0)) AS INTEGER) AS escalation_score, coalesce(pattern, {q(s.NONE)}) AS pattern
FROM (SELECT conv_id, count(*) AS message_count FROM turns GROUP BY conv_id) c LEFT JOIN esc USING (conv_id)"""


def lines(source: str, text: str) -> str:
    """CTE tl: the turns read from each message's lines."""
    f = lambda g: f"regexp_replace(regexp_extract(line, {q(s.LINE)}, {g}), '^\\s+|\\s+\\z', '', 'g')"
    return f"""ln0 AS (SELECT message_id, unnest(string_split({text}, chr(10))) AS line, unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS no FROM {source}),
ln1 AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY no) AS turn, count(*) OVER (PARTITION BY message_id) AS many FROM ln0 WHERE regexp_matches(line, {q(s.LINE)})),
tl AS MATERIALIZED (SELECT message_id, turn, {f(1)} AS ts, {f(2)} AS sender, {f(3)} AS body FROM ln1 WHERE many >= 2
  UNION ALL SELECT message_id, 1, '', 'Input', {text} FROM {source} WHERE message_id NOT IN (SELECT message_id FROM ln1 WHERE many >= 2))"""


def grams(source: str, key: str, text: str, out: str) -> str:
    """CTE ``out``: (key, gram) for every feature sighted, with repeats."""
    flat = f"regexp_replace(lower({text}), '\\s+', ' ', 'g')"
    parts = [f"SELECT {key}, substr(x, i, {n}) AS gram FROM (SELECT {key}, x, unnest(range(1, length(x) - {n - 2})) AS i FROM {out}_p)" for n in (3, 4, 5)]
    word = f"SELECT {key}, 'w:' || unnest(regexp_extract_all(y, '[\\pL\\pN]{{2,}}')) AS gram FROM {out}_p"
    return f"{out}_p AS (SELECT {key}, {flat} AS y, '  ' || {flat} || '  ' AS x FROM {source}),\n{out} AS ({' UNION ALL '.join([*parts, word, word])})"


def model(rows: str, name: str = "m") -> str:
    """CTEs from (label, normalized) rows with a key ``k``: counts, totals, weights."""
    micro = lambda e: f"CAST(round(ln({e}) * {b.MICRO}) AS BIGINT)"
    return f"""{grams(rows, 'k', 'normalized', name + 'g')},
{name}c AS MATERIALIZED (SELECT gram, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1 FROM {name}g JOIN {rows} USING (k) GROUP BY gram),
{name}t AS MATERIALIZED (SELECT sum(c0) AS t0, sum(c1) AS t1, count(*) AS vocab, (SELECT count(*) FROM {rows} WHERE label = 0) AS d0, (SELECT count(*) FROM {rows} WHERE label = 1) AS d1 FROM {name}c),
{name}w AS MATERIALIZED (SELECT gram, {micro('(c1 + 1) / (t1 + vocab)')} - {micro('(c0 + 1) / (t0 + vocab)')} AS weight FROM {name}c, {name}t),
{name}k AS MATERIALIZED (SELECT {micro('1 / (t1 + vocab)')} - {micro('1 / (t0 + vocab)')} AS unseen, {micro('(d1 + 1) / (d0 + d1 + 2)')} - {micro('(d0 + 1) / (d0 + d1 + 2)')} AS prior FROM {name}t)"""


def scored(source: str, key: str, name: str = "m", out: str = "sc") -> str:
    """CTE ``out``: key, features, delta."""
    return f"""{grams(source, key, 'normalized', out + 'g')},
{out}f AS (SELECT {key}, gram, least(count(*), 3) AS times FROM {out}g GROUP BY {key}, gram),
{out} AS MATERIALIZED (SELECT {key}, CAST(count(*) AS INTEGER) AS features, CAST(greatest(-{30 * b.MICRO}, least({30 * b.MICRO}, sum(times * coalesce(weight, unseen)) + max(prior))) AS BIGINT) AS delta
  FROM {out}f LEFT JOIN {name}w USING (gram), {name}k GROUP BY {key})"""


def probability(heat: float) -> str:
    return f"round_even(1 / (1 + exp(-(delta / {b.MICRO}) / {heat})), 4)"


def seed_rows() -> str:
    rows = ", ".join(f"({i}, {q(x)}, {y})" for i, (x, y) in enumerate([(x, 0) for x in ORDINARY] + [(x, 1) for x in RISKY]))
    ctes = t.normal_ctes("seed0")
    for i in range(8):
        ctes = ctes.replace(f"n{i} AS", f"z{i} AS").replace(f"FROM n{i}", f"FROM z{i}")
    return f"seed0(k, text, label) AS (VALUES {rows}),\n{ctes},\nseeds AS MATERIALIZED (SELECT k, label, normalized FROM z7)"


def opinion(text: str = "text") -> str:
    """CTE op: supported, very_short per message of n7."""
    known = " + ".join(t.letters(text, x) for x in b.SUPPORTED)
    nothing = t.rep(text, r"\PL+", "")
    return (f"op AS (SELECT message_id, ({known}) * 2 >= greatest(1, length({nothing})) AS supported, "
            f"length({t.rep('normalized', '[^' + chr(92) + 'pL' + chr(92) + 'pN_]+', '')}) < 12 AS very_short FROM n7)")


def verdict() -> str:
    hits = " UNION ALL ".join(f"SELECT message_id, turn, {i} AS ord, {q(n)} AS stage FROM tl WHERE regexp_matches(lower(body), {q(rx)})" for i, (n, rx) in enumerate(s.STAGES))
    return f"""WITH {r.all_ctes()},
{ln.arrays('n7')}, {ln.message_links()}, {ln.link_rows('ml')}, {ln.mail_rows()},
{lines('n7', 'normalized')}, shits AS ({hits}), firsts AS (SELECT message_id, ord, stage, min(turn) AS first FROM shits GROUP BY ALL), {escalated('firsts', 'message_id')},
{seed_rows()}, {model('seeds', 'nb')}, {scored('n7', 'message_id', 'nb')}, {opinion()},
fr AS (SELECT message_id, sum(weight) AS pts, count(*) AS n, bool_or(severity = 'critical') AS crit, arg_min(category, ord) AS primary_pattern FROM findings GROUP BY message_id),
a AS (SELECT n.message_id, coalesce(f.n, 0) AS n, coalesce(crit, false) AS crit, coalesce(f.primary_pattern, 'No decisive pattern') AS primary_pattern,
  least(68, round_even(72 * (1 - pow(2.718281828, -coalesce(pts, 0) / 70)), 0)) AS rule_component,
  least(28, coalesce((SELECT sum(points) FROM lf WHERE lf.message_id = n.message_id), 0)) AS url_component,
  least(25, coalesce((SELECT sum(points) FROM mf WHERE mf.message_id = n.message_id), 0)) AS identity_component,
  CASE WHEN {unicode_any('o')} THEN 7 ELSE 0 END AS unicode_component,
  least(30, 4 * coalesce(stages, 0) + 2 * coalesce(pairs, 0)) AS conversation_component, features, {probability(2.4)} AS calibrated, supported, very_short
  FROM n7 n LEFT JOIN fr f USING (message_id) LEFT JOIN esc USING (message_id) JOIN sc USING (message_id) JOIN op USING (message_id)),
b AS (SELECT *, NOT supported OR very_short OR (calibrated BETWEEN 0.35 AND 0.65 AND features < 80) AS abstained FROM a),
c AS (SELECT *, CASE WHEN abstained THEN 0 ELSE round_even(calibrated * 28, 0) END AS full_points FROM b),
d AS (SELECT *, CASE WHEN n = 0 THEN least(full_points, 10) ELSE full_points END AS model_component FROM c),
e AS (SELECT *, least(100, rule_component + url_component + identity_component + unicode_component + conversation_component + model_component) AS risk_score FROM d),
v AS (SELECT *, CASE WHEN abstained AND NOT crit THEN 'Needs review' WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 25 THEN 'Elevated' ELSE 'Low' END AS risk_band FROM e)"""


def unicode_any(x: str) -> str:
    mixed = f"regexp_matches({x}, '\\p{{Latin}}') AND (regexp_matches({x}, '\\p{{Cyrillic}}') OR regexp_matches({x}, '\\p{{Greek}}'))"
    return f"(length({x}) > length({t.strip_invisible(x)}) OR ({mixed}) OR {t.lookalikes(x)} <> {x})"


VERDICT_COLUMNS = ("message_id, CAST(n AS INTEGER) AS finding_count, primary_pattern, CAST(rule_component AS INTEGER) AS rule_component, CAST(url_component AS INTEGER) AS url_component, "
                   "CAST(identity_component AS INTEGER) AS identity_component, CAST(unicode_component AS INTEGER) AS unicode_component, CAST(conversation_component AS INTEGER) AS conversation_component, "
                   "CAST(model_component AS INTEGER) AS model_component, abstained, CAST(risk_score AS INTEGER) AS risk_score, risk_band")
