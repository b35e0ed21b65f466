"""Corpus, checks, samples, evaluation and event windows in DuckDB SQL."""

from __future__ import annotations

from lureline.functions import taxonomy as x
from lureline.functions.languageid import NAMES
from lureline.functions.patterns import sql_text as q
from lureline.operators import evaluate, manifest, sampling
from lureline.operators.corpus import BRANDS
from lureline.sources.intake import FIELDS
from twins import rules_sql, score_sql
from twins import text_sql as t
from twins.messages_sql import messages, turns

LANGS = list(NAMES)


def values(rows) -> str:
    def one(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def split(g: str) -> str:
    n = f"(('0x' || substr(sha256({g}), 1, 8))::BIGINT % 100)"
    return f"CASE WHEN {n} < 80 THEN 'train' WHEN {n} < 90 THEN 'validation' ELSE 'test' END"


def sql() -> dict[str, str]:
    msgs = f"WITH {messages()}"

    def counted(table, columns):
        return " UNION ALL ".join(f"SELECT {q(c)} AS dimension, {c} AS value, count(*) AS rows FROM {table} GROUP BY {c}" for c in columns)

    doc_split = split("'doc-' || doc_id")
    caps = ", ".join(f"coalesce({c}, '') AS {c}" for c in FIELDS)
    evaluated = f"{score_sql.verdict()}, ev AS (SELECT v.*, d.lang, d.expected_rule IS NOT NULL AS scam FROM v JOIN messages d USING (message_id))"
    out = {
        "a1_json_lines": "SELECT doc_id, lang, source, n_chars FROM documents",
        "a2_message_intake": f"{msgs}, i AS (SELECT message_id, {caps} FROM messages) SELECT message_id, CAST(length(text) AS INTEGER) AS chars, source_url, claimed_domain, recruiter_email FROM i WHERE trim(text) <> '' OR trim(source_url) <> ''",
        "a3_turn_intake": f"WITH {turns()} SELECT conv_id, turn + 1 AS message, {t.rep(t.rep("coalesce(sender, 'Unknown')", r'\s+', ' '), r'^ | \z', '')} AS sender, text FROM turns WHERE trim(text) <> ''",
        "a10_page_source": "SELECT page_id, url, CAST(length(html) AS INTEGER) AS chars FROM pages",
        "o9_hash_split": f"SELECT doc_id, {doc_split} AS split FROM documents",
        "o12_dedup": "SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS norm_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
        "p3_duplicate_content": "SELECT sha256(text) AS content_sha256, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
        "p10_split_isolation": f"SELECT grp, count(*) AS rows, min(split) AS low, max(split) AS high FROM (SELECT sha256(text) AS grp, {doc_split} AS split FROM documents) GROUP BY grp HAVING count(DISTINCT split) > 1",
        "p12_reserved_urls": "SELECT page_id, url, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '(?:^|\\.)(?:invalid|example)$') AS reserved FROM pages",
        "q4_document_distributions": counted("documents", ("lang", "source")),
        "q7_review_queue": "SELECT lang, doc_id, CAST(k AS INTEGER) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS k FROM documents WHERE lang <> 'en') WHERE k <= 160",
        "s1_evaluation": f"""{evaluated} SELECT lang, count(*) FILTER (WHERE scam) AS scams, count(*) FILTER (WHERE scam AND risk_score < {evaluate.FLAGGED}) AS missed, count(*) FILTER (WHERE NOT scam) AS ordinary,
          count(*) FILTER (WHERE NOT scam AND risk_score >= {evaluate.FLAGGED}) AS flagged, count(*) FILTER (WHERE NOT scam AND risk_band IN ('High', 'Critical')) AS over_ceiling FROM ev GROUP BY lang""",
        "s2_regression_diff": f"""{evaluated}, ka AS (SELECT message_id FROM ev WHERE scam AND NOT crit), kb AS (SELECT message_id FROM ev WHERE scam AND risk_score < {evaluate.FLAGGED})
          SELECT message_id, 'fixed' AS state FROM ka WHERE message_id NOT IN (SELECT message_id FROM kb) UNION ALL SELECT message_id, 'new' FROM kb WHERE message_id NOT IN (SELECT message_id FROM ka)""",
        "s3_missing_rules": f"WITH {rules_sql.all_ctes()} SELECT message_id, coalesce(expected_rule, 'job_upfront_fee') AS rule_id FROM messages WHERE (message_id, coalesce(expected_rule, 'job_upfront_fee')) NOT IN (SELECT (message_id, rule_id) FROM findings)",
        "s5_variant_matrix": """SELECT item_id, v.n AS variant_no, sha256(CASE v.n WHEN 0 THEN text WHEN 1 THEN replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS') WHEN 2 THEN 'Good morning. ' || text WHEN 3 THEN text || ' Best wishes.' WHEN 4 THEN 'Visitor: ' || text ELSE '[08:15] Desk: ' || text END) AS text_sha256
          FROM benchmark, (VALUES (0), (1), (2), (3), (4), (5)) v(n)""",
        "t2_running_escalation": score_sql.conversations(),
        "t2_escalation_alerts": f"""WITH {score_sql.tagged()}, upto AS (SELECT t.conv_id, t.turn, h.ord, h.stage, min(h.turn) AS first FROM turns t JOIN hits h ON h.conv_id = t.conv_id AND h.turn <= t.turn GROUP BY ALL),
          {score_sql.escalated('upto', 'conv_id, turn')}, s AS (SELECT t.conv_id, t.turn, CAST(least(30, 4 * coalesce(stages, 0) + 2 * coalesce(pairs, 0)) AS INTEGER) AS escalation_score FROM turns t LEFT JOIN esc USING (conv_id, turn)),
          l AS (SELECT *, CASE WHEN escalation_score >= 22 THEN 'act' WHEN escalation_score >= 14 THEN 'warn' WHEN escalation_score >= 6 THEN 'watch' ELSE 'quiet' END AS level FROM s),
          p AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY conv_id ORDER BY turn), 'quiet') AS previous FROM l) SELECT conv_id, turn, escalation_score, level, previous FROM p WHERE level <> previous""",
        "t3_window_counts": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS rows FROM events GROUP BY ALL",
        "t3_sliding_counts": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts) - o.h * INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS rows FROM events, (VALUES (0), (1)) o(h) GROUP BY ALL",
        "t4_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a),
          c AS (SELECT user_id, s, min(ts) AS f, max(ts) + INTERVAL '30 minutes' AS l, count(*) AS events FROM b GROUP BY user_id, s)
          SELECT user_id, CAST(f AS VARCHAR) AS session_start, CAST(l AS VARCHAR) AS session_end, events FROM c""",
    }
    return out
