"""SQL text per query key."""

from __future__ import annotations

from lureline.functions.patterns import sql_text as q
from lureline.operators import stages as st
from lureline.operators.rules import ENGLISH
from lureline.operators.verdict import LEVELS
from lureline.functions import text as ft
from twins import corpus_sql, given_sql, more_sql
from twins import links_sql as ln
from twins import rules_sql as r
from twins import score_sql as s
from twins import text_sql as t
from twins.messages_sql import messages, pages, turns


def sql() -> dict[str, str]:
    out = {}
    msgs = messages()
    normal = f"{msgs},\n{t.normal_ctes('messages')}"
    steps = ", ".join(f"CASE WHEN {a} <> {b} THEN {q(n)} END" for a, b, n in (
        ("o", "s1", "compatibility forms folded"), ("s1", "s2", "invisible characters removed"), ("s2", "s3", "defanged notation restored"),
        ("s3", "s4", "look-alikes mapped"), ("s4", "s5", "spaced letters joined"), ("s5", "s6", "digit spellings decoded")))
    out["b_normalize"] = f"WITH {normal} SELECT message_id, normalized, s4 AS skeleton, concat_ws('; ', {steps}) AS steps FROM n7"
    hidden = f"length(text) - length({t.strip_invisible('text')})"
    out["b9_unicode_signals"] = f"""WITH {msgs} SELECT message_id, concat_ws('; ', CASE WHEN {hidden} > 0 THEN 'invisible characters: ' || ({hidden}) END,
      CASE WHEN regexp_matches(text, '\\p{{Latin}}') AND (regexp_matches(text, '\\p{{Cyrillic}}') OR regexp_matches(text, '\\p{{Greek}}')) THEN 'Latin mixed with Cyrillic or Greek' END,
      CASE WHEN {t.lookalikes('text')} <> text THEN 'look-alike characters' END) AS signals FROM messages"""
    counts = ", ".join(f"{t.letters('text', x)} AS n_{x}" for x in ft.SCRIPTS)
    nothing = t.rep("text", r"\PL+", "")
    out["b10_script_profile"] = f"""WITH {msgs}, c AS (SELECT message_id, length({nothing}) AS letters, {counts} FROM messages)
      SELECT message_id, concat_ws(',', {', '.join(f"CASE WHEN n_{x} > 0 THEN '{x}' END" for x in ft.SCRIPTS)}) AS scripts, CAST(letters AS INTEGER) AS letter_count,
      round(({' + '.join('n_' + x for x in ft.SCRIPTS)}) / greatest(1, letters), 6) AS recognized_ratio FROM c"""
    out["b11_fold"] = f"WITH {msgs}, f AS (SELECT message_id, {t.accents('text')} AS folded FROM messages) SELECT message_id, folded, {t.german('folded')} AS folded_de FROM f"
    out["b14_fingerprint"] = f"WITH {msgs} SELECT message_id, sha256(text) AS input_sha256, {t.clip('text', 220)} AS excerpt, {t.plain_urls('text')} AS plain FROM messages"
    rules = r.all_ctes()
    out["c1_rule_scan"] = f"WITH {rules} SELECT message_id, rule_id, severity, weight, evidence FROM findings"
    own, name = r.supplied()
    out["u1_supplied_rules"] = f"WITH {own} SELECT message_id, rule_id, severity, weight, evidence, {q(name)} AS rule_set FROM findings"
    out["c3_findings_rollup"] = f"""WITH {rules}, act AS (SELECT message_id, action, min(ord) AS o FROM findings GROUP BY message_id, action),
      act6 AS (SELECT message_id, string_agg(action, ' | ' ORDER BY o) AS actions FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY o) AS k FROM act) WHERE k <= 6 GROUP BY message_id),
      g AS (SELECT message_id, sum(weight) AS p, count(*) AS n, bool_or(severity = 'critical') AS c, arg_min(category, ord) AS cat FROM findings GROUP BY message_id)
      SELECT n7.message_id, CAST(coalesce(p, 0) AS INTEGER) AS rule_points, CAST(coalesce(n, 0) AS INTEGER) AS finding_count, coalesce(c, false) AS has_critical, coalesce(cat, 'No decisive pattern') AS primary_pattern,
      coalesce(actions, 'Verify the sender and the offer through official channels found independently before acting.') AS actions FROM n7 LEFT JOIN g USING (message_id) LEFT JOIN act6 USING (message_id)"""
    out["c5_language_rules"] = f"WITH {rules} SELECT rule_id, count(*) AS messages, max(weight) AS weight FROM findings WHERE ord >= {len(ENGLISH)} GROUP BY rule_id"
    out["d_expected_rules"] = f"""WITH {rules} SELECT coalesce(expected_rule, '-') AS expected_rule, count(*) AS messages, count(*) FILTER (WHERE (message_id, expected_rule) IN (SELECT (message_id, rule_id) FROM findings)) AS met
      FROM n7 GROUP BY 1"""
    ent = f"{normal},\n{ln.arrays('n7')}"
    out["e_entities"] = f"WITH {ent} SELECT message_id, kind, subtype, value, CAST(pos AS INTEGER) AS pos FROM ({ln.entity_rows()})"
    lf = f"{ent}, {ln.message_links()}, {ln.link_rows('ml')}"
    out["f_link_risk"] = f"WITH {lf} SELECT message_id, CAST(pos AS INTEGER) AS pos, url, scheme, host, domain, suffix, valid, signals, points FROM lf"
    out["f_page_links"] = f"WITH src AS (SELECT page_id, url AS raw_url FROM pages), {ln.link_rows('src')} SELECT page_id, url, host, domain, suffix, signals, points FROM lf"
    out["g3_brand_lookalikes"] = f"WITH {lf} SELECT domain, brand, count(DISTINCT message_id) AS messages FROM lf JOIN lf_br USING (domain) GROUP BY domain, brand"
    out["g1_registrable"] = f"""WITH {lf}, hosts AS (SELECT host FROM lf UNION ALL SELECT {ln.host_of('url')} FROM pages), {ln.domains('hosts', 'host', 'dom')}
      SELECT raw AS host, valid, domain, suffix FROM dom"""
    ending = "array_to_string(string_split(host, '.')[-1 - page_id % 2:], '.')"
    out["a6_suffix_rows"] = f"""WITH h AS (SELECT page_id, {ln.host_of('url')} AS host FROM pages),
      lines AS (SELECT lower(trim(CASE page_id % 6 WHEN 0 THEN '// ' || {ending} WHEN 1 THEN '*.' || {ending} WHEN 2 THEN '!' || host WHEN 3 THEN '  ' WHEN 4 THEN ' ' || upper({ending}) || ' ' ELSE {ending} END)) AS v FROM h)
      SELECT DISTINCT CASE WHEN starts_with(v, '!') THEN substr(v, 2) WHEN starts_with(v, '*.') THEN substr(v, 3) ELSE v END AS suffix,
        CASE WHEN starts_with(v, '!') THEN 'exception' WHEN starts_with(v, '*.') THEN 'wildcard' ELSE 'exact' END AS kind FROM lines WHERE v <> '' AND NOT starts_with(v, '//')"""
    out["h_email_identity"] = f"WITH {ent}, {ln.mail_rows()} SELECT message_id, CAST(pos AS INTEGER) AS pos, email, domain, signals, points FROM mf"
    out["i1_stage_tags"] = f"WITH {s.tagged()} SELECT t.conv_id, t.turn, coalesce(string_agg(stage, ',' ORDER BY ord), '') AS stages FROM turns t LEFT JOIN hits h USING (conv_id, turn) GROUP BY t.conv_id, t.turn"
    out["i2_first_turns"] = f"WITH {s.tagged()} SELECT conv_id, stage, min(turn) + 1 AS first_message FROM hits GROUP BY conv_id, stage"
    out["i4_escalation"] = s.conversations()
    out["i6_timeline"] = f"""WITH {s.tagged()} SELECT t.conv_id, t.turn + 1 AS message, t.sender, string_agg(stage, ',' ORDER BY ord) AS stages, {t.clip('any_value(t.text)', 150)} AS excerpt
      FROM turns t JOIN hits USING (conv_id, turn) GROUP BY t.conv_id, t.turn, t.sender"""
    out["a4_turn_parse"] = f"WITH {normal}, {s.lines('n7', 'normalized')} SELECT message_id, CAST(turn AS INTEGER) AS turn, ts, sender, body FROM tl"
    lab = f"lab0 AS (SELECT d.doc_id AS k, d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL),\n{t.normal_ctes('lab0')},\nlab AS MATERIALIZED (SELECT k, label, normalized FROM n7)"
    out["j2_train"] = f"WITH {lab}, {s.model('lab')} SELECT gram, weight, c0 + c1 AS seen FROM mw JOIN mc USING (gram)"
    docs = t.normal_ctes("docs0")
    for i in range(8):
        docs = docs.replace(f"n{i} AS", f"y{i} AS").replace(f"FROM n{i}", f"FROM y{i}")
    out["j3_score"] = f"""WITH {lab}, {s.model('lab')}, docs0 AS (SELECT doc_id, text FROM documents), {docs}, {s.scored('y7', 'doc_id')}
      SELECT doc_id, features, delta, {s.probability(1.0)} AS raw_probability, {s.probability(2.4)} AS calibrated FROM sc"""
    v = s.verdict()
    out["k_verdict"] = f"{v} SELECT {s.VERDICT_COLUMNS} FROM v"
    out["k5_band_counts"] = f"{v} SELECT risk_band, count(*) AS messages, CAST(sum(risk_score) AS BIGINT) AS score_sum, CAST(max(risk_score) AS INTEGER) AS top_score FROM v GROUP BY risk_band"
    level = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEVELS.items())
    none = "Verify the sender and the offer through official channels found independently before acting."
    signals = lambda x: f"CASE WHEN {x} = '' THEN [] ELSE string_split({x}, '; ') END"
    out["a9_result_export"] = f"""{v}, act AS (SELECT message_id, action, min(ord) AS o FROM findings GROUP BY message_id, action),
      act6 AS (SELECT message_id, list(action ORDER BY o) AS actions FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY o) AS k FROM act) WHERE k <= 6 GROUP BY message_id),
      fd AS (SELECT message_id, list({{'rule_id': rule_id, 'category': category, 'severity': severity, 'weight': CAST(weight AS INTEGER), 'evidence': evidence, 'explanation': note, 'action': action}} ORDER BY ord) AS found, list(note ORDER BY ord) AS notes FROM findings GROUP BY message_id),
      ld AS (SELECT message_id, list({{'url': url, 'host': host, 'domain': domain, 'signals': {signals('signals')}, 'points': CAST(points AS INTEGER)}} ORDER BY pos) AS links FROM lf GROUP BY message_id),
      md9 AS (SELECT message_id, list({{'email': email, 'domain': domain, 'signals': {signals('signals')}, 'points': CAST(points AS INTEGER)}} ORDER BY pos) AS senders FROM mf GROUP BY message_id),
      names AS (SELECT message_id, string_agg(stage, ' -> ' ORDER BY ord) AS pattern FROM firsts GROUP BY message_id),
      said AS (SELECT m.message_id, sha256(m.text) AS sha, list_filter([{steps}], lambda x: x IS NOT NULL) AS steps,
        list_filter([CASE WHEN {hidden} > 0 THEN 'invisible characters: ' || ({hidden}) END, CASE WHEN regexp_matches(text, '\\p{{Latin}}') AND (regexp_matches(text, '\\p{{Cyrillic}}') OR regexp_matches(text, '\\p{{Greek}}')) THEN 'Latin mixed with Cyrillic or Greek' END,
          CASE WHEN {t.lookalikes('text')} <> text THEN 'look-alike characters' END], lambda x: x IS NOT NULL) AS marks FROM messages m JOIN n7 USING (message_id, text))
      SELECT v.message_id, CAST(to_json({{'message_id': v.message_id, 'input_sha256': sha, 'risk_score': CAST(risk_score AS INTEGER), 'risk_band': risk_band, 'verdict': risk_band, 'level': CASE risk_band {level} END, 'primary_pattern': primary_pattern,
        'summary': risk_band || ': ' || CAST(n AS INTEGER) || ' findings, ' || primary_pattern, 'has_critical': crit,
        'components': {{'rule': CAST(rule_component AS INTEGER), 'url': CAST(url_component AS INTEGER), 'identity': CAST(identity_component AS INTEGER), 'unicode': CAST(unicode_component AS INTEGER), 'conversation': CAST(conversation_component AS INTEGER), 'model': CAST(model_component AS INTEGER)}},
        'findings': coalesce(found, []), 'warnings': coalesce(notes, []), 'actions': coalesce(actions, [{q(none)}]), 'recommendations': coalesce(actions, [{q(none)}]),
        'entities': {{'urls': ent.urls, 'emails': ent.emails, 'phones': ent.phones, 'handles': ent.handles, 'wallets': ent.wallets}}, 'links': coalesce(links, []), 'senders': coalesce(senders, []),
        'conversation': {{'pattern': coalesce(pattern, {q(st.NONE)}), 'score': CAST(conversation_component AS INTEGER)}},
        'model': {{'calibrated': printf('%.4f', calibrated), 'features': CAST(features AS INTEGER), 'abstained': abstained,
          'reasons': list_filter([CASE WHEN NOT supported THEN 'script not supported' END, CASE WHEN very_short THEN 'too little text' END, CASE WHEN calibrated BETWEEN 0.35 AND 0.65 AND features < 80 THEN 'uncertain and sparse' END], lambda x: x IS NOT NULL),
          'uncorroborated': n = 0 AND full_points > 10}}, 'transformations': steps, 'unicode_signals': marks}}) AS VARCHAR) AS verdict
      FROM v LEFT JOIN act6 USING (message_id) LEFT JOIN fd USING (message_id) LEFT JOIN ld USING (message_id) LEFT JOIN md9 USING (message_id) LEFT JOIN names USING (message_id) JOIN said USING (message_id) JOIN ent USING (message_id)"""
    out.update(more_sql.sql())
    out.update(corpus_sql.sql())
    out.update(given_sql.sql())
    return out
