"""The checks, splits and samples of lureline.plans.given, row by row; constants are stated here, not imported."""

from __future__ import annotations

from twins.text_sql import compat, plain_urls, refang, strip_invisible, tidy

LANGUAGES = "'en', 'zh', 'ms', 'ta', 'id', 'es', 'pt', 'fr', 'de', 'hi', 'bn', 'ur', 'ar', 'ja', 'ko', 'th', 'vi', 'tl', 'ru'"
GOVERNANCE = (("G01", "Native-language review", "native_language_review"), ("G02", "Independent real-world validation", "external_real_world_validation"), ("G03", "Bias, calibration and abstention review", "bias_calibration_review"),
              ("G04", "Legal and privacy review", "legal_privacy_review"), ("G05", "Security release review", "security_release_review"), ("G06", "Git repository governance", "git_repository_governance"), ("G07", "Production owner approval", "production_owner_approval"))
APPROVED = ("native_language_review",)


def _split(g: str) -> str:
    n = f"(('0x' || substr({g}, 1, 8))::BIGINT % 100)"
    return f"CASE WHEN {n} < 80 THEN 'train' WHEN {n} < 90 THEN 'validation' ELSE 'test' END"


REC = f"""rec AS (SELECT d.*, quality, toxic, sha256(text) AS sha, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' ELSE 'unlabelled' END AS label,
  {_split("sha256(sha256(text))")} AS split, {_split("sha256('doc-' || doc_id)")} AS numbered FROM documents d LEFT JOIN labels USING (doc_id))"""


def _check(name: str, failing: str) -> str:
    return f"SELECT '{name}' AS \"check\", n = 0 AS passed, n AS failing_rows FROM (SELECT CAST(coalesce(({failing}), 0) AS BIGINT) AS n)"


def _rows(table: str, bad: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {bad}"


CHECKS = " UNION ALL ".join((
    _check("all_required_fields", _rows("rec", "doc_id IS NULL OR text IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL")),
    _check("content_lengths_valid", _rows("rec", "n_chars <> length(text)")), _check("language_supported", _rows("rec", f"lang NOT IN ({LANGUAGES})")),
    _check("english_cue_removed", _rows("rec", "lang <> 'en' AND contains(lower(text), ' the ')")), _check("label_contradiction", _rows("rec", "toxic = 1 AND quality = 1")),
    _check("label_values", _rows("labels", "quality NOT IN (0, 1) OR toxic NOT IN (0, 1)")), _check("labels_have_documents", _rows("labels", "doc_id NOT IN (SELECT doc_id FROM documents)")),
    _check("record_types", _rows("conversations", "role NOT IN ('user', 'assistant', 'system')")),
    _check("reserved_urls_only", _rows("pages", "NOT regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '(?:^|\\.)(?:invalid|example)$')")),
    _check("benchmark_isolation", _rows("benchmark", "text IN (SELECT text FROM documents)")), _check("benchmark_unique", "SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM benchmark GROUP BY text)"),
    _check("unique_ids", "SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM rec GROUP BY doc_id)"), _check("unique_content", "SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM rec GROUP BY sha)"),
    _check("record_count", "SELECT abs(count(*) - coalesce(max(doc_id) + 1, 0)) FROM documents"),
    _check("split_isolation", "SELECT count(*) FROM (SELECT sha FROM rec GROUP BY sha HAVING min(split) <> max(split))"),
    _check("split_isolation_by_number", "SELECT count(*) FROM (SELECT sha FROM rec GROUP BY sha HAVING min(numbered) <> max(numbered))"),
    *(_check(name, f"SELECT max(c) - min(c) FROM (SELECT count(*) AS c FROM rec GROUP BY {key})") for name, key in (("language_balance", "lang"), ("source_balance", "source"), ("label_balance", "label"))),
))


def _variant() -> str:
    said = "text"
    for word in ("fee", "deposit", "profit", "payment"):
        parts = "".join(f"({c})" for c in word)
        back = " ".join(f"\\{i + 1}" for i in range(len(word)))
        said = f"regexp_replace({said}, '(?i)\\b{parts}\\b', '{back}', 'g')"
    return f"""CASE kind WHEN 'defanged_url' THEN replace(replace(text, 'https://', 'hxxps://'), '.invalid', '[.]invalid')
      WHEN 'zero_width' THEN CASE WHEN len(string_split(text, ' ')) <= 3 THEN array_to_string(string_split(text, ' '), chr(8203) || ' ')
        ELSE string_split(text, ' ')[1] || chr(8203) || ' ' || string_split(text, ' ')[2] || chr(8203) || ' ' || array_to_string(string_split(text, ' ')[3:], ' ') END
      WHEN 'fullwidth_punctuation' THEN translate(text, ':!?', '：！？') WHEN 'spaced_tokens' THEN CASE WHEN lang = 'en' THEN {said} ELSE text END
      WHEN 'mixed_punctuation' THEN regexp_replace(regexp_replace(text, '\\. ', '... '), ' — ', ' !!! ') ELSE text END"""


def _family(x: str) -> str:
    plain = f"regexp_replace(lower({refang(strip_invisible(compat(plain_urls(x))))}), '[^\\pL\\pN]+', '', 'g')"
    return f"sha256(CASE WHEN {plain} <> '' THEN {plain} ELSE {x} END)"


MANIFESTS = f"""mdocs AS (SELECT doc_id, text, source || '/' || doc_id || '.txt' AS path FROM documents),
  mkept AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))),
  mold AS (SELECT path, strlen(text) AS size_bytes, sha256(text) AS sha FROM mdocs),
  mnew AS (SELECT path, strlen(tidied) AS size_bytes, sha256(tidied) AS sha FROM (SELECT path, {tidy('text')} AS tidied FROM mdocs JOIN mkept USING (doc_id))),
  mdiff AS (SELECT path, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' ELSE 'changed' END AS state FROM mold o FULL JOIN mnew n USING (path)
    WHERE o.sha IS DISTINCT FROM n.sha OR o.size_bytes IS DISTINCT FROM n.size_bytes)"""


def sql() -> dict[str, str]:
    rec, checks = f"WITH {REC}", f"WITH {REC}, val AS ({CHECKS})"
    governed = " UNION ALL ".join(f"SELECT '{g}', '{n}', '{'PASS' if k in APPROVED else 'BLOCKED'}'" for g, n, k in GOVERNANCE)
    gates = f"""{checks}, {MANIFESTS}, gt(gate, name, state) AS (SELECT 'T01', 'Dataset validation', CASE WHEN (SELECT bool_and(passed) FROM val) THEN 'PASS' ELSE 'BLOCKED' END UNION ALL SELECT 'T02', 'Complete release manifest', CASE WHEN (SELECT count(*) FROM mdiff) = 0 THEN 'PASS' ELSE 'BLOCKED' END
      UNION ALL SELECT 'T03', 'Synthetic provenance and safe indicators', CASE WHEN (SELECT bool_and(passed) FROM val WHERE "check" IN ('safe_provenance_flags', 'reserved_urls_only')) THEN 'PASS' ELSE 'BLOCKED' END
      UNION ALL SELECT 'T04', 'External records excluded', CASE WHEN (SELECT count(*) FROM benchmark WHERE text IN (SELECT text FROM documents)) = 0 THEN 'PASS' ELSE 'BLOCKED' END UNION ALL {governed})"""
    kinds = "['clean', 'defanged_url', 'zero_width', 'fullwidth_punctuation', 'spaced_tokens', 'mixed_punctuation']"
    sliced = f"{rec}, sl AS (SELECT * FROM (SELECT *, concat_ws(':', label, lang) AS slice, row_number() OVER (PARTITION BY label, lang ORDER BY doc_id) AS k FROM rec WHERE split = 'test') WHERE k <= 16)"
    allotted = f"""{rec}, wanted(slice, quota) AS (VALUES ('good', 24), ('poor', 16), ('toxic', 16), ('unlabelled', 8), ('disputed', 4)),
      held AS (SELECT slice, CAST(quota AS BIGINT) AS quota, (SELECT count(*) FROM rec WHERE split = 'test' AND label = slice) AS rows FROM wanted),
      spares AS (SELECT *, least(quota, rows) AS taken, rows - least(quota, rows) AS spare FROM held),
      al AS (SELECT *, greatest(0, least(spare, greatest(64 - (SELECT sum(taken) FROM spares), 0) - coalesce(sum(spare) OVER (ORDER BY spare DESC, slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra FROM spares)"""
    fields = ("lang", "source", "split", "label")
    return {
        "a7_split_counts": f"{rec} SELECT split, count(*) AS records FROM rec GROUP BY split",
        "a8_split_index": f"{rec} SELECT printf('DOC-%07d', doc_id) AS id, split, sha AS campaign_group_id, {_family('text')} AS variant_family_id FROM rec",
        "o5_document_variants": f"{rec}, v AS (SELECT *, ({kinds})[(('0x' || substr(sha, 9, 6))::BIGINT % 6) + 1] AS kind FROM rec) SELECT doc_id, kind AS variant_type, sha256({_variant()}) AS text_sha256 FROM v",
        "p_corpus_checks": f"{checks} SELECT * FROM val",
        "p22_rollup": f"{checks} SELECT CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS checks, coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (WHERE NOT passed), '') AS failures FROM val",
        "p23_schema_violations": """WITH c AS (SELECT 'conversations' AS table_name, 'role' AS k, role NOT IN ('user', 'assistant') AS bad FROM conversations UNION ALL SELECT 'conversations', 'text', length(text) < 40 FROM conversations UNION ALL SELECT 'conversations', 'turn', turn NOT BETWEEN 0 AND 199 FROM conversations
          UNION ALL SELECT 'documents', 'doc_id', doc_id < 0 FROM documents UNION ALL SELECT 'documents', 'text', length(text) < 10 FROM documents UNION ALL SELECT 'documents', 'lang', NOT regexp_matches(lang, '^[a-z]{2}$') FROM documents
          UNION ALL SELECT 'documents', 'source', NOT regexp_matches(source, '^src[0-9]$') FROM documents UNION ALL SELECT 'documents', 'n_chars', n_chars NOT BETWEEN 10 AND 20000 FROM documents)
          SELECT table_name, k AS "constraint", count(*) AS rows FROM c WHERE bad GROUP BY ALL""",
        "p23_schema_document": """WITH c AS (SELECT conv_id, turn, text, CASE WHEN (conv_id + turn) % 11 <> 0 THEN role END AS said_by, role FROM conversations),
          k AS (SELECT conv_id, turn, unnest([CASE WHEN conv_id < 0 THEN 'conv_id.minimum' END, CASE WHEN turn < 0 THEN 'turn.minimum' END, CASE WHEN said_by IS NULL THEN 'role.required' END,
            CASE WHEN said_by NOT IN ('user', 'assistant', 'system') THEN 'role.enum' END, CASE WHEN length(text) < 60 THEN 'text.minLength' END, CASE WHEN NOT regexp_matches(text, '[.!?]') THEN 'text.pattern' END,
            CASE WHEN role = 'system' THEN 'tags.items.enum' END, CASE WHEN turn % 3 = 1 THEN 'version.const' END, CASE WHEN conv_id % 7 = 0 THEN 'unknown:mood' END]) AS "constraint" FROM c)
          SELECT conv_id, turn, "constraint" FROM k WHERE "constraint" IS NOT NULL""",
        "q1_source_sample": "SELECT source, doc_id, CAST(k AS INTEGER) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 10",
        "q2_evaluation_slice": f"{sliced} SELECT doc_id, label, lang, source, slice FROM sl",
        "q2_allotments": f"{allotted} SELECT slice, quota, rows, greatest(quota - rows, 0) AS missing, CAST(taken + extra AS BIGINT) AS allotted FROM al",
        "q2_quota_sample": f"""{allotted}, nth AS (SELECT doc_id, label AS slice, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS place FROM rec WHERE split = 'test')
          SELECT doc_id, slice, CAST(place AS INTEGER) AS place, CAST(taken + extra AS BIGINT) AS allotted FROM nth JOIN al USING (slice) WHERE place <= taken + extra""",
        "q4_distributions": f"{rec} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS rows FROM rec GROUP BY {c}" for c in fields),
        "q5_slice_statistics": f"{sliced} SELECT slice, count(*) AS rows, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM sl GROUP BY slice",
        "q6_language_audit": "SELECT count(*) FILTER (WHERE lang <> 'en') AS non_english, count(*) FILTER (WHERE lang <> 'en' AND contains(lower(text), ' the ')) AS english_cue_left FROM documents",
        "a1_json_file": "SELECT doc_id, lang, source, sha256(text) AS text_sha256, true AS whole FROM documents",
        "a5_csv_file": """SELECT CAST(item_id AS VARCHAR) AS id, 'benchmark' AS kind, sha256(text) AS value_sha256 FROM benchmark UNION ALL
          SELECT CAST(doc_id AS VARCHAR), 'labels', sha256(coalesce(CAST(quality AS VARCHAR), '-') || '/' || coalesce(CAST(toxic AS VARCHAR), '-')) FROM labels""",
        "o11_fixed_order": "SELECT doc_id, sha256('7041:' || doc_id) AS shuffle_key FROM documents ORDER BY 2",
        "p15_transient_files": """SELECT page_id, path, NOT regexp_matches(path, '(?:^|/)(?:__pycache__(?:/|$)|\\.[^/]+)') AND NOT regexp_matches(lower(path), '\\.(?:tmp|partial|bak|pyc|zip)$') AS included
          FROM (SELECT page_id, regexp_replace(url, '^[a-zA-Z]+://[^/]*/?|[?#].*$', '', 'g') AS path FROM pages)""",
        "r3_manifest_diff": f"WITH {MANIFESTS} SELECT path, state FROM mdiff",
        "r2_digest_tree": f"""WITH {MANIFESTS}, leaves AS (SELECT substr(sha256(path), 1, 4) AS node, sha256(string_agg(line, '' ORDER BY line)) AS digest, count(*) AS files, sum(size_bytes) AS bytes
            FROM (SELECT path, path || chr(0) || size_bytes || chr(0) || sha || chr(10) AS line, size_bytes FROM mold) GROUP BY 1),
          branches AS (SELECT substr(node, 1, 2) AS node, sha256(string_agg(node || '=' || digest || chr(10), '' ORDER BY node)) AS digest, sum(files) AS files, sum(bytes) AS bytes FROM leaves GROUP BY 1),
          root AS (SELECT '' AS node, sha256(string_agg(node || '=' || digest || chr(10), '' ORDER BY node)) AS digest, sum(files) AS files, sum(bytes) AS bytes FROM branches)
          SELECT node, digest, CAST(files AS BIGINT) AS files, CAST(bytes AS BIGINT) AS bytes FROM (SELECT * FROM leaves UNION ALL SELECT * FROM branches UNION ALL SELECT * FROM root)""",
        "p11_family_isolation": f"""{rec}, e AS (SELECT *, unnest({kinds}) AS kind FROM rec), f AS (SELECT kind, text, {_variant()} AS said FROM e),
          g AS (SELECT kind, said <> text AS disguised, {_family('text')} AS own, {_family('said')} AS family FROM f)
          SELECT kind AS variant_type, count(*) FILTER (WHERE disguised) AS disguised, count(DISTINCT family) AS families, count(*) FILTER (WHERE family <> own) AS left_family,
            count(*) FILTER (WHERE {_split('sha256(family)')} <> {_split('sha256(own)')}) AS left_split FROM g GROUP BY kind""",
        "r4_gates": f"{gates} SELECT * FROM gt",
        "r5_readiness": f"{gates} SELECT CASE WHEN count(*) FILTER (WHERE gate LIKE 'T%' AND state <> 'PASS') = 0 THEN 'PASS' ELSE 'BLOCKED' END AS technical_status, CASE WHEN bool_and(state = 'PASS') THEN 'READY_FOR_PRODUCTION' ELSE 'NOT_READY_FOR_PRODUCTION' END AS overall_status, count(*) FILTER (WHERE state <> 'PASS') AS blocked_gate_count FROM gt",
    }
