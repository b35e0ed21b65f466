"""The rule scan and its guards in DuckDB SQL: matches unnested to rows, guards as row filters."""

from __future__ import annotations

from lureline.functions import cues
from lureline.functions import languages as lang
from lureline.functions.patterns import near, then, whole
from lureline.functions.patterns import sql_text as q
from lureline.functions.patterns import words as w
from lureline.functions.rulebook import Rule
from lureline.functions.ruleset import BUILT_IN, RuleSet
from lureline.operators.rules import FAR_WINDOW, WINDOW, _ORD
from lureline.plans.supplied import LEXICONS, RULES
from twins import text_sql as t
from twins.messages_sql import messages


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def subjects() -> str:
    spaced = lambda x: f"' ' || {t.rep(x, t.NW + '+', '  ')} || ' '"
    return (
        f"sub0 AS (SELECT *, {t.mark('lower(normalized)')} AS subject FROM n7),\n"
        f"sub1 AS (SELECT *, {t.accents('subject')} AS folded FROM sub0),\n"
        f"sub2 AS (SELECT *, {t.german('folded')} AS folded_de FROM sub1),\n"
        f"sub AS MATERIALIZED (SELECT *, {spaced('folded')} AS spaced, {spaced('folded_de')} AS spaced_de FROM sub2)"
    )


def english(rules: RuleSet = BUILT_IN) -> str:
    def _of(guard: str) -> str:
        return "ord IN (" + ", ".join(map(str, rules.guarded(guard))) + ")"

    flags = ", ".join(f"CASE WHEN {has('subject', r.pattern)} THEN {i} END" for i, r in enumerate(rules.rules))
    patterns = ", ".join(f"({i}, {q(r.pattern)})" for i, r in enumerate(rules.rules))
    foreign = "|".join(lang.pattern(lang.LEXICON[c][k], c) for c in lang.LANGUAGES if c != "de" for k in ("warn", "loose"))
    german = "|".join(lang.pattern(lang.LEXICON["de"][k], "de") for k in ("warn", "loose"))
    abroad = (
        f"({has(t.accents('sentence'), foreign)} OR {has(t.german(t.accents('sentence')), german)} OR {has(t.german(t.accents('near')), lang.awareness())})"
    )
    guards = " OR ".join((
        f"({_of('warning')} AND {has('sentence', cues.WARNING)})",
        f"({_of('abroad')} AND {abroad})",
        f"({_of('overdraft')} AND {has('win', cues.OVERDRAFT)})",
        f"({_of('past_figure')} AND {has('win', cues.HISTORICAL)} AND NOT {has('win', cues.FAST_OR_SURE)})",
        f"({_of('not_sure')} AND {has('win', cues.NOT_GUARANTEED)})",
        f"({_of('risk_stated')} AND {has('win', cues.RISK_STATED)})",
        f"({_of('staff_referral')} AND {has('win', cues.STAFF_REFERRAL)} AND NOT {has('win', cues.PYRAMID_WORDS)})",
        f"({_of('never_do')} AND {has('win', cues.NEVER_DO)})",
        f"({_of('no_fee')} AND ({has(t.unmark('sentence'), cues.NO_FEE)} OR NOT {has('subject', cues.JOB_WORDS)}))",
        f"({_of('denial')} AND {has('sentence', cues.MALAY_DENIAL)})",
    ))
    return f"""
patterns(ord, pattern) AS (VALUES {patterns}),
cand AS (SELECT message_id, subject, unnest(list_filter([{flags}], lambda x: x IS NOT NULL)) AS ord FROM sub),
parts AS (SELECT c.*, regexp_extract_all(subject, pattern) AS m, string_split_regex(subject, pattern) AS p FROM cand c JOIN patterns USING (ord)),
occ0 AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM parts),
occ1 AS (SELECT message_id, subject, ord, m[i] AS hit, 1 + length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS start,
         translate(subject, '!?' || chr(10), '...') AS marks FROM occ0),
occ AS (SELECT *, string_split(substr(marks, 1, start - 1), '.')[-1] || hit || string_split(substr(marks, start + length(hit)), '.')[1] AS sentence,
        substr(subject, greatest(start - {WINDOW}, 1), start + length(hit) + {WINDOW} - greatest(start - {WINDOW}, 1)) AS near, {t.unmark('near')} AS win FROM occ1),
english AS (SELECT message_id, ord, min(start) AS start, arg_min(length(hit), start) AS len FROM occ WHERE NOT ({guards}) GROUP BY message_id, ord)"""


def languages() -> str:
    out, unions = [], []
    for code in lang.LANGUAGES:
        folded, spaced = ("folded_de", "spaced_de") if code == "de" else ("folded", "spaced")
        rx, need = lang.markers(code)
        gate = has(spaced, rf"{rx}[\s\S]*?{rx}" if need == 2 else rx)
        end = lang.SENTENCE_END
        out.append(
            f"w_{code} AS MATERIALIZED (SELECT message_id, {folded} AS txt, string_split_regex({folded}, {q(end)}) AS s, "
            f"regexp_extract_all({folded}, {q('(' + end + ')')}) AS d FROM sub WHERE {gate})"
        )
        out.append(
            f"s_{code} AS MATERIALIZED (SELECT message_id, txt, s[i] AS body, 1 + length(array_to_string(s[1:i - 1], '')) + length(array_to_string(d[1:i - 1], '')) AS start "
            f"FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM w_{code}) WHERE length(s[i]) > 0)"
        )
        near = f"substr(txt, greatest(start - {FAR_WINDOW}, 1), start + length(body) + {FAR_WINDOW} - greatest(start - {FAR_WINDOW}, 1))"
        for shape in lang.SHAPES:
            needs = lang.needs_of(code, shape)
            if not needs:
                continue
            ordinal = _ORD[f"{code}_{shape.suffix}"]
            whole = lang.speaks_in(code, shape)
            column = "txt" if whole else "body"
            holds = " OR ".join("(" + " AND ".join(has(column, lang.concept(code, c)) for c in need) + ")" for need in needs)
            if whole:
                unions.append(f"SELECT message_id, {ordinal} AS ord, 1 AS start, length(txt) AS len, txt FROM w_{code} WHERE ({holds}) AND NOT {has('txt', lang.guard('strict', code))}")
            else:
                unions.append(
                    f"SELECT message_id, {ordinal} AS ord, min(start) AS start, arg_min(length(body), start) AS len, any_value(txt) AS txt FROM s_{code} WHERE ({holds}) "
                    f"AND NOT {has('body', lang.guard('loose', code))} AND NOT {has(near, lang.awareness())} GROUP BY message_id"
                )
    return ",\n".join(out) + ",\nabroad AS (" + "\nUNION ALL ".join(unions) + ")"


def findings(rules: RuleSet = BUILT_IN) -> str:
    rows = ", ".join(f"({i}, {q(r.id)}, {q(r.category)}, {q(r.severity)}, {r.weight}, {q(r.action)}, {q(r.note)})" for i, r in enumerate(rules.all_rules))
    text = f"CASE WHEN length({t.unmark('h.txt')}) = length(n.normalized) THEN n.normalized ELSE {t.unmark('h.txt')} END"
    begin = f"length({t.unmark('substr(h.txt, 1, h.start - 1)')}) + 1"
    size = f"length({t.unmark('substr(h.txt, h.start, h.len)')})"
    cut = f"substr({text}, greatest({begin} - 55, 1), {begin} + {size} + 55 - greatest({begin} - 55, 1))"
    return f"""
rules(ord, rule_id, category, severity, weight, action, note) AS (VALUES {rows}),
hits AS (SELECT e.message_id, e.ord, e.start, e.len, s.subject AS txt FROM english e JOIN sub s USING (message_id){' UNION ALL SELECT message_id, ord, start, len, txt FROM abroad' if rules.languages else ''}),
findings AS (SELECT h.message_id, h.ord, r.rule_id, r.category, r.severity, r.weight, r.action, r.note, {t.clip(cut, 220)} AS evidence
             FROM hits h JOIN rules r USING (ord) JOIN sub n USING (message_id))"""


def all_ctes(rules: RuleSet = BUILT_IN) -> str:
    parts = [messages(), t.normal_ctes("messages"), subjects(), english(rules).strip()]
    return ",\n".join([*parts, *([languages()] if rules.languages else []), findings(rules).strip()])


def supplied() -> tuple[str, str]:
    """The rules of the supplied table with their patterns put together here, and the name of the set.

    Same word lists, written as one row of alternatives; the distances are those of marked text.
    """
    named: dict[str, list[str]] = {}
    for name, word in LEXICONS:
        named.setdefault(name, []).append(word)
    rows = []
    for rule_id, category, severity, weight, words, then_words, gap, either, same, guards, action, note in sorted(RULES, key=lambda r: r[0]):
        first, second = (w(_spelled(x, named)) if x else None for x in (words, then_words))
        body = first if second is None else near(first, gap, second, within=same) if either else then(first, (gap, second), within=same)
        rows.append((Rule(rule_id, category, severity, weight, whole(body), action or "Verify independently before acting.", note), (guards or "").split()))
    own = RuleSet(tuple(r for r, _ in rows), (), {g: frozenset(r.id for r, gs in rows if g in gs) for _, every in rows for g in every})
    return all_ctes(own), own.fingerprint()


def _spelled(words: str, named: dict[str, list[str]]) -> str:
    return "|".join("|".join(sorted(named[x[1:]])) if x.startswith("@") else x for x in words.split("|"))
