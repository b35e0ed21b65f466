"""DuckDB SQL with the same rows, for the operators that SQL can express.

Run-length index, packing, perplexity, language machines, Spark's shuffle and token planes have no SQL form; tests/llm holds them against
plain versions.
"""

from __future__ import annotations

from lureline.llm.licences import BASE, KEY_WORDS, TEMPLATES, VOCABULARY
from lureline.llm.mixing import STEPS

_WORD = r"[^\x20\x09-\x0D]+"


def mixing(entropy: float = 0.97, repeats: float = 4.0, seed: int = 11, block_docs: int = 1024) -> str:
    """Exponents k / STEPS^2 are tried by sections: the coarse grid first, then the fine one in the section found."""

    def draw(n: int, *parts: str) -> str:
        return "md5(" + " || ':' || ".join([f"'{n}'", *[f"CAST({p} AS VARCHAR)" for p in parts]]) + ")"

    def tried(name: str, grid: str) -> str:
        return f"""{name}_p AS (SELECT k, a, share, pow(share, a) AS p FROM live, ({grid})),
        {name} AS (SELECT a, max(p / share) <= {repeats} * min(p / share) * (1 + 1e-12) AS few,
          ln(sum(p)) - sum(p * a * ln(share)) / sum(p) >= {entropy} * ln(count(*)) - 1e-12 AS even FROM {name}_p GROUP BY k, a)"""

    fine = 1 / STEPS**2
    return rf"""WITH docs AS (SELECT doc_id, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n_tokens, text FROM documents),
    sizes AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS n_docs FROM docs GROUP BY source),
    live AS (SELECT source, tokens, n_docs, tokens / (SELECT sum(tokens) FROM sizes) AS share FROM sizes WHERE tokens > 0),
    {tried("coarse", f"SELECT range AS k, range * {1 / STEPS!r} AS a FROM range({STEPS + 1})")},
    ends AS (SELECT coalesce(min(a) FILTER (few), 1.0) AS lo, coalesce(max(a) FILTER (even), 0.0) AS hi FROM coarse),
    {tried("fine_lo", f"SELECT range AS k, lo - {1 / STEPS!r} + range * {fine!r} AS a FROM range({STEPS + 1}), ends")},
    {tried("fine_hi", f"SELECT range AS k, hi + range * {fine!r} AS a FROM range({STEPS + 1}), ends")},
    chosen AS (SELECT least(1.0, greatest(CASE WHEN lo <= 0 THEN 0.0 ELSE (SELECT coalesce(min(a) FILTER (few), 1.0) FROM fine_lo) END, CASE WHEN hi >= 1 THEN 1.0 ELSE (SELECT coalesce(max(a) FILTER (even), 0.0) FROM fine_hi) END)) AS alpha FROM ends),
    powers AS (SELECT source, tokens, pow(share, alpha) AS p FROM live, chosen),
    quotas AS (SELECT source, p / (SELECT sum(p) FROM powers) AS weight, CAST(round(p * (SELECT max(tokens / p) FROM powers)) AS BIGINT) AS quota FROM powers),
    plan AS (SELECT s.source, coalesce(weight, 0.0) AS weight, CAST(ceil(n_docs / {block_docs}) AS BIGINT) AS blocks, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM sizes s LEFT JOIN quotas USING (source)),
    placed AS (SELECT docs.*, weight, blocks, whole, rest, CAST('0x' || substr({draw(seed, "coalesce(doc_id, -1)")}, 1, 8) AS BIGINT) % blocks AS block,
      unnest(range(0, CAST(CASE WHEN rest > 0 THEN whole + 1 ELSE whole END AS BIGINT))) AS epoch FROM docs JOIN plan USING (source)),
    in_blocks AS (SELECT source, epoch, block, sum(n_tokens) AS n FROM placed GROUP BY ALL),
    befores AS (SELECT source, epoch, block, coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY {draw(seed + 1, "epoch", "source", "block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM in_blocks),
    within AS (SELECT placed.*, sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY {draw(seed + 2, "epoch", "coalesce(doc_id, -1)")}, doc_id NULLS FIRST, n_tokens, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
    SELECT doc_id, source, epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(earlier + upto - n_tokens AS BIGINT) AS place, (SELECT alpha FROM chosen) AS alpha, weight
    FROM within JOIN befores USING (source, epoch, block) WHERE epoch < whole OR earlier + upto <= rest"""


def near_duplicates(width: int = 3, percent: int = 85) -> str:
    """All pairs that share a shingle, then the smallest label that spreads over the links."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({lower}, '{_WORD}') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS s FROM words WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)),
    sides AS MATERIALIZED (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
    reach(u, v) AS (SELECT DISTINCT u, u FROM sides UNION SELECT reach.u, sides.v FROM reach JOIN sides ON sides.u = reach.v),
    labels AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
    SELECT words.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, words.doc_id) AS component_id, words.doc_id = coalesce(component_id, words.doc_id) AS kept
    FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN labels USING (doc_id)"""


def neighbours(every: int = 100, k: int = 10) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    near AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM near)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def licences(template_words: int = 8, cover: float = 0.6) -> str:
    """The same method on rows: frequencies, postings, relative places, mandatory phrases."""
    lower = "lower(coalesce(text, ''))"
    notices = ", ".join(f"({t}, '{label}', '{words}')" for t, (label, words, _) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({t}, '{p}')" for t, (_, _, own) in enumerate(TEMPLATES) for p in own)
    base = ", ".join(f"('{p}', '{k}')" for p, k in BASE.items())
    listed = ", ".join(f"('{w}')" for w in VOCABULARY)
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    near AS (SELECT rid, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM docs WHERE list_has_any(w, [{", ".join(f"'{k}'" for k in KEY_WORDS)}])),
    vocabulary AS (SELECT w FROM (VALUES {listed}) t(w)), notices AS (SELECT * FROM (VALUES {notices}) n(t, label, words)),
    seen AS (SELECT word AS w, count(*) AS n FROM (SELECT DISTINCT rid, unnest(w) AS word FROM docs) WHERE word IN (SELECT w FROM vocabulary) GROUP BY word),
    idf AS (SELECT w, ln(((SELECT count(*) FROM docs) + 1) / (coalesce(n, 0) + 0.5)) AS idf FROM vocabulary LEFT JOIN seen USING (w)),
    spread AS (SELECT t, label, unnest(range(len(string_split(words, ' ')))) AS place, unnest(string_split(words, ' ')) AS w FROM notices),
    postings AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idf DESC, place) AS nth FROM spread JOIN idf USING (w)),
    rare AS (SELECT * FROM postings WHERE nth <= {template_words}), totals AS (SELECT t, sum(idf) AS total FROM rare GROUP BY t),
    places AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS w FROM near),
    own AS (SELECT DISTINCT rid, w FROM places JOIN idf USING (w)),
    verified AS (SELECT rid, t FROM near, (VALUES {phrases}) p(t, phrase) GROUP BY rid, t HAVING bool_and(contains(joined, ' ' || phrase || ' '))),
    masses AS (SELECT rid, r.t, r.label, pos - place AS spot, sum(idf) AS mass FROM places JOIN own USING (rid, w) JOIN rare r USING (w) JOIN verified v USING (rid, t) GROUP BY ALL),
    labelled AS (SELECT rid, label, least(mass / total, 1.0) AS covered FROM masses JOIN totals USING (t) WHERE least(mass / total, 1.0) >= {cover}),
    found AS (SELECT rid, list(DISTINCT label) AS labels, max(covered) AS best FROM labelled GROUP BY rid),
    base_places AS (SELECT rid, label, i AS spot FROM (SELECT rid, w, label, string_split(phrase, ' ') AS p, unnest(range(len(w))) AS i FROM near, (VALUES {base}) b(phrase, label)) WHERE w[i + 1:i + len(p)] = p),
    bases AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base_places GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(bases.labels, ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
      coalesce(round(best, 6), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
    FROM docs LEFT JOIN bases USING (rid) LEFT JOIN found USING (rid)"""


def fill_in_middle(rate: int = 50, spm: int = 80, seed: int = 42) -> str:
    """Units as a list, cut at the two drawn places. The restored text is the text itself."""
    h1, h2, h3, h4 = (f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)" for k in range(4))
    return rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {h1} % (len(u) + 1) AS x, {h2} % (len(u) + 1) AS y,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {h3} % 100 >= {rate} THEN 'plain' WHEN {h4} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM docs),
    parts AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


ORACLES: dict[str, str] = {
    "op1_temperature_mixing": mixing(),
    "op4_minhash": near_duplicates(),
    "op7_licence_index": licences(),
    "op9_vantage_points": neighbours(),
    "op13_fill_in_middle": fill_in_middle(),
}
