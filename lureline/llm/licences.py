"""License scans with a positional index of rare words, in SQL functions only.

A template is a run of words with mandatory phrases. Document frequencies of the licence words (the templates' words) are counted over all
documents. Every licence word of a file is looked up in the postings of the templates' rarest words (word, template, place); hits are
gathered by relative position, so that words at the template's distances from each other agree on where it begins. A template that is covered well enough there, and whose mandatory phrases stand in the file, gives its label.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.llm.common import cut, row_key

#: A word is a run of digits, letters and characters beyond ASCII.
LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Usual notices: label, words of the notice, phrases that must be there too.
TEMPLATES = [
    ("agpl-3.0", "gnu affero general public license version 3", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "licensed under cc0 1 0 universal", ["cc0 1 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
VOCABULARY = sorted({w for _, words, _ in TEMPLATES for w in words.split()})
#: Each base phrase and a mandatory phrase of each template has one of these words, so a text without them gets no label.
KEY_WORDS = ["license", "cc", "cc0", "redistribution", "permission", "unencumbered"]
assert all(set(KEY_WORDS) & set(p.split()) for p in [*BASE, *(" ".join(own) for _, _, own in TEMPLATES)])


def starts(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively."""
    first, *others = phrase.split()
    opened = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.get(words, i) == first)
    return F.filter(opened, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(others, 1)]))


def scanned(docs: DataFrame) -> DataFrame:
    """rk, doc_id, n_words, found (licence words in the text), words (all, where there is a key word)."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(LETTERS), F.lit(0))
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    rows = rows.select("rk", "doc_id", "words", F.array_intersect("words", F.array(*map(F.lit, VOCABULARY))).alias("found"))
    some = F.arrays_overlap("found", F.array(*map(F.lit, KEY_WORDS)))
    return rows.select("rk", "doc_id", F.size("words").cast("long").alias("n_words"), "found", F.when(some, F.col("words")).alias("words"))


def frequencies(rows: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents: as many numbers as the templates have words."""
    n = rows.count()
    seen = {r.w: r.n for r in rows.select(F.explode("found").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: log((n + 1) / (seen.get(w, 0) + 0.5)) for w in VOCABULARY}


def template_labels(rows: DataFrame, idf: dict[str, float], file_words: int | None, template_words: int, cover: float) -> DataFrame:
    """rk, method_labels, best: the labels of the templates found in each text, and how well the best is covered."""
    postings: dict[str, list[Column]] = {}
    totals = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        rare = sorted(enumerate(notice.split()), key=lambda r: (-idf[r[1]], r[0]))[:template_words]
        totals.append(sum(idf[w] for _, w in rare))
        for place, w in rare:
            postings.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(place).alias("place"), F.lit(idf[w]).alias("idf")))
    index = F.create_map(*[x for w, own in postings.items() for x in (F.lit(w), F.array(*own))])
    near = rows.filter("words IS NOT NULL").dropDuplicates(["rk"])
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    verified = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [F.contains(F.col("joined"), F.lit(f" {p} ")) for p in own]), F.lit(t)) for t, (_, _, own) in enumerate(TEMPLATES)]))
    sought = F.array(*map(F.lit, sorted(postings)))
    if file_words is not None:
        weight = F.create_map(*[x for w in VOCABULARY for x in (F.lit(w), F.lit(-idf[w]))])
        sought = F.slice(F.array_sort(F.transform("found", lambda w: F.struct(weight[w].alias("k"), w.alias("w")))), 1, file_words).getField("w")
    near = near.withColumn("joined", text).withColumn("verified", verified).withColumn("sought", sought)
    hits = near.filter("size(verified) > 0").select("rk", "verified", "sought", F.posexplode("words").alias("pos", "w")).filter(F.array_contains("sought", F.col("w")))
    hits = hits.select("rk", "verified", "pos", F.explode(index[F.col("w")]).alias("h")).filter(F.array_contains("verified", F.col("h.t")))
    places = hits.groupBy("rk", F.col("h.t").alias("t"), (F.col("pos") - F.col("h.place")).alias("at")).agg(F.sum("h.idf").alias("mass"))
    covered = F.col("mass") / F.element_at(F.array(*map(F.lit, totals)), F.col("t") + 1)
    label = F.element_at(F.array(*[F.lit(k) for k, _, _ in TEMPLATES]), F.col("t") + 1)
    return places.select("rk", label.alias("label"), F.least(covered, F.lit(1.0)).alias("covered")).filter(F.col("covered") >= cover).groupBy("rk").agg(F.collect_set("label").alias("method_labels"), F.max("covered").alias("best"))


def licences(docs: DataFrame, file_words: int | None = None, template_words: int = 8, cover: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text: empty, without places. Repeated rows count as often as they are there and get the same labels. Only doc_id and text are
    read. An empty table gives no rows. score: how much of the best template (by inverse document frequency) is covered where it begins;
    half if there are base places only; else 0. `file_words` looks up only so many of a file's licence words, the rarest; by default all.
    """
    rows = cut(scanned(docs))
    found = template_labels(rows, frequencies(rows), file_words, template_words, cover)
    words = F.coalesce("words", F.array().cast("array<string>"))
    at = [starts(words, phrase) for phrase in BASE]
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(at, BASE.values(), strict=True)]))
    placed = rows.select("rk", "doc_id", "n_words", F.concat(*at).alias("places"), F.array_sort(F.array_distinct(base)).alias("base"))
    met = placed.join(found, "rk", "left").withColumn("all", F.array_sort(F.array_union("base", F.coalesce("method_labels", F.array().cast("array<string>")))))
    score = F.coalesce(F.round("best", 6), F.when(F.size("places") > 0, 0.5), F.lit(0.0))
    return met.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join("all", ",").alias("labels"), score.alias("score"))
