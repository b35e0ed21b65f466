import re

from lureline.llm import licences
from tests.llm import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def by_hand(rows):
    out = []
    for d, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        at = [(i, k) for p, k in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        out.append((d, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))))
    return sorted(out, key=str)


def base(rows):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)


NOTICES = {
    1: ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    2: ("x y This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    3: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    4: ("Released under the MIT License.", "mit"),
    5: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more", "mit"),
    6: ("no permission is needed; license cc of mit", ""),
    7: ("The version 2 of apache. The license", ""),
    8: ("MİT License, mıt license, CC-BY", "cc-by"),
    9: ("Licensed under the Apache License, Version 2.0. " * 50 + "Released under the MIT License.", "apache,apache-2.0,mit"),
    10: (None, ""),
    11: ("apache", ""),
    12: ("ＭＩＴ license éapache license apacheé license", ""),
}


def test_notices(spark):
    rows = [(i, t) for i, (t, _) in NOTICES.items()] + [(9, NOTICES[9][0])]
    got = licences.licences(edge.table(spark, rows)).collect()
    assert {r.doc_id: r.labels for r in got} == {i: k for i, (_, k) in NOTICES.items()}
    assert base(got) == by_hand(rows)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def test_edge_table(spark):
    assert base(licences.licences(edge.table(spark)).collect()) == by_hand(edge.texts())
    assert licences.licences(edge.table(spark).limit(0)).count() == 0


def test_given_documents(spark):
    rows = edge.documents("sf0.01")
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert base(got) == by_hand(rows)
    assert sum(r.labels != r.base_labels for r in got) > 5


def test_all_notices_in_one_document(spark):
    """More different licence words than the rarest 24: each notice keeps its label, whatever stands beside it."""
    whole = ". ".join(notice for _, notice, _ in licences.TEMPLATES)
    some = ". ".join(notice for label, notice, _ in licences.TEMPLATES if label not in ("agpl-3.0", "cc0-1.0", "mpl-2.0"))
    got = {r.doc_id: r for r in licences.licences(edge.table(spark, [(1, whole), (2, some), *((i, f"the {i}") for i in range(3, 9))])).collect()}
    labels = {label for label, _, _ in licences.TEMPLATES}
    assert set(got[1].labels.split(",")) == labels | set(got[1].base_labels.split(","))
    assert set(got[2].labels.split(",")) == labels - {"agpl-3.0", "cc0-1.0", "mpl-2.0"} | set(got[2].base_labels.split(","))
    assert got[1].score == got[2].score == 1.0
