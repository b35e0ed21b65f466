"""What is asked first never changes what a step of normalisation or an entity finds."""

import itertools
import unicodedata

from pyspark.sql import functions as F

from lureline.functions import charmaps as cm
from lureline.functions import text as t
from lureline.operators import links, rules
from lureline.operators import normalize as nz

SAMPLES = ["", "plain words", "a b c", "word a word b c d", "x y zz", "aa b c", "_a b c", "a b c_", "1 2 3 4", "a  b c", "q\ta b", "(a b c)", "xa b c", "a b", " a b ", "a\tb c d", "é a b c é", "v i s a", "p4y", "12h", "a1", "4you", "w0rk", "te1egram p@y", "RETRN", "P4Y me", "xp4y", "4 u", "reTRN it", "returns", "a—b", "a‐b c", "wallet 0x" + "aB" * 20, "0x" + "a" * 41, "_0x" + "a" * 40,
           "T" + "a" * 33, "xT" + "a" * 33, "T" + "a" * 34, "1" + "a" * 25, "3" + "B" * 34, "1" + "a" * 24, "bc1" + "a" * 25, "bc1" + "q" * 90, "Bc1" + "a" * 25, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT;TJRabPrwbZy45sbavfcjinPJC18kjpRTv8",
           "раy now", "αbc", "ﬀ", "Ａ１", "x­Y", "x​y", "﻿x", "\U000e0041x", "\x80x", "tab\tand\nline"]


def all_of(spark):
    every = [f"x{chr(i)}y" for i in itertools.chain(range(0x3100), range(0xFB00, 0x10000), range(0x1D400, 0x1D800), range(0xE0000, 0xE0080)) if unicodedata.category(chr(i)) != "Cs"]
    return spark.createDataFrame([(s,) for s in SAMPLES + every], "text string")


def test_steps_without_their_gates(spark):
    c = F.col("text")
    compat, looks = cm.pair(cm.COMPAT, ""), cm.pair(cm.LOOKALIKES, "")
    lone, end = rf"(?<!{t.WORD})[A-Za-z0-9][ \t]", rf"(?!{t.WORD})"
    inner = rf"[ \t](?:(?<={lone}[A-Za-z0-9][ \t])(?=[A-Za-z0-9]{end})|(?<={lone})(?=[A-Za-z0-9][ \t][A-Za-z0-9]{end}))"
    leet = c
    for source, target in cm.LEET.items():
        leet = F.regexp_replace(leet, rf"(?i)(?<!{t.WORD}){source}(?!{t.WORD})", target)
    pairs = (
        (t.fold_compat(c), F.translate(c, *compat)), (t.strip_invisible(c), F.regexp_replace(c, cm.INVISIBLE, "")), (t.map_lookalikes(c), F.translate(c, *looks)),
        (t.join_spaced_letters(c), F.regexp_replace(c, inner, "")), (t.decode_leet(c), leet), (t.has_lookalike(c), c.rlike(cm.char_class("".join(cm.LOOKALIKES)))),
        (t.mixed_scripts(c), t.has_script(c, "Latin") & (t.has_script(c, "Cyrillic") | t.has_script(c, "Greek"))),
    )
    out = all_of(spark).select("text", *[(~a.eqNullSafe(b)).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    for i in range(len(pairs)):
        assert out.filter(F.col(str(i))).select("text").collect() == [], i


def test_wallets_without_their_gates(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "normalized string")
    found = links.entities(df).select("normalized", "wallets").collect()
    plain = df.select(*[links._all(F.col("normalized"), rx).alias(n) for n, rx in links.WALLETS]).collect()
    assert [[w.value for w in r.wallets] for r in found] == [[v for kind in p for v in kind] for p in plain]
    assert {w.subtype for r in found for w in r.wallets} == {n for n, _ in links.WALLETS}


def test_signals_that_nobody_reads_are_not_in_the_plan(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "text string")
    full, short = nz.normalize(df), nz.normalize(df, signals=False)
    assert set(full.columns) - set(short.columns) == {"transformations", "unicode_signals"}
    assert full.select("normalized", "skeleton").collect() == short.select("normalized", "skeleton").collect()
    assert "look-alike characters" not in short.select("normalized")._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_cut_where_a_shape_is_open(spark):
    rows = [(1, "Hola, nos vemos el lunes en la oficina y hablamos de la obra del puente con los vecinos."), (2, "El trabajo es suyo, pero debe pagar la tasa de 150 EUR por la oferta de empleo antes de empezar.")]
    out = rules.scan(nz.normalize(spark.createDataFrame(rows, "message_id long, text string"), signals=False), languages=("es",))
    got = {r.message_id: len(r.findings) for r in out.select("message_id", "findings").collect()}
    assert got[1] == 0 and got[2] >= 1
    tests = rules._any_possible(["es"], "folded", "_words")
    words = rules.opened(rules.t.mark_words(F.lower("text")), rules.lang.all_openings(("es",)))
    asked = spark.createDataFrame(rows, "message_id long, text string").select("message_id", rules.t.mark_words(F.lower("text")).alias("folded"), words.alias("_words"), F.lit(True).alias("_is_es"))
    assert {r.message_id for r in asked.where(F.expr(tests)).collect()} == {2}
