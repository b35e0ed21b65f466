"""B: the normalisation chain. One projection per step, no shuffle."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lureline.functions import text as t
from lureline.functions.rows import settle


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Exact NFKC; Spark has no built-in for it, so this is the one Arrow function of the package."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(df: DataFrame, text: str = "text", exact: bool = False, signals: bool = True) -> DataFrame:
    """Add ``normalized``, ``skeleton``, ``transformations`` and the Unicode signals of the original text.

    Without ``signals`` the last two are left out: settled columns are computed even where nothing reads them. ``exact`` runs the full NFKC in Python workers; the default folds one-to-one forms in the JVM.
    Each step is settled on the row so that it is computed once.
    """
    original = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_o", original)
    out = out.withColumn("_s1", nfkc("_o")) if exact else settle(out, _s1=t.fold_compat(F.col("_o")))
    for name, step, source in (
        ("_s2", t.strip_invisible, "_s1"),
        ("_s3", t.refang, "_s2"),
        ("skeleton", t.map_lookalikes, "_s3"),
        ("_s5", t.join_spaced_letters, "skeleton"),
        ("_s6", t.decode_leet, "_s5"),
        ("normalized", t.tidy, "_s6"),
    ):
        out = settle(out, **{name: step(F.col(source))})
    if not signals:
        return out.drop("_o", "_s1", "_s2", "_s3", "_s5", "_s6")
    steps = (
        ("_o", "_s1", "compatibility forms folded"),
        ("_s1", "_s2", "invisible characters removed"),
        ("_s2", "_s3", "defanged notation restored"),
        ("_s3", "skeleton", "look-alikes mapped"),
        ("skeleton", "_s5", "spaced letters joined"),
        ("_s5", "_s6", "digit spellings decoded"),
    )
    changed = F.array_compact(F.array(*[F.when(F.col(a) != F.col(b), F.lit(s)) for a, b, s in steps]))
    out = settle(out, transformations=changed, unicode_signals=unicode_signals(F.col("_o")))
    return out.drop("_o", "_s1", "_s2", "_s3", "_s5", "_s6")


def unicode_signals(c: Column) -> Column:
    """B9, on the original text."""
    hidden = t.invisible_count(c)
    return F.array_compact(
        F.array(
            F.when(hidden > 0, F.concat(F.lit("invisible characters: "), hidden.cast("string"))),
            F.when(t.mixed_scripts(c), F.lit("Latin mixed with Cyrillic or Greek")),
            F.when(t.has_lookalike(c), F.lit("look-alike characters")),
        )
    )


def script_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Scripts seen, letters, and the share of letters in a recognised script."""
    counts = [t.letters_of(F.col(text), s).alias(f"_n_{s}") for s in t.SCRIPTS]
    out = df.select("*", *counts, t.letter_count(F.col(text)).alias("letter_count"))
    seen = F.array_compact(F.array(*[F.when(F.col(f"_n_{s}") > 0, F.lit(s)) for s in t.SCRIPTS]))
    known = sum((F.col(f"_n_{s}") for s in t.SCRIPTS), F.lit(0))
    return (
        out.withColumn("scripts", seen)
        .withColumn("recognized_ratio", known / F.greatest(F.lit(1), F.col("letter_count")))
        .drop(*[f"_n_{s}" for s in t.SCRIPTS])
    )
