"""N: language by script and by word lists, code switching, localised evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.functions import languageid as l
from lureline.functions.patterns import NOT_WORD
from lureline.functions.rows import settle


def _range(span: str) -> str:
    a, b = span.split("-")
    return rf"[^\x{{{a}}}-\x{{{b}}}]+"


def script_language(c: Column) -> Column:
    """N1."""
    counts = [(lang, F.length(F.regexp_replace(c, _range(span), "")) * times) for lang, span, times in l.RANGES]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, n) in enumerate(counts)]))
    plain = F.when(best["n"] > 0, best["lang"])
    return F.when(c.rlike(r"[^\x{00}-\x{24f}]"), F.when(c.rlike(f"[{l.URDU}]"), "ur").otherwise(plain))


def _hits(tokens: tuple[str, ...], spaced: Column, lower: Column) -> Column:
    tests = [lower.contains(w) if " " in w else spaced.contains(f" {w} ") for w in tokens]
    return sum((F.when(x, F.lit(1)).otherwise(F.lit(0)) for x in tests), F.lit(0))


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """``language`` and ``languages`` (at most four)."""
    out = settle(df, _lower=F.lower(text))
    out = settle(out, _spaced=F.concat(F.lit(" "), F.regexp_replace("_lower", NOT_WORD + "+", "  "), F.lit(" ")), _script=script_language(F.col(text)))
    out = settle(out, **{f"_n_{c}": _hits(w, F.col("_spaced"), F.col("_lower")) for c, w in l.LEXICONS.items()}, _n_en=_hits(l.ENGLISH_MARKERS, F.col("_spaced"), F.col("_lower")))
    best = F.array_max(F.array(*[F.struct(F.col(f"_n_{c}").alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("lang")) for i, c in enumerate(l.LEXICONS)]))
    worded = F.when(best["n"] > 0, best["lang"]).when(F.col("_lower").rlike("[a-z]"), "en").otherwise("unknown")
    out = settle(out, language=F.coalesce("_script", worded))
    others = [F.when((F.col(f"_n_{c}") >= 2) & (F.col("language") != c), F.lit(c)) for c in (*l.LEXICONS, "en")]
    listed = F.array_compact(F.array(F.when(F.col("language") != "unknown", F.col("language")), *others))
    out = settle(out, languages=F.when(F.size(listed) == 0, F.array(F.lit("unknown"))).otherwise(F.slice(listed, 1, 4)))
    return out.drop("_lower", "_spaced", "_script", "_n_en", *[f"_n_{c}" for c in l.LEXICONS])


def evidence(df: DataFrame, text: str = "text") -> DataFrame:
    """Up to three listed phrases without a negation in the 36 characters before, the own language first."""
    out = settle(df, _lower=F.lower(text))
    found = []
    order = 0
    for code, phrases in l.SIGNALS.items():
        for phrase in phrases:
            at = F.instr("_lower", phrase)
            before = F.substring(F.col("_lower"), F.greatest(at - 36, F.lit(1)), F.least(at - 1, F.lit(36)))
            denied = F.lit(False)
            for word in l.NEGATIONS:
                denied = denied | before.contains(word)
            found.append(F.when((at > 0) & ~denied, F.struct((F.col("language") != code).alias("foreign"), F.lit(order).alias("o"), F.lit(phrase).alias("phrase"))))
            order += 1
    hits = F.transform(F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, 3), lambda x: x["phrase"])
    aware = F.slice(F.array_compact(F.array(*[F.when(F.col("_lower").contains(a), F.lit(a)) for a in l.AWARENESS])), 1, 3)
    return settle(out, evidence=hits, awareness=aware).drop("_lower")


def supported(spark: SparkSession) -> DataFrame:
    """N6."""
    return spark.createDataFrame(list(l.NAMES.items()), "code string, name string")
