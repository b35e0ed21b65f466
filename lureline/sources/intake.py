"""A: reading messages, turns, records and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.operators.links import Suffixes

FIELDS = ("text", "source_url", "claimed_company", "claimed_domain", "recruiter_email", "claimed_license")


def messages(df: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """A2: whole fields without nulls; rows with neither text nor link go. ``limits`` (characters by field) is an option."""
    cut = limits or {}
    whole = {c: F.coalesce(F.col(c), F.lit("")) for c in FIELDS if c in df.columns}
    out = df.withColumns({c: F.substring(v, 1, cut[c]) if c in cut else v for c, v in whole.items()})
    return out.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.trim(F.coalesce("source_url", F.lit(""))) != ""))


def turns(df: DataFrame, sender_chars: int | None = None) -> DataFrame:
    """A3: every turn of each conversation, whole; blank ones are dropped but keep their number. ``sender_chars`` is an option."""
    body = F.coalesce("text", F.lit(""))
    sender = F.regexp_replace(F.regexp_replace(F.coalesce("sender", F.lit("Unknown")), r"\s+", " "), r"^ | \z", "")
    sender = sender if sender_chars is None else F.substring(sender, 1, sender_chars)
    return df.select("conv_id", (F.col("turn") + 1).alias("message"), sender.alias("sender"), body.alias("text")).where(F.trim("text") != "")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A1: JSON lines; blank lines are skipped and broken ones kept in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def parse_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A1 for lines that already are a column."""
    lines = df.where(F.trim(column) != "")
    return lines.select("*", F.from_json(column, schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A5: CSV with a header, all text. Quoted values may hold quotes and line ends; \\N is null, an empty value is an empty text."""
    return spark.read.options(header=True, escape='"', multiLine=True, nullValue="\\N", emptyValue="").csv(path)


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def suffix_rows(lines: DataFrame) -> DataFrame:
    """(suffix, kind) from the lines of a public suffix file."""
    c = F.lower(F.trim("value"))
    kept = lines.select(c.alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("//"))
    kind = F.when(F.col("v").startswith("!"), "exception").when(F.col("v").startswith("*."), "wildcard").otherwise("exact")
    return kept.select(F.regexp_replace("v", r"^(?:!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()


def suffix_table(spark: SparkSession, path: str) -> DataFrame:
    """A public suffix file as a table that hosts meet in a join."""
    return suffix_rows(spark.read.text(path))


#: Suffixes that may become constants on the row; longer lists are joined.
MOST_SUFFIXES = 1000


def suffixes(spark: SparkSession, path: str) -> Suffixes:
    """A short list as constants; a longer one is an error that points to ``suffix_table``."""
    rows = suffix_table(spark, path).limit(MOST_SUFFIXES + 1).collect()
    if len(rows) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffixes: use suffix_table")
    kinds = {k: tuple(r.suffix for r in rows if r.kind == k) for k in ("exact", "wildcard", "exception")}
    return Suffixes(**kinds)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A10: crawled pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")
