"""P: corpus invariants as (check, passed, failing_rows), and schema constraints as violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.functions import taxonomy as x
from lureline.functions.text import plain_urls
from lureline.operators.corpus import content_hash

CHECK = "check string, passed boolean, failing_rows bigint"


def reserved_url(url: Column) -> Column:
    """Is the parsed host (not a part of the text) reserved for examples?"""
    cleaned = F.regexp_replace(url, r"[.,;:!?)\]}>'\x22]+\z", "")
    authority = F.regexp_extract(cleaned, r"(?i)^https?://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")), r"\.+$", "")
    return host.rlike(r"(?:^|\.)(?:invalid|example)$")


def urls_of(c: Column) -> Column:
    return F.regexp_extract_all(plain_urls(c), F.lit(r"(?i)https?://\S+"), F.lit(0))


def row_checks() -> dict[str, Column]:
    """Checks that hold row by row: a column that is true on a failing row. All are summed in one pass."""
    said = F.concat_ws("\n", "text", "text_en", F.array_join(F.transform("turns", lambda v: v["text"]), "\n"))
    blank = F.lit(False)
    for c in ("id", "record_type", "label", "domain", "taxonomy_id", "language", "country", "channel", "text", "text_en", "signals", "source_id", "campaign_group_id", "requested_action", "harm_vector", "severity",
              "annotation_confidence", "split", "content_sha256"):
        blank = blank | F.col(c).isNull()
    ood = F.col("label") == "ambiguous_ood"
    return {
        "reserved_urls_only": F.exists(urls_of(said), lambda u: ~reserved_url(u)),
        "safe_provenance_flags": ~F.col("synthetic") | F.col("contains_live_indicator"),
        "multilingual_english_cue_removed": (F.col("language") != "en") & F.coalesce(F.contains("text", F.col("scenario_cue_en")), F.lit(False)),
        "ood_abstention_metadata": ood & (F.col("ood_reason").isNull() | (F.col("annotation_confidence") != 0.5) | ~F.array_contains("signals", "abstention_recommended")),
        "content_hashes_valid": F.col("content_sha256") != content_hash(),
        "all_required_fields": blank,
    }


def validate(records: DataFrame, languages: int = 19, leaves: int = 32, slack: int = 2) -> DataFrame:
    """P1 to P21 over records: one pass for the row checks and plain counts, one small aggregation per grouped check."""
    one = records.agg(
        F.count(F.lit(1)).alias("record_count"),
        *[F.count(F.when(c, 1)).alias(n) for n, c in row_checks().items()],
        F.count_distinct("language").alias("_languages"), F.count_distinct(F.when(F.col("label") == "scam", F.col("taxonomy_id"))).alias("_leaves"),
        F.count_distinct(F.when(F.col("label") == "scam", F.col("variant_type"))).alias("_variants"),
    )
    simple = [F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("passed"), F.col(n).alias("failing_rows")) for n in row_checks()]
    simple.append(F.struct(F.lit("record_count").alias("check"), (F.col("record_count") > 0).alias("passed"), F.lit(0).cast("bigint").alias("failing_rows")))
    for name, seen, want in (("language_count", "_languages", languages), ("taxonomy_leaf_count", "_leaves", leaves), ("robustness_variants_present", "_variants", len(x.VARIANTS))):
        simple.append(F.struct(F.lit(name).alias("check"), (F.col(seen) == want).alias("passed"), F.abs(F.col(seen) - want).alias("failing_rows")))
    out = one.select(F.inline(F.array(*simple)))
    for name, key in (("unique_ids", "id"), ("unique_content", "content_sha256")):
        out = out.unionByName(repeated(records, key, name))
    for name, key in (("campaign_split_isolation", "campaign_group_id"), ("variant_family_split_isolation", "variant_family_id")):
        out = out.unionByName(straddling(records, key, name))
    out = out.unionByName(spread(records, "language", "language_balance", slack))
    out = out.unionByName(spread(records.where(F.col("label") == "scam"), "taxonomy_id", "leaf_balance", slack))
    return out.unionByName(spread(records, "domain", "domain_balance", 64))


def _one(name: str, df: DataFrame, failing: Column) -> DataFrame:
    g = df.agg(F.coalesce(failing, F.lit(0)).cast("bigint").alias("failing_rows"))
    return g.select(F.lit(name).alias("check"), (F.col("failing_rows") == 0).alias("passed"), "failing_rows")


def repeated(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows beyond the first of their key."""
    return _one(name, df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), F.sum(F.col("n") - 1))


def straddling(df: DataFrame, key: str, name: str) -> DataFrame:
    """Groups found in more than one split."""
    return _one(name, df.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")), F.count(F.when(F.col("a") != F.col("b"), 1)))


def spread(df: DataFrame, key: str, name: str, slack: int) -> DataFrame:
    """How far the largest and the smallest group lie apart beyond the slack."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _one(name, g, F.greatest(F.max("n") - F.min("n") - slack, F.lit(0)))


def counted(df: DataFrame, expected: Column, name: str) -> DataFrame:
    """How far the number of rows is from the expected one (a literal or an aggregate of the same table)."""
    return _one(name, df, F.abs(F.count(F.lit(1)) - F.coalesce(expected, F.lit(0))))


def rollup(checks: DataFrame) -> DataFrame:
    """P22."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",")
    return checks.agg(F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("status"), F.count(F.lit(1)).alias("checks"), failed.alias("failures"))


def violations(df: DataFrame, key: list[str], constraints: dict[str, Column]) -> DataFrame:
    """One row per broken constraint; a constraint is a column that is true on good rows."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in constraints.items()]))
    return df.select(*key, F.explode(broken).alias("constraint"))


def record_constraints() -> dict[str, Column]:
    return {
        "id": F.col("id").rlike(r"^LRC-[0-9]{7,}$"), "record_type": F.col("record_type").isin("single_message", "conversation"),
        "label": F.col("label").isin("scam", "legitimate", "awareness", "ambiguous_ood"), "domain": F.col("domain").isin("job", "investment"), "country": F.col("country").rlike("^[A-Z]{2}$"),
        "currency": F.col("currency").rlike("^[A-Z]{3}$"), "text": F.length("text") >= 10, "channel": F.col("channel").isin(*x.CHANNELS), "variant_type": F.col("variant_type").isin(*x.VARIANTS),
        "severity": F.col("severity").isin("none", "medium", "high"), "annotation_confidence": F.col("annotation_confidence").between(0, 1), "split": F.col("split").isin("train", "validation", "test"),
        "signals": F.size("signals") == F.size(F.array_distinct("signals")), "content_sha256": F.col("content_sha256").rlike("^[a-f0-9]{64}$"), "synthetic": F.col("synthetic"),
    }


#: Who may speak; P8 and P23 use the same list.
ROLES = ("assistant", "system", "user")


def turn_constraints(min_text: int = 40, roles: tuple[str, ...] = ROLES, most_turns: int | None = None) -> dict[str, Column]:
    """P23 for turns. ``most_turns`` is an option; by default a conversation may have any number."""
    turn = F.col("turn") >= 0
    return {"role": F.col("role").isin(*roles), "text": F.length("text") >= min_text, "turn": turn if most_turns is None else turn & (F.col("turn") < most_turns)}
