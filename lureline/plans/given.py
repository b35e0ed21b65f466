"""Corpus checks, splits, samples and statistics over the given tables: documents with their labels, pages, benchmark, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.functions import taxonomy as x
from lureline.functions.languageid import NAMES
from lureline.functions.rows import settle
from lureline.operators import checks, corpus, sampling
from lureline.plans.messages import read

def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels (null where there are none), a group per text, and the split that follows from the group."""
    docs = read(spark, d, "documents").withColumn("content_sha256", F.sha2("text", 256))
    labels = read(spark, d, "labels").select("doc_id", "quality", "toxic")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")
    return docs.join(labels, "doc_id", "left").withColumn("label", kind).withColumn("split", corpus.split_of(F.col("content_sha256")))


def index(docs: DataFrame) -> DataFrame:
    """The columns that the split writer and its index need."""
    return docs.select(F.format_string("DOC-%07d", "doc_id").alias("id"), "split", F.col("content_sha256").alias("campaign_group_id"), corpus.family_key(F.col("text")).alias("variant_family_id"))


def variants(docs: DataFrame) -> DataFrame:
    """O5 over given texts: a disguise drawn by the hash of the text."""
    drawn = F.conv(F.substring("content_sha256", 9, 6), 16, 10).cast("int") % len(x.VARIANTS)
    kind = F.element_at(F.array(*map(F.lit, x.VARIANTS)), drawn + 1)
    return docs.select("doc_id", kind.alias("variant_type"), corpus.apply_variant(F.col("text"), kind, F.col("lang")).alias("said")).select("doc_id", "variant_type", F.sha2("said", 256).alias("text_sha256"))


def families(docs: DataFrame) -> DataFrame:
    """Each document in all its disguises, with the family and the split that follow from each text alone."""
    own = settle(docs.select("doc_id", "lang", "text"), own=corpus.family_key(F.col("text")))
    every = own.withColumn("variant_type", F.explode(F.array(*map(F.lit, x.VARIANTS))))
    said = settle(every, said=corpus.apply_variant(F.col("text"), F.col("variant_type"), F.col("lang")))
    # A text that a disguise leaves as it is keeps the key it has.
    changed = F.col("said") != F.col("text")
    named = settle(said, family=F.when(changed, corpus.family_key(F.col("said"))).otherwise(F.col("own")))
    named = named.select("doc_id", "variant_type", "own", "family", changed.alias("disguised"))
    return named.withColumn("own_split", corpus.split_of(F.col("own"))).withColumn("split", corpus.split_of(F.col("family")))


def family_isolation(docs: DataFrame) -> DataFrame:
    """P11 per disguise: how many texts it changes, and how many would leave their family or their split (none should)."""
    return families(docs).groupBy("variant_type").agg(
        F.count(F.when(F.col("disguised"), 1)).alias("disguised"), F.count_distinct("family").alias("families"),
        F.count(F.when(F.col("family") != F.col("own"), 1)).alias("left_family"), F.count(F.when(F.col("split") != F.col("own_split"), 1)).alias("left_split"))


def _counted(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One pass for all row checks: a test is true on a failing row."""
    one = rows.agg(*[F.count(F.when(F.coalesce(bad, F.lit(False)), 1)).alias(n) for n, bad in tests.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("passed"), F.col(n).alias("failing_rows")) for n in tests])))


def corpus_checks(spark: SparkSession, d: str) -> DataFrame:
    """P over the given tables; failures are real ones. Row checks of a table are one pass."""
    docs = labelled(spark, d)
    missing = F.lit(False)
    for c in ("doc_id", "text", "lang", "source", "n_chars"):
        missing = missing | F.col(c).isNull()
    out = _counted(docs, {
        "all_required_fields": missing, "content_lengths_valid": F.col("n_chars") != F.length("text"), "language_supported": ~F.col("lang").isin(*NAMES),
        "english_cue_removed": (F.col("lang") != "en") & F.contains(F.lower("text"), F.lit(" the ")), "label_contradiction": (F.col("toxic") == 1) & (F.col("quality") == 1),
    })
    labels = read(spark, d, "labels")
    out = out.unionByName(_counted(labels, {"label_values": ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)}))
    out = out.unionByName(_counted(labels.join(docs.select("doc_id"), "doc_id", "left_anti"), {"labels_have_documents": F.lit(True)}))
    out = out.unionByName(_counted(read(spark, d, "conversations"), {"record_types": ~F.col("role").isin(*checks.ROLES)}))
    out = out.unionByName(_counted(read(spark, d, "pages"), {"reserved_urls_only": ~checks.reserved_url(F.col("url"))}))
    copies = read(spark, d, "benchmark").join(docs.select("text"), "text", "left_semi")
    out = out.unionByName(_counted(copies, {"benchmark_isolation": F.lit(True)}))
    out = out.unionByName(checks.repeated(read(spark, d, "benchmark"), "text", "benchmark_unique"))
    out = out.unionByName(checks.repeated(docs, "doc_id", "unique_ids")).unionByName(checks.repeated(docs, "content_sha256", "unique_content"))
    numbered = docs.withColumn("split", corpus.split_of(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))))
    out = out.unionByName(checks.straddling(docs, "content_sha256", "split_isolation")).unionByName(checks.straddling(numbered, "content_sha256", "split_isolation_by_number"))
    # Numbers from 0 on without gaps, so the last one says how many there must be.
    out = out.unionByName(checks.counted(docs, F.max("doc_id") + 1, "record_count"))
    for name, key in (("language_balance", "lang"), ("source_balance", "source"), ("label_balance", "label")):
        out = out.unionByName(checks.spread(docs, key, name, 0))
    return out


#: P23 as a document: a turn as a raw JSON row.
TURN_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["conv_id", "turn", "role", "text", "tags"],
    "properties": {
        "conv_id": {"type": "integer", "minimum": 0}, "turn": {"type": "integer", "minimum": 0}, "role": {"type": "string", "enum": list(checks.ROLES)}, "text": {"type": "string", "minLength": 60, "pattern": "[.!?]"},
        "tags": {"type": "array", "items": {"type": "string", "enum": ["opening", "question", "long"]}, "uniqueItems": True}, "version": {"const": "1"},
    },
}


def turn_lines(turns: DataFrame) -> DataFrame:
    """Turns as the JSON rows that another system might send: tags, a field that the schema lacks on some, another version on others."""
    tags = F.array_compact(F.array(F.when(F.col("turn") == 0, "opening"), F.when(F.contains("text", F.lit("?")), "question"), F.when(F.length("text") > 200, "long"), F.when(F.col("role") == "system", "notice")))
    extra = F.when(F.pmod("conv_id", F.lit(7)) == 0, F.lit("x"))
    row = F.struct("conv_id", "turn", F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) != 0, F.col("role")).alias("role"), "text", tags.alias("tags"), F.when(F.pmod("turn", F.lit(3)) == 1, "2").alias("version"), extra.alias("mood"))
    return turns.select("conv_id", "turn", F.to_json(row).alias("line"))


def slices(docs: DataFrame) -> DataFrame:
    """Q2, Q3: the first documents of each label and language in the test split."""
    test = docs.where(F.col("split") == "test").withColumn("slice", F.concat_ws(":", "label", "lang"))
    return sampling.first_per_group(test, "slice", "doc_id", 16)


#: Q2: rows wanted from each label of the test split; more than some hold, so that shortfalls are dealt out.
QUOTAS = {"good": 24, "poor": 16, "toxic": 16, "unlabelled": 8, "disputed": 4}
TOTAL = 64


def quota_slices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q2: the test rows of the labels, and their quotas."""
    spark = docs.sparkSession
    return docs.where(F.col("split") == "test").withColumn("slice", F.col("label")), spark.createDataFrame(list(QUOTAS.items()), "slice string, quota long")


def constraints() -> dict[str, Column]:
    """P23 for documents: true on good rows."""
    return {"doc_id": F.col("doc_id") >= 0, "text": F.length("text") >= 10, "lang": F.col("lang").rlike("^[a-z]{2}$"), "source": F.col("source").rlike("^src[0-9]$"), "n_chars": F.col("n_chars").between(10, 20000)}
