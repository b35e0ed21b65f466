"""O: labelled records built by expansion, one narrow projection over numbers.

Every column follows from the record number alone, so a corpus of any size is built without a shuffle and any part of
it can be rebuilt on its own after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.functions import taxonomy as x
from lureline.functions import text as t
from lureline.functions.languageid import NAMES
from lureline.functions.rows import let, lookup, settle

LANGS = list(NAMES)
BRANDS = {"job": "Example Cedar Staffing", "investment": "Example Cedar Capital"}


def idiv(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("bigint")


def split_of(group: Column) -> Column:
    """Train, validation or test from the hash of the group, so a group never straddles two splits."""
    bucket = F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def reference(number: Column) -> Column:
    """O6."""
    return F.concat(F.lit("RF-"), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{x.SEED}:"), number.cast("string")), 256), 1, 10)))


def apply_variant(text: Column, variant: Column, language: Column) -> Column:
    """The same text in a disguise that keeps its meaning."""
    spaced = text
    for word in ("fee", "deposit", "profit", "payment"):
        spaced = F.regexp_replace(spaced, r"(?i)\b" + "".join(f"({c})" for c in word) + r"\b", " ".join(f"${i + 1}" for i in range(len(word))))
    wide = F.translate(text, ":!?", "：！？")
    mixed = F.array_join(F.split(F.array_join(F.split(text, r"\. ", 2), "... "), " — ", 2), " !!! ")
    return (
        F.when(variant == "defanged_url", F.replace(F.replace(text, F.lit("https://"), F.lit("hxxps://")), F.lit(".invalid"), F.lit("[.]invalid")))
        .when(variant == "zero_width", F.array_join(F.split(text, " ", 3), "​ "))
        .when(variant == "fullwidth_punctuation", wide)
        .when((variant == "spaced_tokens") & (language == "en"), spaced)
        .when(variant == "mixed_punctuation", mixed)
        .otherwise(text)
    )


def family_key(text: Column) -> Column:
    """Names a text whatever its disguise: links written out, invisible signs and compatibility forms undone, then only letters and
    digits, lower-cased. Spaced letters and changed punctuation leave no trace in it. Texts without letters or digits go by themselves."""
    plain = text
    for step in (t.plain_urls, t.fold_compat, t.strip_invisible, t.refang):
        plain = let(plain, step)  # a step asks for its text more than once, which would run the steps before it as often
    plain = F.regexp_replace(F.lower(plain), r"[^\pL\pN]+", "")
    return let(plain, lambda p: F.sha2(F.when(p != "", p).otherwise(text), 256))


def plan(numbers: DataFrame, number: str = "number") -> DataFrame:
    """O1 and O2: segment, place in the segment, language, leaf, country, currency, channel."""
    n = F.col(number)
    block, place = idiv(n - 1, 64), F.pmod(n - 1, F.lit(64))
    start, pieces = 0, []
    for i, (_, _, _, size) in enumerate(x.SEGMENTS):
        pieces.append((start + size, F.struct(F.lit(i).alias("seg"), (block * size + place - start).alias("i"))))
        start += size
    chosen = F.lit(None)
    for end, piece in reversed(pieces):
        chosen = F.when(place < end, piece).otherwise(chosen)
    out = settle(numbers, _p=chosen)
    seg, i = F.col("_p.seg"), F.col("_p.i")
    out = settle(
        out, i=i, record_type=lookup([s[0] for s in x.SEGMENTS], seg), label=lookup([s[1] for s in x.SEGMENTS], seg), domain=lookup([s[2] for s in x.SEGMENTS], seg),
        language=lookup(LANGS, F.pmod(n - 1, F.lit(19)).cast("int")), leaf=F.pmod(i, F.lit(16)).cast("int"), channel=lookup(list(x.CHANNELS), F.pmod(idiv(n, 3), F.lit(7)).cast("int")),
    )
    leaf = F.col("leaf") + F.when(F.col("domain") == "job", 0).otherwise(16)
    scam = F.col("label") == "scam"
    kind = F.when(F.col("label") == "legitimate", "L").when(F.col("label") == "awareness", "A").otherwise("O")
    taxonomy = F.when(scam, lookup([v[0] for v in x.LEAVES], leaf)).otherwise(F.concat(F.upper(F.substring("domain", 1, 1)), F.lit("00-"), kind))
    at = F.array_position(F.array(*[F.lit(c) for c in LANGS]), F.col("language")).cast("int") - 1
    countries = F.split(lookup([" ".join(x.COUNTRIES[c]) for c in LANGS], at), " ")
    out = settle(out, taxonomy_id=taxonomy, _leaf=F.when(scam, leaf), _at=at, country=F.element_at(countries, (F.pmod(n, F.size(countries)) + 1).cast("int")), ref=reference(n))
    codes = list(x.CURRENCIES)
    money = lookup(list(x.CURRENCIES.values()), F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("country")).cast("int") - 1)
    return settle(out, currency=money).drop("_p")


def records(numbers: DataFrame, number: str = "number") -> DataFrame:
    """The full record."""
    out = plan(numbers, number)
    n, i, leaf, at = F.col(number), F.col("i"), F.col("_leaf"), F.col("_at")
    en, scam = F.col("language") == "en", F.col("label") == "scam"

    def phrase(k: int) -> Column:
        return lookup([x.PHRASES[c][k] for c in LANGS], at)

    topic = F.when(F.col("domain") == "job", phrase(0)).otherwise(phrase(1))
    topic_en = F.when(F.col("domain") == "job", x.PHRASES["en"][0]).otherwise(x.PHRASES["en"][1])
    brand = F.when(F.col("domain") == "job", BRANDS["job"]).otherwise(BRANDS["investment"])
    link = F.concat(F.lit("https://"), "domain", F.lit("-"), F.lower("taxonomy_id"), F.lit("-"), F.pmod(i, F.lit(97)).cast("string"), F.lit(".invalid/"), F.lower("ref"))
    out = settle(
        out, topic=topic, topic_en=topic_en, brand=brand, urge=phrase(2), demand=phrase(3), safe=phrase(4), alert=phrase(5), cue=F.lower(lookup([v[1] for v in x.LEAVES], leaf)),
        amount=lookup(list(x.AMOUNTS), F.pmod(i, F.lit(12)).cast("int")).cast("string"), link=F.when(F.pmod(i, F.lit(4)) == 2, "[LINK REDACTED]").otherwise(link), tail=F.concat(F.lit(" Ref: "), "ref"),
    )
    c, s = F.concat, F.lit
    turn = F.pmod(i, F.lit(4))
    local = (
        F.when(turn == 0, c("urge", s(". "), "topic", s(". "), "demand", s(" "), "amount", s(". "), "link", "tail"))
        .when(turn == 1, c("topic", s(". "), "urge", s("; "), "demand", s(". "), "link", "tail"))
        .when(turn == 2, c("topic", s(". "), "demand", s(" "), "amount", s(". "), "link", "tail"))
        .otherwise(c("urge", s(" — "), "topic", s(". "), "link", s("."), "tail"))
    )
    english = c(s(x.PHRASES["en"][2] + ". "), "brand", s(": "), "topic_en", s(". "), "cue", s(". " + x.PHRASES["en"][3] + " "), "amount", s(". "), "link", "tail")
    variant = F.when(scam, lookup(list(x.VARIANTS), F.pmod(idiv(i, 4), F.lit(6)).cast("int"))).otherwise("clean")
    out = settle(out, variant_type=variant, _bait_en=english, _bait=F.when(en, english).otherwise(local))
    out = settle(out, _bait=apply_variant(F.col("_bait"), F.col("variant_type"), F.col("language")))
    who = F.when(en, F.col("brand")).otherwise("[ORGANISATION]")
    plain = (
        F.when(F.col("label") == "legitimate", c(who, s(": "), "topic", s(". "), "safe", s("."), "tail"))
        .when(F.col("label") == "awareness", c("alert", s(": "), "topic", s("; "), "demand", s(". "), "safe", s("."), "tail"))
        .otherwise(c("safe", s("."), "tail"))
    )
    out = settle(out, _single=F.when(scam, F.col("_bait")).otherwise(plain))

    def say(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("text"))

    bad = F.array(say("unknown_sender", F.col("_bait")), say("recipient", F.col("safe")), say("unknown_sender", c("urge", s("."))), say("recipient", F.col("safe")),
                  say("unknown_sender", c("demand", s(" "), "amount", "tail")))
    good = F.array(say("organisation", F.col("_single")), say("recipient", F.col("safe")), say("organisation", F.col("safe")))
    chat = F.col("record_type") == "conversation"
    turns = F.when(chat & scam, bad).when(chat, good).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    out = settle(out, turns=turns)
    joined = F.array_join(F.transform("turns", lambda v: c(s("["), v["role"], s("] "), v["text"])), "\n")
    extra = F.array_compact(F.array(F.when(turn != 2, s("contains_url")), F.when(F.pmod(i, F.lit(3)) == 0, s("off_platform")), F.when(chat, s("conversation_escalation"))))
    signals = F.when(scam, F.array_distinct(F.concat(F.split(lookup([" ".join(v[4]) for v in x.LEAVES], leaf), " "), extra))).when(
        F.col("label") == "legitimate", F.array(s("official_verification"), s("no_payment_request"))).when(
        F.col("label") == "awareness", F.array(s("awareness_context"), s("negated_risk_terms"))).otherwise(F.array(s("abstention_recommended")))
    action = F.coalesce(lookup([x.ACTIONS[v[2]] for v in x.LEAVES], leaf), s("none"))
    stages = F.split(lookup([" ".join(v[3]) for v in x.LEAVES], leaf), " ")
    width = F.when(scam, 1520).otherwise(152)
    group = c(s("GRP-"), "domain", s("-"), "taxonomy_id", s("-"), "language", s("-"), F.format_string("%06d", F.floor(n / width).cast("bigint")))
    out = settle(out, text=F.when(chat, joined).otherwise(F.col("_single")), text_en=F.when(scam, F.col("_bait_en")).when(F.col("label") == "legitimate", "Official message; nothing is asked for.").when(
        F.col("label") == "awareness", "Warning about scams; do not pay.").otherwise("General talk with no offer."), signals=signals, requested_action=action, campaign_group_id=group)
    harms = list(x.HARMS)
    harm = F.coalesce(lookup(list(x.HARMS.values()), F.nullif(F.array_position(F.array(*[s(h) for h in harms]), F.col("requested_action")), F.lit(0)).cast("int") - 1), s("none"))
    ood = F.col("label") == "ambiguous_ood"
    out = settle(
        out, id=F.format_string("LRC-%07d", n), version=s(x.VERSION), taxonomy_name=F.when(scam, lookup([v[1] for v in x.LEAVES], leaf)).otherwise(c("label", s(" sample"))),
        language_name=lookup(list(NAMES.values()), at), language_variant=F.when(en, "english").otherwise("native_script_template"),
        translation_status=F.when(en, "source_english").otherwise("auditable_template_not_human_verified"), scenario_cue_en=F.col("cue"),
        leaf_text_specificity=F.when(en, "leaf_level").when(scam, "mechanism_level").otherwise("not_applicable"), variant_family_id=F.col("campaign_group_id"), harm_vector=harm,
        severity=F.when(scam & F.col("requested_action").isin(*x.GRAVE), "high").when(scam, "medium").otherwise("none"), annotation_confidence=F.when(ood, 0.5).otherwise(1.0),
        label_basis=F.when(ood, "designed_abstention_case").otherwise("generator_ground_truth"), review_status=F.when(en, "internal_template_review").otherwise("native_speaker_review_required"),
        ood_reason=F.when(ood, F.when(F.pmod(i, F.lit(2)) == 0, "insufficient_evidence").otherwise("adjacent_but_non_transactional")),
        lifecycle_stage=F.coalesce(F.element_at(stages, (F.pmod(n, F.size(stages)) + 1).cast("int")), s("prevention")),
        payment_method=F.when(scam, lookup(list(x.PAYMENTS), F.pmod(n, F.lit(5)).cast("int"))).otherwise("none"), synthetic=s(True), contains_live_indicator=s(False),
        pii_status=s("safe_placeholders_only"), code_switch_status=s("none"), source_id=s("LURELINE-SYNTH-01"), source_type=s("deterministic_synthetic_template"), generator_seed=s(x.SEED),
        created_at=s(x.CREATED), split=split_of(F.col("campaign_group_id")),
    )
    return settle(out, content_sha256=content_hash()).select(*FIELDS)


HASHED = ("label", "domain", "taxonomy_id", "language", "text", "text_en", "turns_flat", "signals_flat", "scenario_cue_en", "requested_action", "harm_vector", "severity", "confidence_text", "label_basis", "ood_reason", "variant_type")


def content_hash() -> Column:
    """A hash over the decision-relevant fields in a fixed order (a form of our own, nulls kept apart from blanks)."""
    values = {
        "turns_flat": F.array_join(F.transform("turns", lambda v: F.concat(v["role"], F.lit("="), v["text"])), "\x02"),
        "signals_flat": F.array_join("signals", "\x02"), "confidence_text": F.when(F.col("annotation_confidence") == 1, "1").otherwise(F.col("annotation_confidence").cast("string")),
    }
    return F.sha2(F.concat_ws("\x01", *[F.coalesce(values.get(c, F.col(c) if c not in values else None), F.lit("\x03")) for c in HASHED]), 256)


FIELDS = (
    "id", "version", "record_type", "label", "domain", "taxonomy_id", "taxonomy_name", "language", "language_name", "language_variant", "translation_status", "country", "currency", "channel", "text", "text_en",
    "turns", "signals", "scenario_cue_en", "leaf_text_specificity", "variant_type", "variant_family_id", "requested_action", "harm_vector", "severity", "annotation_confidence", "label_basis", "review_status",
    "ood_reason", "lifecycle_stage", "payment_method", "synthetic", "contains_live_indicator", "pii_status", "code_switch_status", "source_id", "source_type", "generator_seed", "campaign_group_id", "created_at",
    "split", "content_sha256",
)


def shuffled(df: DataFrame, key: str, seed: int = x.SEED) -> DataFrame:
    """A fixed random order, as a rank-free sort key; sort by it only where an order is needed."""
    return df.withColumn("shuffle_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))


def dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keep the lowest key of each normalised text. A minimum per hash is combined on the map side, so a text that
    makes up a third of the rows is one row per task by the time it is shuffled."""
    hashed = df.select(key, F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256).alias("norm_hash"))
    return hashed.groupBy("norm_hash").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
