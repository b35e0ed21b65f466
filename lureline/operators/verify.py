"""L: what a person should check, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.functions import places as p
from lureline.operators.links import inspect_email

CHECKS = {
    "company": "Confirm the exact legal entity in the company registry",
    "licence": "Search the regulator's register for this exact licence",
    "domain": "Open the official record independently and compare its domain",
    "email": "Compare the sender's domain with the claimed company domain",
    "call": "Call a published switchboard number, not one from the message",
    "separate": "Confirm vacancy, representative, beneficiary and licence separately",
}


def checklist(messages: DataFrame) -> DataFrame:
    """L1: one row per check that applies."""

    def given(c: str):
        return F.coalesce(F.col(c), F.lit("")) != ""

    risk = inspect_email(F.col("recruiter_email"), F.col("claimed_domain"))["points"]

    def row(key: str, value, status=F.lit("manual")):
        return F.struct(status.alias("status"), F.lit(CHECKS[key]).alias("check"), value.alias("value"))

    rows = F.array_compact(F.array(
        F.when(given("claimed_company"), row("company", F.col("claimed_company"))),
        F.when(given("claimed_license"), row("licence", F.col("claimed_license"))),
        F.when(given("claimed_domain"), row("domain", F.col("claimed_domain"))),
        F.when(given("recruiter_email"), row("email", F.col("recruiter_email"), F.when(risk > 0, "warning").otherwise("reviewed"))),
        row("call", F.lit("")), row("separate", F.lit("")),
    ))
    return messages.select("message_id", F.posexplode(rows).alias("i", "r")).select("message_id", (F.col("i") + 1).alias("ord"), "r.*")


def sources(messages: DataFrame) -> DataFrame:
    """L2: official sources of the country, then the global ones. The dimension is constant and small, hence the broadcast."""
    spark = messages.sparkSession
    rows = [(code, country, [(n, u) for n, u in listed]) for code, (country, listed) in p.COUNTRY_SOURCES.items()]
    dim = spark.createDataFrame(rows, "code string, region string, listed array<struct<source:string,url:string>>")
    keyed = messages.select("message_id", F.upper(F.trim("country_code")).alias("code"))
    joined = keyed.join(F.broadcast(dim), "code", "left")
    world = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(u).alias("url")) for n, u in p.GLOBAL_SOURCES])
    every = F.when(F.col("listed").isNotNull(), F.concat("listed", world)).otherwise(world)
    note = F.when(F.col("region").isNull(), p.NOTE_FALLBACK).otherwise(p.NOTE)
    return joined.select("message_id", F.coalesce("region", F.lit("")).alias("region_label"), note.alias("note"), F.posexplode(every).alias("i", "s")).select(
        "message_id", "region_label", "note", (F.col("i") + 1).alias("ord"), "s.source", "s.url")
