"""A rule table, lexicons and a guard as a user would supply them: what ``u1_supplied_rules`` compiles and runs over the messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lureline.functions.ruleset import RULE_SCHEMA, RuleSet, compiled

LEXICONS: tuple[tuple[str, str], ...] = (
    ("demand", "pay"), ("demand", "paid"), ("demand", "recharge"), ("demand", "activate"), ("demand", "send"), ("demand", "top up"),
    ("cost", "fee"), ("cost", "fees"), ("cost", "deposit"), ("cost", "charge"), ("cost", "tier"), ("purse", "wallet"), ("purse", "account"), ("purse", "balance"),
)
# rule_id, category, severity, weight, words, then_words, gap, either_order, same_sentence, guards, action, note
RULES: tuple[tuple, ...] = (
    ("cost_asked", "Own list", "critical", 30, "@demand", "@cost", 40, False, True, "warning never_do", "Ask the sender for a written bill.", "A cost is asked for."),
    ("purse_in_red", "Own list", "high", 15, "@purse", "negative|minus|red", 30, True, True, None, "Look at the balance in the official app.", "A purse below zero."),
    ("ratings", "Own list", "medium", 8, "hotel listings|star rating*", None, None, None, None, None, None, "Ratings for money."),
    ("the_of", "Own list", "medium", 1, "the", "of", 12, False, True, None, None, "Common words close together, found in the bodies themselves."),
    ("never_met", "Own list", "high", 20, "zeppelin timetable", "@cost", 10, True, False, None, None, "Nothing meets it."),
)


def rule_set(spark: SparkSession) -> RuleSet:
    return compiled(spark.createDataFrame(list(RULES), RULE_SCHEMA), lexicon_table(spark))


def lexicon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICONS), "lexicon string, word string")
