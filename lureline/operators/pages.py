"""M: static inspection of crawled pages with expressions only; nothing is fetched or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.functions.rows import settle

SCRIPT_OR_STYLE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
PASSWORD = r"(?i)<input\b[^>]*type\s*=\s*[\x22']?password"
LINK = r"(?i)<(?:a|link|script|img)\b[^>]*?\s(?:href|src)\s*=\s*[\x22']?([^\x22'\s>]+)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SIGNALS: tuple[tuple[str, str, int], ...] = (
    (r"(?:sure|certain|guaranteed|fixed) (?:\S+ ){0,2}(?:profits?|returns?|gains?|income)|no risk|risk[- ]free|cannot lose", "guaranteed return wording", 18),
    (r"(?:deposit|recharge|top[- ]?up|pay) (?:\S+ ){0,6}(?:unlock|unfreeze|activate|withdraw|next set|task set)", "advance fee wording", 22),
    (r"(?:only|contact|write to|ask) (?:\S+ ){0,4}(?:whatsapp|telegram|wechat|line) ?(?:support|agent|group|only)?", "contact by chat app only", 8),
    (r"(?:install|download|get) (?:\S+ ){0,4}(?:apk|app file|beta app)|unknown (?:sources|apps)", "app from outside a store", 25),
    (r"(?:send|pay|deposit|transfer) (?:\S+ ){0,4}(?:usdt|btc|bitcoin|crypto|coins)|(?:wallet|coin) address", "crypto payment wording", 18),
)


def plain(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def inspect(pages: DataFrame, cap: int | None = None, links: int | None = None) -> DataFrame:
    """M1 to M8 over whole pages. ``cap`` (characters of a page) and ``links`` (of a page) are options."""
    html = F.coalesce(F.col("html"), F.lit(""))
    out = settle(pages, _h=html if cap is None else F.substring(html, 1, cap))
    h = F.col("_h")
    found = F.regexp_extract_all(h, F.lit(LINK), F.lit(1))
    out = settle(
        out,
        title=F.substring(plain(F.regexp_extract(h, TITLE, 1)), 1, 200),
        visible=plain(F.regexp_replace(F.regexp_replace(h, SCRIPT_OR_STYLE, " "), r"<[^>]*>", " ")),
        forms=F.regexp_count(h, F.lit(r"(?i)<form\b")), password_fields=F.regexp_count(h, F.lit(PASSWORD)), script_tags=F.regexp_count(h, F.lit(r"(?i)<script\b")),
        links=found if links is None else F.slice(found, 1, links),
    )
    lower = F.lower("visible")
    tests = [(lower.rlike(rx), name, w) for rx, name, w in SIGNALS]
    tests.append(((F.col("password_fields") > 0) & ~F.lower("url").startswith("https://"), "password form without https", 15))
    tests.append((F.col("forms") >= 3, "several forms", 5))
    points = F.least(F.lit(45), sum((F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, _, w in tests), F.lit(0)))
    return settle(out, signals=F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n, _ in tests])), risk_points=points).drop("_h")
