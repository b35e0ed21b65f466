"""Quality rules: counts of words, symbols and repeats, and an n-gram perplexity with upper and lower bands for each language.

The model is a modified Kneser-Ney model of order 4 over characters as they stand: each code point is a symbol of its own, so the model grows
with the corpus. Spark counts the 4-grams of all documents; continuation counts, discounts, probabilities and back-off weights are joins and
sums over the counts. A gram is the pair of its context (up to three symbols of 21 bits in a long) and its last symbol. Texts are dealt to
blocks; a block sends each of its different 4-grams to the model once and gets their probabilities back, so no task holds the model. The
uniform floor below single symbols is 1 / 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm import tokens
from lureline.llm.common import cut, packed, row_key
from lureline.llm.words import Words, runs

ORDER, BITS = 4, 21
#: The probability of any symbol below the order of single symbols.
FLOOR = 1 / 64
#: Characters of a block of texts that meets the model at once, and blocks of a small table at least.
BLOCK, PARTS = 8_000_000, 4
#: Different 4-grams that a counting task holds before it sends its sums on.
HELD = 2_000_000


def _table() -> np.ndarray:
    """The symbol of each code point. Case, digits, white space and groups of ASCII signs are one symbol each, as texts are normalised for such
    models; any other character is a symbol of its own. 0 stands before a text."""
    t = np.arange(1, 0x110001, dtype=np.int32)
    for same in (range(9, 14), range(48, 58), *([65 + k, 97 + k] for k in range(26)), *([ord(c) for c in signs] for signs in (".!?", ",;:", "\"'`", "()[]{}", "#*$%&|<>"))):
        t[list(same)] = same[-1] + 1
    t[[*range(9, 14), 0x85, 0xA0]] = 33  # white space
    return t


_SYMBOL = _table()
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&|<>")] = True


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the texts with ORDER - 1 zeros before each, the place of each character there, and the number of characters of each."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    apart = np.zeros(int(sizes.sum()) + (ORDER - 1) * (len(texts) + 1), np.int64)
    own = np.repeat(np.arange(1, len(texts) + 1) * (ORDER - 1), sizes) + np.arange(int(sizes.sum()))
    apart[own] = _SYMBOL[np.concatenate(points) if points else np.zeros(0, "<u4")]
    return apart, own, sizes


def _mask(n: int) -> int:
    """Of a context, the last n symbols."""
    return (1 << (BITS * n)) - 1


def grams(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Context and last symbol of the 4-gram ending at each character of the texts, and the number of characters of each."""
    apart, own, sizes = _symbols(texts)
    return (apart[own - 3] << (2 * BITS) | apart[own - 2] << BITS | apart[own - 1], apart[own]), sizes


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different 4-grams of the texts (context and last symbol, ascending), how often each is there, which one ends at each character, and
    the number of characters of each text. Grams are sorted as one number over the symbols that these texts have."""
    apart, own, sizes = _symbols(texts)
    there = np.bincount(apart, minlength=1) > 0
    alphabet, code = np.flatnonzero(there), (np.cumsum(there) - 1)[apart]
    k = len(alphabet)
    context, ranked = (code[own - 3] * k + code[own - 2]) * k + code[own - 1], None
    if k**ORDER >= 1 << 63:
        ranked, context = np.unique(context, return_inverse=True)
    key, which, times = np.unique(context * k + code[own], return_inverse=True, return_counts=True)
    before = key // k if ranked is None else ranked[key // k]
    packed_up = alphabet[before // k // k] << (2 * BITS) | alphabet[before // k % k] << BITS | alphabet[before % k]
    return packed_up, alphabet[key % k], times, which, sizes


def _summed(runs_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of several lists of 4-grams as one, ascending by context and last symbol."""
    if not runs_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    context, last, c = (np.concatenate(x) for x in zip(*runs_of, strict=True))
    by = np.lexsort((last, context))
    context, last, c = context[by], last[by], c[by]
    first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (last[1:] != last[:-1])]) if len(by) else by
    return context[first], last[first], np.add.reduceat(c, first) if len(by) else c


def counted(docs: DataFrame) -> DataFrame:
    """context, last, c: how often each 4-gram occurs in the texts. Each task sums its own before they are shuffled."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(sums[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], t) for x, t in zip(sums, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["context", "last", "c"])

        tokens.forgotten()
        waiting = []
        for run in tokens.runs(parts):
            waiting.append(numbered([t for t, in run if t])[:3])
            if len(waiting) == 16:
                waiting = [_summed(waiting)]
                if len(waiting[0][0]) > HELD:
                    yield from sent(waiting.pop())
        yield from sent(_summed(waiting))

    return docs.select("text").mapInArrow(count, "context long, last int, c long").groupBy("context", "last").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from the numbers of n-grams seen one to four times; plain values where one is 0."""
    row = table.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in range(1, 5)]).first()
    n1, n2, n3, n4 = row
    if min(row) == 0:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.0), k - 1e-3) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _levels(docs: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """For each order, lowest first: its n-grams with their probability (context, last, p), and its contexts with their back-off weight (b)."""
    table, tables = cut(counted(docs)), []
    for n in range(ORDER, 0, -1):
        tables.append((n, table))
        if n > 1:  # lower orders count the different symbols that stand before
            table = cut(table.groupBy(F.col("context").bitwiseAND(F.lit(_mask(n - 2))).alias("context"), "last").agg(F.count(F.lit(1)).alias("c")))
    lower = None
    for n, table in reversed(tables):
        d1, d2, d3 = discounts(table)
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = table.select("context", "last", "c", F.col("context").bitwiseAND(F.lit(_mask(max(n - 2, 0)))).alias("shorter"), taken.alias("d"))
        contexts = rows.groupBy("context").agg(F.sum("c").alias("all"), (F.sum("d") / F.sum("c")).alias("b"))
        met = rows.join(contexts, "context")
        met = met.withColumn("q", F.lit(FLOOR)) if lower is None else met.join(lower.select(F.col("context").alias("shorter"), "last", F.col("p").alias("q")), ["shorter", "last"])
        lower = cut(met.select("context", "last", ((F.col("c") - F.col("d")) / F.col("all") + F.col("b") * F.col("q")).alias("p")))
        yield n, lower, contexts


def probabilities(docs: DataFrame) -> DataFrame:
    """context, last, p of the 4-grams of the texts. Every 4-gram of a counted text is there, so their scores need no back-off weights."""
    return [grams_of for _, grams_of, _ in _levels(docs)][-1]


def kneser_ney(docs: DataFrame) -> DataFrame:
    """The whole model: order, kind (`p`: probability of an n-gram; `b`: back-off weight of a context), context, last (null for `b`), value."""
    out = None
    for n, own, contexts in _levels(docs):
        rows = own.select(F.lit(n).alias("order"), F.lit("p").alias("kind"), "context", "last", F.col("p").alias("value"))
        rows = rows.union(contexts.select(F.lit(n), F.lit("b"), "context", F.lit(None).cast("int"), "b"))
        out = rows if out is None else out.union(rows)
    return out


class Pairs:
    """Places of (context, last) in ascending lists of them."""

    def __init__(self, context: np.ndarray, last: np.ndarray) -> None:
        self.contexts = np.unique(context)
        self.key = np.searchsorted(self.contexts, context) << BITS | last

    def find(self, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each, and whether it is there."""
        if not len(self.key):
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        c = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        key = c << BITS | last
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, (self.contexts[c] == context) & (self.key[at] == key)


class Model:
    """The whole model in memory, for texts that were not counted: log probabilities of n-grams, log back-off weights of contexts. It is as
    large as the model, so no query uses it."""

    def __init__(self, table: DataFrame) -> None:
        self.held: dict[tuple[int, str], tuple[Pairs, np.ndarray]] = {}
        for (order, kind), own in table.toPandas().fillna({"last": 0}).groupby(["order", "kind"]):
            own = own.sort_values(["context", "last"])
            self.held[order, kind] = Pairs(own["context"].to_numpy(np.int64), own["last"].to_numpy(np.int64)), np.log(own["value"].to_numpy())

    def _find(self, order: int, kind: str, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if (order, kind) not in self.held:
            return np.zeros(len(context)), np.zeros(len(context), bool)
        pairs, values = self.held[order, kind]
        at, there = pairs.find(context, last)
        return values[at], there

    def score(self, keys: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> np.ndarray:
        """Natural log of the probability of each 4-gram's last symbol after the others."""
        context, last = keys
        if order == 0:
            return np.full(len(last), np.log(FLOOR))
        out, there = self._find(order, "p", context, last)
        if not there.all():
            gone = np.flatnonzero(~there)
            weight, known = self._find(order, "b", context[gone], np.zeros(len(gone), np.int64))
            out = out.copy()
            out[gone] = np.where(known, weight, 0) + self.score((context[gone] & _mask(max(order - 2, 0)), last[gone]), order - 1)
        return out


def repeated_words(h: np.ndarray) -> int:
    """Words of a text in 3-word windows that are found twice or more."""
    if len(h) < 4:
        return 0
    sort = np.sort(h3 := runs(h, 3))
    twice = sort[1:][sort[1:] == sort[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(h3, twice))
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[hit + k] = True
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


#: Three bins of the histogram: a floor that only keeps a quartile distance of zero from closing the band.
BINS = 0.003
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored")


def features(docs: DataFrame, model: DataFrame) -> DataFrame:
    """rk, doc_id, lang, the counts of FEATURES, and log_perplexity (null for a text without characters). ``model``: probabilities() of a
    corpus that holds these documents."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    characters = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rk"), F.lit(max(PARTS, characters // BLOCK + 1))))

    def named(block: pa.Table) -> pa.Table:
        tokens.forgotten()
        waiting = []
        for run in tokens.runs(block.to_batches()):
            waiting.append(numbered([r[3] for r in run])[:3])
            if len(waiting) == 16:
                waiting = [_summed(waiting)]
        context, last, _ = _summed(waiting)
        return pa.table({"block": pa.repeat(block["block"][0], len(last)), "place": pa.array(np.arange(len(last)), pa.int32()), "context": context, "last": pa.array(last, pa.int32())})

    def measure(block: pa.Table, met: pa.Table) -> pa.Table:
        tokens.forgotten()
        at = met["place"].to_numpy()
        context, last, log_p = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at))
        context[at], last[at], log_p[at] = met["context"].to_numpy(), met["last"].to_numpy(), np.log(met["p"].to_numpy())
        pairs, out = Pairs(context, last), []
        for run in tokens.runs(block.to_batches()):
            texts = [r[3] for r in run]
            words = Words([t.encode("utf-8", "surrogatepass") for t in texts])
            edges = np.r_[words.starts_of_text, len(words.buf)]
            within = np.r_[0, np.cumsum(~words.blank & ((words.buf & 0xC0) != 0x80))]
            signs = np.r_[0, np.cumsum(_SIGNS[words.buf])]
            h = words.hashes()
            again = [repeated_words(h[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            own_context, own_last, _, which, sizes = numbered(texts)
            places, there = pairs.find(own_context, own_last)
            if not there.all():
                raise ValueError("a 4-gram of a counted text has no probability")
            total = np.r_[0, np.cumsum(log_p[places][which])] if len(which) else np.zeros(1)
            ends = np.cumsum(sizes)
            mean = np.where(sizes > 0, -(total[ends] - total[ends - sizes]) / np.maximum(sizes, 1), np.nan)
            cols = [words.count, np.diff(within[edges]), np.diff(signs[edges]), [repeated_lines(t) for t in texts], again, sizes]
            out.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in run], pa.binary()), pa.array([r[1] for r in run], pa.int64()), pa.array([r[2] for r in run], pa.string()), *(pa.array(c, pa.int64()) for c in cols), pa.array(mean, pa.float64(), from_pandas=True)], names=["rk", "doc_id", "lang", *FEATURES, "log_perplexity"]))
        return pa.Table.from_batches(out)

    sent = dealt.groupBy("block").applyInArrow(named, "block long, place int, context long, last int")
    met = sent.join(model, ["context", "last"]).select("block", "place", "context", "last", "p")
    return dealt.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(measure, "rk binary, doc_id long, lang string, " + "".join(f"{c} long, " for c in FEATURES) + "log_perplexity double")


def bands(scored: DataFrame, reach: float = 3.0, least: float = BINS, step: float = 0.001) -> DataFrame:
    """lang, low, high: the quartiles of log perplexity of a language's documents that pass the base rules, `reach` times their distance apart.

    Quartiles come from a histogram with bins of `step`, which is summed exactly; the distance counts as `least` at least.
    """
    bins = scored.filter("NOT base_failed AND log_perplexity IS NOT NULL").groupBy("lang", F.floor(F.col("log_perplexity") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    quartile = [F.min(F.when(F.col("upto") >= q * F.col("total"), (F.col("bin") + 0.5) * step)) for q in (0.25, 0.75)]
    q = upto.groupBy("lang").agg(quartile[0].alias("q1"), quartile[1].alias("q3")).withColumn("apart", F.greatest(F.col("q3") - F.col("q1"), F.lit(least)))
    return q.select("lang", (F.col("q1") - reach * F.col("apart")).alias("low"), (F.col("q3") + reach * F.col("apart")).alias("high"))


def judged(docs: DataFrame, reach: float = 3.0, least: float = BINS) -> DataFrame:
    """features() with base_failed, the language's band (low, high) and kept; `least` is the smallest quartile distance of bands().

    Null text: no words, so it fails the base rules, as an empty one does. A null language is the language `und`. Repeated rows count as
    often as they are there and are judged alike. Only doc_id, text and lang are read. An empty table gives no rows.
    """
    scored = features(docs, probabilities(docs))
    scored = cut(scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    met = scored.join(bands(scored, reach, least), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & inside)


def kept_documents(docs: DataFrame, reach: float = 3.0) -> DataFrame:
    """The documents that are kept, with their own columns."""
    kept = judged(docs, reach).filter("kept").select("rk").distinct()
    rows = docs.select(packed(docs).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    return rows.join(kept, "rk", "left_semi").select("row.*")
