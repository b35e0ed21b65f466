"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

Both steps use the same features (hashed letter trigrams of the whole text) and the same machine. Only a bounded sample of labelled rows
is fitted: `sample_docs` different rows of each language, the first in order of a hash; families are fitted in Spark tasks, each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import row_key
from lureline.llm.tokens import batches

DIMENSIONS = 1 << 12
#: Families of common language codes (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn ur mr gu pa ne si".split(),
    "dravidian": "ta te kn ml".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue".split(),
    "malayic": "id ms tl jv".split(),
    "iranian": "fa ps ku tg".split(),
    "celtic": "ga cy br gd".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower(), f"={lang}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(texts: list[str]) -> np.ndarray:
    """A row for each text: roots of the shares of its hashed trigrams with a letter in the middle; all 0 without a letter."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    c = np.concatenate(points)
    c = np.where(_letters()[c], c, np.uint32(32)).astype(np.uint32)
    own = (c[1:-1] != 32) & (owner[2:] == owner[:-2])
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = owner[1:-1][own] * DIMENSIONS + (h[own] >> np.uint32(20)).astype(np.int64)
    seen = np.bincount(at, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)
    return np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 300) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss; y is -1 or 1, classes weigh alike."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(x.shape[1])
    rate, t = 1 / (1 + 4 * cost), 1.0
    for _ in range(steps):  # accelerated gradient descent
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * cost * (x.T @ (share * y * slack)))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (before - 1) / t * (new - w)
    return w


class Duels:
    """One-versus-one machines between labels."""

    def __init__(self, labels: list[str], pairs: dict[tuple[str, str], np.ndarray]) -> None:
        self.labels = sorted(labels)
        at = {k: i for i, k in enumerate(self.labels)}
        self.a = np.array([at[a] for a, _ in pairs], int)
        self.b = np.array([at[b] for _, b in pairs], int)
        self.w = np.array(list(pairs.values())) if pairs else np.zeros((0, DIMENSIONS + 1))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The label with most duels won (then the largest margin, then the first), and its score from 0 to 1."""
        margin = x @ self.w[:, :-1].T + self.w[:, -1]
        n = len(self.labels)
        points, least = np.zeros((len(x), n)), np.full((len(x), n), 20.0)
        for k in range(len(self.w)):
            m = margin[:, k]
            for label, own in ((self.a[k], m), (self.b[k], -m)):
                points[:, label] += (own > 0) + 0.01 * np.tanh(own)
                least[:, label] = np.minimum(least[:, label], own)
        best = points.argmax(axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(len(x)), best]))


def fit(sample: DataFrame) -> dict[str, Duels]:
    """Machines by family, and `*` for the families themselves. sample: lang, text (whole), bounded."""

    def vectors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for run in batches(list(zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True)), lambda r: len(r[1]), 1_000_000):
                out = [(g, k, v) for (lang, _), x in zip(run, features([t for _, t in run]), strict=True) if x.any() for v in [x.tobytes()] for g, k in (("*", family_of(lang)), (family_of(lang), lang))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["grp", "label", "x"])

    def duel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "x"], kind="stable")
        x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]])
        label = rows["label"].to_numpy()
        names = sorted(set(label))
        out = [(rows["grp"].iloc[0], k, k, b"") for k in names]
        for a, b in combinations(names, 2):
            own = (label == a) | (label == b)
            out.append((rows["grp"].iloc[0], a, b, svm(x[own], np.where(label[own] == a, 1.0, -1.0)).tobytes()))
        return pd.DataFrame(out, columns=["grp", "a", "b", "w"])

    found = sample.mapInArrow(vectors, "grp string, label string, x binary").groupBy("grp").applyInPandas(duel, "grp string, a string, b string, w binary").collect()
    out = {}
    for grp in {r.grp for r in found}:
        own = sorted((r for r in found if r.grp == grp), key=lambda r: (r.a, r.b))
        out[grp] = Duels([r.a for r in own if r.a == r.b], {(r.a, r.b): np.frombuffer(r.w) for r in own if r.a != r.b})
    return out


def languages(docs: DataFrame, sample_docs: int = 300, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, family of each document.

    Rows whose crc32 of the id (as text) is divisible by `folds`, and those without an id, are held out: nothing is learned from them.
    Text null or without a letter: `und`, score 0; so is everything if no row can be learned from. lang is read for learning only; source
    and other columns are never read. Repeated rows are judged alike. An empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text"))
    # First in order of a hash of the id, repeated rows being one: no text is moved to choose, only that of the chosen.
    keyed = rows.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    ids = keyed.select("lang", "doc_id", "rk").distinct().withColumn("draw", F.xxhash64("doc_id"))
    chosen = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "rk"))).filter(F.col("nth") <= sample_docs).select("lang", "rk")
    # Its bound: sample_docs for each language, repeats being dropped in each task before they are shuffled.
    learned = fit(keyed.join(F.broadcast(chosen), ["lang", "rk"]).select("lang", "rk", "text").distinct().select("lang", "text"))
    model = docs.sparkSession.sparkContext.broadcast(learned)

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        duels = model.value
        top = duels.get("*")
        for part in parts:
            for run in batches(list(zip(*(part[c].to_pylist() for c in ("doc_id", "held_out", "text")), strict=True)), lambda r: len(r[2]) + 2000, 1_000_000):
                x = features([r[2] for r in run])
                out = [("und", 0.0, None)] * len(run)
                live = np.flatnonzero(x.any(axis=1))
                if top is not None and len(live):
                    family, sure = top.decide(x[live])
                    for k in set(family.tolist()):
                        name, own = top.labels[k], live[family == k]
                        lang, score = duels[name].decide(x[own])
                        for i, j, s in zip(own.tolist(), lang.tolist(), np.minimum(score, sure[family == k]).tolist(), strict=True):
                            out[i] = (duels[name].labels[j], s, name)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in run], pa.int64()), pa.array([r[1] for r in run], pa.bool_()), *(pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.float64(), pa.string())))], names=["doc_id", "held_out", "lang_pred", "score", "family"])

    return rows.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, family string")
