"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text, A-Z lower-cased, has the set of hashed n-grams of the characters of each of its words with a mark before and after. Over all labelled training rows
the document counts of each hashed n-gram in either class give the log-count ratio ``r``. A logistic regression on the features
``r * presence`` is then fitted on a bounded sample of the training rows. What is kept is one weight per hashed n-gram and a bias, 1 MB at
most at any size of the input, and a text is scored by the sum of the weights of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Land, landing, table, with_code

#: Characters (code points) of an n-gram.
SIZES = (3, 4, 5, 6)
#: log2 of the number of hashed features.
HASH_BITS = 18
#: Added to the counts of either class.
SMOOTHING = 1.0
#: Different labelled texts of each class on which the weights are fitted; the counts behind the ratios see all rows.
FIT_ROWS = 2000
#: Features with a ratio nearer to 0 than this are left out of the fit: they tell the classes too little apart.
LEAST_RATIO = 0.75
PENALTY, STEPS = 1e-3, 300
#: From this score on a text counts as toxic.
THRESHOLD = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, repeats included. A text without words has none."""
    data = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "replace"), "<u4")
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    blank = _SPACE[np.minimum(data, 255)]
    gap = np.concatenate(([0], np.cumsum(blank)))
    mixed = np.where(blank, np.uint64(1), data.astype(np.uint64) + np.uint64(2))
    out = []
    for n in SIZES:
        if len(data) < n + 1:
            continue
        count = len(data) - n + 1
        h = np.full(count, np.uint64(n))
        for k in range(n):
            h = (h ^ mixed[k : k + count]) * _FACTORS[k]
            h ^= h >> np.uint64(29)
        # white space only as the first or the last character of an n-gram
        inner = gap[n - 1 : n - 1 + count] - gap[1 : 1 + count] if n > 2 else np.zeros(count, np.int64)
        out.append((h[inner == 0] >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Weights by hashed n-gram and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pd.Series) -> pd.Series:
        present, out = np.zeros(1 << HASH_BITS, np.float32), []
        for text in texts:
            f = features(text)
            present[f] = 1
            out.append(float(self.weights @ present) + self.bias)
            present[f] = 0
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -40, 40))), dtype="float64")


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of class 0 and 1 with each hashed n-gram, and documents of either class, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen = np.zeros((2, 1 << HASH_BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                held[int(toxic), np.unique(features(text))] += 1
                seen[int(toxic)] += 1
        for y in (0, 1):
            at = np.flatnonzero(held[y])
            yield pd.DataFrame({"toxic": y, "feature": np.append(at, -1), "n": np.append(held[y][at], seen[y])})

    # a row for each feature and class, 2^19 + 2 at most
    found = rows.select("text", "toxic").mapInPandas(count, "toxic int, feature int, n long").groupBy("toxic", "feature").agg(F.sum("n").alias("n")).toPandas()
    total, docs = np.zeros((2, 1 << HASH_BITS)), np.zeros(2)
    for y in (0, 1):
        own = found[found["toxic"] == y]
        total[y, own["feature"][own["feature"] >= 0]] = own["n"][own["feature"] >= 0]
        docs[y] = own["n"][own["feature"] < 0].sum()
    return total, docs


def _sampled(rows: DataFrame, toxic: int) -> pd.DataFrame:
    """At most ``FIT_ROWS`` different texts of a class, drawn by a hash of the text: copies of a text take one place."""
    own = rows.where(F.col("toxic") == toxic).select("text", F.xxhash64("text").alias("draw"))
    last = own.select("draw").distinct().orderBy("draw").limit(FIT_ROWS).agg(F.max("draw").alias("draw")).first()["draw"]
    return own.where(F.col("draw") <= last).distinct().orderBy("draw", "text").limit(FIT_ROWS).select("text").toPandas()


def _fit(ratio: np.ndarray, texts: list[str | None], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on ``ratio`` of the present features by gradient descent with momentum."""
    kept = np.abs(ratio) >= LEAST_RATIO
    place = np.cumsum(kept) - 1
    cols = [place[u[kept[u]]] for u in (np.unique(features(t)) for t in texts)]
    sizes = np.array([len(c) for c in cols])
    row, col = np.repeat(np.arange(len(cols), dtype=np.int32), sizes), np.concatenate(cols).astype(np.int32) if cols else np.zeros(0, np.int32)
    scale = ratio[kept].astype(np.float32)
    value = scale[col] / np.float32(np.sqrt(max(1.0, float(np.median(sizes) if len(sizes) else 1.0))))
    balance = np.where(y == 1, 0.5 / max(1, int(y.sum())), 0.5 / max(1, int((1 - y).sum())))
    w, b, vw, vb = np.zeros(int(kept.sum())), 0.0, 0.0, 0.0
    for _ in range(STEPS):
        z = np.bincount(row, value * w[col], minlength=len(cols)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        vw = 0.9 * vw - 0.5 * (np.bincount(col, value * g[row], minlength=len(w)) + PENALTY * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    out = np.zeros(1 << HASH_BITS, np.float32)
    out[kept] = w * scale / np.sqrt(max(1.0, float(np.median(sizes) if len(sizes) else 1.0)))
    return out, float(b)


def train(rows: DataFrame) -> Model:
    """The model from rows ``text, toxic`` (0 or 1; other values and nulls are ignored).

    Without a row of one of the classes every text scores near the share of class 1 (0.5 without any row).
    """
    with_code(rows.sparkSession)
    rows = rows.where("toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"))
    held, docs = _counts(rows)
    if docs.min() == 0:
        share = (docs[1] + 0.5) / (docs.sum() + 1)
        return Model(np.zeros(1 << HASH_BITS, np.float32), float(np.log(share / (1 - share))))
    rates = (held + SMOOTHING) / (docs + 2 * SMOOTHING)[:, None]
    ratio = np.log(rates[1] / rates[0]).astype(np.float32)
    parts = [_sampled(rows, y) for y in (0, 1)]
    y = np.repeat([0, 1], [len(p) for p in parts])
    weights, bias = _fit(ratio, [t for p in parts for t in p["text"]], y)
    return Model(weights, bias)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to rows with a ``text``; columns of these names are replaced.

    Null and empty texts have no n-grams and score by the bias alone. The weights travel as a broadcast of fixed size.
    """
    held = with_code(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return held.value.score(texts)

    own = docs.drop("score", "predicted").withColumn("score", score("text"))
    return own.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, land: Land) -> DataFrame:
    """``text, toxic`` of the documents that have a label and are not held out, written once; an id with several labels counts by its largest.

    Labels grow with the documents, so they are never broadcast: both sides meet by a shuffle at every size.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).hint("merge")
    return land.compressed(docs.select("doc_id", "text").where(fold(F.col("doc_id"), 3) != 1).join(known, "doc_id").select("text", "toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled(docs, table(spark, sf_dir, "labels"), landing(spark)))
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
