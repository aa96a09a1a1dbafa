"""Packing documents into sequences along a space-filling curve.

A document's ids, hashed, give a bag whose mean under a fixed random projection is a point of few dimensions. Points, scaled by the mean and
the spread of all documents, are put in the order of their Hilbert key, so that neighbours on the curve are alike. The ids of all documents in that order are
one stream, cut every ``LENGTH`` ids; what is left at its end is cut into powers of two. So nothing is padded, and neighbours share sequences.

Documents are dealt by ranges of the key, with ties of equal points broken by a hash of the row, so that many copies of one document
spread over ranges too. The place of a document is the sum of the ranges before its own and the running sum within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Land, count_below, landing, quantile_bounds, slots, table, with_code
from .hashing import mixed
from .tokens import Encoder, encoder, in_slices

#: Ids of a sequence, and the id that ends a document.
LENGTH, END = 2048, 1
#: Dimensions of a point, bits of each in the key, bits that break ties.
DIMS, BITS, TIE_BITS = 4, 10, 22
#: Words that a worker of the query holds: about 200 MB more than by default, which the pipeline doesn't have to spare.
HELD = 1_200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def signs(size: int) -> np.ndarray:
    """Fixed random signs of each id, one for each dimension: one bit in every 16 of a number."""
    h = mixed(np.arange(size, dtype=np.uint64) + np.uint64(0x5EED))
    return sum(((h >> np.uint64(d)) & np.uint64(1)) << np.uint64(16 * d) for d in range(DIMS))


def projection(ids: np.ndarray, size: int) -> np.ndarray:
    """The mean of the ids' signs."""
    own, most = signs(size)[ids], (1 << 16) - 1
    sums = [int(own[a : a + most].sum()) for a in range(0, len(own), most)]
    plus = np.array([sum(s >> 16 * d & most for s in sums) for d in range(DIMS)], np.float64)
    return (2 * plus - len(ids)) / len(ids)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below ``2 ** bits``, one a row."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level, coarse to fine
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, path: str, spaced: bool, end: int, held: int = Encoder.MOST_PARTS) -> DataFrame:
    """``doc_id, ids, n, tie, v0..`` of every row; ids as unsigned numbers of 16 bits, or of 32 where the vocabulary needs them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, spaced, held)
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in in_slices(texts):
                ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end)) for x in enc.encode(texts[a:b])]
                v = np.stack([projection(x, max(enc.size, end + 1)) for x in ids])
                out = {"doc_id": batch["doc_id"].iloc[a:b].astype("Int64"), "ids": [x.astype(kind).tobytes() for x in ids], "n": [len(x) for x in ids], "tie": batch["tie"].iloc[a:b]}
                yield pd.DataFrame(out | {f"v{d}": v[:, d] for d in range(DIMS)})

    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - TIE_BITS).alias("tie")
    kinds = "doc_id long, ids binary, n long, tie long, " + ", ".join(f"v{d} double" for d in range(DIMS))
    return docs.select("doc_id", "text", tie).mapInPandas(run, kinds)


def _keyed(points: DataFrame) -> DataFrame:
    """Adds ``key``: the Hilbert key of the scaled point and the tie bits."""
    names = [f"v{d}" for d in range(DIMS)]
    stats = points.agg(*[F.avg(v).alias(f"m{v}") for v in names], *[F.stddev_pop(v).alias(f"s{v}") for v in names]).first()
    mean = np.array([stats[f"m{v}"] or 0.0 for v in names])
    spread = np.array([stats[f"s{v}"] or 1.0 for v in names])

    @F.pandas_udf("long")
    def key(tie: pd.Series, *v: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy() for c in v], axis=1) - mean) / spread
        cells = np.clip((0.5 + 0.5 * np.tanh(0.8 * z)) * (1 << BITS), 0, (1 << BITS) - 1)
        return pd.Series((hilbert(cells) << TIE_BITS) | tie.to_numpy())

    return points.withColumn("key", key("tie", *names))


def pieces(docs: DataFrame, land: Land, path: str | None = None, spaced: bool = False, end: int = END, length: int = LENGTH, held: int = Encoder.MOST_PARTS) -> DataFrame:
    """The pieces of the documents (``doc_id, text``; other columns are ignored) in sequences of at most ``length`` ids.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids``, the piece's ids as little-endian unsigned 32-bit numbers. Each row of ``docs`` is a document of
    its own; null and empty texts are their end alone. Sequences are full but for the last ones, whose lengths are falling powers of two.
    A worker holds the ids of ``held`` words at most.
    """
    with_code(docs.sparkSession)
    wide = land.compressed(tokenized(docs, path or default_tokenizer(), spaced, end, held))
    keys = _keyed(wide.select("tie", "n", *[f"v{d}" for d in range(DIMS)]))
    bounds = quantile_bounds(keys, "key", 2 * max(1, slots(docs.sparkSession)))
    placed = _keyed(wide).select("doc_id", "ids", "n", "key").withColumn("range", count_below(bounds, F.col("key")))
    sums = land(keys.withColumn("range", count_below(bounds, F.col("key"))).groupBy("range").agg(F.sum("n").alias("ids_in")))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select("range", F.coalesce(F.sum("ids_in").over(ahead), F.lit(0)).alias("before"))
    total = sums.agg(F.coalesce(F.sum("ids_in"), F.lit(0)).alias("n")).first()["n"]
    within = Window.partitionBy("range").orderBy("key", "doc_id", "n", F.crc32("ids")).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("run", F.coalesce(F.sum("n").over(within), F.lit(0)))
    spots = run.join(offsets, "range").select("doc_id", "ids", "n", (F.col("before") + F.col("run")).alias("at"))
    left = total % length
    cuts = np.cumsum([0] + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]) + total - left  # edges of the last sequences

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, data, n, at in zip(batch["doc_id"], batch["ids"], batch["n"], batch["at"]):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    pos = at + start
                    if pos < cuts[0]:
                        sequence, begin = pos // length, pos // length * length
                        size = min(n - start, begin + length - pos)
                    else:
                        k = int(np.searchsorted(cuts, pos, side="right")) - 1
                        sequence, begin = cuts[0] // length + k, cuts[k]
                        size = min(n - start, cuts[k + 1] - pos)
                    piece = ids[start : start + size].tobytes()
                    rows.append((doc, start, size, zlib.crc32(piece), n, sequence, pos - begin, piece))
                    start += size
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            yield out.astype({"doc_id": "Int64"})

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return spots.mapInPandas(cut, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents``, without the ids themselves."""
    return pieces(table(spark, sf_dir, "documents"), landing(spark), held=HELD).drop("ids")
