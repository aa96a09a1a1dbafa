"""Hard negatives for contrastive training, by exact integer scores.

Anchors meet all candidates in a grid of tasks: a block of anchors and a block of candidates each, every vector copied once for each block
of the other side. A task walks through tiles of its blocks. The scores of a tile are one matrix product of whole numbers, by Strassen's
recursion: seven products of quarters in place of eight, odd sides filled up with zeros, only additions of 64-bit integers, so exact.

A task keeps a heap for each anchor and returns it; heaps of different tasks merge by keeping the first few of them all. Positives need
one such pass, the windows of negatives, whose limits depend on the positives, a second one. Nothing but a few rows for an anchor and a
block of candidates leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Land, landing, table, with_code

#: Every how many ids are anchors; whose labels are moved on; the number of labels; the factor of components.
ANCHOR_EVERY, MOVED_EVERY, LABELS, SCALE = 50, 7, 10, 256
#: Positives of an anchor, negatives of a window, the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Anchors and candidates of a task, and of a tile.
ANCHOR_BLOCK, CANDIDATE_BLOCK, TILE = 4096, 4096, 1024
#: The largest side at which the recursion ends.
LEAF = 32
#: Squared length of a row from which products of two rows may not fit 64 bits with the factors of the window.
MOST_SQUARES = float(1 << 56)
#: Below every score: the free places of a heap.
EMPTY = -(1 << 62)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices. Wraps like any 64-bit arithmetic, so it is exact where the result fits."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ij,jk->ik", a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of ``rows`` the first ``size`` scores met, higher first. Candidates come in ascending order of id, so of equal scores the earlier stays."""

    def __init__(self, rows: int, size: int):
        self.scores = np.full((rows, size), EMPTY)
        self.places = np.full((rows, size), -1)

    def merge(self, scores: np.ndarray, fits: np.ndarray, first: int) -> None:
        """Takes in a tile: scores by row and candidate, where they count, and the place of the first candidate."""
        fits = fits & (scores > self.scores[:, -1:])
        touched = np.flatnonzero(fits.any(axis=1))
        if not len(touched):
            return
        size = self.scores.shape[1]
        own = np.where(fits[touched], scores[touched], EMPTY)
        if own.shape[1] > size:
            least = np.partition(own, own.shape[1] - size, axis=1)[:, -size][:, None]
        else:
            least = np.full((len(touched), 1), EMPTY)
        row, col = np.nonzero((own >= least) & fits[touched])
        at = np.concatenate((np.repeat(np.arange(len(touched)), size), row))
        all_scores = np.concatenate((self.scores[touched].ravel(), own[row, col]))
        all_places = np.concatenate((self.places[touched].ravel(), first + col))
        # of equal scores what is held already stands before what is new, and that by place
        order = np.lexsort((np.arange(len(at)), -all_scores, at))
        rank = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        kept = order[rank < size]
        self.scores[touched] = all_scores[kept].reshape(len(touched), size)
        self.places[touched] = all_places[kept].reshape(len(touched), size)


def _usable(vectors: DataFrame, every: int, moved: int) -> DataFrame:
    """``row, id, label, vector, n``: distinct rows that take part, up to six copies of equal ones, ``n`` counting them. To be written before use: ``row`` is theirs then."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE))
    fits = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.pow(F.floor(v.cast("double") * SCALE).cast("double"), 2)) < MOST_SQUARES
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    rows = vectors.where("label is not null and embedding is not null").where(sound).where(fits).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole.alias("vector"))
    same = rows.groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("n"))
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(POSITIVES + 1)).cast("int")))
    named = same.withColumn("copy", copies).withColumn("row", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(F.col("id") % every == 0, F.lit(False)))
    return named.select("row", "id", "label", "vector", "n", "copy", F.size("vector").alias("d"), "anchor")


def _grid(rows: DataFrame, anchors: DataFrame, sizes: list, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Anchors and candidates, each once for every block of the other side, with ``d, a, c``: dimension and the two blocks."""
    spark = rows.sparkSession
    counts = spark.createDataFrame([(s["d"], max(1, -(-s["anchors"] // ANCHOR_BLOCK)), max(1, -(-s["rows"] // CANDIDATE_BLOCK))) for s in sizes], "d int, na int, nc int")
    counts = F.broadcast(counts)  # a row for each dimension
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(counts, "d").withColumn("a", F.pmod(F.xxhash64("row", F.lit(3)), F.col("na")).cast("int")).withColumn("c", upto("nc")).select("d", "a", "c", *keys)
    right = rows.join(counts, "d").withColumn("c", F.pmod(F.xxhash64("row", F.lit(5)), F.col("nc")).cast("int")).withColumn("a", upto("na")).select("d", "a", "c", "row", "id", "label", "vector")
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])  # own names: both sides come from one table


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column]) if d and len(column) else np.zeros((len(column), d), np.int64)


def _tiles(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Slices of anchors and candidates with their scores, candidates in their order."""
    d = int(left["d"].iloc[0])
    x, y = _matrix(left["vector"], d), np.ascontiguousarray(_matrix(right["vector"], d).T)
    for i in range(0, len(x), TILE):
        for j in range(0, y.shape[1], TILE):
            yield slice(i, i + TILE), slice(j, j + TILE), strassen(x[i : i + TILE], y[:, j : j + TILE])


def _by_id(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["id", "row"], na_position="last", kind="stable").reset_index(drop=True)


def _found(frame: pd.DataFrame, heaps: Heaps, names: list[str], right: pd.DataFrame) -> pd.DataFrame:
    at, k = np.nonzero(heaps.places >= 0)
    place = heaps.places[at, k]
    return pd.concat([frame[names].iloc[at].reset_index(drop=True), pd.DataFrame({"score": heaps.scores[at, k], "other": right["id"].to_numpy()[place], "other_row": right["row"].to_numpy()[place]})], axis=1)


def _best_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"row": [], "score": [], "other": [], "other_row": []}).astype("int64")
    right = _by_id(right)
    heaps = Heaps(len(left), POSITIVES)
    a_label, c_label, a_row, c_row = (f[c].to_numpy() for c in ("label", "row") for f in (left, right))
    for i, j, scores in _tiles(left, right):
        part = Heaps(0, POSITIVES)
        part.scores, part.places = heaps.scores[i], heaps.places[i]  # views: the heaps of these anchors
        part.merge(scores, (a_label[i, None] == c_label[None, j]) & (a_row[i, None] != c_row[None, j]), j.start)
    return _found(left, heaps, ["row"], right)


def _best_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    names = ["row", "place"]
    if not len(left) or not len(right):
        return pd.DataFrame({c: [] for c in (*names, "score", "other", "other_row")}).astype("int64")
    right = _by_id(right)
    limits = np.stack([np.asarray(list(p) + [None] * (POSITIVES - len(p)), dtype=float) for p in left["scores"]])
    exact = [list(map(int, p)) + [0] * (POSITIVES - len(p)) for p in left["scores"]]
    positive, there = np.array(exact, np.int64), ~np.isnan(limits)
    heaps = [Heaps(len(left), NEGATIVES) for _ in range(POSITIVES)]
    a_label, c_label = left["label"].to_numpy(), right["label"].to_numpy()
    for i, j, scores in _tiles(left, right):
        apart = a_label[i, None] != c_label[None, j]
        hundred = 100 * scores
        for p, h in enumerate(heaps):
            score = positive[i, p, None]
            fits = apart & (hundred >= LOW * score) & (hundred <= HIGH * score) & there[i, p, None]
            part = Heaps(0, NEGATIVES)
            part.scores, part.places = h.scores[i], h.places[i]
            part.merge(scores, fits, j.start)
    return pd.concat([_found(left.assign(place=p), h, names, right) for p, h in enumerate(heaps)], ignore_index=True)


def _merged(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first ``size`` of the heaps of all tasks, ranked; each task sends no more than as many for a key."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("other").asc_nulls_last(), "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(vectors: DataFrame, land: Land, every: int = ANCHOR_EVERY, moved: int = MOVED_EVERY) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (``vec_id, embedding, label``; others are ignored).

    Rows with a null label, a null vector or a null or non-finite component take no part. Nor do rows whose whole numbers have a sum of
    squares of 2^56 or more (components of about a million): their scores might not fit a long. Rows of different dimensions don't
    meet; empty vectors have score 0. A row with a null id is no anchor, but a candidate after all others of its score. Repeated rows are rows of
    their own: each is an anchor, and they are each other's candidates. Anchors without positives, and positives without negatives in their
    window, give no row; an empty table gives none.
    """
    with_code(vectors.sparkSession)
    rows = land(_usable(vectors, every, moved))
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).collect()  # a row for each dimension
    anchors = rows.where("anchor and copy = 1")
    left, right = _grid(rows, anchors, sizes, ["row", "label", "vector"])
    keys = ["d", "a", "c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best_positives, "row long, score long, other long, other_row long")
    positives = land(_merged(found, ["row"], POSITIVES).select("row", "rank", "score", F.col("other").alias("positive_id")))
    lists = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("held"))  # five at most
    wanting = anchors.join(lists.select("row", F.transform("held", lambda h: h["score"]).alias("scores")), "row")
    left, right = _grid(rows, wanting, sizes, ["row", "label", "vector", "scores"])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best_negatives, "row long, place int, score long, other long, other_row long")
    negatives = _merged(found, ["row", "place"], NEGATIVES).select("row", (F.col("place") + 1).alias("place"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    kept = positives.select("row", F.col("rank").alias("place"), "positive_id", F.col("score").alias("positive_score"))
    named = anchors.select("row", F.col("id").alias("anchor_id"), "n")
    out = negatives.join(kept, ["row", "place"]).join(named, "row").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors of ``embeddings`` against all rows."""
    return mine(table(spark, sf_dir, "embeddings"), landing(spark))


ORACLE_SQL = """
WITH used AS (
  SELECT row_number() OVER () AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT a.rid, a.id AS anchor_id, c.rid AS other, c.id, a.label = c.label AS alike, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM used a JOIN used c ON a.rid <> c.rid WHERE a.id % 50 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id, other) AS k FROM scored WHERE alike) WHERE k <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.id, n.other) AS rank
  FROM positives p JOIN scored n ON p.rid = n.rid AND NOT n.alike AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3"""
