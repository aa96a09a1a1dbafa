"""Embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has its own codebook, fitted on a bounded sample; the pairs of codes are the cells of a product grid, and a
vector lies in the cell of its nearest codes. From a vector, the multi-sequence order visits cells by growing sum of the two squared
distances. How far a visit goes is set by the target recall: neighbours at exactly the least cosine are drawn around sampled vectors, and
the visit ends where the wanted share of them has been met. Vectors met in a cell are verified by their cosine in double precision.

Equal vectors are one class, compared once and counted by their number. A cell with many vectors is cut into blocks, each a task of its
own. A task counts links and gives a spanning forest of them, so a group of ``n`` neighbours gives ``n`` rows and not ``n * n``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Land, components, landing, table, with_code

LEAST_COSINE = 0.98
#: Vectors of the sample on which codebooks and the length of a visit are fitted.
FIT_ROWS = 8192
#: Share of neighbours at the least cosine that a visit from one side has to meet; a link is found from either side.
TARGET_RECALL = 0.97
#: Vectors wished for in a cell and label, the largest codebook, and the rounds of its fit.
CELL_ROWS, MOST_CODES, ROUNDS = 32, 256, 12
#: Vectors of a block of a cell.
BLOCK = 512


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and the largest score up to which a visit goes, relative to the vector's best cell."""

    left: np.ndarray
    right: np.ndarray
    reach: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return _squared(x[:, :cut], self.left), _squared(x[:, cut:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector the cells of its visit, nearest first."""
        for a, b in zip(*self.distances(x)):
            yield np.array([i * len(self.right) + j for i, j in multi_sequence(a, b, a.min() + b.min() + self.reach)])

    def met(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether the visit of each vector holds the cell beside it."""
        a, b = self.distances(x)
        n = np.arange(len(x))
        return a[n, cells // len(self.right)] + b[n, cells % len(self.right)] <= a.min(axis=1) + b.min(axis=1) + self.reach


def multi_sequence(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of codes by growing ``a[i] + b[j]`` up to ``most``: rows and columns in sorted order, a heap of the next pairs."""
    import heapq

    ra, rb = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, out, pushed = [(a[ra[0]] + b[rb[0]], 0, 0)], [], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        out.append((int(ra[i]), int(rb[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(ra) and q < len(rb) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (a[ra[p]] + b[rb[q]], p, q))
    return out


def _squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    # summed term by term, so that a vector has the same distances alone and in a batch
    return np.stack([((x - c) ** 2).sum(axis=1) for c in codes], axis=1) if len(x) else np.zeros((0, len(codes)))


def _codes(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)]
    if not x.shape[1]:  # the right half of vectors of one number
        return codes
    for _ in range(ROUNDS):
        near = _squared(x, codes).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        codes = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], codes)
    return codes


def fit(sample: np.ndarray, per_label: float, least: float = LEAST_COSINE, recall: float = TARGET_RECALL) -> Index:
    """The index of unit vectors like those of ``sample``, of which a label has about ``per_label``."""
    rng = np.random.default_rng(17)
    d = sample.shape[1]
    cut = (d + 1) // 2
    k = int(np.clip(round(np.sqrt(per_label / CELL_ROWS)), 1, min(MOST_CODES, len(sample))))
    if d < 2:
        k = 1
    index = Index(_codes(sample[:, :cut], k, rng), _codes(sample[:, cut:], k, rng), 0.0)
    side = rng.standard_normal(sample.shape)
    side -= (side * sample).sum(axis=1, keepdims=True) * sample
    length = np.linalg.norm(side, axis=1, keepdims=True)
    close = least * sample + np.sqrt(1 - least**2) * side / np.where(length > 0, length, 1)
    cells = index.cells(close)
    a, b = index.distances(sample)
    n = np.arange(len(sample))
    beyond = a[n, cells // k] + b[n, cells % k] - a.min(axis=1) - b.min(axis=1)
    return Index(index.left, index.right, float(np.quantile(beyond, recall)))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that join what earlier ones left apart."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = parent.get(parent[v], parent[v])
            v = parent[v]
        return v

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _classes(vectors: DataFrame) -> DataFrame:
    """``node, label, vector, n``: distinct vectors of a label, named by their least id. ``n`` rows have it."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.where("label is not null and vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda v: v != 0))
    numbers = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    return usable.select("vec_id", "label", numbers.alias("vector")).groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def dedup(vectors: DataFrame, land: Land, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding, label``; other columns are ignored).

    Two rows link when their labels are equal and not null and their cosine is ``least`` or more; rows with equal vectors link. Null and empty
    vectors, vectors of zeros only and vectors with null or non-finite components link with nothing, and vectors of different dimensions
    don't link. Rows that share an id count as one node. A row with a null id links with nothing and has a null component.
    """
    with_code(vectors.sparkSession)
    classes = land(_classes(vectors))
    shapes = classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("label").alias("labels")).collect()
    counted, forest = [], []
    for shape in sorted(shapes, key=lambda r: r["d"]):  # one for all vectors of a dimension; tables have one or two
        own = classes.where(F.size("vector") == shape["d"])
        sample = own.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(FIT_ROWS).select("vector").toPandas()
        index = fit(_unit(sample["vector"]), shape["rows"] / max(1, shape["labels"]), least)
        found = land(_found(own, index, least))
        counted.append(found.where("links is not null").select("node", "links"))
        forest.append(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    return _named(vectors, classes, counted, forest, land)


def _named(vectors: DataFrame, classes: DataFrame, counted: list[DataFrame], forest: list[DataFrame], land: Land) -> DataFrame:
    spark = vectors.sparkSession
    every = lambda parts, kind: parts[0] if len(parts) == 1 else spark.createDataFrame([], kind) if not parts else parts[0].union(every(parts[1:], kind))
    links = every(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(every(forest, "src long, dst long"), land)
    full = classes.join(links, "node", "left").join(joined, "node", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    ids = vectors.select("vec_id", F.col("label").alias("label_"), F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("vector_"))
    out = ids.join(full, (F.col("label_") == F.col("label")) & (F.col("vector_") == F.col("vector")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _found(own: DataFrame, index: Index, least: float) -> DataFrame:
    """``node, links, other``: numbers of linked rows by class, and links of a forest. A pair met from both sides counts from the lesser."""
    held = own.sparkSession.sparkContext.broadcast(index)  # two codebooks of at most MOST_CODES halves

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch["vector"])
            home = held.value.cells(x)
            visits = [v[v != h] for v, h in zip(held.value.visits(x), home)]
            who = np.repeat(np.arange(len(batch)), [len(v) for v in visits])
            guests = batch.iloc[who].assign(cell=np.concatenate(visits) if len(who) else np.zeros(0, np.int64), home=home[who])
            yield pd.concat([batch.assign(cell=home, home=home), guests])[["label", "cell", "home", "node", "n", "vector"]]

    kind = f"label {own.schema['label'].dataType.simpleString()}, cell long, home long, node long, n long, vector array<double>"
    dealt = own.select("label", "node", "n", "vector").mapInPandas(probe, kind)
    seen = own.select("label", "vector").mapInPandas(_seen(held), f"label {own.schema['label'].dataType.simpleString()}, cell long, home long")
    counts = seen.groupBy("label", "cell").agg(F.count_if(F.col("cell") == F.col("home")).alias("members"), F.count(F.lit(1)).alias("all"))
    sizes = counts.where("members > 0").select("label", "cell", F.ceil(F.col("members") / BLOCK).alias("blocks"), F.ceil(F.col("all") / (4 * BLOCK)).alias("shares"))
    # a vector meets every block of a cell that it visits; at home it is a member of one block
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = dealt.join(sizes, ["label", "cell"]).withColumn("block", upto("blocks"))
    placed = placed.withColumn("member", (F.col("cell") == F.col("home")) & (F.pmod(F.xxhash64("node"), F.col("blocks")) == F.col("block")))
    # members go to every share of their block, guests to one
    members = placed.where("member").withColumn("share", upto("shares"))
    tasks = members.unionByName(placed.where("not member").withColumn("share", F.pmod(F.xxhash64("node", F.lit(3)), F.col("shares"))))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        index, x = held.value, _unit(rows["vector"])
        member = rows["member"].to_numpy()
        node, n, home, cell = (rows[c].to_numpy() for c in ("node", "n", "home", "cell"))
        inside, outside = np.flatnonzero(member), np.flatnonzero(~member)
        left, right = [], []
        first = int(rows["share"].iloc[0]) == 0  # pairs of members are compared in one share only
        for part in (inside if first else inside[:0], outside):
            for at in range(0, len(part), 1024):
                i, j = np.nonzero(x[part[at : at + 1024]] @ x[inside].T >= least - 1e-9)
                left.append(part[at : at + 1024][i])
                right.append(inside[j])
        a, b = np.concatenate(left or [inside[:0]]).astype(np.int64), np.concatenate(right or [inside[:0]]).astype(np.int64)
        near = np.ones(len(a), bool)
        for i in np.flatnonzero(np.abs((x[a] * x[b]).sum(axis=1) - least) < 1e-9):
            near[i] = _cosine(rows["vector"].iloc[a[i]], rows["vector"].iloc[b[i]]) >= least
        a, b = a[near], b[near]
        back, away = np.zeros(len(a), bool), home[a] != cell[a]
        if away.any():
            back[away] = index.met(x[b[away]], home[a[away]])
        # where both sides meet a pair, it counts where the lesser node comes to the other
        keep = (away & ~back) | (node[a] < node[b])
        a, b = a[keep], b[keep]
        counts = pd.DataFrame({"node": np.concatenate((node[a], node[b])), "links": np.concatenate((n[b], n[a]))}).groupby("node", as_index=False)["links"].sum()
        tree = _forest(node[a], node[b])
        trees = pd.DataFrame({"node": node[a][tree], "other": node[b][tree]})
        return pd.concat([counts, trees]).reindex(columns=["node", "links", "other"]).astype("Int64")

    return tasks.groupBy("label", "cell", "block", "share").applyInPandas(verify, "node long, links long, other long")


def _seen(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch["vector"])
            visits = list(held.value.visits(x))
            who = np.repeat(np.arange(len(batch)), [len(v) for v in visits])
            yield pd.DataFrame({"label": batch["label"].to_numpy()[who], "cell": np.concatenate(visits), "home": held.value.cells(x)[who]})

    return run


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` with its links and its component."""
    return dedup(table(spark, sf_dir, "embeddings"), landing(spark))
