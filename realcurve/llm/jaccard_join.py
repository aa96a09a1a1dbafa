"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Equal shingle sets are one class from the begin. Sets of about the same size share a band. In a band, linked sets differ in at most ``k``
shingles; shingles are dealt by hash into ``k + g`` parts, so two linked sets agree wholly in ``g`` parts. The sets that agree in a
part (a key of band, part and content) are candidates. As linked sets share ``g`` keys, each set leaves out its ``g - 1`` most frequent
ones, in one order of all keys, and linked sets still share one: a shingle that is common everywhere joins no large group. The pivot of a key is the one of its sets with the most shared keys. A set is first compared with
its pivots, which joins most copies of one original without a comparison for each pair. Where members of a key remain in several components, the key is cut into tiles
of two blocks of bounded size, none of two blocks of its largest component; in a tile the counts of differing bits of two bitmaps bound the overlap from above, and pairs that
pass are compared by exact intersection of the sorted sets. The result is exact: no link is missed, none is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Land, components, landing, table, with_code
from .hashing import lowered, mixed, shingle_hashes

#: Words of a shingle, and the least intersection as a share of the union, in hundredths.
SHINGLE, LIKE = 4, 85
#: Ratio of neighbouring band edges, above 100 / LIKE, so that linked sets lie in one band or in neighbouring ones.
BAND_RATIO = 1.5
#: Sets of a block of a tile.
BLOCK = 256


def _edges(limit: int) -> list[int]:
    """Least sizes of the bands up to ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def _allowed(top: int, like: int) -> int:
    """The largest difference of two linked sets of which the smaller has at most ``top`` members."""
    return (top + top * 100 // like) * (100 - like) // (100 + like)


def signature_keys(h: np.ndarray, like: int = LIKE) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set and, for each, ``2 * spare + (0 or 1)``, the last to tell its two bands apart.

    With every other set it links to, it shares more than ``spare`` keys of one band, ``spare`` the lesser of both sets at least.
    """
    size = len(h)
    edges = _edges(size)
    band = len(edges) - 2
    bands = [band]
    if band and edges[band] - 1 >= -(-like * size // 100):
        bands.append(band - 1)
    keys, spares = [], []
    for b in bands:
        k = _allowed(edges[b + 1] - 1, like)
        if not k:
            continue  # only equal sets link
        parts = k + 2 + k // 8
        part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        held = part[order][first]
        content = np.add.reduceat(mixed(h ^ np.uint64(0x51)), [0]) if len(first) == 1 else np.add.reduceat(mixed(h[order] ^ np.uint64(0x51)), first)
        keys.append(mixed(content + mixed(held.astype(np.uint64) * np.uint64(64) + np.uint64(b))))
        count = len(held)
        if parts - len(held) >= parts - k:  # two sets might agree in empty parts only
            empty = np.setdiff1d(np.arange(parts), held).astype(np.uint64)
            keys.append(mixed(mixed(empty * np.uint64(64) + np.uint64(b)) ^ np.uint64(0xE)))
            count = parts
        # empty parts that agree give no key unless both sets have many, so as many are not spared
        spare = max(0, parts - k - 1 - (parts - len(held)))
        spares.append(np.full(count, 2 * spare + (b != band), np.int32))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(keys).view(np.int64), np.concatenate(spares)


def class_of(h: np.ndarray) -> int:
    """A number for the whole set."""
    return int(mixed(np.uint64([np.add.reduce(mixed(h ^ np.uint64(0xC1))) ^ mixed(np.uint64([len(h)]))[0]])).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, like: int = LIKE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= like * (len(a) + len(b) - both)


def bitmap(h: np.ndarray) -> bytes:
    """One bit for each hash, in a map of eight to sixteen bits a member."""
    width = 1 << max(7, (8 * len(h)).bit_length())
    bits = np.zeros(width, bool)
    bits[(h % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of the narrowest width; a wide map folds onto itself."""
    width = min(map(len, maps))
    rows = [np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0) for m in maps]
    return np.stack(rows).view(np.uint64)


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, cls`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(lowered(t), shingle) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(h) for h in sets], "cls": [class_of(h) if len(h) else 0 for h in sets]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, cls long")


def _keyed(docs: DataFrame, shingle: int, like: int) -> DataFrame:
    """``key, spare, cls`` of every set; copies within a partition give their keys once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            keys, spares, owners = [], [], []
            for text in batch["text"]:
                h = shingle_hashes(lowered(text), shingle)
                if len(h) and (c := class_of(h)) not in seen:
                    seen.add(c)
                    key, spare = signature_keys(h, like)
                    keys.append(key)
                    spares.append(spare)
                    owners.append(np.full(len(key), c))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "spare": np.concatenate(spares), "cls": np.concatenate(owners)})

    return docs.where("doc_id is not null").select("text").mapInPandas(run, "key long, spare int, cls long")


def _texts(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """``cls, text`` of the classes in ``reps`` (``doc_id, cls``). A text is a third of its hashes on disk, so hashes are made where they meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = []
            for text, c in zip(batch["text"], batch["cls"]):
                h = shingle_hashes(lowered(text), shingle)
                own.append(len(h) > 0 and class_of(h) == c)  # else another text of a repeated id
            yield batch.loc[own, ["cls", "text"]]

    met = docs.select("doc_id", "text").join(reps, "doc_id").where("rows > 1").select("cls", "text").dropDuplicates()
    several = met.mapInPandas(run, "cls long, text string").dropDuplicates(["cls"])
    return docs.select("doc_id", "text").join(reps.where("rows = 1"), "doc_id").select("cls", "text").union(several)


def _sets(texts: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``cls, hashes, bits`` of the texts whose class is in ``classes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(lowered(t), shingle) for t in batch["text"]]
            yield pd.DataFrame({"cls": batch["cls"], "hashes": [h.tobytes() for h in sets], "bits": [bitmap(h) for h in sets]})

    return texts.join(classes, "cls", "left_semi").select("cls", "text").mapInPandas(run, "cls long, hashes binary, bits binary")


def _verified(pairs: DataFrame, sets: DataFrame, shingle: int, like: int) -> DataFrame:
    """The ``src, dst`` pairs that link, from a written table; ``sets`` has ``cls`` and either ``hashes`` or ``text``. The partners of a ``dst`` are cut into parts, and parts share tasks by hash."""
    form = "hashes" if "hashes" in sets.columns else "text"
    spread = pairs.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    tasks = -(-pairs.count() // BLOCK) or 1
    task = F.pmod(F.xxhash64("dst", "part"), F.lit(tasks)).alias("task")
    dealt = pairs.join(spread, "dst").withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts"))).select("src", "dst", task)
    asked = dealt.join(sets.select(F.col("cls").alias("src"), form), "src").select("task", "src", "dst", form)
    parts = spread.select("dst", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("dst", task).distinct()
    pivots = parts.join(sets.select(F.col("cls").alias("dst"), form), "dst").select("task", F.col("dst").alias("src"), "dst", form)

    def hashes(held: bytes | str) -> np.ndarray:
        return np.frombuffer(held, np.uint64) if form == "hashes" else shingle_hashes(lowered(held), shingle)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = (rows["src"] == rows["dst"]).to_numpy()
        pivot = {d: hashes(h) for d, h in zip(rows["dst"][own], rows[form][own])}
        asked = rows[~own]
        return asked.loc[[linked(hashes(x), pivot[d], like) for x, d in zip(asked[form], asked["dst"])], ["src", "dst"]]

    return asked.union(pivots).groupBy("task").applyInPandas(run, "src long, dst long")


def _tiled(members: DataFrame, sets: DataFrame, like: int, land: Land) -> DataFrame:
    """Pairs ``src, dst`` of one key and two components whose bitmaps let them link; ``members`` has ``key, cls, component``."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    groups = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "component")).alias("home"))
    kept = groups.groupBy("n", "x", "y").agg(F.min(F.struct("key", "home")).alias("k")).select(  # equal groups once
        "k.key", F.col("k.home.component").alias("home"), F.ceil(F.col("k.home.n") / BLOCK).alias("inner"), F.ceil((F.col("n") - F.col("k.home.n")) / BLOCK).alias("outer"))
    kept = land(kept)
    # the largest component of a key is never compared with itself: its sets meet the blocks of the others only
    placed = members.join(kept, "key").withColumn("at_home", F.col("component") == F.col("home"))
    own = F.when(F.col("at_home"), F.pmod(F.xxhash64("cls"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("cls"), F.col("outer")))
    first = F.when(F.col("at_home"), F.col("inner")).otherwise(F.lit(0).cast("long"))
    tiles = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(first, F.col("inner") + F.col("outer") - 1)))
    tiles = land(tiles.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cls", "component"))
    tasks = -(-tiles.count() // (4 * BLOCK)) or 1
    tiles = tiles.join(sets.select("cls", "bits", (F.length("hashes") / 8).cast("long").alias("size")), "cls")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "low", "high"], kind="stable")
        tile = rows[["key", "low", "high"]].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]).any(axis=1), [True])))
        columns = [rows[c].to_numpy() for c in ("cls", "component", "own", "size")]
        bits, out = rows["bits"].tolist(), []
        for a, b in zip(edges[:-1], edges[1:]):
            one_block, top = tile[a, 1] == tile[a, 2], tile[a, 2]
            maps = _folded(bits[a:b])
            cls, component, own, size = (c[a:b] for c in columns)
            for i in range(b - a):
                if not one_block and own[i] == top:
                    continue
                j = np.flatnonzero((cls > cls[i] if one_block else own == top) & (component != component[i]))
                both = size[j] + size[i]
                overlap = (both - np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)) // 2
                j = j[100 * overlap >= like * (both - overlap)]
                if len(j):
                    out.append((np.maximum(cls[j], cls[i]), np.minimum(cls[j], cls[i])))
        return pd.DataFrame({"src": np.concatenate([x for x, _ in out]), "dst": np.concatenate([y for _, y in out])}) if out else pd.DataFrame({"src": [], "dst": []}, dtype="int64")

    return tiles.withColumn("task", F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks))).groupBy("task").applyInPandas(run, "src long, dst long").distinct()


def join(docs: DataFrame, land: Land, shingle: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``; other columns are ignored).

    Null and empty texts and texts without words have no shingles and link with nothing. Rows that share an id are one document, whose
    rows are linked. A row with a null id links with nothing and has a null component.
    """
    with_code(docs.sparkSession)
    described = land(_described(docs, shingle))
    real = described.where("doc_id is not null and n_shingles > 0")
    by_key = Window.partitionBy("key")
    shared = _keyed(docs, shingle, like).withColumn("low", F.min("cls").over(by_key)).withColumn("top", F.max("cls").over(by_key))
    shared = shared.where("low < top").withColumn("n", F.count(F.lit(1)).over(by_key)).select("key", "spare", "cls", "n").distinct()
    # every set leaves out as many of its most frequent keys of a band as it can spare
    frequent = Window.partitionBy("cls", "spare").orderBy(F.desc("n"), F.desc("key"))
    shared = shared.withColumn("place", F.row_number().over(frequent)).where(F.col("place") > F.shiftright("spare", 1)).select("key", "cls")
    shared = shared.withColumn("low", F.min("cls").over(by_key)).withColumn("top", F.max("cls").over(by_key))
    shared = land(shared.where("low < top").select("key", "cls"))
    # the pivot of a key is its set with the most shared keys: copies share more with their original than with each other
    ranked = shared.join(shared.groupBy("cls").agg(F.count(F.lit(1)).alias("keys")), "cls")
    shared = land(ranked.withColumn("pivot", F.max(F.struct("keys", "cls")).over(by_key)["cls"]).select("key", "cls", "pivot"))
    many = described.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    reps = real.join(shared.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(many, "doc_id")
    reps = land(reps)
    texts = land.compressed(_texts(docs, reps, shingle))
    asked = shared.where("cls <> pivot").groupBy(F.col("cls").alias("src"), F.col("pivot").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    asked = land(asked.groupBy("src").agg(F.max(F.struct("n", "dst"))["dst"].alias("dst")))  # the pivot that a set shares most with
    links = land(_verified(asked, texts, shingle, like))
    parted = land(_parted(shared, links, land))
    # then the other pivots of keys that are still in parts
    other = parted.where("cls <> pivot and component <> pivot_component").select(F.col("cls").alias("src"), F.col("pivot").alias("dst")).distinct()
    other = land(other.join(asked, ["src", "dst"], "left_anti"))
    sets = land(_sets(texts, parted.select("cls").distinct(), shingle))
    links = land(links.union(_verified(other, sets, shingle, like)))
    rest = land(_tiled(land(_parted(shared, links, land).select("key", "cls", "component")), sets, like, land))
    links = links.union(_verified(rest, sets, shingle, like)).union(_one_id(real))
    found = components(land(links), land)
    named = described.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls"))
    least = named.where("doc_id is not null and n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = named.where("doc_id is not null and n_shingles > 0").join(least, "label").select("doc_id", "n_shingles", "component_id")
    return out.union(described.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _parted(shared: DataFrame, links: DataFrame, land: Land) -> DataFrame:
    """The rows of keys whose sets are in several components of ``links``, with components."""
    by_key = Window.partitionBy("key")
    found = components(links, land).withColumnRenamed("node", "cls")
    named = shared.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = named.withColumn("least", F.min("component").over(by_key)).withColumn("most", F.max("component").over(by_key))
    named = named.withColumn("pivot_component", F.max(F.when(F.col("cls") == F.col("pivot"), F.col("component"))).over(by_key))
    return named.where("least < most").select("key", "cls", "pivot", "component", "pivot_component")


def _one_id(real: DataFrame) -> DataFrame:
    """Links between the classes of an id that has several."""
    pairs = real.select("doc_id", "cls").distinct()
    least = pairs.groupBy("doc_id").agg(F.min("cls").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.join(least, "doc_id").where("cls <> dst").select(F.col("cls").alias("src"), "dst")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its component of linked documents."""
    return join(table(spark, sf_dir, "documents"), landing(spark))


#: Every pair with a common shingle, on whole tables.
ORACLE_SQL = r"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM cut),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON l.x = r.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = s.doc_id
"""
