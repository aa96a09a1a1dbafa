"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of a source, shuffled by a seeded hash, form one stream of words, repeated for a second pass; the stream is cut into blocks
of equal size. Slot ``i`` of the mix belongs to the source in whose share of the unit interval the ``i``-th golden-ratio point falls, and
the ``r``-th slot of a source takes its ``r``-th block. Every prefix of the mix is so close to the target weights. Points are whole
numbers (steps of a fixed stride on a ring of 2^31), so reruns agree. Running sums and ranks over a source are two-level (within buckets
of about the square root of all rows, then over buckets), so that a source with most of the rows never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Land, landing, table, words

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: How often a document may be taken.
MAX_PASSES = 2
#: Words of a block.
BLOCK = 512
#: The ring on which golden-ratio steps are taken, and the odd step nearest to ring / golden ratio.
RING, STEP = 1 << 31, 1327217885
#: Cells of the unit interval by which points meet the sources' shares.
CELLS = 1024
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """``source, k, source_size, target`` of ``source, source_size``: shares by weight, filled up to ``passes`` times the size.

    Sources by code point, null last, have the weights in turn. With sources sorted by cap / weight, the first ones are full and the rest
    share what is left by weight; one pass finds the level at which that holds. The windows here see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("k") - 1) % len(weights))
    ranked = sizes.withColumn("k", F.row_number().over(by_name)).withColumn("w", weight).withColumn("cap", passes * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("k").asc())
    everything = Window.partitionBy()
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward)
    reached = ranked.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    final = reached.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full") | F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("w"))
    return final.select("source", "k", "source_size", target.alias("target"))


def document_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """By which the documents of a source are put in order: equal for equal ids and texts."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def _shuffled(sized: DataFrame, buckets: int) -> DataFrame:
    """Adds ``start``: words of the same source before the document, in the order of ``key``."""
    cut = sized.withColumn("bucket", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32), F.lit(buckets)).cast("long"))
    sums = cut.groupBy("k", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("k", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("k", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = cut.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return run.join(offset, ["k", "bucket"]).withColumn("start", F.col("offset") + F.col("run")).drop("bucket", "offset", "run")


def schedule(spark: SparkSession, quotas: DataFrame, n_slots: int) -> DataFrame:
    """``slot, k, rank``: the source of each slot and the slot's rank within it, from ``k, low, high, blocks`` (shares of the ring).

    A source that the points gave fewer slots than blocks has its last blocks after the schedule; slots beyond its blocks stay unused.
    """
    width = RING // CELLS
    shares = quotas.where("high > low").withColumn("cell", F.explode(F.sequence((F.col("low") / width).cast("long"), ((F.col("high") - 1) / width).cast("long"))))
    point = (F.col("id") % RING) * STEP % RING
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("point"), (point / width).cast("long").alias("cell"))
    placed = points.join(shares, "cell").where("point >= low and point < high").select("slot", "k")
    chunk = max(256, math.isqrt(n_slots))
    chunked = placed.withColumn("chunk", (F.col("slot") / chunk).cast("long"))
    ahead = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunked.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offset = counts.select("k", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    ranked = chunked.withColumn("in_chunk", rank).join(offset, ["k", "chunk"])
    ranked = ranked.select("slot", "k", (F.col("offset") + F.col("in_chunk")).alias("rank"))
    missing = quotas.join(counts.groupBy("k").agg(F.sum("n").alias("n")), "k", "left").where(F.coalesce("n", F.lit(0)) < F.col("blocks"))
    late = missing.select(F.lit(None).cast("long").alias("slot"), "k", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("blocks") - 1)).alias("rank"))
    late = late.withColumn("slot", n_slots + F.col("rank") * 1_000_003 + F.col("k"))
    return ranked.join(F.broadcast(quotas.select("k", "blocks")), "k").where("rank < blocks").select("slot", "k", "rank").union(late)


def mix(docs: DataFrame, land: Land, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The sized documents and the mix.

    First: ``doc_id, source, size, source_size, target, start, key`` for every row of ``docs`` (``doc_id, text, source``; other columns are
    ignored), where ``start`` with the source names the row. Second: ``slot, k, start, from_word, n_words``: the words of each document piece
    a slot takes, counted from the document's begin. Null texts have size 0; a null source is a source of its own, the last one. Repeated
    rows are documents of their own. Documents of size 0 are taken with 0 words. Each source gives its target, rounded.
    """
    key = document_key(F.col("doc_id"), F.col("text"), seed).alias("key")
    sized = land(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key))
    goals = land(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))
    total = sized.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    joined = sized.join(goals, sized.source.eqNullSafe(goals.source)).select("doc_id", sized.source, "size", "key", "k", "source_size", "target")
    placed = land(_shuffled(joined, max(1, math.isqrt(total))))

    quota = F.least(F.round("target").cast("long"), MAX_PASSES * F.col("source_size"))
    goals = goals.withColumn("quota", quota).withColumn("blocks", F.ceil(F.col("quota") / block))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.floor(F.sum("quota").over(upto) * F.lit(RING) / F.greatest(F.sum("quota").over(Window.partitionBy()), F.lit(1)))
    shares = goals.withColumn("high", reach).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("k")), F.lit(0)))
    shares = land(shares.select("k", "low", "high", "blocks", "quota"))
    n_slots = shares.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    slots = schedule(docs.sparkSession, shares, n_slots)

    passes = F.explode(F.array(*[F.lit(p) for p in range(MAX_PASSES)]))
    spans = placed.where("size > 0").join(F.broadcast(shares.select("k", "quota")), "k").select("k", "start", "size", "source_size", "quota", passes.alias("pass"))
    begin = F.col("pass") * F.col("source_size") + F.col("start")
    spans = spans.withColumn("begin", begin).withColumn("stop", F.least(begin + F.col("size"), F.col("quota"))).where("begin < stop")
    pieces = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block))))
    first, last = F.greatest("begin", F.col("rank") * block), F.least("stop", (F.col("rank") + 1) * block)
    pieces = pieces.select("k", "start", "rank", (first - F.col("begin")).alias("from_word"), (last - first).alias("n_words"))
    return placed, pieces.join(slots, ["k", "rank"]).select("slot", "k", "start", "from_word", "n_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document of ``documents``."""
    return taken(table(spark, sf_dir, "documents"), landing(spark)).drop("key")


def taken(docs: DataFrame, land: Land) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, key``, one row for each row of ``docs``."""
    placed, pieces = mix(docs, land)
    words_taken = pieces.groupBy("k", "start").agg(F.sum("n_words").alias("taken"))
    out = placed.where("size > 0").join(words_taken, ["k", "start"], "left").unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "key")


#: The same mix by running sums alone: schedule and blocks decide the order of the words, not how many each document gives.
ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
                      md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM src),
capped AS (SELECT *, [3, 1, 2][((k - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                     / sum(w) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM capped),
water AS (SELECT max(level) AS water FROM levels WHERE cap::DOUBLE / w > level),
goals AS (SELECT l.source, l.k, l.source_size, CASE WHEN cap::DOUBLE / w <= level OR water IS NULL THEN cap::DOUBLE ELSE water * w END AS target FROM levels l, water),
placed AS (SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
                  coalesce(sum(s.size) OVER (PARTITION BY g.k ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
                  least(round(g.target)::BIGINT, 2 * g.source_size) AS quota
           FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, quota) - start) + greatest(0, least(source_size + start + size, quota) - source_size - start))::BIGINT AS taken, source
FROM placed
"""
