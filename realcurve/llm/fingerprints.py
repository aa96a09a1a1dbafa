"""Document fingerprints by one-permutation MinHash.

The distinct five-word shingles of a text are hashed once; the top bits of a hash are its bin, and the least hash of a bin is the bin's
value. Sorting the hashes together with one sentinel per bin leaves, at the begin of each bin, its least hash or the sentinel of an empty
bin. An empty bin takes the value of the first filled bin of its own pseudo-random order of all bins (optimal densification: each filled
bin is an equally likely donor, and the order depends on the bin alone, so that two texts agree on donors). The lowest byte of each
value is kept. Two equal bytes may stand for different values, which the likeness corrects. All of it is array functions of the engine.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_below, quantile_bounds, slots, table, words

#: Words of a shingle.
SHINGLE = 5
#: log2 of the number of bins.
BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Bits kept of each bin's value.
KEPT_BITS = 8
#: How many places of a bin's donor order are looked at together.
PROBES = (6, 40, BINS)


def _donors() -> list[list[int]]:
    """For each bin all bins, in an order drawn from the bin's number."""
    return [sorted(range(BINS), key=lambda j: hashlib.md5(f"{i}/{j}".encode()).digest()) for i in range(BINS)]


def _sentinels() -> list[int]:
    """The largest hash of each bin, bins in the order of signed hashes."""
    span = 1 << (64 - BIN_BITS)
    return [-(1 << 63) + (i + 1) * span - 1 for i in range(BINS)]


def _fixed(values: list, kind: str) -> Column:
    """A constant array, which the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the values of all bins of the text in column ``text``, each cut to its lowest byte; null for a text without words.

    Texts of fewer than five words have one shingle, the whole sequence. The steps are columns of their own, so none runs twice.
    """
    drop = [f"__{out}_{k}" for k in ("words", "sorted", "bins")]
    w, s, b = drop
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))
    shingles = F.transform(F.slice(F.col(w), F.lit(SHINGLE), F.greatest(F.size(w), F.lit(SHINGLE))),
                           lambda x, i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(SHINGLE - 1)], x))
    hashes = F.when(F.size(w) < SHINGLE, F.array(F.xxhash64(F.col(w)))).otherwise(shingles)
    df = df.withColumn(s, F.when(F.size(w) > 0, F.sort_array(F.concat(hashes, _fixed(_sentinels(), "bigint")))))
    top = lambda x: F.shiftright(x, 64 - BIN_BITS)
    begins = F.filter(F.col(s), lambda x, i: (i == 0) | (top(x) != top(F.get(F.col(s), i - 1))))
    ends = _fixed(_sentinels(), "bigint")
    df = df.withColumn(b, F.transform(begins, lambda x, i: F.when(x != F.get(ends, i), x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int"))))
    orders = _fixed([j for row in _donors() for j in row], "int")
    filled = lambda part: F.get(F.filter(part, lambda j: F.get(F.col(b), j).isNotNull()), F.lit(0))
    tries, at = [], 0
    for upto in PROBES:
        tries.append((at, upto - at))
        at = upto

    def densify(x: Column, i: Column) -> Column:
        return F.coalesce(x, *[F.get(F.col(b), filled(F.slice(orders, i * BINS + start + 1, F.lit(n)))) for start, n in tries])

    return df.withColumn(out, F.transform(F.col(b), densify)).drop(*drop)


def packed(sketch: Column) -> Column:
    """The sketch as hex text, two digits a bin; empty for a text without words."""
    digits = _fixed([f"{v:02x}" for v in range(1 << KEPT_BITS)], "string")
    return F.coalesce(F.array_join(F.transform(sketch, lambda v: F.get(digits, v)), ""), F.lit(""))


def unpacked(fingerprint: Column) -> Column:
    """The sketch of a packed fingerprint."""
    return F.when(F.length(fingerprint) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.conv(F.substring(fingerprint, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: equal bytes, less those equal by chance. Two texts without words are alike, one is not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-KEPT_BITS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (hex text) to any rows with a text column; a column of that name is replaced."""
    return with_sketch(docs.drop("fingerprint"), text, "__sketch").withColumn("fingerprint", packed(F.col("__sketch"))).drop("__sketch")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text`` and the window by which rows follow each other, descending ``doc_id``, after the last the first.

    Rows are cut into ranges of ids. The first rows of each range are copied to the end of the range before it, so that no row looks beyond
    its range. Null ids come last; rows of one id follow by text. ``own`` is false for the copies.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"))
    bounds = quantile_bounds(rows, "at", 16 * max(1, slots(spark)))
    rows = rows.withColumn("range", count_below(bounds, F.col("at")))
    heads = rows.groupBy("range").agg(F.max("at").alias("at")).orderBy(F.col("range").desc()).collect()  # a row for each range
    if not heads:
        return rows.withColumn("own", F.lit(True)).withColumn("next_range", F.lit(None).cast("int"))
    above = [(heads[(i + 1) % len(heads)]["at"], heads[i]["range"]) for i in range(len(heads))]  # the head of the next range goes to this one
    copies = F.broadcast(spark.createDataFrame(above, "at long, next_range int"))
    both = rows.join(copies, "at", "left").withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    both = both.where("own or next_range is not null")
    return both.withColumn("range", F.when(F.col("own"), F.col("range")).otherwise(F.col("next_range")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, and likenesses to that and to the next document."""
    return edited_pairs(table(spark, sf_dir, "documents"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id, text``; other columns are ignored).

    A null text is empty, an empty text has the fingerprint ``''``. The only row follows itself. Rows with one id follow by text, rows that
    are equal follow each other. Null ids come after all others.
    """
    rows = with_next(docs)
    order = Window.partitionBy("range").orderBy(F.col("own").desc(), F.col("at").desc(), "text")
    cut = F.floor(F.char_length("text") / 3).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("edited", F.concat(F.left("text", F.char_length("text") - cut), F.left("next_text", cut)))
    rows = with_sketch(with_sketch(rows, "text", "sketch"), "edited", "edited_sketch")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.where("own").select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed(F.col("sketch")).alias("fingerprint"), packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
