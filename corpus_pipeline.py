"""A corpus pipeline over ``documents``: toxic documents go, one document of each group of near-duplicates stays, the rest is mixed and packed.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written and reread as the next stage's documents. All but the last
return the columns of ``documents``. Stages act on the rows that they get; the only other table read is ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from realcurve.llm import jaccard_join, mixing, packing, toxicity
from realcurve.llm.common import landing, table

#: Near-duplicates of the pipeline: five-word shingles, similarity of 0.8 or more.
SHINGLE, LIKE = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled rows of ``docs`` outside the held-out fold, doesn't reject.

    A null or empty text is scored like any other; a null id takes part in no label.
    """
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels"), landing(spark)))
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashes with the score columns are so ruled out
    text = names[docs.columns.index("text")]
    judged = toxicity.scored(docs.toDF(*names).withColumn("text", F.col(text)), model)
    return judged.where("predicted = 0").select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component; documents with a null id or without words all stay.

    Rows that share an id and are its component's least stay as they are.
    """
    found = jaccard_join.join(docs, landing(spark), SHINGLE, LIKE)
    leaving = found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(leaving, docs["doc_id"] == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents.

    A document of ``s`` words of which the mix takes ``t`` appears ``t / s`` times, rounded: so once, twice or not at all; documents without
    words weigh nothing in a mix and stay once. Copies are equal rows.
    """
    keyed = docs.withColumn("__key", mixing.document_key(F.col("doc_id"), F.col("text")))
    taken = mixing.taken(docs, landing(spark)).where("size > 0")
    times = taken.groupBy("key").agg(F.sum(F.round(F.col("taken") / F.col("size")).cast("int")).alias("__times"), F.count(F.lit(1)).alias("__rows"))
    joined = keyed.join(times, keyed["__key"] == times["key"], "left").drop("key")
    # rows that are equal share what they were given
    at = F.coalesce(F.ceil(F.col("__times") / F.col("__rows")).cast("int"), F.lit(1))
    return joined.withColumn("__copy", F.explode(F.when(at > 0, F.sequence(F.lit(1), at)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, as the packing query returns them."""
    return packing.pieces(docs, landing(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: No SQL can express training a classifier or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    land = landing(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
