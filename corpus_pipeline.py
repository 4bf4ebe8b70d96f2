"""A corpus pipeline over ``documents``: toxicity, quality rules, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
what it keeps with the columns of ``docs``; the last returns the packed pieces.
Classifiers learn from the tables ``documents`` and ``labels`` of ``sf_dir``, so a
stage's verdict on a text doesn't depend on the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import near_dedup, packing, quality, toxicity
from leafmill.llm.common import drop_settled, scratch, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, "text", model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the classifier reject go."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.drop_poor(docs, "text", model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows with a null id can't be named and stay; rows that repeat an id and text are one document, and other texts of an id documents of their own.
    """
    found = near_dedup.near_duplicate_rows(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_print").alias("__gone_print")).distinct()
    own = near_dedup.text_print(docs["text"])
    named = docs.join(gone, (docs["doc_id"].cast("long") == F.col("__gone")) & (own == F.col("__gone_print")), "left_anti")
    own = near_dedup.text_print(named["text"])
    repeated = named.groupBy(named["doc_id"].alias("__twice"), own.alias("__twice_print")).agg(F.count("*").alias("__n")).where("__n > 1 and __twice is not null").drop("__n")
    again = (named["doc_id"] == F.col("__twice")) & (own == F.col("__twice_print"))
    single = named.join(repeated, again, "left_anti")
    double = named.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(double)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_duplicates), ("packing", pack)]

#: SQL can express neither the learned classifiers nor the tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next, and deleted when that one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(settle(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop_settled(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
