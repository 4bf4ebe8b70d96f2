"""Semantic memory: scoped nearest records by cosine similarity, with a block of queries against all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Blocks that the records of a scope are dealt over.
BLOCKS = 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def top_k(queries: DataFrame, records: DataFrame, k: int, key: str = "vec_id", scope: str = "tenant_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` (1 to 100) most similar records of its own scope for each query, itself left out; ties go to the smaller key."""
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    q = queries.select(F.col(key).alias("query_id"), scope, F.col(vector).alias("q"), norm(F.col(vector)).alias("qn"))
    r = records.select(F.col(key).alias("record_id"), scope, F.col(vector).alias("r"), norm(F.col(vector)).alias("rn"))
    # A query's records are dealt over blocks, so that no task ranks all records of a scope; the best of blocks are ranked again.
    r = r.withColumn("block", F.pmod(F.xxhash64("record_id"), F.lit(BLOCKS)))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    pairs = q.join(r, [scope, "block"]).where("query_id <> record_id")
    score = F.when((F.col("qn") > 0) & (F.col("rn") > 0), dot(F.col("q"), F.col("r")) / (F.col("qn") * F.col("rn")))
    scored = pairs.select("query_id", scope, "block", "record_id", F.round(score, 5).alias("similarity"))
    order = (F.col("similarity").desc_nulls_last(), F.col("record_id"))
    some = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).where(F.col("place") <= k).drop("block")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k)
