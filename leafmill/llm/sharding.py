"""Sharding by extendible hashing: a directory over hash-prefix bits, where only oversized buckets split.

A row's hash is 60 bits of the digest of its id and text.  A bucket of rows that
share a prefix splits on the next bit until it fits the byte limit or holds one
row.  The directory's entries are cells, prefixes of as many bits as the deepest
buckets need; each points to its bucket, several to one that split less often.

Byte sums are made for the entries first (some bits more than the number of
shards asks for) and rolled up to all shorter prefixes, so one round settles
nearly all buckets; entries that are still too large go on with more bits, in a
next table.  Rows that agree in all 60 bits (repeated rows) go to numbered
overflow shards by running bytes, within tasks and then over tasks.

The directory grows with the data, so it stays a table.  Short prefixes would be
hot keys: there are at most ``2 ** SHORT`` of each length, so those that fit are
broadcast; longer ones hold so small a part of the rows that they are joined.

Cases: null and empty texts have no bytes; a row above the limit is a shard by
itself; null ids count as empty strings; repeated rows overflow; an empty table
gives no shards; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, settle, table

#: Bytes of text in a shard at most.
LIMIT = 32 << 20
#: The same for the query over ``documents``, so that small tables split, too.
QUERY_LIMIT = 128 << 10
BITS = 60
#: Bits up to which prefixes that fit are broadcast: at most 2 ** (SHORT + 1) rows of a few numbers.
SHORT = 14
#: Bits beyond the expected depth that cells have in the first round, and bits added in each later one.
SPARE = 4


def row_hash(id_col: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def prefix(h: str, depth: Column) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.call_function("shiftright", F.col(h), F.lit(BITS) - depth)


def directory(items: DataFrame, limit: int, least: int, most: int) -> DataFrame:
    """Entries of ``most`` bits for the hashes of ``items`` (``h``, ``n_bytes``), each with its bucket.

    ``entry`` is a prefix of ``most`` bits; ``bucket`` holds the shortest prefix
    of ``least`` bits or more that fits, with its bytes and rows, and is null
    where the entry itself is too large.
    """
    deep = F.lit(most)
    cells = items.groupBy(prefix("h", deep).alias("entry")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
    cells = settle(cells, "cells")
    spread = cells.select("entry", "bytes", "rows", F.explode(F.sequence(F.lit(least), deep)).alias("depth"))
    spread = spread.withColumn("prefix", F.call_function("shiftright", "entry", deep - F.col("depth")))
    sums = spread.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_docs"))
    sums = settle(sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)), "fitting")
    at, is_short = ["depth", "prefix"], F.col("depth") <= SHORT
    held = spread.where(is_short).join(F.broadcast(sums.where(is_short)), at)
    if most > SHORT:
        held = held.unionByName(spread.where(~is_short).join(sums.where(~is_short).hint("merge"), at))
    best = held.groupBy("entry").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("bucket"))
    return cells.select("entry").join(best, "entry", "left")


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Shard of each row: ``shard_depth`` bits, ``shard_prefix``, ``overflow`` number, and the shard's bytes and rows."""
    text = df[text_col]
    items = df.select(df[id_col].alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), row_hash(df[id_col], text).alias("h"), F.spark_partition_id().alias("task"))
    items = settle(items, "items")
    total = items.agg(F.sum("n_bytes")).first()[0] or 0
    depth, low, parts = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE), 0, []
    while True:
        with scratch(df.sparkSession) as keep:
            entries = keep(settle(directory(items, limit, low, depth), "directory"))
        found = items.withColumn("entry", prefix("h", F.lit(depth))).join(entries, "entry")
        parts.append(found.where("bucket is not null").select("id", "n_bytes", "bucket.*", F.lit(0).cast("long").alias("overflow")))
        if entries.where("bucket is null").isEmpty():
            break
        items = found.where("bucket is null").select("id", "n_bytes", "h", "task")
        if depth == BITS:
            parts.append(overflow(items, limit))
            break
        low, depth = depth + 1, min(BITS, depth + 2 * SPARE)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "n_bytes", F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), "overflow", "shard_bytes", "shard_docs")


def overflow(items: DataFrame, limit: int) -> DataFrame:
    """Rows that agree in all bits, dealt by running bytes to numbered shards; sums run within a task's rows, then over tasks."""
    tasks = items.groupBy("h", "task").agg(F.sum("n_bytes").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = tasks.select("h", "task", F.coalesce(before, F.lit(0)).alias("before"))
    here = F.sum("n_bytes").over(Window.partitionBy("h", "task").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    placed = items.withColumn("here", F.coalesce(here, F.lit(0))).join(tasks, ["h", "task"])
    # Rows of one bucket have one size here, so a shard takes as many whole rows as fit.
    whole = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    number = F.floor((F.col("before") + F.col("here")) / F.greatest("n_bytes", F.lit(1)) / whole).cast("long")
    placed = placed.select("id", "n_bytes", "h", number.alias("overflow"))
    sums = placed.groupBy("h", "overflow").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    out = placed.join(sums, ["h", "overflow"])
    return out.select("id", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", "shard_docs", "overflow")


def write_shards(placed: DataFrame, docs: DataFrame, id_col: str, path: str) -> None:
    """Write ``docs`` with one folder for each shard; ids must be unique and known to ``placed``."""
    at = placed.select(F.col(id_col).alias("__id"), F.concat_ws("-", "shard_depth", F.lpad(F.conv(F.col("shard_prefix"), 10, 16), 15, "0"), "overflow").alias("shard"))
    docs.join(at, docs[id_col] == at["__id"]).drop("__id").repartition("shard").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of ``documents`` of 128 KiB of text at most."""
    return shards(table(spark, sf_dir, "documents"), limit=QUERY_LIMIT)


def oracle(limit: int = QUERY_LIMIT) -> str:
    """The same buckets from the sums of all prefixes (tables of so few rows need no more than 40 bits)."""
    return f"""
with items as (select doc_id, row_number() over () as r, coalesce(octet_length(encode(text)), 0) as n_bytes,
    ('0x' || left(md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')), 15))::bigint as h from documents),
spread as (select doc_id, r, n_bytes, d as depth, h >> ({BITS} - d) as prefix from items, generate_series(0, 40) as g(d)),
sums as (select depth, prefix, sum(n_bytes) as shard_bytes, count(*) as shard_docs from spread group by all),
held as (select s.*, shard_bytes, shard_docs, row_number() over (partition by r order by s.depth) as k
  from spread s join sums using (depth, prefix) where shard_bytes <= {limit} or shard_docs = 1)
select doc_id, cast(n_bytes as bigint) as n_bytes, cast(depth as integer) as shard_depth, cast(prefix as bigint) as shard_prefix,
  cast(0 as bigint) as overflow, cast(shard_bytes as bigint) as shard_bytes, cast(shard_docs as bigint) as shard_docs
from held where k = 1
"""
