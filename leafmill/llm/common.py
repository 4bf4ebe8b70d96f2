"""Helpers shared by the training-data operators: table access, Arrow row mapping, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handled at once inside a Python worker; an Arrow batch (64 MB at most) is cut into such slices.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only in local mode, where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths settled inside the innermost :func:`scratch`; null outside of any.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what is written survives lost executors and is not
    computed again by each of its readers.
    """
    path = f"{shared_dir(df.sparkSession)}/leafmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are settled inside are deleted at the end, but for those that the given function marks as kept.

    What is kept belongs to the scratch around this one, if there is one;
    otherwise it is left for the reader of the result (``drop_settled``).
    """
    paths: list[str] = []
    outer = _scratch.set(paths)

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df.settled_at)
        kept.append(df.settled_at)
        return df

    kept: list[str] = []
    try:
        yield keep
    finally:
        _scratch.reset(outer)
        if (around := _scratch.get()) is not None:
            around.extend(kept)
        for path in paths:
            delete(spark, path)


def drop_settled(df: DataFrame) -> None:
    """Delete a table that :func:`settle` made, once nothing reads it any more."""
    delete(df.sparkSession, df.settled_at)


#: A key is hot if it holds more than this part of a table's rows, and more rows than a task takes lightly; so there are fewer hot keys than ``HOT``.
HOT, LIGHT = 1_000, 1_000


def look_up(rows: DataFrame, facts: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``facts``, which have one row for each key ``on``.

    Rows of hot keys are dealt over copies of their fact, fewer than ``HOT`` in
    all, so no task gets all rows of a hot key; rows without a key are dealt, too.
    ``rows`` are read twice: settle what is dear to make.
    """
    counted = rows.groupBy(on).agg(F.count("*").alias("__n"))
    total, most = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    least, key = max(LIGHT, total // HOT), rows.schema[on]
    # Fewer than HOT rows; none in most cases.
    found = counted.where(F.col("__n") > least).where(F.col(on).isNotNull()).collect() if most > least else []
    schema = T.StructType([T.StructField(on, key.dataType), T.StructField("__copies", T.IntegerType())])
    hot = F.broadcast(rows.sparkSession.createDataFrame([(r[0], -(-r[1] // least)) for r in found], schema))
    copies = F.when(F.col(on).isNull(), HOT).otherwise(F.coalesce("__copies", F.lit(1)))
    dealt = rows.join(hot, on, "left").withColumn("__copy", F.pmod(F.xxhash64(*rows.columns), copies).cast("int")).drop("__copies")
    copied = facts.join(hot, on, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    return dealt.join(copied, [on, "__copy"], how).drop("__copy")


def settled_labels(labels: DataFrame, label: str) -> DataFrame:
    """``id`` and ``label`` of each identifier that has one value of it; those labelled several ways are left out."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("label")).where("id is not null and label is not null")
    sides = known.groupBy("id").agg(F.min("label").alias(label), F.max("label").alias("most"))
    return sides.where(F.col(label) == F.col("most")).drop("most")


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of ``sample`` (``id``, bounded) with the ``text`` of their document; of several texts with one id, the least by digest."""
    # The sample is bounded, so it goes to the texts and not they to it.
    found = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id")
    others = [c for c in sample.columns if c != "id"]
    return found.groupBy("id", *others).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def map_text(
    df: DataFrame,
    start: Callable[[], Callable[[list], Sequence[list]]],
    source: str,
    keep: Sequence[str],
    fields: T.StructType,
) -> DataFrame:
    """Map column ``source`` to new ``fields`` in Arrow batches, keeping the columns ``keep``.

    ``start`` runs once in each task and returns a function from a list of
    values to one list for each field.
    """
    kept = df.select(*keep).schema
    out = T.StructType([*kept.fields, *fields.fields])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, types = start(), to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = work(part.column(n).to_pylist())
                columns = [part.column(i).cast(types.field(i).type) for i in range(n)]
                columns += [pa.array(v, types.field(n + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    return df.select(*[df[c] for c in keep], df[source].alias("__source")).mapInArrow(run, out)


def filter_text(df: DataFrame, start: Callable[[], Callable[[list], list]], source: str) -> DataFrame:
    """Keep the rows for which the function that ``start`` returns says True; all columns stay as they are."""
    index = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield part.filter(pa.array(work(part.column(index).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
