"""Tables that several branches of a plan read are written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only in local mode, where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the folder that executors share (``spark.checkpoint.dir``) and read again.

    Where no such folder is set (local mode only), a folder of our own takes its place.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leafmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """``df``'s rows dealt over all cores.  Rows that are small but dear to work on lie in few files, so that few tasks would get them."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * per_core)


#: Rows that a task sorts, on the average.
TASK_ROWS = 1_000_000


def by_key(df: DataFrame, keys: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` with the rows of each key together, in as many partitions as its rows ask for, so that a task's share doesn't grow with the table.  Rows are counted first."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
