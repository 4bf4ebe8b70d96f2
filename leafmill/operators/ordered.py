"""Folds along an order that don't take a key's rows to one task: rows in range order, cut into blocks.

A fold over all rows of a key is a chain of functions of the state.  Rows are put in order by range, so a key with
many rows stands in many partitions; each block of a bounded number of rows becomes one function of the state, a pass over
these functions gives the state in which each block is entered, and blocks are then folded by themselves.
Keys with no more rows than a block need none of this: they are folded where they were joined (:func:`folded_swaps`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.staging import staged

#: Rows of a block, a power of two.
BLOCK = 1_024
#: Stands for a revision that isn't named; no state has it.
NO_REVISION = -(1 << 62)


def mapped(df: DataFrame, fields: T.StructType, work: Callable[[Iterator[dict]], Iterator[tuple]], rows: int = 1_024) -> DataFrame:
    """A partition's rows in order (as dictionaries) through ``work``, in Arrow batches of so many results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, held = to_arrow_schema(fields), []
        for made in work(row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist()):
            held.append(made)
            if len(held) == rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)

    return df.mapInArrow(run, fields)


def in_order(df: DataFrame, key: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """The rows with their place ``at`` in the order of keys, then ``order``, then of the input; a written table."""
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    by = [F.asc_nulls_first(c) for c in (*key, *order, "__row")]
    return staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__row").withColumn("at", F.monotonically_increasing_id()), label)


def folded_swaps(rows: DataFrame, key: Sequence[str], order: Sequence[str], revision: str, now: str) -> DataFrame:
    """``rows`` with whether each is ``swapped``, and the revision that holds ``after`` it, for keys with few rows: a task folds them as they come, in their order.

    Rows stand in the order of ``order``; ``now`` is the revision before a key's first row.
    """
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.asc_nulls_first(c) for c in order])))
    given = rows.withColumns({"__named": F.coalesce(F.col(revision).cast("long"), F.lit(NO_REVISION)), "__start": F.coalesce(F.col(now).cast("long"), F.lit(NO_REVISION - 1))})
    n, fields = len(rows.columns) - 1, T.StructType([*rows.drop("__place").schema, T.StructField("swapped", T.BooleanType()), T.StructField("after", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, state = to_arrow_schema(fields), 0
        for batch in batches:
            done, after = [], []
            for place, named, start in zip(*[batch.column(n + i).to_numpy().tolist() for i in range(3)]):
                if place == 1:
                    state = start
                swapped = named == state
                state += swapped
                done.append(swapped)
                after.append(state)
            columns = [batch.column(i).cast(types.field(i).type) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(done, pa.bool_()), pa.array(after, pa.int64())], schema=types)

    return given.mapInArrow(run, fields)


def swaps(start: int, named: Sequence[int]) -> tuple[list[bool], int]:
    """Which of the updates, in their order, name the revision that holds when they come; and the revision after them."""
    done = []
    for revision in named:
        done.append(revision == start)
        start += revision == start
    return done, start


def after_each(named: Sequence[int]) -> dict[int, int]:
    """For each revision that a block's updates name: the revision behind the block, if it is entered with that one."""
    out: dict[int, int] = {}
    for revision in reversed(named):
        # Entered just before this update with its own revision, it swaps; with any other, what comes later says.
        out[revision] = out.get(revision + 1, revision + 1)
    return out


def serial_swaps(rows: DataFrame, key: Sequence[str], revision: str, now: str, block: int = BLOCK) -> DataFrame:
    """For rows of :func:`in_order`, by ``at``: whether each is ``swapped``, and the revision that holds behind it."""
    number = F.expr(f"at div {block}").alias("block")
    blocks = rows.select(*key, number, F.col(now).alias("now"), F.struct("at", F.coalesce(F.col(revision).cast("long"), F.lit(NO_REVISION)).alias("named")).alias("row"))
    blocks = staged(blocks.groupBy(*key, "block").agg(F.first("now").cast("long").alias("now"), F.array_sort(F.collect_list("row")).alias("rows")), "swap-blocks")
    head = [blocks.schema[c] for c in (*key, "block", "now")]
    longs = T.ArrayType(T.LongType())

    def functions(stream: Iterator[dict]) -> Iterator[tuple]:
        for r in stream:
            made = after_each([x["named"] for x in r["rows"]])
            yield *[r[f.name] for f in head], list(made), list(made.values())

    def entered(stream: Iterator[dict]) -> Iterator[tuple]:
        before, state = None, 0
        for r in stream:
            mine = [r[k] for k in key]
            if mine != before:
                before, state = mine, r["now"]
            yield *mine, r["block"], state
            state = dict(zip(r["names"], r["afters"])).get(state, state)

    def within(stream: Iterator[dict]) -> Iterator[tuple]:
        for r in stream:
            state = r["state"]
            for x in r["rows"]:
                done = x["named"] == state
                state += done
                yield x["at"], done, state

    made = mapped(blocks, T.StructType([*head, T.StructField("names", longs), T.StructField("afters", longs)]), functions)
    states = mapped(made.repartition(*key).sortWithinPartitions(*key, "block"), T.StructType([*head[:-1], T.StructField("state", T.LongType())]), entered)
    both = blocks.join(states, [*key, "block"]).select("rows", "state")
    return mapped(both, T.StructType([T.StructField("at", T.LongType()), T.StructField("swapped", T.BooleanType()), T.StructField("revision", T.LongType())]), within)
