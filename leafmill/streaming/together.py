"""Keys of a stateful stream taken in groups, so that no call to the state and no batch of output is made for a key alone.

A processor of single keys runs unchanged: its value states are elements of the
group's list states, read at most once and written at most once for each group and batch.  What a
group costs (its key, its times, these calls, its batch of output; milliseconds) is
met once for all its keys.  A state with a time to live is only appended to, so each
element ends by its own time; a key's value there stands until it ends.
Rows go in and out as one row of arrays, as each row of a state's stream is dear: those of a group
that stand in one Arrow batch are packed before they are shuffled.

A batch reads, and writes if any of them changed, the values of all keys of the groups that it
meets, and holds a group's rows of one batch in memory: groups are to be of
hundreds of keys.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def plain(value):
    """Rows and lists as tuples and lists that the state takes again."""
    return [plain(x) for x in value] if type(value) is list else tuple(map(plain, value)) if isinstance(value, tuple) else value


class Value:
    """A value state of the key at hand, among those of its group."""

    def __init__(self, elements, ends: bool) -> None:
        self.elements, self.ends, self.key = elements, ends, None
        self.begin()

    def begin(self) -> None:
        """Another group."""
        self.held, self.added, self.changed = None, [], False

    def get(self) -> tuple | None:
        if self.held is None:
            self.held = {key: plain(tuple(value)) for key, *value in self.elements.get()}
        return self.held.get(self.key)

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple) -> None:
        had = self.exists()
        if self.ends:
            if had:
                raise ValueError("a value with a time to live stands until it ends")
            self.added.append((self.key, *value))
        self.held[self.key], self.changed = value, True

    def clear(self) -> None:
        if self.ends:
            raise ValueError("a value with a time to live stands until it ends")
        if self.exists():
            del self.held[self.key]
            self.changed = True

    def write(self) -> None:
        if self.added:
            self.elements.appendList(self.added)
        elif self.changed and self.held:
            self.elements.put([(key, *value) for key, value in self.held.items()])
        elif self.changed:
            self.elements.clear()


class Values:
    """The handle that the processor of single keys is given."""

    def __init__(self, handle: StatefulProcessorHandle, key: str) -> None:
        self.handle, self.key, self.made = handle, key, []

    def getValueState(self, name: str, schema: str, ttlDurationMs: int | None = None) -> Value:  # noqa: N802, N803
        self.made.append(Value(self.handle.getListState(name, f"{self.key}, {schema}", ttlDurationMs), ttlDurationMs is not None))
        return self.made[-1]


class Together(StatefulProcessor):
    """``processor``, which knows value states only, for all keys of a group; ``key`` names and types the key's column, ``made`` names what is made."""

    def __init__(self, processor: StatefulProcessor, key: str, made: list[str]) -> None:
        self.processor, self.key, self.made = processor, key, made

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = Values(handle, self.key)
        self.processor.init(self.values)

    def handleInputRows(self, group: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        key, of, columns = self.key.split()[0], {}, None
        for r in rows:
            if columns is None:
                columns = [c for c in r.__fields__ if c != GROUP]
                at, single = columns.index(key), namedtuple("single", columns)
            for x in zip(*(r[c] for c in columns)):
                of.setdefault(x[at], []).append(single._make(x))
        for value in self.values.made:
            value.begin()
        made = []
        for k, own in of.items():
            for value in self.values.made:
                value.key = k
            made += self.processor.handleInputRows((k,), iter(own), timerValues)
        for value in self.values.made:
            value.write()
        if made:
            yield Row(**dict(zip(self.made, map(list, zip(*made)))))

    def close(self) -> None:
        self.processor.close()


GROUP = "__group"


def arrays(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema])


def packed(rows: DataFrame, group: Column) -> DataFrame:
    """One row of arrays for the rows of a group in each Arrow batch, in their order."""
    rows = rows.withColumn(GROUP, group)
    out = T.StructType([*arrays(rows.drop(GROUP).schema), rows.schema[GROUP]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [(GROUP, "ascending")]))  # a stable sort
            if batch.num_rows:
                of = batch.column(batch.num_columns - 1)
                bounds = pa.array([0, *pc.run_end_encode(of).run_ends.to_pylist()], pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, column, type=schema.field(i).type) for i, column in enumerate(batch.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*lists, of.take(bounds[:-1])], schema=schema)

    return rows.mapInArrow(run, out)


def by_group(rows: DataFrame, group: Column, processor: StatefulProcessor, key: str, made: str, mode: str = "None") -> DataFrame:
    """``transformWithState`` in append mode over groups of the ``key`` ("name type"), which ``group`` follows from, instead of over single keys."""
    schema = T.StructType.fromDDL(made)
    out = packed(rows, group).groupBy(GROUP).transformWithState(Together(processor, key, schema.names), arrays(schema), "append", mode)
    return out.select(F.explode(F.arrays_zip(*schema.names)).alias("x")).select("x.*")
