"""Repair of the structure of conversations by the cheapest edits, over tight arcs found from both ends.

A conversation should be empty or read ``s?(ua)+`` by the initials of its roles.  Edits of
its rows are arcs between (row, state of that pattern): keep, give the role user or assistant, delete, insert.  An
arc is optimal where the minimum cost from the front, its own, and the minimum cost to the end add up to the total; these
arcs form a DAG, and a frontier of states that follows the least letter at each step reads off
the least of all cheapest edit scripts.

A conversation may be of any length.  Rows are put in order by range, and cut into
blocks of a bounded number of rows.  Each block becomes a matrix of minimum costs between the four states;
a pass over the matrices from each end gives the costs at block borders, with which blocks are
traversed independently, for each state in which they may be entered, and a last pass over borders
chooses among these.  So one task reads a few numbers of a block, not its rows; the rows
meet their edits again by block.

Cases: rows are taken by turn (nulls first), then role, text and input order; null roles and texts are one space; rows without an
identifier are one conversation; repeated rows are duplicates but the first; blank
texts and repeats must go; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import look_up, settle, table

#: Rows of a block, a power of two.
BLOCK = 1_024
#: Bytes of repaired rows that are joined before they go to the pass that hashes a conversation.
CHUNK = 1 << 20

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: States of the pattern: at the start, after system, after user, after assistant; it may end in the first and the last.
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that is given or inserted in each state, and the state after it.
GIVEN = ["user", "user", "assistant", "user"]
THEN = [NEXT[q, GIVEN[q][0]] for q in STATES]
FAR = 1 << 50

#: A row's code is its role's initial (s, u, a or another) and whether it is sound, unfinished or must go.
KINDS, SOUND, OPEN, DOOMED = "suax", 0, 1, 2
CODES = [(kind, fault) for fault in (SOUND, OPEN, DOOMED) for kind in KINDS]
LETTERS = [chr(ord("a") + i) for i in range(len(CODES))]


def arcs(kind: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state, how a row can be taken: letter, next state and cost, by letter."""
    out = []
    for q in STATES:
        ways = [("D", q, DELETE)]
        if fault != DOOMED:
            extra = UNFINISHED if fault == OPEN else 0
            if (q, kind) in NEXT:
                ways.append(("K", NEXT[q, kind], KEEP + extra))
            ways.append(("R", THEN[q], REROLE + extra))
        out.append(ways)
    return out


ARCS = {letter: arcs(*code) for letter, code in zip(LETTERS, CODES)}


def inserted(costs: list[int], forward: bool) -> list[int]:
    """Costs with rows inserted at a place; no more than two are ever of use."""
    costs = list(costs)
    for _ in range(3):
        for q in STATES:
            a, b = (THEN[q], q) if forward else (q, THEN[q])
            costs[a] = min(costs[a], costs[b] + INSERT)
    return costs


#: Cost to the end from each state after the last row.
ENDING = inserted([0, FAR, FAR, 0], forward=False)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices of minimum costs."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def step_matrix(letter: str) -> np.ndarray:
    out = np.full((4, 4), FAR, np.int64)
    for q in STATES:
        at = inserted([0 if x == q else FAR for x in STATES], forward=True)
        for x in STATES:
            for _, to, cost in ARCS[letter][x]:
                out[q, to] = min(out[q, to], at[x] + cost)
    return out


STEPS = np.stack([step_matrix(c) for c in LETTERS])
IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def block_matrix(codes: str) -> np.ndarray:
    """Minimum costs from each state before a block's rows to each state after them."""
    held = STEPS[np.frombuffer(codes.encode(), np.uint8) - ord("a")] if codes else IDENTITY[None]
    while len(held) > 1:
        if len(held) % 2:
            held = np.concatenate([held, IDENTITY[None]])
        held = times(held[::2], held[1::2])
    return held[0]


class Path(NamedTuple):
    """Edits of a block entered in one state: letters, their cost, and the state after it."""

    letters: str
    cost: int
    state: int


def traverse(codes: str, entering: Sequence[int], leaving: Sequence[int], last: bool) -> list[Path | None]:
    """The least optimal edits of a block for each state in which an optimal script may enter it.

    ``entering`` are costs from the conversation's start to the block, ``leaving`` those from behind its
    rows to the conversation's end; behind the last block's rows, rows may be inserted.
    """
    n = len(codes)
    back = [list(leaving)]
    for c in reversed(codes):
        after = back[-1]
        back.append(inserted([min(cost + after[to] for _, to, cost in ARCS[c][q]) for q in STATES], forward=False))
    back.reverse()
    front = [list(entering)]
    for c in codes:
        at, new = inserted(front[-1], forward=True), [FAR] * 4
        for q in STATES:
            for _, to, cost in ARCS[c][q]:
                new[to] = min(new[to], at[q] + cost)
        front.append(new)
    total = min(front[0][q] + back[0][q] for q in STATES)
    front = [inserted(f, forward=True) for f in front]

    def onward(i: int, q: int) -> list[tuple[str, int, int, int]]:
        """Optimal arcs of a node: letter, row, state, cost."""
        ways = [(letter, i + 1, to, cost) for letter, to, cost in ARCS[codes[i]][q]] if i < n else []
        if i < n or last:
            ways.append(("I", i, THEN[q], INSERT))
        return [w for w in ways if front[i][q] + w[3] + back[w[1]][w[2]] == total]

    out: list[Path | None] = []
    for q in STATES:
        if entering[q] + back[0][q] != total:
            out.append(None)
            continue
        i, frontier, letters, spent = 0, {q}, [], 0
        while ways := [w for x in frontier for w in onward(i, x)]:
            letter = min(w[0] for w in ways)
            chosen = [w for w in ways if w[0] == letter]
            # Arcs of one letter lead from a row to one row; costs are those of the letter and row.
            i, frontier = chosen[0][1], {w[2] for w in chosen}
            letters.append(letter)
            spent += chosen[0][3]
        # In this pattern a letter leads from a state to one state, so the frontier has one.
        (state,) = frontier
        out.append(Path("".join(letters), spent, state))
    return out


# -- over tables ------------------------------------------------------------


def kind_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def last_sign(text: Column) -> Column:
    """The last character that isn't white space."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), -1, 1)


def in_order(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with their place ``at`` in the order of conversations and turns; a written table.

    Rows of one conversation may stand in any number of partitions: what breaks ties ends with a number of the row.
    """
    text, role = F.coalesce(df[text_col].cast("string"), F.lit(" ")), F.coalesce(df[role_col].cast("string"), F.lit(" "))
    rows = df.select(df[id_col].alias("conv"), df[turn_col].alias("turn"), role.alias("role"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "print": F.sha2("text", 256)})
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "head", "print", "row")]
    same = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("-")), F.octet_length("role"), "role", "print"), 256)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.select("conv", "turn", "role", "text", same.alias("same"), F.monotonically_increasing_id().alias("at")), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """Rows without their texts, with the first ``fault`` of each (blank, duplicate, truncated or null)."""
    firsts = rows.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = rows.select("conv", "turn", "at", "same", kind_of(F.col("role")).alias("kind"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), last_sign(F.col("text")).alias("sign"))
    seen = look_up(seen, firsts, "same", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("sign").isin(".", "!", "?"), "truncated")
    return seen.select("conv", "turn", "at", "kind", fault.alias("fault"))


BORDER = T.StructType([T.StructField("matrix", T.ArrayType(T.LongType())), T.StructField("illegal", T.LongType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def mapped(df: DataFrame, fields: T.StructType, work) -> DataFrame:  # noqa: ANN001
    """Rows in order through ``work``, a function from an iterator of rows (as dictionaries) to one of tuples, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, held, size = to_arrow_schema(fields), [], 0
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        for made in work(rows):
            held.append(made)
            size += 100 + sum(len(v) for v in made if isinstance(v, (str, bytes)))
            if size > 8 * CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)

    return df.mapInArrow(run, fields)


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


LONGS = T.ArrayType(T.LongType())


def blocks_of(found: DataFrame, block: int) -> DataFrame:
    """One row for each block of a conversation: its rows' codes, its matrix, and what its borders need; a written table."""
    code = F.substring(F.lit("".join(LETTERS)), F.lit(1) + F.instr(F.lit(KINDS), F.col("kind")) - 1 + F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNull(), 0).otherwise(8), F.lit(1))
    rows = found.select("conv", F.expr(f"at div {block}").alias("block"), F.struct("at", code.alias("code")).alias("row"))
    held = rows.groupBy("conv", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["code"]), "").alias("codes"))

    def work(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            kinds = [CODES[ord(c) - ord("a")][0] for c in r["codes"]]
            bad = sum(not legal(a, b) for a, b in zip(kinds, kinds[1:]))
            yield *r.values(), block_matrix(r["codes"]).ravel().tolist(), bad, kinds[0], kinds[-1]

    return settle(mapped(held, with_fields(held, *BORDER.fields), work), "blocks")


def along(df: DataFrame, *order: Column) -> DataFrame:
    """Blocks of each conversation in one partition, in order; a row for each block, whatever it holds."""
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def with_borders(blocks: DataFrame) -> DataFrame:
    """Blocks with the costs to both ends of their conversation (``entering`` and ``leaving``), whether they are the ``last``, and illegal pairs with the block before counted in."""

    def forward(rows: Iterator[dict]) -> Iterator[tuple]:
        before, costs, kind = object(), None, None
        for r in rows:
            if r["conv"] != before:
                before, costs, kind = r["conv"], np.array([0, FAR, FAR, FAR], np.int64), None
            yield r["conv"], r["block"], r["codes"], r["matrix"], r["illegal"] + (kind is not None and not legal(kind, r["first"])), costs.tolist()
            costs, kind = np.minimum((costs[:, None] + np.reshape(r["matrix"], (4, 4))).min(axis=0), FAR), r["last"]

    def backward(rows: Iterator[dict]) -> Iterator[tuple]:
        before, costs, last = object(), None, True
        for r in rows:
            if last := r["conv"] != before:
                before, costs = r["conv"], np.array(ENDING, np.int64)
            yield r["conv"], r["block"], r["codes"], r["illegal"], r["entering"], costs.tolist(), last
            costs = np.minimum((np.reshape(r["matrix"], (4, 4)) + costs).min(axis=1), FAR)

    head = [blocks.schema[c] for c in ("conv", "block", "codes")]
    some = T.StructType([*head, blocks.schema["matrix"], blocks.schema["illegal"], T.StructField("entering", LONGS)])
    every = T.StructType([*head, blocks.schema["illegal"], T.StructField("entering", LONGS), T.StructField("leaving", LONGS), T.StructField("last", T.BooleanType())])
    return mapped(along(mapped(along(blocks, F.asc("block")), some, forward), F.desc("block")), every, backward)


def with_paths(blocks: DataFrame) -> DataFrame:
    """The edits of each block: ``entry`` state, ``letters`` and their ``cost``; a written table."""
    paths = T.StructField("paths", T.ArrayType(T.StructType([T.StructField("letters", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("state", T.IntegerType())])))
    head = [blocks.schema[c] for c in ("conv", "block", "illegal")]

    def ways(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            yield r["conv"], r["block"], r["illegal"], [p and p._asdict() for p in traverse(r["codes"], r["entering"], r["leaving"], r["last"])]

    def choose(rows: Iterator[dict]) -> Iterator[tuple]:
        before, state = object(), START
        for r in rows:
            if r["conv"] != before:
                before, state = r["conv"], START
            path = r["paths"][state]
            yield r["conv"], r["block"], r["illegal"], state, path["letters"], path["cost"]
            state = path["state"]

    out = T.StructType([*head, T.StructField("entry", T.IntegerType()), T.StructField("letters", T.StringType()), T.StructField("cost", T.LongType())])
    return settle(mapped(along(mapped(blocks, T.StructType([*head, paths]), ways), F.asc("block")), out, choose), "edits")


def edited(rows: DataFrame, edits: DataFrame, block: int) -> DataFrame:
    """Repaired rows: the block and ``place`` within it give their order; inserted ones have no turn, and ``edit`` is K, R or I."""
    null = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    texts = rows.select("conv", F.expr(f"at div {block}").alias("block"), "at", "turn", "role", "text", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("letters"))
    plans = edits.select("conv", "block", F.lit(-1).cast("long").alias("at"), null("turn"), null("role"), null("text"), "entry", "letters")
    both = texts.unionByName(plans).repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
    out = T.StructType([*[both.schema[c] for c in ("conv", "block")], T.StructField("place", T.IntegerType()), *[both.schema[c] for c in ("turn", "role", "text")], T.StructField("edit", T.StringType())])

    def work(stream: Iterator[dict]) -> Iterator[tuple]:
        conv = number = None
        state, place, letters = START, 0, iter("")

        def insert() -> tuple:
            nonlocal state, place
            made = conv, number, place, None, GIVEN[state], "", "I"
            state, place = THEN[state], place + 1
            return made

        for r in stream:
            if r["letters"] is not None:
                yield from (insert() for _ in letters)  # behind the last row of the block before
                conv, number, state, place, letters = r["conv"], r["block"], r["entry"], 0, iter(r["letters"])
                continue
            while (letter := next(letters)) == "I":
                yield insert()
            if letter == "D":
                continue
            role = r["role"] if letter == "K" else GIVEN[state]
            yield conv, number, place, r["turn"], role, r["text"], letter
            state, place = NEXT[state, role[0]], place + 1
        yield from (insert() for _ in letters)

    return mapped(both, out, work)


def digests(repaired: DataFrame, edits: DataFrame) -> DataFrame:
    """For each conversation the ``audit`` of its edits, their ``cost``, ``illegal`` pairs, and the SHA-256 of its repaired ``role:text`` lines.

    A digest is made in one pass from front to end, over chunks that stand for many rows.
    """

    def chunks(rows: Iterator[dict]) -> Iterator[tuple]:
        at, part, held, size = None, 0, [], 0
        for r in rows:
            if (r["conv"], r["block"]) != at or size > CHUNK:
                if held:
                    yield *at, part, "\n".join(held)
                part, held, size = (part + 1 if (r["conv"], r["block"]) == at else 0), [], 0
                at = r["conv"], r["block"]
            held.append(f"{r['role']}:{r['text']}")
            size += len(held[-1])
        if held:
            yield *at, part, "\n".join(held)

    head = [edits.schema[c] for c in ("conv", "block")]
    lines = mapped(repaired, T.StructType([*head, T.StructField("part", T.IntegerType()), T.StructField("lines", T.StringType())]), chunks)
    lines = lines.withColumns({"letters": F.lit(None).cast("string"), "cost": F.lit(None).cast("long"), "illegal": F.lit(None).cast("long")})
    both = lines.unionByName(edits.select("conv", "block", F.lit(-1).alias("part"), F.lit(None).cast("string").alias("lines"), "letters", "cost", "illegal"))

    def work(rows: Iterator[dict]) -> Iterator[tuple]:
        before, audit, numbers, digest, any_lines = object(), [], [0, 0], None, False
        for r in rows:
            if r["conv"] != before:
                if digest is not None:
                    yield before, "".join(audit), *numbers, digest.hexdigest()
                before, audit, numbers, digest, any_lines = r["conv"], [], [0, 0], hashlib.sha256(), False
            if r["lines"] is None:
                audit.append(r["letters"])
                numbers = [numbers[0] + r["cost"], numbers[1] + r["illegal"]]
            else:
                digest.update((b"\n" if any_lines else b"") + r["lines"].encode("utf-8", "surrogatepass"))
                any_lines = True
        if digest is not None:
            yield before, "".join(audit), *numbers, digest.hexdigest()

    out = T.StructType([head[0], T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("repaired_sha256", T.StringType())])
    return mapped(along(both, F.asc("block"), F.asc("part")), out, work)


class Repair(NamedTuple):
    """What :func:`repair` finds: faults of rows, edits by block, repaired rows in order of ``block`` and ``place``."""

    faults: DataFrame
    edits: DataFrame
    rows: DataFrame


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> Repair:
    """The cheapest repair of each conversation."""
    rows = in_order(df, id_col, turn_col, role_col, text_col)
    found = faults(rows)
    edits = with_paths(with_borders(blocks_of(found, block)))
    return Repair(found, edits, edited(rows, edits, block))


def report(df: DataFrame, made: Repair, id_col: str) -> DataFrame:
    """One row for each conversation of ``df``: faults, gaps between turns, cost and audit of the repair, digest of its result."""
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    turns = made.faults.groupBy("conv", "turn").agg(*map(count, ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("conv").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    parts = df.select(df[id_col].alias("conv")).distinct()
    for part in (counts, digests(made.rows, made.edits)):
        parts = parts.unionByName(part, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return parts.groupBy(F.col("conv").alias(id_col)).agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))


def damaged(df: DataFrame) -> DataFrame:
    """The query's faults, by a hash of each row's identifier and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations`` repaired, after the contract's damage."""
    conversations = table(spark, sf_dir, "conversations")
    return report(conversations, repair(damaged(conversations)), "conv_id")
