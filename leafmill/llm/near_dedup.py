"""Near-duplicate groups by bottom-k sketches.

1. One hash function gives each text's shingle set and its sketch, the k
   smallest hashes.  Texts with one set are a class with one representative, the
   row with the smallest id (and print of the text); a class's node is a number
   from these two, so an id may stand on several texts.
2. Inverted lists of the retained hashes give candidates.  Sketches of two sets
   that are similar enough share at least a part of k hashes (``shared_part``; the
   chance of fewer is at most ``MISS``, and 2e-7 at similarity 0.8), so lists need only hold
   each class under the rarest of its hashes, by the prefix principle; classes
   with no other class beside them drop out.
3. In a first round each class is held against one hub of each list, the class
   with the most common hashes (of copies with edits, that is the original),
   and verified with the best.  Then the lists give each pair that no verified
   chain of links joins yet; so no list emits all its pairs, and every link
   between different components is found.  In crowded lists this would still be
   a product: their classes retain their whole sets.  Each is held against the
   most typical member of its lists first, the one with the most common values,
   which the whole sets tell better than the sketches; then lists hold the smaller set of a
   pair under its shorter indexing prefix only, the larger one under its probing prefix, and the
   position filter says which of the pairs that are still apart can reach the
   threshold.
4. Candidates pass a union-sketch estimate, then exact similarity of full sets.
5. Components come from contraction with pointer jumps, all in tables.

No key gets all of its rows into one task: facts of hot values, hubs and
components, which are few, are broadcast (``look_up``), a hub with very many
members is copied, with its members dealt over the copies, and so are long lists.

Cases: null and empty texts link with nothing; rows with a null id are in no
component (null) and kept; repeated rows have one component; rows that share an
id only are told apart by a print of their texts; ties go to the smallest id,
then print; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import look_up, map_text, scratch, settle, table
from .shingles import shingle_sets

SKETCH = 32
#: Part of a sketch that similar sets share at least, where a smaller one isn't needed for ``MISS``.
SHARED = 0.4
#: Greatest chance that two sets just similar enough share less.
MISS = 1e-6
#: Members of a list up to which it gives its pairs as they are; longer lists go by whole sets.
CROWD = 64
#: Members of a hub that go to one copy of it.
PER_COPY = 2_000

SKETCHES = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.StringType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType()))])


def sketches(df: DataFrame, keep: list[str], text_col: str, words: int, k: int = SKETCH) -> DataFrame:
    """Size, digest and bottom-k sketch of each text's shingle set; the digest is null for an empty set."""

    def start():
        def work(texts):
            sets = shingle_sets(texts, words)
            return [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], [s[:k] for s in sets]

        return work

    return map_text(df, start, text_col, keep, SKETCHES)


def full_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The whole shingle set of each text."""
    return map_text(df, lambda: lambda texts: [shingle_sets(texts, words)], text_col, [id_col], SETS)


def shared_part(percent: int, k: int) -> float:
    """Part of k hashes that sets of this similarity share, but for a chance of ``MISS``; raises if the sketch is too small to share any."""
    p = percent / 100
    below = least = 0  # the chance of fewer than ``least`` in common
    while least <= k and (below := below + math.comb(k, least) * p**least * (1 - p) ** (k - least)) <= MISS:
        least += 1
    if not least:
        raise ValueError(f"sketches of {k} hashes miss more than {MISS} of the pairs at {percent} %")
    return SHARED if math.ceil(k * SHARED) <= least else (least - 0.5) / k


def estimate(a: Column, b: Column, k: int) -> Column:
    """Part of the k smallest hashes of the union that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def comparable(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component, for edges ``a``, ``b``: hook to the smallest neighbour, jump, contract, repeat."""
    spark = edges.sparkSession
    links = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        hooks = settle(links.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "hooks")
        above = hooks.select(F.col("a").alias("to"), F.col("to").alias("top"))
        jumps = settle(look_up(hooks, above, "to", "left").select("a", F.coalesce("top", "to").alias("to")), "jumps")
        if labels is None:
            labels = settle(jumps.select(F.col("a").alias("node"), F.col("to").alias("component")), "labels")
        else:
            move = jumps.select(F.col("a").alias("component"), "to")
            labels = settle(look_up(labels, move, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        left, right = jumps.select("a", F.col("to").alias("x")), jumps.select(F.col("a").alias("b"), F.col("to").alias("y"))
        # Links stand in both directions, so each of the two joins has the same hot keys.
        kept = look_up(settle(look_up(links, left, "a").select("x", "b"), "half"), right, "b").select("x", "y")
        tops = jumps.select(F.col("to").alias("x")).join(jumps.select(F.col("a").alias("x"), F.col("to").alias("y")), "x")
        kept = kept.union(tops).where("x <> y")
        links = settle(kept.union(kept.select("y", "x")).distinct().toDF("a", "b"), "links")
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids``.  The ids grow with the data, so they are never broadcast, at any size."""
    return docs.join(ids.distinct().hint("merge"), "id", "left_semi")


def sets_of(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The full set of each of ``ids`` as a written table; ``docs`` has ``id`` and ``text`` of all of them."""
    return settle(full_sets(only(docs, ids), "id", "text", words), "sets")


def similar_pairs(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose full sets are similar enough."""
    pairs = settle(pairs, "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), docs, words)
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies"))
    dealt = look_up(pairs, copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    hubs = copies.join(sets.withColumnRenamed("id", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("hashes").alias("right"))
    held = dealt.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a").join(hubs, ["b", "copy"])
    both = F.size(F.array_intersect("left", "right"))
    held = held.select("a", "b", both.alias("both"), (F.size("left") + F.size("right")).alias("sum"))
    return settle(held.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b"), "similar")


def by_rarity(held: DataFrame) -> DataFrame:
    """For rows ``id``, ``value``: the values that several ids hold, rarest first, as ``shared`` of each id."""
    common = settle(held.groupBy("value").agg(F.count("*").alias("f")).where("f > 1"), "common")
    return look_up(held, common, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("shared"))


def open_pairs(lists: DataFrame, condition: Column) -> DataFrame:
    """Pairs from lists (``value``, ``id``, ``n``, ``place``, ``c``, ``large``, ``members``) across components, where ``condition`` holds for n, place and m, spot.

    Each pair has a member outside its list's largest component, which is never
    held against itself.  A long list is cut into copies, with all of those
    outside the largest component in each.  Where rows say whether they are ``indexed``,
    only pairs whose smaller set (of equal ones that with the smaller id) is so are formed.
    """
    copies, more = F.ceil(F.col("members") / PER_COPY).cast("int"), ["indexed"] if "indexed" in lists.columns else []
    left = lists.where("c <> large").select("value", F.col("id").alias("a"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("c").alias("d"), *more, F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    right = lists.select("value", F.col("id").alias("b"), "n", "place", "c", "large", *more, F.pmod(F.xxhash64("id"), copies).cast("int").alias("copy"))
    new = (F.col("c") != F.col("d")) & ((F.col("c") == F.col("large")) | (F.col("a") < F.col("b")))
    smaller = F.struct("m", "a") < F.struct(F.col("n").alias("m"), F.col("b").alias("a"))
    if more:
        found = left.where("indexed").drop("indexed").join(right.drop("indexed"), ["value", "copy"]).where(smaller)
        found = found.unionByName(left.drop("indexed").join(right.where("indexed").drop("indexed"), ["value", "copy"]).where(~smaller))
    else:
        found = left.join(right, ["value", "copy"])
    return found.where(new & condition).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def still_open(lists: DataFrame) -> DataFrame:
    """Rows of those lists (``value``, ``c``) that hold several components, and an ``indexed`` row if rows are, with the largest and the number of members."""
    lists = settle(lists, "placed")
    indexed = F.bool_or("indexed") if "indexed" in lists.columns else F.lit(True)
    sizes = lists.groupBy("value", "c").agg(F.count("*").alias("members"), indexed.alias("some"))
    largest = sizes.groupBy("value").agg(F.max_by("c", F.struct("members", "c")).alias("large"), F.count("*").alias("parts"), F.sum("members").alias("members"), F.bool_or("some").alias("some"))
    return look_up(lists, settle(largest.where("parts > 1 and some").drop("parts", "some"), "largest"), "value")


def likely(pairs: DataFrame, classes: DataFrame, k: int, part: float) -> DataFrame:
    """``pairs`` with the union-sketch estimate, without those below ``part``."""
    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("left"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("right"))
    scored = look_up(settle(pairs, "candidates"), right, "b").join(left, "a").select("a", "b", estimate(F.col("left"), F.col("right"), k).alias("part"))
    return scored.where(F.col("part") >= part)


def text_print(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(text)


def numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with a number ``id`` of their own instead of ``row``; another seed is taken should two have the same."""
    for seed in range(100):
        number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row.id"), F.col("row.print")), 1)
        if classes.groupBy(number.alias("id")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return classes.withColumn("id", number)
    raise ValueError("no seed tells the classes apart")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = SKETCH, exact: bool = False) -> DataFrame:
    """Component of each row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``; linked sets have Jaccard similarity of ``percent`` / 100 or more.

    ``component_id`` is the id of the kept row; where ids stand on several texts, ``near_duplicate_rows`` tells components apart.
    """
    return near_duplicate_rows(df, id_col, text_col, words, percent, k, exact).drop("text_print", "component_print")


def near_duplicate_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = SKETCH, exact: bool = False) -> DataFrame:
    """As ``near_duplicates``, with the ``text_print`` of each row and ``component_print``, that of the row its component keeps.

    With ``exact``, all classes go by whole sets, as those of crowded lists do,
    and no estimate drops a pair; this shuffles all shingles.
    """
    with scratch(df.sparkSession) as keep:
        made, members = grouped_rows(df, id_col, text_col, words, percent, k, exact)
        rows = made.select("id", "print", "n_shingles", "set_key")
        empty = rows.where("set_key is null").withColumn("first", F.lit(None).cast(members.schema["first"].dataType))
        placed = look_up(rows.where("set_key is not null"), members, "set_key", "left").unionByName(empty)
        out = keep(settle(placed.drop("set_key"), "components"))
    own = F.struct("id", "print")
    out = out.withColumn("smallest", F.when(F.col("id").isNotNull(), F.coalesce("first", own)))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", F.col("smallest.id").alias("component_id"), F.coalesce(F.col("smallest") == own, F.lit(True)).alias("kept"),
        F.col("print").alias("text_print"), F.col("smallest.print").alias("component_print"),
    )


def whole_lists(ids: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Inverted lists of whole sets by the prefix principle: ``id``, ``n``, ``typical`` (mean frequency of its values), ``place`` of ``value`` among them, and whether it is ``indexed``: early enough in a set that is the smaller of a pair."""
    sets = sets_of(ids, docs, words).withColumn("n", F.size("hashes").cast("long"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    whole = by_rarity(settle(sets.select("id", F.explode("hashes").alias("value")), "values")).join(sets.select("id", "n"), "id")
    alone, total = F.col("n") - F.size("shared"), F.aggregate("shared", F.lit(0).cast("long"), lambda t, x: t + x["f"])
    whole = whole.where(alone < most).select("id", "n", (total / F.col("n")).alias("typical"), alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), (most - alone).cast("int"))).alias("i", "x"))
    place = F.col("alone") + F.col("i") + 1
    # The smaller of two sets that reach the threshold has this much in common with the other, so their first common value stands this early in it.
    indexed = place <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
    return settle(whole.select("id", "n", "typical", place.alias("place"), F.col("x.value").alias("value"), indexed.alias("indexed")), "whole")


def whole_hubs(lists: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """One pair for each id of another component (``crowd``: ``id``, ``c``) than the most typical member of its lists: with that member."""
    hub = F.max_by(F.struct(F.col("id").alias("b"), F.col("n").alias("m"), "typical"), F.struct("typical", -F.col("id"))).alias("hub")
    found = look_up(lists, settle(lists.groupBy("value").agg(hub), "hubs"), "value").where((F.col("id") != F.col("hub.b")) & comparable(F.col("n"), F.col("hub.m"), percent))
    best = found.groupBy("id").agg(F.max_by("hub.b", F.struct("hub.typical", -F.col("hub.b"))).alias("b"))
    best = settle(best.join(crowd, "id").select(F.col("id").alias("a"), "c", "b"), "best")
    other = look_up(best, crowd.select(F.col("id").alias("b"), F.col("c").alias("d")), "b")
    return other.where("c <> d").select("a", "b")


def whole_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs across components (``c``) of :func:`whole_lists` that can reach the threshold, by position."""
    # Two sets of n and m reach the threshold only with this many in common, and no more can follow their first common value.
    needed = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    reach = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("spot")) + 1 >= needed
    return open_pairs(settle(still_open(lists), "open"), comparable(F.col("n"), F.col("m"), percent) & reach)


def grouped_rows(df: DataFrame, id_col: str, text_col: str, words: int, percent: int, k: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Two written tables: rows with digests of their sets (``id``, ``print``, ``n_shingles``, ``set_key``), and for each ``set_key`` the ``first`` row of its component."""
    part = shared_part(percent, k)
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).withColumn("print", text_print(F.col("text")))
    made = settle(sketches(docs, ["id", "print"], "text", words, k), "sketches")
    real = made.where("id is not null and set_key is not null")
    grouped = settle(real.groupBy("set_key").agg(F.min(F.struct("id", "print")).alias("row"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    classes = settle(numbered(grouped), "numbered")

    shared = by_rarity(settle(classes.select("id", F.explode("sketch").alias("value")), "values"))
    size = F.size("sketch")
    # The hashes that no other class has come first in the order by rarity, then the shared ones.
    prefix = size - F.ceil(size * part) + 1 - (size - F.size("shared"))
    lists = shared.join(classes, "id").where(prefix > 0)
    lists = lists.select("id", "n", F.size("shared").alias("typical"), F.explode(F.slice("shared", F.lit(1), prefix.cast("int"))).alias("x"))
    lists = settle(lists.select("id", "n", "typical", F.col("x.value").alias("value")), "lists")

    # Texts of the classes that stand in lists: all later rounds read these, not the whole corpus.
    listed = classes if exact else lists.select("id").distinct().join(classes, "id")
    rows = listed.select("row.id", "row.print", F.col("id").alias("node"))
    # Duplicates go by the join's own keys, so that texts are shuffled once.
    docs = docs.join(rows.hint("merge"), ["id", "print"]).dropDuplicates(["id", "print"])
    docs = settle(docs.select(F.col("node").alias("id"), "text"), "texts")

    hubs = settle(lists.groupBy("value").agg(F.max_by(F.struct(F.col("id").alias("b"), F.col("n").alias("m")), F.struct("typical", -F.col("id"))).alias("hub")), "hubs")
    to_hub = look_up(lists, hubs, "value").where((F.col("id") != F.col("hub.b")) & comparable(F.col("n"), F.col("hub.m"), percent))
    to_hub = to_hub.select(F.col("id").alias("a"), F.col("hub.b").alias("b")).distinct()
    best = likely(to_hub, classes, k, part).groupBy("a").agg(F.max_by("b", F.struct("part", -F.col("b"))).alias("b"))
    links = similar_pairs(best, docs, words, percent)

    grown = connected(links)
    component = grown.withColumnRenamed("node", "id")
    placed = lists.drop("typical").join(component, "id", "left").withColumn("c", F.coalesce("component", "id"))
    more = None
    if exact:
        crowd = classes.select("id").join(component, "id", "left").select("id", F.coalesce("component", "id").alias("c"))
    else:
        opened = settle(still_open(placed).withColumn("place", F.lit(0)), "open")
        rest = open_pairs(opened.where(F.col("members") <= CROWD), comparable(F.col("n"), F.col("m"), percent))
        more = similar_pairs(likely(rest, classes, k, part).select("a", "b"), docs, words, percent)
        crowd = opened.where(F.col("members") > CROWD).select("id", "c").distinct()

    if exact or not crowd.isEmpty():
        whole = whole_lists(crowd.select("id"), docs, words, percent)
        first = similar_pairs(whole_hubs(whole, crowd, percent), docs, words, percent)
        links = links.union(more.union(first) if more else first)
        component = connected(links).withColumnRenamed("node", "id")
        placed = whole.join(component, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        found = whole_pairs(placed, percent)
        more = similar_pairs(found if exact else likely(found, classes, k, part).select("a", "b"), docs, words, percent)
        grown = component.withColumnRenamed("id", "node")
    if not more.isEmpty():
        grown = connected(links.union(more))

    members = classes.select("set_key", "row", F.col("id").alias("node")).join(grown, "node", "left")
    members = settle(members.select("set_key", "row", F.coalesce("component", "node").alias("group")), "groups")
    first = members.groupBy("group").agg(F.min("row").alias("first"))
    return made, settle(look_up(members, first, "group").select("set_key", "first"), "members")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: three-word shingles, similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


#: Every pair of texts that share a shingle, by exact similarity; components by all that can be reached.  For tables with unique ids.
ORACLE = r"""
with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from worded),
shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as common from shingles a join shingles b on a.x = b.x and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared where 100 * common >= 85 * (n + m - common)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, cast(len(s) as bigint) as n_shingles, c as component_id, doc_id = c as kept
from sets join (select a, min(b) as c from reach group by a) on a = doc_id
"""
