"""Nutrition labels: line classes, row readings, spatial cells, first-wins fields and cross-field checks.

Lines are rows (doc, page, reading_order, observation_id, text, confidence,
polygon).  Values are never changed by a check and never guessed: a cell that
can't be told apart gives nothing.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantity as Q
from ..functions.ids import gtin_valid
from ..sources.staging import staged

MOST_LABEL_CHARS = 40

# Row prefixes, words that rule a row out, label units and locale markers; fixed values.
ROWS = [
    ("saturated", "saturated_fat_g"), ("sugar", "sugars_g"), ("fibre", "fibre_g"), ("fiber", "fibre_g"), ("dietary fibre", "fibre_g"), ("dietary fiber", "fibre_g"),
    ("energy", "energy"), ("calories", "calories"), ("protein", "protein_g"), ("fat", "fat_g"), ("carbohydrate", "carbohydrate_g"), ("sodium", "sodium_mg"),
]
EXCLUDED = ["unsaturated", "trans", "added", "includes", "from"]
LABEL_UNITS = [("(g)", "g"), ("(mg)", "mg"), ("(kcal)", "kcal"), ("(kj)", "kj")]
LOCALES = [("fssai", "en-IN"), ("nutrition facts", "en-US"), ("nutrition information", "en-AU")]
NUTRIENTS = ["energy_kj", "energy_kcal", "protein_g", "fat_g", "saturated_fat_g", "carbohydrate_g", "sugars_g", "fibre_g", "sodium_mg"]
ERRORS = ["nutrition_panel_not_found", "nutrition_columns_unidentified", "nutrition_row_incomplete"]


def row_label(text: Column) -> Column:
    """The cleaned label of a row: what stands before the first digit or <, without bullets and lead words; null if too long."""
    raw = F.regexp_extract(text, r"(?s)^([^0-9<]*)", 1)
    label = F.regexp_replace(raw, r"^[-–—•*· ]+", "")
    label = F.regexp_replace(F.regexp_replace(label, "^of which ", ""), "^total ", "")
    return F.when(F.length(raw) <= MOST_LABEL_CHARS, label)


def row_kind(label: Column) -> Column:
    """What the nutrient row of a cleaned label is about, or null."""
    out = F.when(label.isNull() | label.rlike("|".join(EXCLUDED)), F.lit(None).cast("string"))
    for prefix, kind in ROWS:
        out = out.when(label.startswith(prefix), kind)
    return out


def label_unit(label: Column) -> Column:
    return F.coalesce(*[F.when(label.contains(mark), F.lit(unit)) for mark, unit in LABEL_UNITS])


def classify(lines: DataFrame) -> DataFrame:
    """Each line with its lower text, quantities and class; the first class that fits counts."""
    low = lines.withColumn("lower", F.lower("text"))
    # Each costly part in a projection of its own, so that it is computed once.
    low = low.withColumns({"label": row_label(F.col("lower")), "columns": Q.header_columns(F.col("lower")), "quantities": Q.quantities(F.col("lower"))})
    low = low.withColumns({"kind": row_kind(F.col("label")), "given": label_unit(F.col("label"))}).drop("label")
    cls = (
        F.when(F.col("lower").contains("servings per"), "servings").when(F.size("columns") > 0, "header")
        .when(F.col("lower").contains("serving size") | F.col("lower").contains("serve size"), "serving").when(F.col("kind").isNotNull(), "row").otherwise("other")
    )
    return low.withColumn("class", cls).withColumn("at", F.struct("page", "reading_order"))


def read_array(quantities: Column, kind: Column, given: Column) -> Column:
    """A row's quantities as nutrient, slot (the place among the row's amounts of that nutrient) and amount; a bound takes a slot but gives nothing."""
    given, energy = F.coalesce(given, F.when(kind == "calories", "kcal")), kind.isin("energy", "calories")

    def read(q: Column, i: Column) -> Column:
        unit = F.coalesce(q["unit"], given)
        nutrient = F.when(energy & (unit == "kj"), "energy_kj").when(energy & (unit == "kcal"), "energy_kcal").when(~energy, kind)
        value = F.when(energy, q["amount"]).otherwise(Q.normal_mass(q["amount"], unit, kind))
        return F.struct(i.alias("i"), nutrient.alias("nutrient"), value.alias("amount"), q["upper_bound"].alias("bound"))

    told = F.filter(F.transform(quantities, read), lambda r: r["nutrient"].isNotNull() & r["amount"].isNotNull())
    slot = lambda all_, r: F.size(F.filter(all_, lambda o: (o["nutrient"] == r["nutrient"]) & (o["i"] < r["i"])))
    shaped = lambda all_: F.transform(F.filter(all_, lambda r: ~r["bound"]), lambda r: F.struct(r["i"].alias("i"), r["nutrient"].alias("nutrient"), slot(all_, r).alias("slot"), r["amount"].alias("amount")))
    # The array of an array, so that what is told is made once.
    return F.flatten(F.transform(F.array(told), shaped))


# -- spatial rows -------------------------------------------------------------


class Box(NamedTuple):
    left: float
    right: float
    top: float
    bottom: float

    @property
    def middle(self) -> float:
        return (self.left + self.right) / 2


def turned(polygon: list, cosine: float, sine: float) -> Box:
    """Bounds of a polygon in axes turned to the panel's text."""
    xs = [p["x"] * cosine + p["y"] * sine for p in polygon]
    ys = [p["y"] * cosine - p["x"] * sine for p in polygon]
    return Box(min(xs, default=math.inf), max(xs, default=-math.inf), min(ys, default=math.inf), max(ys, default=-math.inf))


def panel_angle(polygons: list[list]) -> float:
    """The upper median of the directions of first edges."""
    edges = [(p[1]["x"] - p[0]["x"], p[1]["y"] - p[0]["y"]) for p in polygons if len(p) > 1]
    angles = sorted(math.atan2(y, x) for x, y in edges if math.hypot(x, y) > 2.220446049250313e-16)
    return angles[len(angles) // 2] if angles else 0.0


def same_row(a: Box, b: Box) -> bool:
    return min(a.bottom, b.bottom) - max(a.top, b.top) > 0.5 * min(a.bottom - a.top, b.bottom - b.top)


def page_cells(rows: list[dict]) -> list[tuple[int, int, int, int]]:
    """For the label lines of a page without numbers: (label, cell, header, slot) by place of the lines, where they are told apart.

    Lines have class, kind, lower, polygon, columns, n_quantities and ``slots``
    (the document's columns found before a line, in order).
    """
    angle = panel_angle([r["polygon"] for r in rows if r["kind"] is not None])
    boxes = [turned(r["polygon"], math.cos(angle), math.sin(angle)) for r in rows]
    labels = [i for i, r in enumerate(rows) if r["kind"] is not None]
    digits = [i for i, r in enumerate(rows) if (t := r["lower"].lstrip()) and (t[0] in "0123456789<")]
    found = []
    for i in labels:
        row, box = rows[i], boxes[i]
        if row["class"] != "row" or row["n_quantities"]:
            continue
        slots = list(row["slots"])
        heads = [(slots.index(r["columns"][0]), j) for j, r in enumerate(rows) if len(r["columns"]) == 1 and r["columns"][0] in slots and boxes[j].bottom < box.top and boxes[j].left > box.right]
        if not slots or sorted(s for s, _ in heads) != list(range(len(slots))):
            continue  # a missing or doubled header would shift values
        for slot, j in heads:
            cells = []
            for k in digits:
                cell = boxes[k]
                if cell.left <= box.right or not same_row(box, cell):
                    continue
                away = abs(cell.middle - boxes[j].middle)
                if away > max(boxes[j].right - boxes[j].left, cell.right - cell.left):
                    continue
                if any(s != slot and abs(cell.middle - boxes[h].middle) <= away for s, h in heads):
                    continue
                if any(m != i and same_row(boxes[m], cell) for m in labels):
                    continue
                cells.append(k)
            if len(cells) == 1:
                found.append((i, cells[0], j, slot))
    return found


CELLS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("label", "cell", "header", "slot")]))


@F.pandas_udf(CELLS)
def match_cells(pages: pd.Series) -> pd.Series:
    """Cells of pages, each an array of its lines in their order."""
    return pd.Series([[dict(zip(CELLS.elementType.names, c)) for c in page_cells(list(lines))] for lines in pages], dtype=object)


def before(known: Column, at: Column) -> Column:
    """The columns found before a line, in order."""
    return F.transform(F.filter(known, lambda k: k["since"] < at), lambda k: k["column"])


def spatial_readings(lines: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """Readings of rows whose numbers stand in other lines of the page (a page's lines meet in one row), with the least confidence of label, cell and header."""
    bare = (F.col("class") == "row") & (F.size("quantities") == 0)
    pages = lines.where(bare).select(doc, "page").distinct().hint("merge")
    parts = ("reading_order", "class", "kind", "given", "lower", "polygon", "columns", "quantities", "confidence")
    small = lines.join(pages, [doc, "page"], "left_semi").select(doc, "page", F.struct(*parts).alias("line"))
    whole = small.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct(F.col("line.reading_order").alias("place"), "line"))).alias("lines"))
    whole = whole.withColumn("lines", F.transform("lines", lambda x: x["line"])).join(known.hint("merge"), doc, "left")
    none = F.array().cast(known.schema["known"].dataType)
    seen = F.coalesce("known", none)
    told = lambda x: F.struct(*[x[c].alias(c) for c in ("class", "kind", "lower", "polygon", "columns")], F.size(x["quantities"]).alias("n_quantities"), before(seen, F.struct(F.col("page"), x["reading_order"])).alias("slots"))
    # Written before and after, so that the function's argument is a column and its result nothing that the planner moves.
    asked = staged(whole.select(doc, "page", "lines", F.transform("lines", told).alias("told")), "pages")
    matched = staged(asked.select(doc, "page", "lines", match_cells("told").alias("cells")), "cells")
    cells = matched.select(doc, "page", "lines", F.explode("cells").alias("c"))
    line = lambda part: F.get("lines", F.col(f"c.{part}"))
    cells = cells.select(doc, "page", line("label").alias("label"), line("cell").alias("cell"), line("header").alias("header"), "c.slot")
    at = F.struct("page", F.col("label.reading_order").alias("reading_order")).alias("at")
    found = cells.select(doc, at, "slot", F.least("label.confidence", "cell.confidence", "header.confidence").alias("confidence"), F.explode(read_array(F.col("cell.quantities"), F.col("label.kind"), F.col("label.given"))).alias("r"))
    # A cell's readings all go to its header's column.
    return found.select(doc, "at", "slot", "confidence", "r.i", "r.nutrient", "r.amount")


# -- documents ----------------------------------------------------------------


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(best)).where("__first = 1").drop("__first")


def extract(lines: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Fields (``doc``, name, value, confidence) and failures (``doc``, code, severity) of each document's label.

    What a line says is told from the line; lines then meet once, as one row of each document, with arrays of what their checks and fields
    need.  All tables grow with the documents, so none is broadcast.
    """
    c = staged(classify(lines), "classified")
    is_row, bare = F.col("class") == "row", F.size("quantities") == 0
    size = F.when(F.col("class") == "header", Q.header_serving(F.col("lower"))).when(F.col("class") == "serving", Q.metric(F.col("quantities")))
    told = c.select(
        doc, "at", "confidence", F.when(F.col("class") == "header", F.col("columns")).alias("heads"), F.when(is_row & ~bare, read_array(F.col("quantities"), F.col("kind"), F.col("given"))).alias("own"),
        (is_row & F.exists("quantities", lambda q: q["upper_bound"])).alias("bound"), (is_row & bare).alias("bare"), size.alias("size"), *single_fields(),
    )
    first = lambda value, *order: F.min_by(F.struct(value.alias("value"), F.col("confidence").alias("confidence")), F.struct(*order, "at", "confidence"))
    some = lambda condition, *cols: F.collect_list(F.when(condition, F.struct(*cols)))
    docs = told.groupBy(doc).agg(
        F.sort_array(some(F.col("heads").isNotNull(), "at", "heads", "confidence")).alias("heads"), some(F.size("own") > 0, "at", "confidence", "own").alias("rows"),
        F.collect_list(F.when(F.col("bare"), F.col("at"))).alias("bare"), F.bool_or("bound").alias("bound"), first(F.when(F.col("size").isNotNull(), F.col("size")), F.col("size").isNull()).alias("serving"),
        *[first(F.col(f"{name}.value"), F.col(name).isNull(), F.col(f"{name}.rank")).alias(name) for name in SINGLE],
    )
    # Each column where it is found first, in that order.
    every = F.flatten(F.transform("heads", lambda h: F.transform(h["heads"], lambda x: F.struct(x.alias("column"), h["at"].alias("since")))))
    docs = docs.withColumn("every", every).withColumn("names", F.array_distinct(F.transform("every", lambda x: x["column"])))
    docs = docs.withColumn("known", F.transform("names", lambda name: F.struct(name.alias("column"), F.filter("every", lambda x: x["column"] == name)[0]["since"].alias("since")))).drop("every", "names")
    docs = staged(docs, "documents")

    reading = lambda at, r, slot, confidence: F.struct(at.alias("at"), r["i"].alias("i"), r["nutrient"].alias("nutrient"), slot.alias("slot"), r["amount"].alias("amount"), confidence.alias("confidence"))
    own = F.flatten(F.transform("rows", lambda x: F.transform(x["own"], lambda r: reading(x["at"], r, r["slot"], x["confidence"]))))
    docs = docs.withColumn("readings", own)
    if docs.where(F.size("bare") > 0).isEmpty():
        docs = docs.withColumn("spatial", F.slice("readings", 1, 0))
    else:
        spatial = spatial_readings(c, docs.select(doc, "known").where(F.size("known") > 0), doc)
        spatial = spatial.groupBy(doc).agg(F.collect_list(F.struct("at", "i", "nutrient", "slot", "amount", "confidence")).alias("spatial"))
        docs = docs.join(spatial.hint("merge"), doc, "left").withColumn("spatial", F.coalesce("spatial", F.slice("readings", 1, 0)))
    docs = docs.withColumn("readings", F.concat("readings", "spatial"))
    # A row without numbers is incomplete where fewer columns have a cell of their own than stand before it.
    filled = lambda at: F.size(F.array_distinct(F.transform(F.filter("spatial", lambda r: r["at"] == at), lambda r: r["slot"])))
    incomplete = F.exists("bare", lambda at: filled(at) < F.size(before(F.col("known"), at)))
    headed, panel = F.size("known") > 0, (F.size("readings") > 0) | F.col("bound")
    docs = docs.withColumns({"headed": headed, "panel": panel, "incomplete": incomplete})
    placed = F.filter("readings", lambda r: r["slot"] < F.size("known"))
    key = lambda r: F.struct(r["slot"], r["nutrient"])
    ordered = F.array_sort(F.transform(placed, lambda r: F.struct(r["at"].alias("at"), r["i"].alias("i"), r["slot"].alias("slot"), r["nutrient"].alias("nutrient"), r["amount"].alias("amount"), r["confidence"].alias("confidence"))))
    docs = docs.withColumn("readings", ordered)
    wins = F.filter("readings", lambda r, i: ~F.exists(F.slice("readings", F.lit(1), i), lambda o: key(o) == key(r)))
    value = lambda r: F.struct(F.get("known", r["slot"])["column"].alias("column"), r["nutrient"].alias("nutrient"), r["amount"].alias("amount"), r["confidence"].alias("confidence"))
    docs = docs.withColumn("values", F.when(F.col("panel") & F.col("headed"), F.transform(wins, value)))
    docs = staged(docs.select(doc, "headed", "panel", "incomplete", "known", "values", "serving", *SINGLE, F.array_min(F.transform("heads", lambda h: h["confidence"])).alias("head_confidence")), "labels")

    codes = F.array_compact(F.array(F.when(F.col("incomplete"), F.lit(ERRORS[2])), F.when(~F.col("panel"), F.lit(ERRORS[0])).when(~F.col("headed"), F.lit(ERRORS[1]))))
    failures = docs.select(doc, F.explode(codes).alias("code"), F.lit("error").alias("severity"))
    text = lambda name, value, confidence: F.struct(name.alias("name"), value.alias("value"), confidence.alias("confidence"))
    values = F.transform(F.coalesce("values", F.array().cast(docs.schema["values"].dataType)), lambda v: text(F.concat_ws(".", v["column"], v["nutrient"]), Q.round3(v["amount"]).cast("string"), v["confidence"]))
    serving = F.to_json(F.struct(Q.round3(F.col("serving.value.amount")).alias("amount"), F.col("serving.value.unit").alias("unit")))
    heads = F.to_json(F.transform("known", lambda k: k["column"]))
    others = [F.when(F.col("serving.value").isNotNull(), text(F.lit("serving_size"), serving, F.col("serving.confidence"))), F.when(F.col("values").isNotNull(), text(F.lit("column_headers"), heads, F.col("head_confidence")))]
    others += [F.when(F.col(f"{name}.value").isNotNull(), text(F.lit(name), F.col(f"{name}.value"), F.col(f"{name}.confidence"))) for name in SINGLE]
    fields = docs.select(doc, F.inline(F.concat(values, F.array_compact(F.array(*others)))))
    return fields, failures.unionByName(checks(docs, doc))


#: Fields of which the first line that has one gives the value.
SINGLE = ("servings_per_pack", "barcode", "locale")


def single_fields() -> list[Column]:
    """Servings per pack, bar code and locale of a line, each with its rank before the line's place; null where it has none."""
    digits = F.regexp_replace("text", r"(?U)\s+", "")
    made = lambda value, rank: F.struct(value.alias("value"), F.lit(rank).alias("rank"))
    pack = F.when((F.col("class") == "servings") & (F.size("quantities") > 0), made(Q.round3(F.get("quantities", F.lit(0))["amount"]).cast("string"), 0))
    bar = F.when((F.col("class") == "other") & gtin_valid(digits), made(digits, 0))
    locale = F.coalesce(*[F.when(F.col("lower").contains(m), made(F.lit(v), i)) for i, (m, v) in enumerate(LOCALES)])
    return [c.alias(name) for c, name in zip((pack, bar, locale), SINGLE)]


def checks(docs: DataFrame, doc: str) -> DataFrame:
    """Warnings on documents' ``values`` (column, nutrient, amount) that don't agree, and with their ``serving``; each code once for a document."""
    columns = F.array_distinct(F.transform("values", lambda v: v["column"]))
    every = docs.where("values is not null").select(doc, "values", "serving", F.explode(columns).alias("column"))
    amount = lambda column, nutrient: F.get(F.filter("values", lambda x: (x["column"] == column) & (x["nutrient"] == nutrient)), F.lit(0))["amount"]
    wide = every.select(doc, "column", "values", "serving", *[amount(F.col("column"), F.lit(n)).alias(n) for n in NUTRIENTS])
    v = F.col
    kcal = F.coalesce(v("energy_kcal"), v("energy_kj") / Q.KJ_PER_KCAL)
    atwater = 4.0 * v("protein_g") + 4.0 * v("carbohydrate_g") + 9.0 * v("fat_g")
    zero = lambda c: F.coalesce(v(c), F.lit(0.0))
    solids = zero("protein_g") + zero("fat_g") + zero("carbohydrate_g") + zero("fibre_g")
    # Served amounts against those of the reference column.
    reference = F.when(v("serving.value.unit") == "ml", "per_100ml").otherwise("per_100g")
    expected = lambda per_100: per_100 * v("serving.value.amount") / 100.0
    odd = lambda n: F.abs(v(n) - expected(amount(reference, F.lit(n)))) > F.greatest(0.1 * expected(amount(reference, F.lit(n))), F.lit(0.5))
    differ = F.array_contains(F.array(*[F.coalesce(odd(n), F.lit(False)) for n in NUTRIENTS]), True)
    rules = [
        ((v("energy_kcal") > 0) & ~(v("energy_kj") / v("energy_kcal")).between(3.9, 4.5), "energy_unit_mismatch"),
        (F.abs(atwater - kcal) > F.greatest(0.2 * kcal, F.lit(15.0)), "energy_atwater_mismatch"),
        (v("saturated_fat_g") > v("fat_g") + 0.05, "saturated_fat_exceeds_fat"), (v("sugars_g") > v("carbohydrate_g") + 0.05, "sugars_exceed_carbohydrate"),
        ((v("column") == "per_100g") & (solids > 101.0), "per_100g_exceeds_100g"), ((v("column") == "per_serving") & v("serving.value").isNotNull() & differ, "serving_column_mismatch"),
    ]
    found = wide.select(doc, F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in rules]))).alias("code"))
    return found.distinct().withColumn("severity", F.lit("warning"))


#: Registered extractions by schema and version; anything else is unregistered.
REGISTRY = {("nutrition_label", "1"): extract}


def registered(schema: Column, version: Column) -> Column:
    ok = F.lit(False)
    for name, v in REGISTRY:
        ok = ok | ((schema == name) & (version == v))
    return F.coalesce(ok, F.lit(False))
