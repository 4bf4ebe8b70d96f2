"""Quantities in label text: tokens, units, masses, column headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KJ_PER_KCAL = 4.184

# Units by word, and column headers; fixed values.
UNITS = {"kj": ["kj"], "kcal": ["kcal", "cal", "calories"], "g": ["g", "gm", "grams"], "mg": ["mg"], "mcg": ["mcg", "µg", "ug"], "ml": ["ml"], "percent": ["%"]}
HEADERS = [("per serving", "per_serving"), ("per serve", "per_serving"), ("per 100g", "per_100g"), ("per 100 g", "per_100g"), ("per 100ml", "per_100ml"), ("per 100 ml", "per_100ml")]
COLUMNS = ["per_serving", "per_100g", "per_100ml"]

#: Bound mark (group 1), number (2) and unit word (3).  A digit behind a letter starts no number; a bound mark may stand before spaces.
TOKEN = r"(?=\d)(?<!\p{IsAlphabetic})(?:(?<=(<|less than) {0,60}))?(\d(?:\d|[.,](?=\d))*) *([\p{IsAlphabetic}%]*)"


def round3(value: Column) -> Column:
    """Three decimals, halves away from zero."""
    return F.round(value * 1000, 0) / 1000


def amount(number: Column) -> Column:
    """Value of a number as printed: a comma before exactly three digits parts thousands, another is a decimal mark."""
    plain = F.regexp_replace(F.regexp_replace(number, r",(?=\d{3}(?!\d))", ""), ",", ".")
    return plain.try_cast("double")


def unit_of(word: Column) -> Column:
    out = F.when(word == "", F.lit(None).cast("string"))
    for unit, names in UNITS.items():
        out = out.when(word.isin(names), unit)
    return out.otherwise("other")


def quantities(text: Column) -> Column:
    """All quantities of lower-case text in order: amount, unit (null: none), upper_bound."""
    part = lambda n: F.regexp_extract_all(text, F.lit(TOKEN), F.lit(n))
    rows = F.arrays_zip(part(1).alias("mark"), part(2).alias("number"), part(3).alias("word"))
    made = F.transform(rows, lambda q: F.struct(amount(q["number"]).alias("amount"), unit_of(q["word"]).alias("unit"), (q["mark"] != "").alias("upper_bound")))
    return F.filter(made, lambda q: q["amount"].isNotNull())


def metric(quantity_array: Column) -> Column:
    """The last quantity in g or ml, or null."""
    found = F.filter(quantity_array, lambda q: q["unit"].isin("g", "ml"))
    return F.get(found, F.size(found) - 1)


def header_columns(text: Column) -> Column:
    """Columns that header phrases in lower-case text name, in the order they stand."""
    first = [F.when(F.locate(phrase, text) > 0, F.struct(F.locate(phrase, text).alias("at"), F.lit(column).alias("column"))) for phrase, column in HEADERS]
    return F.array_distinct(F.transform(F.array_sort(F.array_compact(F.array(*first))), lambda h: h["column"]))


def header_serving(text: Column) -> Column:
    """The serving size named inside a column header, or null."""
    after = F.regexp_extract(text, r"(?s)^.*?per serv(.*)$", 1)
    return metric(quantities(F.substring_index(after, "per ", 1)))


def normal_mass(value: Column, unit: Column, nutrient: Column) -> Column:
    """Grams of a mass (milligrams for sodium), or null for other units."""
    grams = F.when(unit == "g", value).when(unit == "mg", value / 1000.0).when(unit == "mcg", value / 1000000.0)
    return F.when(nutrient == "sodium_mg", grams * 1000.0).otherwise(grams)
