"""Nested schemas of pages and results, and a strict JSON reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
OBSERVATION = f"struct<observation_id:string,level:string,text:string,confidence:double,polygon:struct<points:array<{POINT}>>,reading_order:int,parent_observation_id:string>"
PAGE = f"struct<page:int,width:int,height:int,observations:array<{OBSERVATION}>>"
EVIDENCE = f"struct<page:int,polygon:struct<points:array<{POINT}>>,observation_id:string>"
RESULT = (
    f"struct<document_id:string,document_version:string,text:string,markdown:string,pages:array<{PAGE}>,citations:array<{EVIDENCE}>,"
    f"fields:map<string,struct<value:string,confidence:double,evidence:array<{EVIDENCE}>>>,warnings:array<string>,"
    "validation_failures:array<struct<code:string,severity:string>>,processing_provenance:struct<provider:string,model:string,profile:string,duration_ms:bigint>>"
)


def known_keys(schema: T.DataType, at: str = "$") -> dict[str, set[str]]:
    """The allowed keys of each object in a schema, by path; arrays and maps count as ``[*]``."""
    if isinstance(schema, T.ArrayType):
        return known_keys(schema.elementType, at + "[*]")
    if isinstance(schema, T.MapType):
        return known_keys(schema.valueType, at + "[*]")
    if not isinstance(schema, T.StructType):
        return {}
    out = {at: set(schema.fieldNames())}
    for f in schema.fields:
        out |= known_keys(f.dataType, f"{at}.{f.name}")
    return out


def decode_strict(df: DataFrame, json_col: str, schema: str, out: str = "decoded") -> DataFrame:
    """Decode JSON to ``schema``; text that isn't such JSON, or has keys the top object doesn't know, gives null and a ``decode_error``."""
    parsed = T._parse_datatype_string(schema)
    known = F.array(*[F.lit(k) for k in parsed.fieldNames()])
    keys = F.json_object_keys(F.col(json_col))
    value = F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE"})
    extra = F.array_except(keys, known)
    error = F.when(keys.isNull(), "not_an_object").when(F.size(extra) > 0, F.concat(F.lit("unknown:"), F.array_join(F.array_sort(extra), ",")))
    return df.withColumn("decode_error", error).withColumn(out, F.when(F.col("decode_error").isNull(), value))


def json_rows(df: DataFrame, json_col: str, schema: str, *keys: str) -> DataFrame:
    """Rows from a JSON array of objects: the ``keys``, the ``element`` number from 0 and the fields of ``schema``; text that isn't such an array is one row with an ``error``."""
    read = df.select(*keys, F.col(json_col).alias("__json"), F.from_json(json_col, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"}).alias("__read"), F.json_array_length(json_col).alias("__size"))
    # A text that is cut off reads as less than it says, or as nothing.
    good = F.coalesce(F.size("__read") == F.col("__size"), F.lit(False)) & F.coalesce(F.forall("__read", lambda x: x.isNotNull()), F.lit(False))
    rows = read.select(*keys, F.when(~good, "not_an_array").alias("error"), F.when(good, F.col("__read")).alias("__read"))
    names = [F.col(f"__x.{n}").alias(n) for n in T._parse_datatype_string(schema).fieldNames()]
    return rows.select(*keys, "error", F.posexplode_outer("__read").alias("element", "__x")).where("error is not null or element is not null").select(*keys, "error", "element", *names)


def flatten_pages(df: DataFrame, pages_col: str, *keys: str) -> DataFrame:
    """One row for each observation of an array of pages."""
    pages = df.select(*keys, F.explode(pages_col).alias("p")).select(*keys, "p.page", "p.width", "p.height", F.explode("p.observations").alias("o"))
    return pages.select(*keys, "page", "width", "height", "o.observation_id", "o.level", "o.text", "o.confidence", F.col("o.polygon.points").alias("polygon"), "o.reading_order", "o.parent_observation_id")


def nest_pages(observations: DataFrame, *keys: str) -> DataFrame:
    """Observations of a document back as an array of pages in reading order."""
    one = F.struct("reading_order", "observation_id", "level", "text", "confidence", "polygon", "parent_observation_id")
    pages = observations.groupBy(*keys, "page", "width", "height").agg(F.sort_array(F.collect_list(one)).alias("observations"))
    return pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "width", "height", "observations"))).alias("pages"))


def sniff(content: Column) -> Column:
    """MIME type by the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
    )
