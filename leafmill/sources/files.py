"""Readers and writers of files: hash-pinned scans, manifests, provider responses, layout XML, and create-only objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_CASE = "id string, image string, sha256 string, document_type string, quality string, language_hints array<string>, reference_text string, expected_fields map<string,string>, extraction struct<schema_id:string,schema_version:string>"
SAMPLE = "id string, sha256 string, status string, elapsed_ms bigint, text string, fields map<string,struct<value:string>>"
SEGMENT = "struct<startIndex:string,endIndex:string>"
ANCHOR = f"struct<textSegments:array<{SEGMENT}>>"
VERTEX = "struct<x:double,y:double>"
LAYOUT = f"struct<textAnchor:{ANCHOR},confidence:double,boundingPoly:struct<normalizedVertices:array<{VERTEX}>>>"
PROVIDER = f"struct<document:struct<text:string,pages:array<struct<pageNumber:int,lines:array<struct<layout:{LAYOUT}>>>>>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a benchmark manifest file."""
    whole = spark.read.schema(f"version string, provenance string, cases array<struct<{_fields(MANIFEST_CASE)}>>").json(path, multiLine=True)
    return whole.select(F.explode("cases").alias("c")).select("c.*")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Recorded samples, one JSON object a line or one array."""
    s = spark.read.schema(SAMPLE).json(path, multiLine=True)
    return s.withColumn("fields", F.transform_values("fields", lambda _, v: v["value"]))


def _fields(ddl: str) -> str:
    """Top-level ``name type`` pairs of a schema as fields of a struct."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path``: ``name`` (the path from there), ``length``, and ``generation``, the time of their last change in milliseconds."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"), "length", F.unix_millis("modificationTime").alias("generation"), "content")


def pinned(spark: SparkSession, path: str, expected: DataFrame, most_bytes: int = 20 << 20) -> DataFrame:
    """Files under ``path`` held against ``expected`` (name, the path from there; sha256; maybe length and generation): ok, missing, too_large, other_version, changed or outside.

    Files that are too large are told by the listing and not read; those of another version or length than the expected one aren't hashed.
    """
    files = listing(spark, path)
    found = files.select("name", F.col("length").alias("found_length"), F.col("generation").alias("found_generation"))
    j = expected.join(found, "name", "left")
    outside = F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")
    other = F.lit(False)
    for c in ("length", "generation"):
        if c in expected.columns:
            other = other | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"found_{c}")))
    told = F.when(outside, "outside").when(F.col("found_length").isNull(), "missing").when(F.col("found_length") > most_bytes, "too_large").when(other, "other_version")
    j = j.withColumn("told", told)
    sought = j.where("told is null").select("name").distinct()
    digests = files.join(sought, "name", "left_semi").where(F.col("length") <= most_bytes).select("name", F.sha2("content", 256).alias("found"))
    j = j.join(digests, "name", "left")
    return j.withColumn("outcome", F.coalesce("told", F.when(F.col("found").eqNullSafe(F.col("sha256")), "ok").otherwise("changed"))).drop("told")


def anchored(text: Column, segments: Column) -> Column:
    """Text of a provider's anchor: its segments by character offsets, joined; a missing start is 0."""
    part = lambda s: F.substring(text, F.coalesce(s["startIndex"].cast("int"), F.lit(0)) + 1, s["endIndex"].cast("int") - F.coalesce(s["startIndex"].cast("int"), F.lit(0)))
    return F.array_join(F.transform(segments, part), "")


def provider_lines(responses: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """Observations from a provider's JSON responses, a line each."""
    d = responses.select(*keys, F.from_json(json_col, PROVIDER).alias("r")).select(*keys, F.col("r.document.text").alias("full"), F.explode("r.document.pages").alias("p"))
    rows = d.select(*keys, "full", F.col("p.pageNumber").alias("page"), F.posexplode("p.lines").alias("i", "l"))
    lay = F.col("l.layout")
    return rows.select(
        *keys, "page", F.format_string("obs_docai_p%d_l%d", "page", "i").alias("observation_id"), F.lit("line").alias("level"), anchored(F.col("full"), lay["textAnchor"]["textSegments"]).alias("text"),
        lay["confidence"].alias("confidence"), lay["boundingPoly"]["normalizedVertices"].alias("polygon"), F.col("i").cast("int").alias("reading_order"),
    )


def layout_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of extracted layout XML files (doc, page, flow, block, line, word with box attributes): ``document`` is the file, ``page`` counts from 1.

    Boxes are parts of the page; empty boxes are left out, but count in ``place``.
    """
    word = "struct<_VALUE:string,_xMin:double,_yMin:double,_xMax:double,_yMax:double>"
    line = f"struct<_xMin:double,_yMin:double,_xMax:double,_yMax:double,word:array<{word}>>"
    schema = f"page array<struct<_width:double,_height:double,flow:array<struct<block:array<struct<line:array<{line}>>>>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("document"), F.regexp_extract("value", r"(?s)<doc\b.*</doc>", 0).alias("xml"))
    pages = whole.select("document", F.posexplode(F.from_xml("xml", schema)["page"]).alias("at", "p")).select("document", (F.col("at") + 1).alias("page"), "p.*")
    rows = pages.select("document", "page", "_width", "_height", F.posexplode(F.flatten(F.flatten(F.transform("flow", lambda f: F.transform(f["block"], lambda b: b["line"]))))).alias("place", "l"))
    part = lambda c, side: F.least(F.greatest(F.col(f"l.{c}") / F.col(side), F.lit(0.0)), F.lit(1.0))
    rows = rows.select("document", "page", "place", F.array_join(F.transform("l.word", lambda w: w["_VALUE"]), " ").alias("text"), part("_xMin", "_width").alias("left"), part("_yMin", "_height").alias("top"), part("_xMax", "_width").alias("right"), part("_yMax", "_height").alias("bottom"))
    return rows.where("left < right and top < bottom")


def configured(value: Column) -> Column:
    """A map from ``product=bucket,product=bucket`` text; null if a pair is empty or doubled."""
    pairs = F.split(value, ",")
    good = F.forall(pairs, lambda p: p.rlike("^[^=]+=[^=]+$")) & (F.size(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))) == F.size(pairs))
    return F.when(good, F.str_to_map(value, F.lit(","), F.lit("=")))


def create_only(df: DataFrame, path: str) -> None:
    """Write a table where nothing is yet; what exists is never replaced."""
    df.write.mode("errorifexists").parquet(path)


def verify(written: DataFrame, source: DataFrame, key: str, content: str) -> DataFrame:
    """Rows that came back otherwise than they were written, by length and digest."""
    w = written.select(key, F.octet_length(content).alias("length"), F.sha2(content, 256).alias("digest"))
    s = source.select(key, F.octet_length(content).alias("want_length"), F.sha2(content, 256).alias("want"))
    return s.join(w, key, "left").where(~(F.col("digest").eqNullSafe(F.col("want")) & F.col("length").eqNullSafe(F.col("want_length"))))
