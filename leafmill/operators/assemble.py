"""Documents from observations: leaves, reading-order text, evidence, provenance and review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.6
#: Bytes of a document's text at most.
MOST_BYTES = 64 << 20
POLYGON = "array<struct<x:double,y:double>>"


def leaves(observations: DataFrame, *keys: str) -> DataFrame:
    """Observations that are nobody's parent within ``keys``."""
    parents = observations.where("parent_observation_id is not null").select(*keys, F.col("parent_observation_id").alias("observation_id")).distinct()
    return observations.join(parents, [*keys, "observation_id"], "left_anti")


def assemble(observations: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Text, citations and least confidence of each document: lines joined by line ends, pages by empty lines.

    Citations hold page, observation and polygon (null if there is none).  A
    document whose text is longer than ``most_bytes`` has none, and ``limit`` says so.
    """
    polygon = [F.col("polygon")] if "polygon" in observations.columns else [F.lit(None).cast(POLYGON).alias("polygon")]
    line = F.struct("reading_order", "text", "observation_id", *polygon)
    pages = observations.groupBy(key, "page").agg(F.array_sort(F.collect_list(line), lambda a, b: order(a, b)).alias("lines"), F.min("confidence").alias("confidence"))
    docs = pages.groupBy(key).agg(F.collect_list(F.struct("page", "lines")).alias("pages"), F.min("confidence").alias("confidence"))
    docs = docs.withColumn("pages", F.array_sort("pages", lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise(0)))
    text = F.array_join(F.transform("pages", lambda p: F.array_join(F.transform(p["lines"], lambda x: x["text"]), "\n")), "\n\n")
    cited = F.flatten(F.transform("pages", lambda p: F.transform(p["lines"], lambda x: F.struct(p["page"].alias("page"), x["observation_id"].alias("observation_id"), x["polygon"].alias("polygon")))))
    docs = docs.withColumn("text", text).withColumn("limit", F.when(F.octet_length("text") > most_bytes, "text"))
    return docs.select(key, F.when(F.col("limit").isNull(), F.col("text")).alias("text"), cited.alias("citations"), "confidence", "limit")


def order(a: Column, b: Column) -> Column:
    """Of two lines, the earlier by reading order, then text, then observation."""
    parts = ("reading_order", "text", "observation_id")
    out = F.lit(0)
    for c in reversed(parts):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def provenance(observation_id: Column) -> Column:
    """Aggregate: where a document's observations came from."""
    other = F.bool_or(~observation_id.startswith("obs_native_") & ~observation_id.startswith("obs_docai_"))
    return F.when(other, "legacy-mixed").when(F.bool_or(observation_id.startswith("obs_docai_")), "native-text-document-ai").otherwise("native-text")


def provenance_profile(provider: Column) -> Column:
    return F.when(provider == "legacy-mixed", "native-text-transition-v1").when(provider == "native-text-document-ai", "hybrid-ocr-v1").otherwise("native-text-v1")


def review_signals(facts: DataFrame, extraction_codes: str | None = None) -> DataFrame:
    """Failures, warnings and state of each document.

    ``facts`` has provider, empty_page, low_confidence, no_text (booleans), and
    maybe an array column ``extraction_codes`` of an extraction's own failures,
    and ``workflow``, the page workflow's state: what is partial there stays so.
    """
    own = F.col(extraction_codes) if extraction_codes else F.array().cast("array<string>")
    legacy = F.col("provider") == "legacy-mixed"
    failures = F.array_compact(F.array(
        F.when(legacy, F.lit("legacy_processing_requires_review")), F.when(F.col("empty_page"), F.lit("ocr_page_requires_manual_review")),
        F.when(F.col("low_confidence"), F.lit("ocr_low_confidence")), F.when(F.col("no_text"), F.lit("ocr_no_text_detected")),
    ))
    retake = (
        F.when(F.col("no_text"), "retake_include_readable_document")
        .when(F.col("low_confidence") | F.array_contains(own, "nutrition_row_incomplete"), "retake_sharper_image")
        .when(F.array_contains(own, "nutrition_panel_not_found"), "retake_include_column_headers")
    )
    warnings = F.array_compact(F.array(F.when(legacy, F.lit("manual_review_required")), F.when(F.col("empty_page"), F.lit("manual_review_required")), retake))
    out = facts.withColumn("failures", F.array_distinct(F.concat(own, failures))).withColumn("warnings", warnings)
    partial = F.coalesce(F.col("workflow") == "partial", F.lit(False)) if "workflow" in facts.columns else F.lit(False)
    return out.withColumn("state", F.when(partial, "partial").when(F.size("failures") > 0, "review_required").otherwise("completed"))


def hybrid_pages(native: DataFrame, provider: DataFrame, keys: list[str]) -> DataFrame:
    """Each native page with observations as it is; else the provider's, unless it failed for good: then the empty native page stays."""
    p = provider.select(*keys, F.col("observations").alias("p_observations"), F.col("error").alias("p_error"))
    joined = native.join(p, keys, "left")
    has = F.size("observations") > 0
    source = F.when(has, "native").when(F.col("p_error") == "permanent", "empty_native").when(F.col("p_error").isNotNull(), "retry").when(F.col("p_observations").isNull(), "missing").otherwise("provider")
    chosen = F.when(source == "provider", F.col("p_observations")).otherwise(F.col("observations"))
    return joined.select(*keys, source.alias("source"), chosen.alias("observations"))
