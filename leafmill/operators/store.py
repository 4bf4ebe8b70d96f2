"""Remaining store operations: batch inserts, guarded updates, flags, deletes, caches, page sources and document results."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..sources.staging import staged
from . import ordered

SCOPE = ["product_id", "tenant_id"]
MOST_BYTES, MOST_PAGES, MOST_FIELD_NAME, MOST_RATIO = 64 << 20, 1000, 128, 200
QUOTA_WAIT_SECONDS = 65
# Kinds of failure and whether work is tried again; fixed values.
RETRYABLE = {"provider_rate_limited": True, "dependency_unavailable": True, "revision_conflict": True, "invalid_input": False, "scope_not_found": False, "iteration_limit": False}


def unnest(df: DataFrame, *arrays: str) -> DataFrame:
    """Rows from parallel arrays of one length."""
    others = [c for c in df.columns if c not in arrays]
    return df.select(*others, F.inline(F.arrays_zip(*arrays)))


def compare_and_swap(current: DataFrame, updates: DataFrame, key: list[str], order: list[str], block: int = ordered.BLOCK) -> DataFrame:
    """Outcome of updates that name the revision they were made from: swapped (with the next revision), stale or not_found.

    Updates of one key are taken one after another in their ``order``, and each is held against the revision that those before it left, so of
    two that name one revision at most one is swapped.  An update without a revision is stale.  Keys with more than a ``block`` of updates
    are folded in blocks, all others in one pass.
    """
    now = current.select(*key, F.col("revision").alias("__now"))
    result = lambda after: {"outcome": F.when(F.col("__now").isNull(), "not_found").when(F.col("swapped"), "swapped").otherwise("stale"), "revision": F.when(F.col("__now").isNotNull(), F.col(after))}
    many = staged(updates.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.count("*").alias("__n")).where(F.col("__n") > block).drop("__n"), "many-updates")
    if few := many.isEmpty():
        light = updates
    else:
        mine = reduce(and_, [updates[c].eqNullSafe(many[f"__{c}"]) for c in key])
        light = updates.join(many, mine, "left_anti")
    light = light.withColumn("__row", F.monotonically_increasing_id()).join(now, key, "left")
    folded = ordered.folded_swaps(light, key, [*order, "__row"], "revision", "__now")
    folded = folded.withColumns(result("after")).drop("__row", "__now", "swapped", "after")
    if few:
        return folded
    rows = ordered.in_order(updates.join(many, mine, "left_semi").join(now, key, "left"), key, order, "updates")
    made = ordered.serial_swaps(rows.where("__now is not null"), key, "revision", "__now", block).withColumnRenamed("revision", "__after")
    blocks = rows.join(made, "at", "left").withColumns(result("__after")).drop("at", "swapped", "__after", "__now")
    return folded.unionByName(blocks)


def merge_flags(current: DataFrame, changes: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Upsert in which a flag, once set, stays set."""
    return current.select(*keys, *flags).unionByName(changes.select(*keys, *flags)).groupBy(*keys).agg(*[F.bool_or(f).alias(f) for f in flags])


def cascade_delete(parents: DataFrame, children: DataFrame, doomed: DataFrame, parent_key: list[str], link: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the doomed, and children without those of doomed parents."""
    gone = parents.join(doomed.select(*parent_key).distinct(), parent_key, "left_semi").select(link)
    return parents.join(doomed.select(*parent_key).distinct(), parent_key, "left_anti"), children.join(gone, link, "left_anti")


def version_in_step(generation: Column, version: Column) -> Column:
    """The version text and number that belong together; null where they disagree."""
    number = F.when(version.rlike(r"^\d{1,19}$"), version.try_cast("bigint"))
    return F.when(version.isNull(), F.struct(generation.alias("generation"), generation.cast("string").alias("version"))).when(
        generation.isNull() | generation.eqNullSafe(number), F.struct(number.alias("generation"), version.alias("version"))
    )


def release_scopes(scopes: DataFrame, owner: str, now: Column) -> DataFrame:
    """Scopes with the owner's live leases given up; others stay."""
    mine = F.coalesce((F.col("lease_owner") == owner) & (F.col("lease_expires_at") > now), F.lit(False))
    return scopes.withColumns({"released": mine, "lease_owner": F.when(~mine, F.col("lease_owner")), "lease_expires_at": F.when(~mine, F.col("lease_expires_at"))})


def inspection_candidates(uploads: DataFrame, now: Column, limit: int) -> DataFrame:
    """The longest waiting uploads of each scope to be inspected: uploaded ones, and those whose inspector's lease has ended."""
    waiting = (F.col("status") == "uploaded") | ((F.col("status") == "inspecting") & (F.col("lease_expires_at") <= now))
    first = Window.partitionBy(*SCOPE).orderBy("uploaded_at", "upload_id")
    return uploads.where(waiting).withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)


def native_page_lookup(pages: DataFrame, documents: DataFrame, jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Pages of the native documents of jobs whose source is still the one they were read from, with the document's bytes beside each page."""
    j = documents.join(jobs.select(*SCOPE, "job_id", "upload_id"), [*SCOPE, "job_id"])
    u = uploads.select(*SCOPE, "upload_id", F.col("document_version").alias("now_version"))
    j = j.join(u, [*SCOPE, "upload_id"]).where(F.col("document_version") == F.col("now_version")).drop("now_version")
    rows = pages.join(j, "native_document_id")
    return rows.withColumn("document_bytes", F.sum(F.octet_length("page_data")).over(Window.partitionBy("native_document_id")))


def frames(images: DataFrame, key: str, most_pixels: int) -> DataFrame:
    """Frames of a document's image with the running sum of their pixels, and whether it stays in bounds."""
    order = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return images.withColumn("running_pixels", F.sum(F.col("width").cast("long") * F.col("height")).over(order)).withColumn("within", F.col("running_pixels") <= most_pixels)


def first_frame_only(images: DataFrame, key: str) -> DataFrame:
    """Frames of documents accepted with one page: the first; others all."""
    return images.where((F.col("page_count") > 1) | (F.col("frame") == 0))


def ratio_ok(compressed: Column, decoded: Column) -> Column:
    return decoded <= compressed * MOST_RATIO


def page_source_ok(page: Column, index: Column, width: Column, height: Column, want_width: Column, want_height: Column) -> Column:
    """Whether a page is the expected one: numbered by its place, of the accepted size, a quarter turn allowed."""
    size = ((width == want_width) & (height == want_height)) | ((width == want_height) & (height == want_width))
    return (page == index + 1) & size


def upload_verified(content: Column, expected_length: Column, expected_digest: Column) -> Column:
    """Outcome of verifying an upload's bytes: too_short, length, digest or verified."""
    return F.when(F.octet_length(content) < 12, "too_short").when(F.octet_length(content) != expected_length, "length").when(ids.digest(content) != expected_digest, "digest").otherwise("verified")


def elapsed_ms(since: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", since, now))


def clock_ok(stamp: Column, now: Column, skew_seconds: int = 60) -> Column:
    return F.abs(F.timestamp_diff("SECOND", stamp, now)) <= skew_seconds


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables have the same set of keys."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def retry_plan(kind: Column, attempt: Column, most: int = 3) -> Column:
    """Seconds until work that failed with ``kind`` is tried again, or null: rate limits wait longer; permanent and unknown kinds and the last attempt get no other."""
    again = F.lit(False)
    for name, retry in RETRYABLE.items():
        if retry:
            again = again | (kind == name)
    wait = F.when(kind == "provider_rate_limited", QUOTA_WAIT_SECONDS).otherwise(F.least(F.lit(30), F.pow(F.lit(2), attempt - 1).cast("int")))
    return F.when(again & (attempt < most), wait)


def artifact_total(artifacts: DataFrame, key: str) -> DataFrame:
    """Bytes of each document's artifacts: within, too_large, or corrupt where artifacts have no bytes."""
    total = F.try_sum("content_length")
    g = artifacts.groupBy(key).agg(total.alias("bytes"), F.count("*").alias("artifacts"))
    return g.withColumn("outcome", F.when(F.col("bytes").isNull() | (F.col("bytes") > MOST_BYTES), "too_large").when(F.col("bytes") == 0, "corrupt").otherwise("within"))


def result_rules() -> dict[str, Column]:
    """Validity of a document result (as ``schema.RESULT``)."""
    said = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("markdown"), F.lit(0)) > 0
    numbers = F.transform(F.col("pages"), lambda p: p["page"])
    prov = F.col("processing_provenance")
    named = [prov[k].isNotNull() for k in ("provider", "model", "profile", "duration_ms")]
    every, none = named[0] & named[1] & named[2] & named[3], ~(named[0] | named[1] | named[2] | named[3])
    return {
        "citations": ~said | (F.coalesce(F.size("citations"), F.lit(0)) > 0),
        "field_names": F.col("fields").isNull() | F.forall(F.map_keys("fields"), lambda k: F.octet_length(k).between(1, MOST_FIELD_NAME)),
        "evidence": F.col("fields").isNull() | F.forall(F.map_values("fields"), lambda v: (F.size(v["evidence"]) > 0) & v["confidence"].between(0, 1)),
        "pages": F.col("pages").isNull() | ((F.size("pages") <= MOST_PAGES) & (F.size(F.array_distinct(numbers)) == F.size("pages"))),
        "provenance": prov.isNull() | every | none,
        "document_id": ids.valid("document", F.col("document_id")), "document_version": ids.valid("digest", F.col("document_version")),
    }


def locator_rules() -> dict[str, Column]:
    """Form of a stored object's locator."""
    return {
        "bucket": F.col("object_bucket").rlike("^[a-z0-9][a-z0-9._-]{1,220}$"), "name": F.octet_length("object_name").between(1, 1024) & ~F.col("object_name").rlike(r"\p{Cc}"),
        "version": F.col("object_version").isNull() | F.col("object_version").rlike("^[!-~]{1,256}$"), "digest": ids.valid("digest", F.col("object_digest")), "length": F.col("content_length").between(1, MOST_BYTES),
    }


def dispatch_counters(runs: DataFrame) -> DataFrame:
    """Totals of one dispatch pass."""
    return runs.agg(F.countDistinct(F.struct(*SCOPE)).alias("scopes"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("uploads", "workflows", "lease_lost")])
