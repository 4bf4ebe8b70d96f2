"""Outbox delivery in batches: claims with leases, dead letters, acknowledgements, pending scopes.

Time is a parameter.  There are no row locks: one query works on an outbox at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["product_id", "tenant_id"]
MOST_ATTEMPTS, LEASE_MINUTES, MOST_ROWS = 20, 5, 100
JOB_EVENTS = ["ocr.job.accepted.v1", "ocr.job.cancellation_requested.v1"]
WEBHOOK_EVENTS = ["ocr.job.completed.v1", "ocr.job.partial.v1", "ocr.job.review_required.v1"]
MOST_INSPECTIONS = 10


def undelivered() -> Column:
    return F.col("published_at").isNull() & F.col("dead_lettered_at").isNull()


def dead_letters(outbox: DataFrame, now: Column) -> DataFrame:
    """The outbox with rows of used-up attempts and ended lease marked dead, whatever their type."""
    dead = undelivered() & (F.col("delivery_attempts") == MOST_ATTEMPTS) & (F.col("lease_expires_at") <= now)
    dead = F.coalesce(dead, F.lit(False))
    none = lambda c: F.when(~dead, F.col(c))
    return outbox.withColumns({"dead_lettered_at": F.when(dead, now).otherwise(F.col("dead_lettered_at")), "lease_owner": none("lease_owner"), "lease_expires_at": none("lease_expires_at")})


def eligible(owner: str, now: Column, types: list[str]) -> Column:
    free = (F.col("lease_owner") == owner) | F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    return F.col("event_type").isin(types) & undelivered() & (F.col("delivery_attempts") < MOST_ATTEMPTS) & F.coalesce(free, F.lit(False))


def claim(outbox: DataFrame, owner: str, now: Column, types: list[str], limit: int = MOST_ROWS) -> DataFrame:
    """The first eligible rows of each scope, leased to ``owner``; an attempt is counted unless its own live lease is renewed."""
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError("a claim takes 1 to 100 rows")
    first = Window.partitionBy(*SCOPE).orderBy("event_id")
    rows = outbox.where(eligible(owner, now, types)).withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= limit).drop("__place")
    renewed = F.coalesce((F.col("lease_owner") == owner) & (F.col("lease_expires_at") > now), F.lit(False))
    attempts = F.col("delivery_attempts") + F.when(renewed, 0).otherwise(1)
    return rows.withColumns({"delivery_attempts": attempts.cast("int"), "lease_owner": F.lit(owner), "lease_expires_at": now + F.expr(f"interval {LEASE_MINUTES} minutes")})


def dispatches(claimed: DataFrame, jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Claimed job events with the page count of their upload."""
    j = jobs.select("job_id", *SCOPE, "upload_id")
    u = uploads.select("upload_id", *SCOPE, "page_count")
    return claimed.join(j, ["job_id", *SCOPE]).join(u, ["upload_id", *SCOPE])


def webhooks(claimed: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Claimed result events of jobs with a subscription; those without stay leased but aren't sent."""
    j = jobs.where("webhook_subscription_id is not null").select("job_id", *SCOPE, "webhook_subscription_id")
    r = results.select("job_id", *SCOPE, "document_version")
    return claimed.join(j, ["job_id", *SCOPE]).join(r, ["job_id", *SCOPE])


def acknowledge(outbox: DataFrame, acks: DataFrame, now: Column) -> DataFrame:
    """Outcome of acknowledgements (scope, ``event_id``, ``owner``): published, existing, lease_lost or not_found."""
    o = outbox.select(*SCOPE, "event_id", "published_at", "lease_owner", "lease_expires_at")
    a = acks.join(o.withColumn("known", F.lit(True)), [*SCOPE, "event_id"], "left")
    live = F.coalesce((F.col("lease_owner") == F.col("owner")) & (F.col("lease_expires_at") > now), F.lit(False))
    return a.withColumn("outcome", F.when(F.col("known").isNull(), "not_found").when(F.col("published_at").isNotNull(), "existing").when(live, "published").otherwise("lease_lost")).drop("known")


def pending_scopes(outbox: DataFrame, types: list[str]) -> DataFrame:
    """Scopes that still have something to deliver, by an or over their rows."""
    open_rows = F.col("event_type").isin(types) & undelivered() & (F.col("delivery_attempts") < MOST_ATTEMPTS)
    return outbox.groupBy(*SCOPE).agg(F.bool_or(open_rows).alias("pending"), F.max("created_at").alias("updated_at"))


def claim_scopes(scopes: DataFrame, owner: str, now: Column, flag: str, limit: int = MOST_ROWS) -> DataFrame:
    """The longest waiting scopes with work and no other's live lease, leased to ``owner``."""
    free = F.col("lease_owner").isNull() | (F.col("lease_owner") == owner) | (F.col("lease_expires_at") <= now)
    rows = scopes.where(F.col(flag) & free).orderBy("updated_at", *SCOPE).limit(limit)
    return rows.withColumns({"lease_owner": F.lit(owner), "lease_expires_at": now + F.expr(f"interval {LEASE_MINUTES} minutes")})


def inspection_outcome(owner: str, now: Column) -> Column:
    """Outcome of claiming an upload for inspection: claimed, existing, busy, attempts_exhausted or not_inspectable."""
    live = F.coalesce(F.col("lease_expires_at") > now, F.lit(False))
    inspecting, few = F.col("status") == "inspecting", F.col("inspection_attempts") < MOST_INSPECTIONS
    return (
        F.when((F.col("status") == "uploaded") & few, "claimed").when(inspecting & live & (F.col("lease_owner") == owner), "existing")
        .when(inspecting & ~live & few, "claimed").when(inspecting & ~live, "attempts_exhausted").when(inspecting, "busy").otherwise("not_inspectable")
    )
