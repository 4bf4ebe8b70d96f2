"""Job, upload and page lifecycles as data: transition tables, idempotent creation, lookups, run plans, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..sources.staging import by_key

SCOPE = ["product_id", "tenant_id"]

# Transition relations; fixed values.  The domain's and the store's differ and are never merged.
DOMAIN_TRANSITIONS = [
    ("accepted", "inspecting"), ("accepted", "cancelling"), ("inspecting", "rejected"), ("inspecting", "processing"), ("inspecting", "cancelling"),
    ("processing", "validating"), ("processing", "partial"), ("processing", "cancelling"), ("validating", "completed"), ("validating", "review_required"),
    ("validating", "cancelling"), ("cancelling", "cancelled"), ("partial", "review_required"),
]
STORE_TRANSITIONS = [
    ("accepted", "processing"), ("accepted", "cancelled"), ("processing", "validating"), ("processing", "cancelled"), ("validating", "completed"),
    ("validating", "partial"), ("validating", "review_required"), ("validating", "cancelled"), ("cancelling", "cancelled"),
]
NOT_READY = ["accepted", "inspecting", "processing", "validating", "cancelling"]
UNAVAILABLE = ["cancelled", "rejected"]
PUBLISHED = ["partial", "review_required", "completed"]
PAGES_PER_RUN, MOST_PAGES = 50, 1000


def allowed(before: Column, after: Column, transitions: list[tuple[str, str]] = DOMAIN_TRANSITIONS) -> Column:
    """Whether a move is in the relation; staying is always allowed."""
    moves = F.array(*[F.lit(f"{a}>{b}") for a, b in transitions])
    return (before == after) | F.array_contains(moves, F.concat(before, F.lit(">"), after))


def replay(events: DataFrame, key: str, order: str, target: str, start: str = "accepted", transitions: list[tuple[str, str]] = DOMAIN_TRANSITIONS) -> DataFrame:
    """Final state, accepted and refused moves of each key when its events are applied in order; refused moves change nothing."""
    ordered = events.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, target))), lambda e: e[target]).alias("moves"))
    state = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("moved"), F.lit(0).cast("long").alias("refused"))

    def step(s: Column, to: Column) -> Column:
        ok = allowed(s["state"], to, transitions)
        return F.struct(F.when(ok, to).otherwise(s["state"]).alias("state"), (s["moved"] + ok.cast("long")).alias("moved"), (s["refused"] + (~ok).cast("long")).alias("refused"))

    return ordered.select(key, F.aggregate("moves", state, step).alias("end")).select(key, "end.*")


def create_jobs(requests: DataFrame, existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """Outcome of each creation request: created, existing, conflict, or source_unavailable.

    A new key creates if its upload is accepted in the same scope; of several
    requests with one new key in a batch, the first job id creates and the
    others are held against it.
    """
    key = [*SCOPE, "idempotency_key"]
    ready = uploads.where("status = 'accepted'").select(*SCOPE, "upload_id").distinct().withColumn("ready", F.lit(True))
    old = existing.select(*key, F.col("job_id").alias("old_job"), F.col("request_digest").alias("old_digest"), F.col("webhook_subscription_id").alias("old_webhook"))
    r = requests.join(ready, [*SCOPE, "upload_id"], "left").join(old, key, "left")
    fresh = F.col("old_job").isNull() & F.col("ready").isNotNull()
    own = Window.partitionBy(*key)
    first = F.min(F.when(fresh, F.struct(F.col("job_id").alias("j"), F.col("request_digest").alias("d"), F.col("webhook_subscription_id").alias("w")))).over(own)
    r = r.withColumn("first", first)
    holder = F.coalesce(F.when(F.col("old_job").isNotNull(), F.struct(F.col("old_job").alias("j"), F.col("old_digest").alias("d"), F.col("old_webhook").alias("w"))), F.col("first"))
    r = r.withColumn("holder", holder)
    same = (F.col("holder.d") == F.col("request_digest")) & F.col("holder.w").eqNullSafe(F.col("webhook_subscription_id"))
    outcome = (
        F.when(F.col("holder").isNull(), "source_unavailable").when(F.col("old_job").isNull() & (F.col("holder.j") == F.col("job_id")), "created")
        .when(same, "existing").otherwise("conflict")
    )
    return r.select(*requests.columns, outcome.alias("outcome"), F.col("holder.j").alias("holder_job"))


def with_events(created: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Job rows and the outbox rows that belong to them, from one plan."""
    jobs = created.where("outcome = 'created'")
    return jobs, jobs.select(*SCOPE, "job_id", F.lit("ocr.job.accepted.v1").alias("event_type"), F.to_json(F.struct("job_id", F.lit("accepted").alias("status"))).alias("payload"))


def document_identity(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Document id, version and schema of each job whose upload is accepted."""
    u = uploads.where("status = 'accepted'").select(*SCOPE, "upload_id", "document_version", "page_count")
    return jobs.join(u, [*SCOPE, "upload_id"]).select(*SCOPE, "job_id", F.regexp_replace("job_id", "^job_", "doc_").alias("document_id"), "document_version", "page_count", "extraction_schema_id")


def result_lookup(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of asking for each job's result: ready, not_ready, unavailable or corrupt."""
    r = results.select("job_id", "document_id", F.col("document_version").alias("result_version"))
    j = jobs.join(r, "job_id", "left")
    none = F.when(F.col("status").isin(NOT_READY), "not_ready").when(F.col("status").isin(UNAVAILABLE), "unavailable").otherwise("corrupt")
    return j.withColumn("outcome", F.when(F.col("document_id").isNull(), none).when(F.col("status").isin(PUBLISHED), "ready").otherwise("corrupt"))


def transition(jobs: DataFrame, requests: DataFrame, sources: list[str], target: str) -> DataFrame:
    """Conditional update: jobs in one of ``sources`` that ``requests`` name move to ``target``; ``outcome`` says what became of each request."""
    j = jobs.select(*SCOPE, "job_id", "status")
    r = requests.join(j, [*SCOPE, "job_id"], "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == target, "existing").when(F.col("status").isin(sources), "updated").otherwise("refused")
    return r.withColumn("outcome", outcome).withColumn("status", F.when(outcome == "updated", F.lit(target)).otherwise(F.col("status")))


def artifact_batches(artifacts: DataFrame, pages: DataFrame, most: int = 64) -> DataFrame:
    """Artifacts of each job's batch with the first ``rule`` they break: too_many, activity_key, task (their page hasn't succeeded in that attempt) or page_twice; null for good ones.

    A batch may be saved if all of its artifacts are good: ``accepted``.
    """
    done = pages.where("state = 'succeeded'").select("job_id", F.col("page").alias("page_number"), F.col("n").alias("attempt"), F.lit(True).alias("__done"))
    j = artifacts.join(done, ["job_id", "page_number", "attempt"], "left")
    job, page = Window.partitionBy("job_id"), Window.partitionBy("job_id", "page_number")
    key = ids.activity_key(F.col("job_id"), F.col("page_number"), F.col("attempt"))
    rule = F.when(F.count("*").over(job) > most, "too_many").when(~F.col("activity_key").eqNullSafe(key), "activity_key").when(F.col("__done").isNull(), "task").when(F.count("*").over(page) > 1, "page_twice")
    return j.withColumn("rule", rule).drop("__done").withColumn("accepted", F.count("rule").over(job) == 0)


def artifact_rules(artifacts: DataFrame, most: int = 64) -> DataFrame:
    """Jobs whose artifacts break a batch's rules: too many, or a page twice."""
    g = artifacts.groupBy("job_id").agg(F.count("*").alias("artifacts"), F.countDistinct("page_number").alias("pages"))
    return g.where((F.col("artifacts") > most) | (F.col("pages") < F.col("artifacts"))).withColumn("rule", F.when(F.col("artifacts") > most, "too_many").otherwise("page_twice"))


def run_plan(documents: DataFrame, per_run: int = PAGES_PER_RUN) -> DataFrame:
    """The runs of each document's pages; all but the last continue as a new run."""
    d = documents.where(F.col("page_count").between(1, MOST_PAGES)).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("page_count") - 1) / per_run).cast("int"))))
    last = F.least(F.col("page_count"), (F.col("run") + 1) * per_run)
    return d.withColumns({"first_page": F.col("run") * per_run + 1, "last_page": last, "continues_as_new": last < F.col("page_count")})


def backoff_seconds(attempt: Column, first: int = 1, most: int = 30) -> Column:
    """Wait before the attempt after ``attempt``; doubling, bounded."""
    return F.least(F.lit(most), (F.lit(first) * F.pow(F.lit(2), attempt - 1)).cast("int"))


def page_status(pages: DataFrame, key: str) -> DataFrame:
    """Status of each workflow from its pages' states: cancelled, then completed, partial or running; and its succeeded pages."""
    done = ["succeeded", "exhausted", "permanently_failed"]
    g = pages.groupBy(key).agg(
        F.bool_or("cancelled").alias("cancelled"), F.bool_and(F.col("state") == "succeeded").alias("all_succeeded"), F.bool_and(F.col("state").isin(done)).alias("all_done"),
        F.count_if(F.col("state") == "succeeded").alias("succeeded_pages"), F.count("*").alias("pages"),
    )
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("all_succeeded"), "completed").when(F.col("all_done"), "partial").otherwise("running")
    return g.select(key, status.alias("status"), "succeeded_pages", "pages")


def ready_tasks(pages: DataFrame, key: str, limit: int = 64) -> DataFrame:
    """The first pages of each workflow to be worked on: running ones again, pending ones with their next attempt."""
    open_pages = pages.where("not cancelled and state in ('running', 'pending')")
    attempt = F.when(F.col("state") == "running", F.col("attempt")).otherwise(F.col("failures") + 1)
    first = Window.partitionBy(key).orderBy("page")
    return open_pages.withColumns({"next_attempt": attempt, "place": F.row_number().over(first)}).where(F.col("place") <= limit).withColumn("activity_key", ids.activity_key(F.col(key), F.col("page"), attempt)).drop("place")


def bounded_bytes(pages: DataFrame, keys: list[str], size: str, limit: int = 64 << 20) -> DataFrame:
    """Bytes of all pages beside each page, their running sum in page order, and whether the sum stays in the limit."""
    pages = by_key(pages, keys)
    total, running = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("page_number").rangeBetween(Window.unboundedPreceding, 0)
    return pages.withColumns({"total_bytes": F.sum(size).over(total), "running_bytes": F.sum(size).over(running)}).withColumn("within", F.col("total_bytes") <= limit)


def importer_decision() -> Column:
    """What happens to an upload by the outcomes of its stages, in their order: claim, scan, read, inspect, promote, accept."""
    c = F.col
    return (
        F.when(c("claim") != "claimed", F.concat(F.lit("skip:"), c("claim"))).when(c("scan") == "infected", "reject:malware").when(c("scan") != "clean", "retry:scan")
        .when(c("read") == "mismatch", "reject:source_changed").when(c("read") != "ok", "retry:read").when(c("inspect") == "unsupported", "reject:unsupported")
        .when(c("inspect") == "unsafe", "reject:unsafe").when(c("inspect") == "limit", "reject:limit").when(c("inspect") != "ok", "retry:inspect")
        .when(c("promote") == "conflict", "reject:conflict").when(c("promote") != "ok", "retry:promote").when(c("accept") != "ok", "retry:accept").otherwise("accept")
    )


def promotion(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed promotion: copy where nothing is stored, replay where the same bytes are, conflict where others are."""
    s = stored.select("path", F.col("digest").alias("stored_digest"))
    j = sources.join(s, "path", "left")
    return j.withColumn("outcome", F.when(F.col("stored_digest").isNull(), "copy").when(F.col("stored_digest") == F.col("digest"), "replay").otherwise("conflict"))


def cached(records: DataFrame, now: Column, active_ttl: int, terminal_ttl: int) -> DataFrame:
    """Live rows of a status cache: terminal states live longer than active ones."""
    terminal = F.col("status").isin(*PUBLISHED, *UNAVAILABLE)
    ttl = F.when(terminal, terminal_ttl).otherwise(active_ttl)
    return records.where(F.col("stored_at") + F.make_dt_interval(secs=ttl) > now)


def cache_lookup(requests: DataFrame, records: DataFrame, now: Column, active_ttl: int, terminal_ttl: int) -> DataFrame:
    """Outcome of asking the cache for jobs: hit, miss, or foreign where the record's own scope isn't the request's (it is then not shown)."""
    live = cached(records, now, active_ttl, terminal_ttl).select("job_id", *[F.col(c).alias(f"own_{c}") for c in SCOPE], F.col("status").alias("own_status"))
    j = requests.join(live, "job_id", "left")
    same = F.lit(True)
    for c in SCOPE:
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    outcome = F.when(F.col("own_status").isNull(), "miss").when(same, "hit").otherwise("foreign")
    return j.select(*requests.columns, outcome.alias("outcome"), F.when(outcome == "hit", F.col("own_status")).alias("status"))


def transitions_table(spark: SparkSession) -> DataFrame:
    """Both relations as rows."""
    rows = [("domain", *t) for t in DOMAIN_TRANSITIONS] + [("store", *t) for t in STORE_TRANSITIONS]
    return spark.createDataFrame(rows, "relation string, before string, after string")
