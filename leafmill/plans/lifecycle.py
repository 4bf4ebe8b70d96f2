"""Queries over jobs, uploads, artifacts, the outbox, vectors and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import lifecycle as L
from ..operators import outbox as O
from ..operators import semantic
from ..sources import tables

NOW = "2024-01-16 00:00:00"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


def job_document_identity(spark, sf_dir):
    return L.document_identity(tables.jobs(spark, sf_dir), tables.uploads(spark, sf_dir)).drop("product_id")


def result_lookup(spark, sf_dir):
    return L.result_lookup(tables.jobs(spark, sf_dir), tables.results(spark, sf_dir)).select("job_id", "tenant_id", "status", "outcome", "document_id")


def outbox_claim_batch(spark, sf_dir):
    c = O.claim(O.dead_letters(tables.outbox(spark, sf_dir), now()), "worker-a", now(), O.JOB_EVENTS, 20)
    return c.select("event_id", "job_id", "tenant_id", "event_type", "delivery_attempts", "lease_owner", "lease_expires_at")


def outbox_dispatches(spark, sf_dir):
    c = O.claim(O.dead_letters(tables.outbox(spark, sf_dir), now()), "worker-a", now(), O.JOB_EVENTS, 20)
    j = tables.jobs(spark, sf_dir)
    # The star schema has scopes of its own; the claim's jobs are moved into theirs.
    c = c.drop("product_id", "tenant_id").join(j.select("job_id", "product_id", "tenant_id"), "job_id")
    return O.dispatches(c, j, tables.uploads(spark, sf_dir)).select("event_id", "job_id", "event_type", "page_count")


def outbox_dead_letter(spark, sf_dir):
    d = O.dead_letters(tables.outbox(spark, sf_dir), now())
    return d.where("dead_lettered_at is not null").groupBy("event_type").agg(F.count("*").alias("dead"), F.count_if(F.col("dead_lettered_at") == now()).alias("dead_now"), F.count("lease_owner").alias("leased"))


def webhook_claim(spark, sf_dir):
    c = O.claim(O.dead_letters(tables.outbox(spark, sf_dir), now()), "worker-b", now(), O.WEBHOOK_EVENTS, 20)
    j = tables.jobs(spark, sf_dir)
    c = c.drop("product_id", "tenant_id").join(j.select("job_id", "product_id", "tenant_id"), "job_id")
    return O.webhooks(c, j, tables.results(spark, sf_dir)).select("event_id", "job_id", "webhook_subscription_id", "document_version")


def pending_scopes(spark, sf_dir):
    return O.pending_scopes(tables.outbox(spark, sf_dir), O.JOB_EVENTS).where("pending").select("product_id", "tenant_id", "updated_at")


def scope_claim(spark, sf_dir):
    s = O.pending_scopes(tables.outbox(spark, sf_dir), O.JOB_EVENTS)
    u = F.regexp_extract("tenant_id", r"(\d+)", 1).cast("long")
    s = s.withColumns({"lease_owner": F.when(u % 3 == 0, "worker-a").when(u % 3 == 1, "worker-b"), "lease_expires_at": F.when(u % 3 != 2, now() + F.make_dt_interval(mins=(u % 5 - 2).cast("int")))})
    return O.claim_scopes(s, "worker-a", now(), "pending", 50).select("product_id", "tenant_id", "lease_owner", "lease_expires_at")


def outbox_acknowledge(spark, sf_dir):
    o = tables.outbox(spark, sf_dir)
    acks = o.select("product_id", "tenant_id", (F.col("event_id") + F.when(F.col("event_id") % 50 == 0, 10_000_000).otherwise(0)).alias("event_id"), F.lit("worker-a").alias("owner"))
    return O.acknowledge(o, acks, now()).groupBy("outcome").agg(F.count("*").alias("acks"))


def upload_inspection_claim(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    u = o.select(k.alias("upload"), F.when(k % 5 == 0, "uploaded").when(k % 5 < 4, "inspecting").otherwise("accepted").alias("status"), (k % 12).cast("int").alias("inspection_attempts"), F.when(k % 2 == 0, "worker-a").otherwise("worker-b").alias("lease_owner"), (now() + F.make_dt_interval(mins=(k % 11 - 5).cast("int"))).alias("lease_expires_at"))
    return u.groupBy(O.inspection_outcome("worker-a", now()).alias("outcome")).agg(F.count("*").alias("uploads"))


def idempotent_create(spark, sf_dir):
    j = tables.jobs(spark, sf_dir)
    old, new = j.where("order_key % 2 = 0"), j.where("order_key % 3 = 0")
    requests = new.select("product_id", "tenant_id", "job_id", "idempotency_key", F.when(F.col("order_key") % 12 == 0, F.concat("request_digest", F.lit("x"))).otherwise(F.col("request_digest")).alias("request_digest"), "upload_id", "webhook_subscription_id")
    # The store's keys are unique; the star schema's are made so.
    first = old.groupBy("product_id", "tenant_id", "idempotency_key").agg(F.min_by("job_id", "order_key").alias("job_id"))
    old = old.join(first, ["product_id", "tenant_id", "idempotency_key", "job_id"], "left_semi")
    return L.create_jobs(requests, old, tables.uploads(spark, sf_dir)).select("job_id", "tenant_id", "outcome")


def cancellation(spark, sf_dir):
    j = tables.jobs(spark, sf_dir)
    requests = j.select("product_id", "tenant_id", F.when(F.col("order_key") % 41 == 0, F.concat("job_id", F.lit("x"))).otherwise(F.col("job_id")).alias("job_id"))
    return L.transition(j, requests, ["accepted", "inspecting", "processing", "validating"], "cancelled").groupBy("outcome").agg(F.count("*").alias("requests"))


def artifact_duplicate_pages(spark, sf_dir):
    return L.artifact_rules(tables.artifacts(spark, sf_dir), 8).select("job_id", "artifacts", "pages", "rule")


def page_bytes_over(spark, sf_dir):
    b = L.bounded_bytes(tables.artifacts(spark, sf_dir), ["job_id"], "content_length", 150)
    return b.groupBy("job_id", "page_number").agg(F.max("total_bytes").alias("total_bytes"), F.max("running_bytes").alias("running_bytes"), F.bool_and("within").alias("within"))


def workflow_run_plan(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1100).cast("int").alias("page_count"))
    return L.run_plan(p).select("p_partkey", "run", "first_page", "last_page", "continues_as_new")


def retry_backoff_schedule(spark, sf_dir):
    a = tables.artifacts(spark, sf_dir).select("page_number").distinct()
    wait = L.backoff_seconds(F.col("page_number"))
    return a.select("page_number", wait.alias("wait_seconds"), (F.col("page_number") < 3).alias("retries"))


def job_fsm_replay(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    states = F.element_at(F.array(*map(F.lit, ["inspecting", "processing", "validating", "completed", "cancelling", "cancelled", "partial"])), (F.col("event_id") % 7 + 1).cast("int"))
    return L.replay(e.select(F.col("user_id").alias("job"), F.col("event_id").alias("place"), states.alias("target")), "job", "place", "target")


def fsm_relations(spark, sf_dir):
    """Jobs that may make each move, by either relation, and their tenants."""
    t = L.transitions_table(spark)
    j = tables.jobs(spark, sf_dir).withColumn("state", F.when((F.col("status") == "processing") & (F.col("order_key") % 5 == 0), "validating").when((F.col("status") == "processing") & (F.col("order_key") % 7 == 0), "accepted").otherwise(F.col("status")))
    # Counted by state first: every move from a state has the same jobs and tenants, so they aren't held once for each move.
    held = j.groupBy("state", "tenant_id").agg(F.count("*").alias("jobs")).groupBy("state").agg(F.sum("jobs").alias("jobs"), F.count("tenant_id").alias("tenants"))
    return held.join(F.broadcast(t), F.col("state") == F.col("before")).select("relation", "before", "after", "jobs", "tenants")


def page_workflow_status(spark, sf_dir):
    li = tables.read(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_orderkey") % 4 == 0, "succeeded").when(F.col("l_partkey") % 5 == 0, "exhausted").when(F.col("l_partkey") % 7 == 0, "permanently_failed").when((F.col("l_orderkey") % 3 == 0) & (F.col("l_partkey") % 2 == 0), "running").otherwise("succeeded")
    pages = li.select(F.col("l_orderkey").alias("job"), state.alias("state"), (F.col("l_orderkey") % 17 == 0).alias("cancelled"))
    return L.page_status(pages, "job")


def ready_page_tasks(spark, sf_dir):
    li = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    pages = li.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("page"), F.when(F.col("k") % 3 == 0, "running").when(F.col("k") % 3 == 1, "pending").otherwise("succeeded").alias("state"), (F.col("k") % 2 + 1).cast("int").alias("attempt"), (F.col("k") % 3).cast("int").alias("failures"), (F.col("l_orderkey") % 19 == 0).alias("cancelled"))
    return L.ready_tasks(pages, "job", 2).select("job", "page", "next_attempt", "activity_key")


def workflow_identifiers(spark, sf_dir):
    j = tables.jobs(spark, sf_dir)
    return j.select("job_id", ids.workflow_id(F.col("product_id"), F.col("tenant_id"), F.col("job_id")).alias("workflow_id"), ids.page_path(F.col("product_id"), F.col("tenant_id"), F.col("job_id"), F.lit(3), F.lit(1)).alias("path"), ids.activity_id((F.col("order_key") % 1000).cast("int")).alias("activity_id"))


def vector_topk_scoped(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return semantic.top_k(v.where("vec_id % 50 = 0"), v, 5).select("query_id", "record_id", "similarity", F.col("place").cast("long").alias("place"))


def vector_point_id(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    record = F.concat(F.lit("mem_"), F.col("vec_id").cast("string"))
    return v.select("vec_id", ids.point_id(F.col("tenant_id"), record, ids.digest(record), F.lit("emb_v1")).alias("point_id"))


def event_windows(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def event_sessions(spark, sf_dir):
    from pyspark.sql import Window

    e = tables.read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours")
    s = e.withColumn("new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


QUERIES = {f.__name__: f for f in (
    job_document_identity, result_lookup, outbox_claim_batch, outbox_dispatches, outbox_dead_letter, webhook_claim, pending_scopes, scope_claim, outbox_acknowledge, upload_inspection_claim,
    idempotent_create, cancellation, artifact_duplicate_pages, page_bytes_over, workflow_run_plan, retry_backoff_schedule, job_fsm_replay, fsm_relations, page_workflow_status, ready_page_tasks,
    workflow_identifiers, vector_topk_scoped, vector_point_id, event_windows, event_sessions,
)}

_JOBS = """jobs as (select 'job_' || o_orderkey as job_id, lower(c_mktsegment) as product_id, 'ten_' || o_custkey as tenant_id, 'key-' || (o_orderkey % 4999) as idempotency_key,
  'sha256:' || sha256(o_orderkey::varchar) as request_digest,
  case when o_orderkey % 23 = 0 then 'cancelled' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'processing' else 'partial' end as status,
  'upl_' || o_orderkey as upload_id, case when o_orderkey % 3 <> 0 then 'whs_' || (o_custkey % 7) end as webhook_subscription_id,
  case when o_orderkey % 4 = 0 then 'nutrition_label' end as extraction_schema_id, o_orderkey as k
  from orders join customer on o_custkey = c_custkey),
uploads as (select upload_id, case when k % 9 = 0 then 'rejected' when k % 31 = 0 then 'uploaded' else 'accepted' end as status,
  'sha256:' || sha256('doc' || k) as document_version, cast(k % 40 + 1 as integer) as page_count from jobs),
results as (select job_id, 'doc_' || k as document_id, request_digest as document_version from jobs where status in ('completed', 'partial') and k % 13 <> 0)"""

_OUTBOX = f"""raw as (select event_id, 'job_' || event_id as job_id, 'p' || (user_id % 3) as product_id, 'ten_' || user_id as tenant_id,
  (['ocr.job.accepted.v1', 'ocr.job.cancellation_requested.v1', 'ocr.job.completed.v1', 'ocr.job.partial.v1', 'ocr.job.review_required.v1'])[event_id % 5 + 1] as event_type,
  ts as created_at, case when event_id % 4 = 0 then ts + interval 1 hour end as published_at, case when event_id % 97 = 0 then ts + interval 2 hour end as dead_at,
  cast(event_id % 21 as integer) as attempts, case event_id % 6 when 0 then 'worker-a' when 1 then 'worker-b' end as owner,
  case when event_id % 6 < 2 then ts + to_minutes(event_id % 2000 * 7) end as expires, timestamp '{NOW}' as t, user_id from events),
outbox as (select *, published_at is null and dead_at is null and attempts = 20 and coalesce(expires <= t, false) as dies from raw),
live as (select * replace (case when dies then t else dead_at end as dead_at, case when not dies then owner end as owner, case when not dies then expires end as expires) from outbox),
eligible as (select * from live where published_at is null and dead_at is null and attempts < 20)"""


def _claimed(owner, types):
    return f"""{_OUTBOX}, claimed as (select *, row_number() over (partition by product_id, tenant_id order by event_id) as place from eligible
  where event_type in ({', '.join(f"'{t}'" for t in types)}) and (owner = '{owner}' or expires is null or expires <= t) qualify place <= 20)"""


ORACLES = {
    "job_document_identity": f"with {_JOBS} select tenant_id, job_id, 'doc_' || k as document_id, document_version, page_count, extraction_schema_id from jobs join uploads using (upload_id) where uploads.status = 'accepted'",
    "result_lookup": f"""with {_JOBS} select job_id, tenant_id, status, document_id,
        case when document_id is not null then case when status in ('partial', 'review_required', 'completed') then 'ready' else 'corrupt' end
          when status in ('accepted', 'inspecting', 'processing', 'validating', 'cancelling') then 'not_ready' when status in ('cancelled', 'rejected') then 'unavailable' else 'corrupt' end as outcome
        from jobs left join results using (job_id)""",
    "outbox_claim_batch": f"""with {_claimed('worker-a', O.JOB_EVENTS)} select event_id, job_id, tenant_id, event_type,
        cast(attempts + case when owner = 'worker-a' and expires > t then 0 else 1 end as integer) as delivery_attempts, 'worker-a' as lease_owner, t + interval 5 minute as lease_expires_at from claimed""",
    "outbox_dispatches": f"with {_claimed('worker-a', O.JOB_EVENTS)}, {_JOBS} select event_id, job_id, event_type, page_count from claimed join jobs using (job_id) join uploads using (upload_id)",
    "outbox_dead_letter": f"with {_OUTBOX} select event_type, count(*) as dead, count(*) filter (dead_at = t) as dead_now, count(owner) as leased from live where dead_at is not null group by 1",
    "webhook_claim": f"""with {_claimed('worker-b', O.WEBHOOK_EVENTS)}, {_JOBS} select event_id, job_id, webhook_subscription_id, document_version
        from claimed join jobs using (job_id) join results using (job_id) where webhook_subscription_id is not null""",
    "pending_scopes": f"""with {_OUTBOX} select product_id, tenant_id, max(created_at) as updated_at from raw group by all
        having bool_or(event_type in ('ocr.job.accepted.v1', 'ocr.job.cancellation_requested.v1') and published_at is null and dead_at is null and attempts < 20)""",
    "scope_claim": f"""with {_OUTBOX}, s as (select product_id, tenant_id, user_id as u, t, max(created_at) as updated_at from raw group by all
          having bool_or(event_type in ('ocr.job.accepted.v1', 'ocr.job.cancellation_requested.v1') and published_at is null and dead_at is null and attempts < 20))
        select product_id, tenant_id, 'worker-a' as lease_owner, t + interval 5 minute as lease_expires_at from s
        where u % 3 <> 1 or t + to_minutes(u % 5 - 2) <= t order by updated_at, product_id, tenant_id limit 50""",
    "outbox_acknowledge": f"""with {_OUTBOX} select case when event_id % 50 = 0 then 'not_found' when published_at is not null then 'existing'
        when owner = 'worker-a' and expires > t then 'published' else 'lease_lost' end as outcome, count(*) as acks from raw group by 1""",
    "upload_inspection_claim": """with u as (select o_orderkey as k, o_orderkey % 12 as a, o_orderkey % 11 - 5 > 0 as live from orders)
        select case when k % 5 = 0 and a < 10 then 'claimed' when k % 5 in (1, 2, 3) then case when live then case when k % 2 = 0 then 'existing' else 'busy' end when a < 10 then 'claimed' else 'attempts_exhausted' end
          else 'not_inspectable' end as outcome, count(*) as uploads from u group by 1""",
    "idempotent_create": f"""with {_JOBS}, old as (select * from jobs where k % 2 = 0 qualify row_number() over (partition by product_id, tenant_id, idempotency_key order by k) = 1),
        r as (select j.*, case when k % 12 = 0 then request_digest || 'x' else request_digest end as d, u.status = 'accepted' as ready from jobs j join uploads u using (upload_id) where k % 3 = 0),
        h as (select r.*, o.job_id as old_job, o.request_digest as old_digest, o.webhook_subscription_id as old_hook,
          min(case when o.job_id is null and ready then r.job_id end) over (partition by r.product_id, r.tenant_id, r.idempotency_key) as first_job
          from r left join old o using (product_id, tenant_id, idempotency_key))
        select h.job_id, h.tenant_id, case when old_job is null and first_job is null then 'source_unavailable' when old_job is null and first_job = h.job_id then 'created'
          when coalesce(old_digest, f.d) = h.d and (case when old_job is null then f.webhook_subscription_id else old_hook end) is not distinct from h.webhook_subscription_id then 'existing' else 'conflict' end as outcome
        from h left join r f on f.job_id = h.first_job""",
    "cancellation": f"""with {_JOBS} select case when k % 41 = 0 then 'not_found' when status = 'cancelled' then 'existing' when status in ('accepted', 'inspecting', 'processing', 'validating') then 'updated' else 'refused' end as outcome,
        count(*) as requests from jobs group by 1""",
    "artifact_duplicate_pages": """select 'job_' || l_orderkey as job_id, count(*) as artifacts, count(distinct l_linenumber) as pages, case when count(*) > 8 then 'too_many' else 'page_twice' end as rule
        from lineitem group by l_orderkey having count(*) > 8 or count(distinct l_linenumber) < count(*)""",
    "page_bytes_over": """with a as (select l_orderkey, l_linenumber, sum(cast(l_quantity as bigint)) over (partition by l_orderkey) as total,
          sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber range unbounded preceding) as running from lineitem)
        select 'job_' || l_orderkey as job_id, l_linenumber as page_number, cast(max(total) as bigint) as total_bytes, cast(max(running) as bigint) as running_bytes, max(total) <= 150 as within from a group by l_orderkey, l_linenumber""",
    "workflow_run_plan": """with p as (select p_partkey, p_partkey * 37 % 1100 as n from part), r as (select p_partkey, n, unnest(generate_series(0, (n - 1) // 50)) as run from p where n between 1 and 1000)
        select p_partkey, cast(run as integer) as run, cast(run * 50 + 1 as integer) as first_page, cast(least(n, (run + 1) * 50) as integer) as last_page, least(n, (run + 1) * 50) < n as continues_as_new from r""",
    "retry_backoff_schedule": "select l_linenumber as page_number, cast(least(30, pow(2, l_linenumber - 1)) as integer) as wait_seconds, l_linenumber < 3 as retries from (select distinct l_linenumber from lineitem)",
    "job_fsm_replay": f"""with recursive e as (select user_id as job, row_number() over (partition by user_id order by event_id) as place,
          (['inspecting', 'processing', 'validating', 'completed', 'cancelling', 'cancelled', 'partial'])[event_id % 7 + 1] as target from events),
        moves(a, b) as (values {', '.join(map(str, L.DOMAIN_TRANSITIONS))}),
        r as (select job, 0::bigint as place, 'accepted' as state, 0::bigint as moved, 0::bigint as refused from (select distinct job from e)
          union all select e.job, e.place, case when ok then e.target else r.state end, r.moved + ok::bigint, r.refused + (not ok)::bigint
          from r join e on e.job = r.job and e.place = r.place + 1, lateral (select e.target = r.state or exists (select 1 from moves where a = r.state and b = e.target) as ok))
        select job, state, moved, refused from r qualify row_number() over (partition by job order by place desc) = 1""",
    "fsm_relations": f"""with {_JOBS}, moves(relation, before, afters) as (values ('domain', 'accepted', ['inspecting', 'cancelling']), ('domain', 'inspecting', ['rejected', 'processing', 'cancelling']), ('domain', 'processing', ['validating', 'partial', 'cancelling']),
          ('domain', 'validating', ['completed', 'review_required', 'cancelling']), ('domain', 'cancelling', ['cancelled']), ('domain', 'partial', ['review_required']), ('store', 'accepted', ['processing', 'cancelled']), ('store', 'processing', ['validating', 'cancelled']),
          ('store', 'validating', ['completed', 'partial', 'review_required', 'cancelled']), ('store', 'cancelling', ['cancelled'])),
        s as (select tenant_id, case when status = 'processing' and k % 5 = 0 then 'validating' when status = 'processing' and k % 7 = 0 then 'accepted' else status end as state from jobs),
        m as (select relation, before, unnest(afters) as after from moves) select relation, before, after, count(*) as jobs, count(distinct tenant_id) as tenants from s join m on state = before group by all""",
    "page_workflow_status": """with p as (select l_orderkey as job, l_orderkey % 17 = 0 as cancelled, case when l_orderkey % 4 = 0 then 'succeeded' when l_partkey % 5 = 0 then 'exhausted' when l_partkey % 7 = 0 then 'permanently_failed'
          when l_orderkey % 3 = 0 and l_partkey % 2 = 0 then 'running' else 'succeeded' end as state from lineitem)
        select job, case when bool_or(cancelled) then 'cancelled' when bool_and(state = 'succeeded') then 'completed' when bool_and(state <> 'running') then 'partial' else 'running' end as status,
          count(*) filter (state = 'succeeded') as succeeded_pages, count(*) as pages from p group by job""",
    "ready_page_tasks": """with l as (select l_orderkey as job, l_linenumber as page, min(l_partkey) as k from lineitem group by all),
        t as (select job, page, cast(case when k % 3 = 0 then k % 2 + 1 else k % 3 + 1 end as integer) as next_attempt, row_number() over (partition by job order by page) as place from l where k % 3 < 2 and job % 19 <> 0)
        select job, page, next_attempt, 'ocr-job-' || job || '-page-' || page || '-attempt-' || next_attempt as activity_key from t where place <= 2""",
    "workflow_identifiers": f"""with {_JOBS} select job_id, 'ocr-v1-' || left(sha256(product_id || chr(0) || tenant_id || chr(0) || job_id), 32) as workflow_id,
        'products/' || product_id || '/tenants/' || tenant_id || '/pages/' || job_id || '/3/attempt-1.json' as path, 'ocr-page-' || lpad((k % 1000)::varchar, 4, '0') as activity_id from jobs""",
    "vector_topk_scoped": """with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
        s as (select q.vec_id as query_id, r.vec_id as record_id, round(list_dot_product(q.e, r.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(r.e, r.e))), 5) as similarity
          from v q join v r on q.label = r.label and q.vec_id <> r.vec_id where q.vec_id % 50 = 0)
        select query_id, record_id, similarity, row_number() over (partition by query_id order by similarity desc, record_id) as place from s qualify place <= 5""",
    "vector_point_id": """with r as (select vec_id, ['ten_' || label, 'mem_' || vec_id, 'sha256:' || sha256('mem_' || vec_id), 'emb_v1'] as parts from embeddings),
        h as (select vec_id, sha256(from_hex(hex('ocr-memory-point-v1') || list_reduce(list_transform(parts, lambda p: printf('%016X', strlen(p)) || hex(p)), lambda a, b: a || b))) as h from r)
        select vec_id, h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[cast(('0x' || h[17:17]) as integer) % 4 + 1] || h[18:20] || '-' || h[21:32] as point_id from h""",
    "event_windows": "select time_bucket(interval 6 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as value from events group by all",
    "event_sessions": """with g as (select user_id, event_id, ts, case when coalesce(ts - lag(ts) over w > interval 6 hour, true) then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g)
        select user_id, cast(session as bigint) as session, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from s group by user_id, session""",
}
