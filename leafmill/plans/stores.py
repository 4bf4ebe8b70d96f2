"""Queries over the remaining store operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as S
from ..schema import RESULT
from ..sources import tables
from .lifecycle import _JOBS, NOW, now


def orders(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))


def array_insert(spark, sf_dir):
    o = orders(spark, sf_dir).select("k", F.sequence(F.lit(1), F.col("k") % 3 + 1).alias("page"), F.transform(F.sequence(F.lit(1), F.col("k") % 3 + 1), lambda p: p * 10 + F.col("k") % 7).alias("length"))
    return S.unnest(o, "page", "length")


def revision_swap(spark, sf_dir):
    """Line items as updates of their order, taken by ship date; each names the revision it was made from."""
    current = orders(spark, sf_dir).where("k % 10 > 0").select("k", (F.col("k") % 3).alias("revision"))
    line = F.col("l_linenumber").cast("int")
    named = F.when(line != 7, F.col("l_orderkey") % 3 + F.floor((line - 1) / 2))
    updates = tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), line.alias("line"), F.col("l_shipdate").alias("at_date"), named.alias("revision"))
    return S.compare_and_swap(current, updates, ["k"], ["at_date", "line"]).select("k", "line", "outcome", "revision")


def work_flags(spark, sf_dir):
    o = tables.outbox(spark, sf_dir)
    flag = o.select("product_id", "tenant_id", (F.col("event_id") % 50 == 0).alias("upload_pending"), (F.col("event_id") % 70 == 1).alias("dispatch_pending"))
    return S.merge_flags(flag.where("not upload_pending"), flag.where("upload_pending"), ["product_id", "tenant_id"], ["upload_pending", "dispatch_pending"])


def cache_cascade(spark, sf_dir):
    o = orders(spark, sf_dir).select("k", F.concat(F.lit("n"), F.col("k").cast("string")).alias("native_document_id"))
    li = tables.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("native_document_id"), "l_linenumber")
    _, children = S.cascade_delete(o, li, o.where("k % 4 = 0"), ["k"], "native_document_id")
    return children.groupBy("l_linenumber").agg(F.count("*").alias("pages"))


def object_versions(spark, sf_dir):
    o = orders(spark, sf_dir)
    generation = F.when(F.col("k") % 3 > 0, F.col("k"))
    version = F.when(F.col("k") % 5 == 0, F.lit(None).cast("string")).when(F.col("k") % 7 == 0, F.concat(F.lit("v"), F.col("k").cast("string"))).when(F.col("k") % 11 == 0, (F.col("k") + 1).cast("string")).otherwise(F.col("k").cast("string"))
    v = S.version_in_step(generation, version)
    return o.select("k", v["generation"].alias("generation"), v["version"].alias("version"))


def scope_release(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    s = c.select("c_custkey", F.when(k % 3 == 0, "worker-a").when(k % 3 == 1, "worker-b").alias("lease_owner"), F.when(k % 3 < 2, now() + F.make_dt_interval(mins=(k % 5 - 2).cast("int"))).alias("lease_expires_at"))
    return S.release_scopes(s, "worker-a", now()).groupBy("released", F.coalesce("lease_owner", F.lit("none")).alias("owner")).agg(F.count("*").alias("scopes"))


def inspection_queue(spark, sf_dir):
    u = tables.jobs(spark, sf_dir)
    k = F.col("order_key")
    u = u.select("product_id", "tenant_id", "upload_id", F.col("created_at").alias("uploaded_at"), F.when(k % 3 == 0, "uploaded").when(k % 3 == 1, "inspecting").otherwise("accepted").alias("status"), (now() + F.make_dt_interval(mins=(k % 5 - 2).cast("int"))).alias("lease_expires_at"))
    return S.inspection_candidates(u, now(), 2).select("tenant_id", "upload_id", F.col("place").cast("long").alias("place"))


def native_pages(spark, sf_dir):
    j, u = tables.jobs(spark, sf_dir), tables.uploads(spark, sf_dir)
    d = j.where("order_key % 2 = 0").join(u.select("upload_id", "document_version"), "upload_id")
    d = d.select("product_id", "tenant_id", "job_id", F.col("order_key").alias("native_document_id"), F.when(F.col("order_key") % 6 == 0, F.lit("sha256:old")).otherwise(F.col("document_version")).alias("document_version"))
    p = tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("native_document_id"), F.col("l_linenumber").alias("page_number"), F.concat(F.lit("page"), F.col("l_partkey").cast("string")).alias("page_data"))
    return S.native_page_lookup(p, d, j, u).groupBy("job_id").agg(F.count("*").alias("pages"), F.max("document_bytes").alias("document_bytes"), F.min("document_bytes").alias("least"))


def frame_budget(spark, sf_dir):
    li = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    f = li.select("l_orderkey", F.col("l_linenumber").alias("frame"), (F.col("p") % 500 + 1).cast("int").alias("width"), (F.col("p") % 300 + 1).cast("int").alias("height"))
    return S.frames(f, "l_orderkey", 200_000).groupBy("l_orderkey").agg(F.max("running_pixels").alias("pixels"), F.bool_and("within").alias("within"))


def upload_verification(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    body = F.encode(F.when(k % 9 == 0, "short").otherwise(F.concat(F.lit("%PDF-1.7 body "), k.cast("string"))), "UTF-8")
    length = F.octet_length(body) + F.when(k % 5 == 0, 1).otherwise(0)
    from ..functions.ids import digest

    want = F.when(k % 7 == 0, F.lit("sha256:0")).otherwise(digest(body))
    return p.groupBy(S.upload_verified(body, length, want).alias("outcome"), S.ratio_ok(k % 10, k).alias("ratio_ok")).agg(F.count("*").alias("uploads"))


def job_ages(spark, sf_dir):
    o = orders(spark, sf_dir)
    at = F.col("o_orderdate")
    return o.select("k", S.elapsed_ms(at, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).alias("age_ms"), S.clock_ok(at + F.make_dt_interval(secs=F.col("k") % 120), at).alias("clock_ok"))


def retry_decisions(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, S.RETRYABLE)), (F.col("event_id") % 6 + 1).cast("int"))
    attempt = (F.floor(F.col("event_id") / 6) % 3 + 1).cast("int")
    return e.select(kind.alias("kind"), attempt.alias("attempt")).groupBy("kind", "attempt").agg(F.count("*").alias("failures"), F.max(S.retry_plan(F.col("kind"), F.col("attempt"))).alias("wait_seconds"))


def artifact_totals(spark, sf_dir):
    a = tables.artifacts(spark, sf_dir).withColumn("content_length", F.when(F.regexp_extract("job_id", r"(\d+)", 1).cast("long") % 8 == 0, 0).otherwise(F.col("content_length") * 400_000))
    return S.artifact_total(a, "job_id").groupBy("outcome").agg(F.count("*").alias("documents"), F.sum("artifacts").alias("artifacts"))


def result_violations(spark, sf_dir):
    """Results made from orders, each broken in its own way or in none."""
    from ..operators.rules import violations

    k = F.col("k")
    shape = "named_struct('document_id', if(k % 5 = 0, 'd', concat('doc_', k)), 'document_version', concat('sha256:', sha2(cast(k as string), 256)), 'text', if(k % 2 = 0, 'x', ''), 'citations', if(k % 4 = 0, array(), array(named_struct('page', 1))), 'pages', array(named_struct('page', 1), named_struct('page', if(k % 7 = 0, 1, 2))), 'fields', map(if(k % 9 = 0, '', 'a.b'), named_struct('value', '1', 'confidence', if(k % 11 = 0, 1.01D, 0.5D), 'evidence', array(named_struct('page', 1)))))"
    r = orders(spark, sf_dir).select("k", F.from_json(F.to_json(F.expr(shape)), RESULT).alias("r")).select("k", "r.*")
    del k
    return violations(r, S.result_rules(), "k").groupBy("rule").agg(F.count("*").alias("results"))


QUERIES = {f.__name__: f for f in (
    array_insert, revision_swap, work_flags, cache_cascade, object_versions, scope_release, inspection_queue, native_pages, frame_budget, upload_verification, job_ages, retry_decisions, artifact_totals, result_violations,
)}

ORACLES = {
    "array_insert": "select o_orderkey as k, page, page * 10 + o_orderkey % 7 as length from orders, lateral (select unnest(generate_series(1, o_orderkey % 3 + 1)) as page)",
    "revision_swap": """with recursive u as (select l_orderkey as k, cast(l_linenumber as integer) as line, case when l_linenumber <> 7 then l_orderkey % 3 + (l_linenumber - 1) // 2 end as named, l_orderkey % 10 > 0 as known,
          row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) as n from lineitem),
        f as (select k, line, n, known, case when named = k % 3 then 'swapped' else 'stale' end as outcome, k % 3 + cast(named is not distinct from k % 3 as bigint) as revision from u where n = 1
          union all select u.k, u.line, u.n, u.known, case when u.named = f.revision then 'swapped' else 'stale' end, f.revision + cast(u.named is not distinct from f.revision as bigint) from f join u on u.k = f.k and u.n = f.n + 1)
        select k, line, case when known then outcome else 'not_found' end as outcome, case when known then revision end as revision from f""",
    "work_flags": "select 'p' || (user_id % 3) as product_id, 'ten_' || user_id as tenant_id, bool_or(event_id % 50 = 0) as upload_pending, bool_or(event_id % 70 = 1) as dispatch_pending from events group by all",
    "cache_cascade": "select l_linenumber, count(*) as pages from lineitem where l_orderkey % 4 <> 0 group by 1",
    "object_versions": """with v as (select o_orderkey as k, case when o_orderkey % 3 > 0 then o_orderkey end as g, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 'v' || o_orderkey when o_orderkey % 11 = 0 then (o_orderkey + 1)::varchar else o_orderkey::varchar end as v from orders)
        select k, case when v is null then g when g is null or g = try_cast(v as bigint) then try_cast(v as bigint) end as generation, case when v is null then g::varchar when g is null or g is not distinct from try_cast(v as bigint) then v end as version from v""",
    "scope_release": """with s as (select case c_custkey % 3 when 0 then 'worker-a' when 1 then 'worker-b' end as o, c_custkey % 5 - 2 > 0 as live from customer)
        select coalesce(o = 'worker-a' and live, false) as released, case when o = 'worker-a' and live then 'none' else coalesce(o, 'none') end as owner, count(*) as scopes from s group by all""",
    "inspection_queue": f"""with {_JOBS}, u as (select jobs.*, o_orderdate as since from jobs join orders on k = o_orderkey where k % 3 = 0 or (k % 3 = 1 and k % 5 - 2 <= 0))
        select tenant_id, upload_id, row_number() over (partition by product_id, tenant_id order by since, upload_id) as place from u qualify place <= 2""",
    "native_pages": """select 'job_' || l_orderkey as job_id, count(*) as pages, cast(sum(length('page' || l_partkey)) as bigint) as document_bytes, cast(sum(length('page' || l_partkey)) as bigint) as least
        from lineitem where l_orderkey % 2 = 0 and l_orderkey % 6 <> 0 group by l_orderkey""",
    "frame_budget": """with f as (select l_orderkey, l_linenumber, min(l_partkey) as p from lineitem group by all)
        select l_orderkey, cast(sum((p % 500 + 1) * (p % 300 + 1)) as bigint) as pixels, sum((p % 500 + 1) * (p % 300 + 1)) <= 200000 as within from f group by 1""",
    "upload_verification": """select case when p_partkey % 9 = 0 then 'too_short' when p_partkey % 5 = 0 then 'length' when p_partkey % 7 = 0 then 'digest' else 'verified' end as outcome,
        p_partkey <= p_partkey % 10 * 200 as ratio_ok, count(*) as uploads from part group by all""",
    "job_ages": "select o_orderkey as k, greatest(0, date_diff('millisecond', o_orderdate, timestamp '1998-01-01')) as age_ms, o_orderkey % 120 <= 60 as clock_ok from orders",
    "retry_decisions": """with e as (select (['provider_rate_limited', 'dependency_unavailable', 'revision_conflict', 'invalid_input', 'scope_not_found', 'iteration_limit'])[event_id % 6 + 1] as kind, cast((event_id // 6) % 3 + 1 as integer) as attempt from events)
        select kind, attempt, count(*) as failures, cast(max(case when kind in ('invalid_input', 'scope_not_found', 'iteration_limit') or attempt >= 3 then null when kind = 'provider_rate_limited' then 65 else pow(2, attempt - 1) end) as integer) as wait_seconds from e group by all""",
    "artifact_totals": """with a as (select l_orderkey, count(*) as n, sum(case when l_orderkey % 8 = 0 then 0 else cast(l_quantity as bigint) * 400000 end) as b from lineitem group by 1)
        select case when b > 67108864 then 'too_large' when b = 0 then 'corrupt' else 'within' end as outcome, count(*) as documents, cast(sum(n) as bigint) as artifacts from a group by 1""",
    "result_violations": """select rule, count(*) as results from (select unnest(list_filter([case when o_orderkey % 5 = 0 then 'document_id' end, case when o_orderkey % 4 = 0 then 'citations' end,
        case when o_orderkey % 7 = 0 then 'pages' end, case when o_orderkey % 9 = 0 then 'field_names' end, case when o_orderkey % 11 = 0 then 'evidence' end], lambda x: x is not null)) as rule from orders) group by 1""",
}
