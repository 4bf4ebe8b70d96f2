"""Queries over the service's inputs and shapes: decoding, provider responses, benchmarks, constraints, promotion, cache, imports, page workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, evaluate, lifecycle, regions, rules, store
from ..schema import PAGE, decode_strict
from ..sources import files, tables
from ..streaming import pages
from .lifecycle import _JOBS, now
from .streams import event_stream, run_once


def keys(spark, sf_dir, name="orders", key="o_orderkey"):
    return tables.read(spark, sf_dir, name).select(F.col(key).alias("k"))


def by_rule(df, checks):
    return rules.violations(df, checks, "k").groupBy("rule").agg(F.count("*").alias("violations"))


def strict_decode(spark, sf_dir):
    """Pages as JSON, some with a key that a page doesn't know, some not JSON at all."""
    good = '{"page":1,"width":10,"height":20,"observations":[]}'
    text = F.when(F.col("k") % 4 == 1, good.replace('"page"', '"pages"')).when(F.col("k") % 4 == 2, "no").otherwise(good)
    d = decode_strict(keys(spark, sf_dir, "events", "event_id").withColumn("json", text), "json", PAGE)
    return d.groupBy(F.coalesce("decode_error", F.lit("none")).alias("error"), F.col("decoded").isNotNull().alias("decoded")).agg(F.count("*").alias("pages"))


def provider_responses(spark, sf_dir):
    """Two lines of each response, by their anchors."""
    e = keys(spark, sf_dir, "events", "event_id").withColumn("first", F.concat(F.lit("líne "), F.col("k").cast("string"), F.lit("\n")))
    line = lambda start, end, confidence: F.struct(F.struct(F.struct(F.array(F.struct(start.alias("startIndex"), end.alias("endIndex"))).alias("textSegments")).alias("textAnchor"), F.lit(confidence).alias("confidence")).alias("layout"))
    n = F.length("first")
    lines = F.array(line(F.lit(None).cast("string"), n.cast("string"), 0.5), line(n.cast("string"), (n + 5).cast("string"), 0.75))
    document = F.struct(F.concat("first", F.lit("next\nrest")).alias("text"), F.array(F.struct(F.lit(1).alias("pageNumber"), lines.alias("lines"))).alias("pages"))
    made = files.provider_lines(e.select("k", F.to_json(F.struct(document.alias("document"))).alias("json")), "json", "k")
    return made.select("k", "page", "observation_id", "text", "confidence", "reading_order")


def benchmark_scores(spark, sf_dir):
    """A run over the benchmark's texts: a third with one character more, a fourth without its field, a fifth with another value."""
    b, k = tables.read(spark, sf_dir, "benchmark"), F.col("item_id")
    digest = F.sha2(F.col("text"), 256).alias("sha256")
    manifest = b.select(k.alias("id"), digest, F.col("text").alias("reference_text"), F.create_map(F.lit("total"), k.cast("string")).alias("expected_fields"))
    said = F.when(k % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    fields = F.when(k % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("total"), F.when(k % 5 == 0, k + 1).otherwise(k).cast("string")))
    samples = b.select(k.alias("id"), digest, F.lit("completed").alias("status"), (k * 10).alias("elapsed_ms"), said.alias("text"), fields.alias("fields"))
    cases, _ = evaluate.score_benchmark(manifest, samples)
    return cases.select("id", "elapsed_ms", F.round("char_error_rate", 6).alias("char_error_rate"), "expected_fields", "correct_fields", "missing_fields", "wrong_fields")


def page_workflow_stream(spark, sf_dir):
    """Jobs of two pages as a stream of events: a stale success, and every fifth job cancelled before its last page."""
    e = event_stream(spark, sf_dir)
    at = lambda n: (F.col("ts") + F.expr(f"interval {n} seconds")).cast("timestamp")
    event = lambda n, kind, page, attempt: F.struct(F.lit(kind).alias("kind"), F.lit(page).alias("page"), F.lit(attempt).alias("attempt"), F.lit(2).alias("pages"), at(n).alias("at"))
    steps = [event(0, "create", 0, 0), event(1, "claim", 1, 0), event(2, "claim", 2, 0), event(3, "success", 1, 1), event(4, "success", 2, 2), F.when(F.col("event_id") % 5 == 0, event(5, "cancel", 0, 0)), event(6, "success", 2, 1)]
    rows = e.select(F.col("event_id").cast("string").alias("job_id"), F.explode(F.array_compact(F.array(*steps))).alias("x")).select("job_id", "x.*")
    return run_once(spark, pages.page_workflows(rows)).groupBy("kind", "accepted", "status", "succeeded").agg(F.count("*").alias("n"))


def upload_shapes(spark, sf_dir):
    k = F.col("k")
    status = F.element_at(F.array(*map(F.lit, ["accepted", "inspecting", "uploaded", "rejected"])), (k % 4 + 1).cast("int"))
    held = F.when((k % 4 == 1) & (k % 11 > 0), F.lit("w"))
    u = keys(spark, sf_dir).select(
        "k", status.alias("status"), F.when(k % 7 > 0, F.lit("d")).alias("verified_digest"), F.lit(5).alias("verified_length"), F.when((k % 4 == 0) != (k % 9 == 0), F.lit("s")).alias("source_name"),
        held.alias("lease_owner"), held.alias("lease_expires_at"), F.when((k % 4 == 3) | (k % 13 == 0), F.lit("r")).alias("rejection_reason"), F.when(k % 5 > 0, k % 1500).alias("page_count"),
    )
    return by_rule(u, rules.upload_rules())


def outbox_shapes(spark, sf_dir):
    return by_rule(tables.outbox(spark, sf_dir).withColumn("k", F.col("event_id")), rules.outbox_rules())


def geometry_shapes(spark, sf_dir):
    k, n = F.col("k"), F.col("k") % 3 + 1
    page = lambda i: F.struct((i + F.when(k % 10 == 0, 1).otherwise(0)).cast("int").alias("page"), (100 + k % 7).cast("int").alias("width"), F.lit(200).alias("height"))
    size, one = (100 + k % 7) * 200, lambda d: F.when(k % d == 0, 1).otherwise(0)
    g = keys(spark, sf_dir).select("k", F.transform(F.sequence(F.lit(1).cast("long"), n), page).alias("geometries"), (n + one(8)).alias("page_count"), (size + one(6)).alias("max_pixels"), (size * n + one(12)).alias("total_pixels"))
    return by_rule(g, rules.geometry_rules())


def locator_shapes(spark, sf_dir):
    k = F.col("k")
    o = keys(spark, sf_dir).select(
        "k", F.when(k % 5 == 0, "B").otherwise("bucket-1").alias("object_bucket"), F.when(k % 6 == 0, "").when(k % 9 == 0, "a\x01b").otherwise("n").alias("object_name"), F.when(k % 7 == 0, "v 1").alias("object_version"),
        F.when(k % 8 == 0, "sha256:0").otherwise("sha256:" + "0" * 64).alias("object_digest"), (k % 100).alias("content_length"),
    )
    return by_rule(o, store.locator_rules())


def request_bounds(spark, sf_dir):
    k = F.col("k")
    r = keys(spark, sf_dir).select(
        "k", F.when(k % 5 == 0, "poem").otherwise("invoice").alias("document_type"), F.when(k % 6 == 0, "slow").otherwise("fast").alias("processing_class"),
        F.when(k % 7 == 0, F.array(F.lit("en"), F.lit("en"))).when(k % 8 == 0, F.array(F.lit("not a language"))).otherwise(F.array(F.lit("en"), F.lit("fr-FR"))).alias("language_hints"),
        F.when(k % 11 == 0, "other").when(k % 3 > 0, "nutrition_label").alias("schema_id"), F.lit("1").alias("schema_version"),
    )
    return by_rule(r, rules.request_rules(["invoice"], ["fast"], [("nutrition_label", "1")]))


def tensor_bounds(spark, sf_dir):
    k = F.col("k")
    tensor = lambda name, shape: F.array(F.struct(name.alias("name"), shape.alias("shape"), F.lit(4).alias("bytes_per_element")))
    large = F.when(k % 10 == 0, F.array(F.lit(1 << 15), F.lit(1 << 14))).otherwise(F.array(F.lit(1), (k % 5 + 1).cast("int")))
    none = F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return by_rule(keys(spark, sf_dir).select("k", tensor(F.lit("a"), large).alias("inputs"), tensor(F.when(k % 6 == 0, "a").otherwise("b"), none).alias("outputs")), rules.tensor_rules())


def page_order(spark, sf_dir):
    """Lines of an order as observations, each under the line before it."""
    n = F.col("l_linenumber")
    o = tables.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.concat(F.lit("o"), n.cast("string")).alias("observation_id"), n.cast("int").alias("reading_order"),
        F.when(n > 1, F.concat(F.lit("o"), (n - 1).cast("string"))).alias("parent_observation_id"), F.when(F.col("l_partkey") % 50 == 0, " ").otherwise("x").alias("text"),
    )
    return rules.page_rules(o, "doc").groupBy("rule").agg(F.count("*").alias("violations"))


def batch_coverage(spark, sf_dir):
    o = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("at"), (F.col("l_orderkey") % 7 + 1).alias("n"))
    return rules.coverage(o, "l_orderkey", "at", "n").groupBy("covered").agg(F.count("*").alias("batches"))


def promotion_outcomes(spark, sf_dir):
    k = F.col("k")
    o = keys(spark, sf_dir)
    path = F.concat(F.lit("p"), k.cast("string")).alias("path")
    stored = o.where(k % 2 == 0).select(path, F.when(k % 3 == 0, -1).otherwise(k % 5).alias("digest"))
    return lifecycle.promotion(o.select(path, (k % 5).alias("digest")), stored).groupBy("outcome").agg(F.count("*").alias("sources"))


def status_cache(spark, sf_dir):
    """Jobs asked for in a cache whose records have other ages, and every tenth another tenant."""
    j, k = tables.jobs(spark, sf_dir), F.col("order_key")
    records = j.select("job_id", "product_id", F.when(k % 10 == 0, "ten_other").otherwise(F.col("tenant_id")).alias("tenant_id"), "status", (now() - F.make_dt_interval(mins=(k % 100).cast("int"))).alias("stored_at"))
    found = lifecycle.cache_lookup(j.select("job_id", "product_id", "tenant_id"), records, now(), 600, 3600)
    return found.groupBy("outcome", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("jobs"))


_STAGES = {
    "claim": [(10, 0, "busy"), "claimed"], "scan": [(7, 0, "infected"), (7, 1, "error"), "clean"], "read": [(11, 0, "mismatch"), (11, 1, "error"), "ok"],
    "inspect": [(13, 0, "unsupported"), (13, 1, "unsafe"), (13, 2, "limit"), (13, 3, "error"), "ok"], "promote": [(17, 0, "conflict"), (17, 1, "error"), "ok"], "accept": [(19, 0, "error"), "ok"],
}


def import_decisions(spark, sf_dir):
    def stage(*cases):
        out = F.lit(cases[-1])
        for d, r, value in reversed(cases[:-1]):
            out = F.when(F.col("k") % d == r, value).otherwise(out)
        return out

    e = keys(spark, sf_dir, "events", "event_id").withColumns({name: stage(*cases) for name, cases in _STAGES.items()})
    return e.groupBy(lifecycle.importer_decision().alias("decision")).agg(F.count("*").alias("uploads"))


def hybrid_page_sources(spark, sf_dir):
    e, k = keys(spark, sf_dir, "events", "event_id"), F.col("k")
    some = F.array(F.lit("x"))
    native = e.select("k", F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(some).alias("observations"))
    error = F.when(k % 7 == 0, "permanent").when(k % 7 == 1, "timeout")
    provider = e.where(k % 5 > 0).select("k", F.when(error.isNull(), some).alias("observations"), error.alias("error"))
    return assemble.hybrid_pages(native, provider, ["k"]).groupBy("source", F.size("observations").alias("observations")).agg(F.count("*").alias("pages"))


def page_observations(spark, sf_dir):
    """Two regions of each page, the lower one first, read from top to bottom and put back on the page before its crop."""
    k = F.col("k")
    region = lambda top, confidence: F.struct(F.lit(0.25).alias("left"), F.lit(top).alias("top"), F.lit(0.75).alias("right"), F.lit(top + 0.25).alias("bottom"), F.lit(confidence).alias("confidence"))
    crop = F.struct(F.lit("crop").alias("kind"), F.lit(0.5).alias("left"), F.lit(0.0).alias("top"), F.lit(0.5).alias("width"), F.lit(0.5).alias("height"), F.lit(0.0).alias("degrees"))
    text = lambda a: F.concat(F.lit(a), k.cast("string"))
    p = keys(spark, sf_dir, "part", "p_partkey").select(k.cast("int").alias("page"), F.array(region(0.5, 0.5), region(0.0, 0.75)).alias("regions"), F.array(text("low"), text("high")).alias("texts"), F.array(crop).alias("steps"))
    o = regions.page_observations(p)
    return o.select("page", "observation_id", "reading_order", "text", "confidence", F.col("polygon")[0]["x"].alias("left"), F.col("polygon")[2]["y"].alias("bottom"))


QUERIES = {f.__name__: f for f in (
    strict_decode, provider_responses, benchmark_scores, page_workflow_stream, upload_shapes, outbox_shapes, geometry_shapes, locator_shapes, request_bounds, tensor_bounds,
    page_order, batch_coverage, promotion_outcomes, status_cache, import_decisions, hybrid_page_sources, page_observations,
)}


def _counted(table: str, key: str, **broken: str) -> str:
    """SQL for the number of rows that break each rule, by its condition."""
    parts = [f"select '{rule}' as rule, count(*) as violations from (select *, {key} as k from {table}) where {condition}" for rule, condition in broken.items()]
    return f"select * from ({' union all '.join(parts)}) where violations > 0"


def _stage(name: str) -> str:
    *cases, rest = _STAGES[name]
    return "case " + " ".join(f"when event_id % {d} = {r} then '{v}'" for d, r, v in cases) + f" else '{rest}' end as {'read_' if name == 'read' else name}"


ORACLES = {
    "strict_decode": """select case event_id % 4 when 1 then 'unknown:pages' when 2 then 'not_an_object' else 'none' end as error, event_id % 4 in (0, 3) as decoded, count(*) as pages from events group by all""",
    "provider_responses": """select event_id as k, cast(1 as integer) as page, 'obs_docai_p1_l' || i as observation_id, case i when 0 then 'líne ' || event_id || chr(10) else 'next' || chr(10) end as text,
        case i when 0 then 0.5 else 0.75 end::double as confidence, cast(i as integer) as reading_order from events, range(2) as r(i)""",
    "benchmark_scores": """select item_id as id, item_id * 10 as elapsed_ms, round(case when item_id % 3 = 0 then 1.0 / length(text) else 0.0 end, 6)::double as char_error_rate, cast(1 as bigint) as expected_fields,
        cast(item_id % 4 <> 0 and item_id % 5 <> 0 as bigint) as correct_fields, cast(item_id % 4 = 0 as bigint) as missing_fields, cast(item_id % 4 <> 0 and item_id % 5 = 0 as bigint) as wrong_fields from benchmark""",
    "page_workflow_stream": """with c as (select count(*) as n, count(*) filter (event_id % 5 = 0) as c from events),
        t as (select 'create' as kind, true as accepted, 'running' as status, 0 as succeeded, n from c union all select 'claim', true, 'running', 0, 2 * n from c union all select 'success', true, 'running', 1, n from c
          union all select 'success', false, 'running', 1, n from c union all select 'cancel', true, 'cancelled', 1, c from c union all select 'success', false, 'cancelled', 1, c from c union all select 'success', true, 'completed', 2, n - c from c)
        select kind, accepted, status, cast(succeeded as integer) as succeeded, cast(n as bigint) as n from t where n > 0""",
    "upload_shapes": _counted("orders", "o_orderkey", verification="k % 7 = 0", accepted_source="k % 9 = 0", lease="k % 4 = 1 and k % 11 = 0", rejection="k % 4 <> 3 and k % 13 = 0", parser="k % 4 = 0 and (k % 5 = 0 or k % 1500 not between 1 and 1000)"),
    "outbox_shapes": _counted("events", "event_id", published="k % 4 = 0 and (k % 6 < 2 or k % 97 = 0)", dead="k % 97 = 0 and (k % 6 < 2 or k % 21 <> 20)"),
    "geometry_shapes": _counted("orders", "o_orderkey", count="k % 8 = 0", numbered="k % 10 = 0", largest="k % 6 = 0", total="k % 12 = 0"),
    "locator_shapes": _counted("orders", "o_orderkey", bucket="k % 5 = 0", name="k % 6 = 0 or k % 9 = 0", version="k % 7 = 0", digest="k % 8 = 0", length="k % 100 = 0"),
    "request_bounds": _counted("orders", "o_orderkey", document_type="k % 5 = 0", processing_class="k % 6 = 0", hints="k % 7 = 0 or k % 8 = 0", schema="k % 11 = 0"),
    "tensor_bounds": _counted("orders", "o_orderkey", rank="k % 7 = 0", bytes="k % 10 = 0", disjoint="k % 6 = 0"),
    "page_order": """with o as (select l_orderkey as d, l_linenumber as n, l_partkey as p, count(*) over (partition by l_orderkey, l_linenumber) as m from lineitem),
        v as (select 'unique_order' as rule, count(*) as violations from o where m > 1 union all select 'unique_id', count(*) from o where m > 1 union all select 'text_not_blank', count(*) from o where p % 50 = 0
          union all select 'parent_earlier', count(*) from o where n > 1 and not exists (select 1 from lineitem where l_orderkey = d and l_linenumber = n - 1))
        select * from v where violations > 0""",
    "batch_coverage": """with g as (select l_orderkey, count(*) = l_orderkey % 7 + 1 and count(distinct l_linenumber) = l_orderkey % 7 + 1 and min(l_linenumber) = 1 and max(l_linenumber) = l_orderkey % 7 + 1 as covered from lineitem group by 1)
        select covered, count(*) as batches from g group by 1""",
    "promotion_outcomes": "select case when o_orderkey % 2 = 1 then 'copy' when o_orderkey % 3 = 0 then 'conflict' else 'replay' end as outcome, count(*) as sources from orders group by 1",
    "status_cache": f"""with {_JOBS}, c as (select status, k % 100 < case when status = 'processing' then 10 else case when status = 'partial' then 60 else 60 end end as live, k % 10 = 0 as other from jobs)
        select case when not live then 'miss' when other then 'foreign' else 'hit' end as outcome, case when live and not other then status else 'none' end as status, count(*) as jobs from c group by all""",
    "import_decisions": f"""with s as (select {', '.join(map(_stage, _STAGES))} from events)
        select case when claim <> 'claimed' then 'skip:' || claim when scan = 'infected' then 'reject:malware' when scan <> 'clean' then 'retry:scan' when read_ = 'mismatch' then 'reject:source_changed' when read_ <> 'ok' then 'retry:read'
          when inspect in ('unsupported', 'unsafe', 'limit') then 'reject:' || inspect when inspect <> 'ok' then 'retry:inspect' when promote = 'conflict' then 'reject:conflict' when promote <> 'ok' then 'retry:promote'
          when accept <> 'ok' then 'retry:accept' else 'accept' end as decision, count(*) as uploads from s group by 1""",
    "hybrid_page_sources": """with s as (select case when event_id % 3 > 0 then 'native' when event_id % 5 = 0 then 'missing' when event_id % 7 = 0 then 'empty_native' when event_id % 7 = 1 then 'retry' else 'provider' end as source from events)
        select source, cast(source in ('native', 'provider') as integer) as observations, count(*) as pages from s group by all""",
    "page_observations": """select cast(p_partkey as integer) as page, 'obs_p' || p_partkey || '_r' || i as observation_id, cast(i as integer) as reading_order, case i when 0 then 'high' else 'low' end || p_partkey as text,
        case i when 0 then 0.75 else 0.5 end::double as confidence, 0.625::double as "left", case i when 0 then 0.125 else 0.375 end::double as bottom from part, range(2) as r(i)""",
}
