"""Queries over document observations: assembly, routing, rules and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, ids
from ..functions import text as X
from ..operators import assemble, evaluate, rules
from ..sources import tables

#: The same observations in SQL, for the oracles.
OBSERVATIONS = """
lines as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
observations as (select doc_id, cast(i // 40 + 1 as integer) as page,
    (case when doc_id % 17 = 0 then 'obs_' when doc_id % 5 = 0 and i % 2 = 0 then 'obs_docai_' else 'obs_native_' end) || doc_id || '_' || i as observation_id,
    text, (550 + (doc_id * 7919 + i * 104729) % 450) / 1000.0 as confidence, cast(i as integer) as reading_order
  from lines where regexp_matches(text, '\\S'))
"""


def observation_lines(spark, sf_dir):
    o = tables.observations(spark, sf_dir)
    return o.select("doc_id", "page", "observation_id", "confidence", "reading_order", F.octet_length("text").cast("long").alias("n_bytes"))


def leaf_observations(spark, sf_dir):
    return assemble.leaves(tables.turns(spark, sf_dir), "document_id").select("document_id", "observation_id", "reading_order")


def assembled_text_digest(spark, sf_dir):
    a = assemble.assemble(tables.observations(spark, sf_dir), "doc_id")
    return a.select("doc_id", F.sha2("text", 256).alias("digest"), F.size("citations").cast("long").alias("n_citations"), "confidence")


def routing_facts(spark, sf_dir):
    o = tables.observations(spark, sf_dir)
    by_page = o.groupBy("doc_id", "page").agg(F.bool_or(F.col("confidence") < assemble.LOW_CONFIDENCE).alias("low"), F.bool_or(~F.col("observation_id").startswith("obs_native_") & ~F.col("observation_id").startswith("obs_docai_")).alias("legacy"), F.bool_or(F.col("observation_id").startswith("obs_docai_")).alias("docai"))
    all_pages = tables.document_pages(spark, sf_dir).join(by_page, ["doc_id", "page"], "left")
    facts = all_pages.groupBy("doc_id").agg(
        F.coalesce(F.bool_or("low"), F.lit(False)).alias("low_confidence"), F.bool_or(F.col("low").isNull()).alias("empty_page"),
        F.bool_and(F.col("low").isNull()).alias("no_text"), F.coalesce(F.bool_or("legacy"), F.lit(False)).alias("legacy"), F.coalesce(F.bool_or("docai"), F.lit(False)).alias("docai"),
    )
    return facts.withColumn("provider", F.when(F.col("legacy"), "legacy-mixed").when(F.col("docai"), "native-text-document-ai").otherwise("native-text"))


def document_review_routing(spark, sf_dir):
    s = assemble.review_signals(routing_facts(spark, sf_dir))
    return s.select("doc_id", "provider", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"), "state")


def provenance_classes(spark, sf_dir):
    o = tables.observations(spark, sf_dir)
    p = o.groupBy("doc_id").agg(assemble.provenance(F.col("observation_id")).alias("provider"))
    return p.groupBy("provider", assemble.provenance_profile(F.col("provider")).alias("profile")).agg(F.count("*").alias("documents"))


def usable_page_filter(spark, sf_dir):
    o = tables.observations(spark, sf_dir).select("doc_id", "page", "reading_order", F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("\x01"))).otherwise(F.col("text")).alias("text"))
    return rules.usable_lines(o, "doc_id").groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.max("line").cast("long").alias("last_line"))


def identifier_violations(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    made = c.select("c_custkey", F.concat(F.lit("ten_"), key).alias("tenant"), F.concat(F.lit("job_"), F.col("c_name")).alias("job"), F.lower("c_mktsegment").alias("product"), F.concat(F.lit("k y"), key).alias("idempotency"), ids.digest(key).alias("digest"))
    checks = {k: ids.valid(k, F.col(k)) for k in ("tenant", "job", "product", "idempotency", "digest")}
    return rules.violations(made, checks, "c_custkey").groupBy("rule").agg(F.count("*").alias("violations"))


def polygon_validity(spark, sf_dir):
    li = tables.read(spark, sf_dir, "lineitem")
    x = lambda c, d: (F.col(c).cast("long") % d / F.lit(float(d))).alias("x")
    y = lambda c, d: (F.col(c).cast("long") % d / F.lit(float(d))).alias("y")
    points = F.array(F.struct(x("l_partkey", 4), y("l_suppkey", 4)), F.struct(x("l_orderkey", 4), y("l_linenumber", 4)), F.struct(x("l_quantity", 4), y("l_orderkey", 8)))
    made = li.select("l_linenumber", geometry.polygon_valid(points).alias("valid"), F.round(F.abs(geometry.twice_area(points)), 6).alias("area2"))
    return made.groupBy("l_linenumber", "valid").agg(F.count("*").alias("polygons"), F.round(F.sum("area2"), 3).alias("area2"))


def benchmark_pairs(spark, sf_dir):
    b = tables.read(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("candidate"))
    return b.join(after, "item_id").withColumnRenamed("text", "reference")


def char_error_rate_pairs(spark, sf_dir):
    """Every pair, in NFC and by code points."""
    return char_error_rate_all_pairs(spark, sf_dir).drop("limit")


def corpus_error_rate(spark, sf_dir):
    """Every pair within the bounds."""
    return corpus_error_rate_all_pairs(spark, sf_dir).drop("pairs", "limited")


def char_error_rate_all_pairs(spark, sf_dir):
    e = evaluate.evaluate_text(benchmark_pairs(spark, sf_dir), "reference", "candidate")
    return e.select("item_id", "char_edits", "char_units", F.round("char_error_rate", 6).alias("char_error_rate"), "limit")


def corpus_error_rate_all_pairs(spark, sf_dir):
    """Rates of the pairs within the bounds, with the number of all pairs and of those beyond."""
    p = char_error_rate_all_pairs(spark, sf_dir)
    within = lambda c: F.sum(F.when(F.col("limit").isNull(), F.col(c))).alias(c)
    g = p.groupBy((F.col("item_id") % 4).alias("cohort")).agg(F.count("*").alias("pairs"), F.count("limit").alias("limited"), within("char_edits"), within("char_units"))
    return g.withColumn("char_error_rate", F.round(X.rate(F.col("char_edits"), F.col("char_units")), 6))


def word_error_rate_pairs(spark, sf_dir):
    e = evaluate.evaluate_text(benchmark_pairs(spark, sf_dir), "reference", "candidate")
    return e.select("item_id", "char_edits", "char_units", "word_edits", "word_units", "char_error_rate", "word_error_rate", "limit")


def latency_nearest_rank(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 10 == 0, "failed").otherwise("completed").alias("outcome"), F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"))
    return evaluate.nearest_ranks(e, ["event_type", "outcome"], "elapsed_ms", [50, 95]).withColumnsRenamed({"p50": "p50_ms", "p95": "p95_ms"})


def confidence_calibration(spark, sf_dir):
    """Confidence of documents' lines held against whether they are of more than three words, by page source."""
    o = tables.observations(spark, sf_dir).withColumn("right", F.size(F.split(F.trim("text"), " +")) > 3)
    o = o.withColumn("kind", F.regexp_extract("observation_id", "^obs_([a-z]*)", 1))
    r = evaluate.reliability(o, "confidence", "right", "kind", bins=20)
    return r.select("kind", "bin", "n", *[F.round(c, 9).alias(c) for c in ("mean_confidence", "accuracy", "error")])


def field_score_join(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    expected = o.select(F.col("o_orderkey").alias("case_id"), F.explode(F.create_map(F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).alias("field", "value"))
    total = F.round(F.col("o_totalprice") + F.when(key % 7 == 0, 0.02).when(key % 5 == 0, 0.005).otherwise(0.0), 3).cast("string")
    found = o.select(F.col("o_orderkey").alias("case_id"), F.explode(F.create_map(F.lit("total"), total, F.lit("status"), F.when(key % 11 != 0, F.col("o_orderstatus")), F.lit("priority"), F.when(key % 13 == 0, F.lit("?")).otherwise(F.col("o_orderpriority")))).alias("field", "value")).where("value is not null")
    s = evaluate.field_scores(expected, found, ["case_id"], "field", "value")
    return s.groupBy("expected_fields", "correct_fields", "missing_fields", "wrong_fields").agg(F.count("*").alias("cases"))


def benchmark_mismatch_report(spark, sf_dir):
    b = tables.read(spark, sf_dir, "benchmark")
    key = F.col("item_id")
    manifest = b.select(key.alias("id"), F.sha2("text", 256).alias("sha256"))
    samples = b.where(key % 5 != 0).select(key.alias("id"), F.when(key % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), F.when(key % 11 == 0, "lost").otherwise("completed").alias("status"))
    extra = b.where(key % 13 == 0).select((key + 1000).alias("id"), F.sha2("text", 256).alias("sha256"), F.lit("completed").alias("status"))
    return evaluate.run_problems(manifest, samples.union(extra).union(samples.where("id % 9 = 0")))


def content_dedup(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    g = d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return g.where("copies > 1")


def quality_cohort_rollup(spark, sf_dir):
    s = assemble.review_signals(routing_facts(spark, sf_dir)).select("doc_id", "state")
    d = tables.read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = tables.read(spark, sf_dir, "labels")
    facts = d.join(labels, "doc_id").join(s, "doc_id").select("lang", "source", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("truth"), (F.col("state") == "completed").alias("auto"))
    return evaluate.cohorts(facts, ["lang", "source"], "truth", "auto")


def html_lines(spark, sf_dir):
    h = tables.html_observations(spark, sf_dir)
    return h.where("text <> ''").groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.octet_length("text")).alias("n_bytes"))


QUERIES = {f.__name__: f for f in (
    observation_lines, leaf_observations, assembled_text_digest, document_review_routing, provenance_classes, usable_page_filter, identifier_violations, polygon_validity,
    char_error_rate_pairs, corpus_error_rate, char_error_rate_all_pairs, corpus_error_rate_all_pairs, word_error_rate_pairs, latency_nearest_rank, confidence_calibration, field_score_join, benchmark_mismatch_report, content_dedup, quality_cohort_rollup, html_lines,
)}

# DuckDB's distance counts bytes, so each pair's different characters, and its different words, are numbered and stand as one byte each.
_PAIRS = r"""pairs as (select a.item_id, nfc_normalize(a.text) as r, nfc_normalize(b.text) as c from benchmark a join benchmark b on b.item_id = a.item_id + 1),
  parts as (select item_id, string_split(r, '') as rc, string_split(c, '') as cc, list_filter(regexp_split_to_array(r, '\s+'), lambda x: x <> '') as rw, list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '') as cw from pairs),
  known as (select *, list_distinct(list_concat(rc, cc)) as chars, list_distinct(list_concat(rw, cw)) as words from parts),
  coded as (select item_id, len(rc) as char_units, len(rw) as word_units, array_to_string(list_transform(rc, lambda x: chr(list_position(chars, x)::int)), '') as a, array_to_string(list_transform(cc, lambda x: chr(list_position(chars, x)::int)), '') as b,
    array_to_string(list_transform(rw, lambda x: chr(list_position(words, x)::int)), '') as v, array_to_string(list_transform(cw, lambda x: chr(list_position(words, x)::int)), '') as w from known),
  scored as (select item_id, levenshtein(a, b) as char_edits, char_units, levenshtein(v, w) as word_edits, word_units from coded)"""

_FACTS = f"""{OBSERVATIONS},
pages as (select doc_id, cast(unnest(generate_series(1, cast(ceil(len(string_split(coalesce(text, ''), chr(10))) / 40.0) as bigint))) as integer) as page from documents),
by_page as (select doc_id, page, bool_or(confidence < 0.6) as low, bool_or(not starts_with(observation_id, 'obs_native_') and not starts_with(observation_id, 'obs_docai_')) as legacy,
  bool_or(starts_with(observation_id, 'obs_docai_')) as docai from observations group by all),
facts as (select doc_id, coalesce(bool_or(low), false) as low_confidence, bool_or(low is null) as empty_page, bool_and(low is null) as no_text,
  case when coalesce(bool_or(legacy), false) then 'legacy-mixed' when coalesce(bool_or(docai), false) then 'native-text-document-ai' else 'native-text' end as provider
  from pages left join by_page using (doc_id, page) group by doc_id),
routed as (select doc_id, provider,
  concat_ws(',', case when provider = 'legacy-mixed' then 'legacy_processing_requires_review' end, case when empty_page then 'ocr_page_requires_manual_review' end,
    case when low_confidence then 'ocr_low_confidence' end, case when no_text then 'ocr_no_text_detected' end) as failures,
  concat_ws(',', case when provider = 'legacy-mixed' then 'manual_review_required' end, case when empty_page then 'manual_review_required' end,
    case when no_text then 'retake_include_readable_document' when low_confidence then 'retake_sharper_image' end) as warnings from facts)"""

ORACLES = {
    "observation_lines": f"with {OBSERVATIONS} select doc_id, page, observation_id, confidence, reading_order, cast(octet_length(encode(text)) as bigint) as n_bytes from observations",
    "leaf_observations": """
        with t as (select conv_id as document_id, 'obs_c' || conv_id || '_t' || turn as observation_id, cast(turn as integer) as reading_order,
          case when role = 'assistant' and turn > 0 then 'obs_c' || conv_id || '_t' || (turn - 1) end as parent from conversations)
        select document_id, observation_id, reading_order from t a where not exists (select 1 from t b where b.document_id = a.document_id and b.parent = a.observation_id)""",
    "assembled_text_digest": f"""
        with {OBSERVATIONS}, pages as (select doc_id, page, string_agg(text, chr(10) order by reading_order) as text, count(*) as n, min(confidence) as confidence from observations group by all)
        select doc_id, sha256(string_agg(text, chr(10) || chr(10) order by page)) as digest, cast(sum(n) as bigint) as n_citations, min(confidence) as confidence from pages group by doc_id""",
    "document_review_routing": f"with {_FACTS} select *, case when failures <> '' then 'review_required' else 'completed' end as state from routed",
    "provenance_classes": f"""with {_FACTS}, seen as (select distinct doc_id from observations)
        select provider, case provider when 'legacy-mixed' then 'native-text-transition-v1' when 'native-text-document-ai' then 'hybrid-ocr-v1' else 'native-text-v1' end as profile, count(*) as documents
        from facts join seen using (doc_id) group by all""",
    "usable_page_filter": f"""
        with {OBSERVATIONS}, o as (select doc_id, page, reading_order, case when doc_id % 29 = 0 then text || chr(1) else text end as text from observations),
        bad as (select distinct doc_id, page from o where octet_length(encode(text)) > 65536 or contains(text, chr(65533))
          or regexp_matches(text, '[\\x00-\\x08\\x0E-\\x1F\\x7F\\x{{80}}-\\x{{84}}\\x{{86}}-\\x{{9F}}]'))
        select doc_id, page, count(*) as lines, count(*) - 1 as last_line from o anti join bad using (doc_id, page) group by all""",
    "identifier_violations": """
        with made as (select c_custkey, lower(c_mktsegment) as product, 'job_' || c_name as job from customer)
        select rule, count(*) as violations from (
          select case when not regexp_full_match(job, 'job_[A-Za-z0-9_]{1,64}') then 'job' end as rule from made union all select 'idempotency' from made union all
          select case when not regexp_full_match(product, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?') then 'product' end from made) where rule is not null group by rule""",
    "polygon_validity": """
        with p as (select l_linenumber, (l_partkey % 4) / 4.0 as x1, (l_suppkey % 4) / 4.0 as y1, (l_orderkey % 4) / 4.0 as x2, (l_linenumber % 4) / 4.0 as y2,
          (cast(l_quantity as bigint) % 4) / 4.0 as x3, (l_orderkey % 8) / 8.0 as y3 from lineitem),
        a as (select l_linenumber, abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y1 - x1 * y3) as area2 from p)
        select l_linenumber, area2 > 2.220446049250313e-16 as valid, count(*) as polygons, round(sum(round(area2, 6)), 3) as area2 from a group by all""",
    "char_error_rate_pairs": f"with {_PAIRS} select item_id, char_edits, char_units, round(char_edits / char_units, 6) as char_error_rate from scored",
    "char_error_rate_all_pairs": f"with {_PAIRS} select item_id, char_edits, char_units, round(char_edits / char_units, 6) as char_error_rate, cast(null as varchar) as \"limit\" from scored",
    "corpus_error_rate_all_pairs": f"""with {_PAIRS} select item_id % 4 as cohort, count(*) as pairs, cast(0 as bigint) as limited, cast(sum(char_edits) as bigint) as char_edits, cast(sum(char_units) as bigint) as char_units,
        round(sum(char_edits) / sum(char_units), 6) as char_error_rate from scored group by 1""",
    "word_error_rate_pairs": f"""with {_PAIRS} select item_id, char_edits, char_units, word_edits, word_units, char_edits / char_units as char_error_rate, word_edits / word_units as word_error_rate, cast(null as varchar) as "limit" from scored""",
    "corpus_error_rate": f"with {_PAIRS} select item_id % 4 as cohort, cast(sum(char_edits) as bigint) as char_edits, cast(sum(char_units) as bigint) as char_units, round(sum(char_edits) / sum(char_units), 6) as char_error_rate from scored group by 1",
    "confidence_calibration": f"""
        with {OBSERVATIONS},
        j as (select regexp_extract(observation_id, '^obs_([a-z]*)', 1) as kind, confidence, len(regexp_split_to_array(trim(text, ' '), ' +')) > 3 as good from observations),
        b as (select kind, least(cast(floor(confidence * 20) as integer), 19) as bin, count(*) as n, avg(confidence) as mean_confidence, avg(good::integer) as accuracy from j group by 1, 2)
        select kind, bin, n, round(mean_confidence, 9) as mean_confidence, round(accuracy, 9) as accuracy, round(n / sum(n) over (partition by kind) * abs(mean_confidence - accuracy), 9) as error from b""",
    "latency_nearest_rank": """
        with e as (select event_type, case when user_id % 10 = 0 then 'failed' else 'completed' end as outcome, cast(floor(value * 100) as bigint) as ms from events)
        select event_type, outcome, count(*) as n, quantile_disc(ms, 0.5) as p50_ms, quantile_disc(ms, 0.95) as p95_ms from e group by all""",
    "field_score_join": """
        with s as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 0 else 1 end as total_ok,
          case when o_orderkey % 11 = 0 then 1 else 0 end as status_missing, case when o_orderkey % 13 = 0 then 1 else 0 end as priority_wrong from orders),
        c as (select 3 as expected_fields, total_ok + (1 - status_missing) + (1 - priority_wrong) as correct_fields, status_missing as missing_fields, (1 - total_ok) + priority_wrong as wrong_fields from s)
        select cast(expected_fields as bigint) as expected_fields, cast(correct_fields as bigint) as correct_fields, cast(missing_fields as bigint) as missing_fields, cast(wrong_fields as bigint) as wrong_fields, count(*) as cases from c group by all""",
    "benchmark_mismatch_report": """
        with r as (select item_id as id, case when item_id % 5 = 0 then 'no_sample' when item_id % 9 = 0 then 'duplicate' when item_id % 7 = 0 then 'digest' when item_id % 11 = 0 then 'status' end as problem from benchmark
          union all select item_id + 1000, 'not_in_manifest' from benchmark where item_id % 13 = 0)
        select * from r where problem is not null""",
    "content_dedup": "select sha256(text) as digest, count(*) as copies, min(doc_id) as first_doc from documents group by 1 having count(*) > 1",
    "quality_cohort_rollup": f"""
        with {_FACTS}, f as (select lang, source, quality = 0 or toxic = 1 as truth, failures = '' as auto from documents join labels using (doc_id) join routed using (doc_id))
        select lang, source, count(*) as documents, count(*) filter (truth) as needs_review, count(*) filter (truth and auto) as unsafe_accepted,
          cast(grouping(lang) as integer) as all_lang, cast(grouping(source) as integer) as all_source from f group by rollup (lang, source)""",
    "html_lines": """
        with p as (select page_id, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) as raw from pages),
        t as (select page_id, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as text from p)
        select page_id, count(*) as paragraphs, cast(sum(octet_length(encode(text))) as bigint) as n_bytes from t where text <> '' group by page_id""",
}
