"""The engine's logical tables from the star schema and text tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` as observations, 40 to a page; blank lines are none, but count in the order."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    i, doc = F.col("i"), F.col("doc_id")
    kind = F.when(doc % 17 == 0, "obs_").when((doc % 5 == 0) & (i % 2 == 0), "obs_docai_").otherwise("obs_native_")
    left, top = F.pmod(doc + i, F.lit(40)) / 100.0, (i % LINES_PER_PAGE) / 40.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return docs.where(F.col("text").rlike(r"\S")).select(
        "doc_id", (F.floor(i / LINES_PER_PAGE) + 1).cast("int").alias("page"),
        F.concat(kind, doc.cast("string"), F.lit("_"), i.cast("string")).alias("observation_id"),
        F.lit("line").alias("level"), "text", ((550 + F.pmod(doc * 7919 + i * 104729, F.lit(450))) / 1000.0).alias("confidence"),
        F.array(point(left, top), point(left + 0.5, top), point(left + 0.5, top + 0.02), point(left, top + 0.02)).alias("polygon"),
        i.cast("int").alias("reading_order"), F.lit(None).cast("string").alias("parent_observation_id"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of ``documents``, those without text included."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    last = F.ceil(lines / LINES_PER_PAGE).cast("int")
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), last)).alias("page"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of ``conversations`` as observations; an assistant's turn has the user's turn before it as parent."""
    conv = read(spark, sf_dir, "conversations")
    ident = lambda turn: F.concat(F.lit("obs_c"), F.col("conv_id").cast("string"), F.lit("_t"), turn.cast("string"))
    parent = F.when((F.col("role") == "assistant") & (F.col("turn") > 0), ident(F.col("turn") - 1))
    return conv.select(F.col("conv_id").alias("document_id"), ident(F.col("turn")).alias("observation_id"), "text", F.col("turn").cast("int").alias("reading_order"), parent.alias("parent_observation_id"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as jobs: the customer is the tenant, the market segment the product."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    status = F.when(F.col("o_orderkey") % 23 == 0, "cancelled").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("partial")
    key = F.col("o_orderkey").cast("string")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.concat(F.lit("job_"), key).alias("job_id"), F.lower("c_mktsegment").alias("product_id"), F.concat(F.lit("ten_"), F.col("o_custkey").cast("string")).alias("tenant_id"),
        F.concat(F.lit("key-"), (F.col("o_orderkey") % 4999).cast("string")).alias("idempotency_key"), F.concat(F.lit("sha256:"), F.sha2(key, 256)).alias("request_digest"),
        status.alias("status"), F.concat(F.lit("upl_"), key).alias("upload_id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("whs_"), (F.col("o_custkey") % 7).cast("string"))).alias("webhook_subscription_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "nutrition_label").alias("extraction_schema_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("order_key"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload for each job."""
    j = jobs(spark, sf_dir)
    key = F.col("order_key")
    status = F.when(key % 9 == 0, "rejected").when(key % 31 == 0, "uploaded").otherwise("accepted")
    return j.select("upload_id", "product_id", "tenant_id", status.alias("status"), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("doc"), key.cast("string")), 256)).alias("document_version"), (key % 40 + 1).cast("int").alias("page_count"), "created_at")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of finished jobs; some are missing."""
    j = jobs(spark, sf_dir).where("status in ('completed', 'partial') and order_key % 13 <> 0")
    return j.select("job_id", "product_id", "tenant_id", F.concat(F.lit("doc_"), F.col("order_key").cast("string")).alias("document_id"), F.col("request_digest").alias("document_version"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as page artifacts; (job, page) isn't unique there."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("job_id"), F.col("l_linenumber").alias("page_number"), (F.col("l_linenumber") % 3 + 1).alias("attempt"),
        F.col("l_quantity").cast("long").alias("content_length"), F.col("l_partkey").alias("part_key"), F.col("l_returnflag").alias("flag"),
    )


#: Event types of the outbox, by the remainder of the event's number.
EVENT_TYPES = ["ocr.job.accepted.v1", "ocr.job.cancellation_requested.v1", "ocr.job.completed.v1", "ocr.job.partial.v1", "ocr.job.review_required.v1"]


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as outbox rows with delivery state."""
    e, key = read(spark, sf_dir, "events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, EVENT_TYPES)), (key % 5 + 1).cast("int"))
    owner = F.when(key % 6 == 0, "worker-a").when(key % 6 == 1, "worker-b")
    return e.select(
        "event_id", F.concat(F.lit("job_"), key.cast("string")).alias("job_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("product_id"),
        F.concat(F.lit("ten_"), F.col("user_id").cast("string")).alias("tenant_id"), kind.alias("event_type"), F.col("ts").alias("created_at"),
        F.when(key % 4 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("published_at"), F.when(key % 97 == 0, F.col("ts") + F.expr("interval 2 hours")).alias("dead_lettered_at"),
        (key % 21).cast("int").alias("delivery_attempts"), owner.alias("lease_owner"),
        F.when(owner.isNotNull(), F.col("ts") + F.make_dt_interval(mins=(key % 2000 * 7).cast("int"))).alias("lease_expires_at"), "user_id",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the label as tenant."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("ten_"), F.col("label").cast("string")).alias("tenant_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def html_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of ``pages`` as observations."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("i", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", ""), r"[ \t\r\n]+", " "))
    return rows.select("page_id", F.col("i").cast("int").alias("reading_order"), text.alias("text"))


def with_scope(df: DataFrame, product: Column, tenant: Column) -> DataFrame:
    return df.withColumns({"product_id": product, "tenant_id": tenant})
