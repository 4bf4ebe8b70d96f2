"""Streaming queries run over what is there, and the batch queries they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import jsoncmp
from ..sources import tables
from ..sources.staging import shared_folder
from ..streaming import outbox, runner, windows


def folder(spark) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/leafmill-stream-{uuid.uuid4().hex}"


def run_once(spark, stream, mode="append", at=None, by_clock=False):
    """Run a stream over what is there and read what it wrote; ``at`` is the folder of its output and state, a new one by default.

    State that ends ``by_clock`` asks for batches without rows for ever, so that this run wouldn't end: it goes without them.
    """
    at = at or folder(spark)
    confs = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(not by_clock).lower()}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    for k, v in before.items():
        spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def batches(spark, *tables_):
    """A stream of tables, one after another, each in a batch of its own."""
    at = f"{folder(spark)}/in"
    for t in tables_:
        t.coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(tables_[0].schema).option("maxFilesPerTrigger", 1).parquet(at)


def event_stream(spark, sf_dir):
    """``events`` as a stream (the folder's files, by pattern)."""
    schema = tables.read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def outbox_stream_leases(spark, sf_dir):
    """Insert, claim by two workers and acknowledge each event, as a stream of commands."""
    e, at = event_stream(spark, sf_dir), F.col("ts").cast("timestamp")
    command = lambda kind, owner, minutes: F.struct(F.lit(kind).alias("kind"), owner.alias("owner"), (at + F.expr(f"interval {minutes} minutes")).alias("at"))
    none, first = F.lit(None).cast("string"), F.when(F.col("event_id") % 2 == 0, "worker-a").otherwise("worker-b")
    commands = F.array(command("insert", none, 0), command("claim", first, 1), command("claim", F.lit("worker-a"), 2), command("acknowledge", F.lit("worker-a"), 3))
    out = run_once(spark, outbox.deliveries(e.select("event_id", F.explode(commands).alias("c")).select("event_id", "c.*")), by_clock=True)
    return out.groupBy("outcome", "attempts").agg(F.count("*").alias("n"))


def event_windows_stream(spark, sf_dir):
    """Six-hour windows of the stream, in append mode behind the watermark."""
    e = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = run_once(spark, windows.tumbling(e, "at", "6 hours", "1 hour", "event_type"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def event_sliding_stream(spark, sf_dir):
    """Half-day windows every six hours of the stream, in append mode behind the watermark."""
    e = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = run_once(spark, windows.sliding(e, "at", "12 hours", "6 hours", "1 hour", "event_type"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def event_sessions_stream(spark, sf_dir):
    """Sessions of users (six hours without an event end one), merged in state while their batches come, in append mode behind the watermark."""
    e = tables.read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("at"))
    # Every session that goes on over the middle of the table is met in two batches.
    middle = e.agg(F.percentile_approx("at", 0.5)).first()[0]
    stream = batches(spark, e.where(F.col("at") <= F.lit(middle)), e.where(F.col("at") > F.lit(middle)))
    out = run_once(spark, windows.sessions(stream, "at", "6 hours", "1 hour", "user_id"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"), F.col("session_window.end").cast("timestamp_ntz").alias("end_ts"), "n", F.round("value", 2).alias("value"))


def deliveries_once(spark, sf_dir):
    """Events that are delivered again minutes later, in the same batch or a later one, come out once; those behind the watermark not at all."""
    e = tables.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    again = e.where("event_id % 3 = 0").withColumn("at", F.col("at") + F.expr("interval 10 minutes"))
    low, high = e.agg(F.percentile_approx("at", 0.5), F.max("at")).first()
    first, second = F.col("at") <= F.lit(low), F.col("at") > F.lit(low)
    # Under new numbers: those behind the watermark of the first batch are too late when the last one comes, those of the last hour are not.
    late = e.where((F.col("event_id") % 7 == 0) & ((F.col("at") < F.lit(low) - F.expr("interval 2 hours")) | (F.col("at") > F.lit(high) - F.expr("interval 1 hour")))).withColumn("event_id", F.col("event_id") + 1_000_000_000)
    stream = batches(spark, e.where(first).unionByName(again.where(first)), e.where(second).unionByName(again.where(second & (F.col("at") <= F.lit(high)))), late.unionByName(again.where(F.col("at") > F.lit(high))))
    return run_once(spark, outbox.once(stream, "event_id", "at", "2 hours").select("event_id"))


def tries_of(k, page):
    """What becomes of a page of the runner's query: the attempt that succeeds, 0 for a page that never does, -1 for one that can't."""
    h = (k * 7 + page * 3) % 10
    return F.when(h < 6, 1).when(h == 6, 2).when(h == 7, 3).when(h == 8, 0).otherwise(-1)


def page_runner(spark, sf_dir):
    """Pages of orders worked on in committed rounds, two of each order at a time, until none is open; runs have three rounds each."""
    o = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), (F.col("o_orderkey") % 4 + 1).alias("pages"))

    def work(tasks):
        ends = tries_of(F.col("job_id").cast("long"), F.col("page"))
        outcome = F.when(ends == F.col("attempt"), "success").when(ends == -1, "permanent_failure").otherwise("retryable_failure")
        return tasks.withColumns({"outcome": outcome, "artifact": F.format_string("%s/%d/attempt-%d.json", "job_id", "page", "attempt")})

    ledger = runner.new_ledger(spark, "runner")
    runner.begin(ledger, o)
    ended = runner.loop(ledger, work, batch=2, rounds=3)
    made = ledger.table("artifacts").groupBy("job_id").agg(F.count("*").alias("artifacts"), F.max("artifact").alias("last_artifact"))
    s = runner.statuses(ledger.table("pages")).join(made, "job_id", "left")
    return s.select("job_id", "status", "succeeded", F.col("attempts").cast("long"), F.coalesce("artifacts", F.lit(0)).cast("long").alias("artifacts"), "last_artifact", F.lit(ended.reason).alias("ended"), F.lit(-(-ended.rounds // 3) == ended.runs).alias("runs_fit"))


def props_equivalence(spark, sf_dir):
    """Event properties as canonical JSON, and against near copies."""
    e = tables.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    near = F.concat(F.lit('{ "k" : '), (k + F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(0.0)).cast("string"), F.lit(" }"))
    return e.select("event_id", jsoncmp.canonical(F.col("props")).alias("canonical"), jsoncmp.equivalent("props", near).alias("equivalent"))


QUERIES = {f.__name__: f for f in (outbox_stream_leases, event_windows_stream, event_sliding_stream, event_sessions_stream, deliveries_once, page_runner, props_equivalence)}

ORACLES = {
    "outbox_stream_leases": """with c as (select count(*) as n, count(*) filter (event_id % 2 = 0) as a from events)
        select outcome, cast(attempts as integer) as attempts, n from (select 'inserted' as outcome, 0 as attempts, n from c union all select 'claimed', 1, n from c
          union all select 'renewed', 1, a from c union all select 'published', 1, a from c union all select 'refused', 1, n - a from c union all select 'lease_lost', 1, n - a from c)""",
    "event_windows_stream": """with w as (select time_bucket(interval 6 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as value from events group by all)
        select * from w where start + interval 6 hour <= (select max(ts) - interval 1 hour from events)""",
    "event_sliding_stream": """with e as (select ts, event_type, value, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as start from events),
        w as (select start, event_type, count(*) as n, round(sum(value), 2) as value from e group by all) select * from w where start + interval 12 hour <= (select max(ts) - interval 1 hour from events)""",
    "event_sessions_stream": """with g as (select user_id, event_id, value, ts, case when coalesce(ts - lag(ts) over w >= interval 6 hour, true) then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g),
        o as (select user_id, min(ts) as first_ts, max(ts) + interval 6 hour as end_ts, count(*) as n, round(sum(value), 2) as value from s group by user_id, session)
        select * from o where end_ts <= (select max(ts) - interval 1 hour from events)""",
    "deliveries_once": """select event_id from events union all select event_id + 1000000000 from events where event_id % 7 = 0 and ts > (select max(ts) - interval 1 hour from events)""",
    "page_runner": """with p as (select o_orderkey as k, unnest(generate_series(1, o_orderkey % 4 + 1)) as page from orders),
        h as (select k, page, (k * 7 + page * 3) % 10 as h from p), t as (select k, page, case when h < 6 then 1 when h = 6 then 2 when h = 7 then 3 end as ok, case when h < 6 or h = 9 then 1 when h = 6 then 2 else 3 end as attempts from h)
        select cast(k as varchar) as job_id, case when count(ok) = count(*) then 'completed' else 'partial' end as status, count(ok) as succeeded, cast(sum(attempts) as bigint) as attempts, count(ok) as artifacts,
          max(case when ok is not null then k || '/' || page || '/attempt-' || ok || '.json' end) as last_artifact, 'idle' as ended, true as runs_fit from t group by k""",
    "props_equivalence": "select event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' as canonical, event_id % 3 <> 0 as equivalent from events",
}
