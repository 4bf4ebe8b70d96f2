"""Work that must stay bounded however large a table is: files, tasks, passes and calls."""

from __future__ import annotations

import glob
from types import SimpleNamespace

from pyspark.sql import Row

from leafmill.plans import files, labels, lifecycle, stores
from leafmill.streaming import outbox, pages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pdf_files_are_rows(spark, sf_dir):
    """A folder and an object for each document would be listed by the driver."""
    at = f"{spark.conf.get('spark.checkpoint.dir')}/leafmill"
    before = set(glob.glob(f"{at}/pdf-*"))
    assert files.pdf_page_geometry(spark, sf_dir).count() > 0
    (made,) = set(glob.glob(f"{at}/pdf-*")) - before
    assert len(glob.glob(f"{made}/**/part-*", recursive=True)) <= 8


def test_images_are_dealt_and_made_once(spark, sf_dir):
    assert labels.image_rows(spark, sf_dir).rdd.getNumPartitions() >= 4
    for query in (labels.image_deskew, labels.image_preparation, labels.image_quality_scores):
        assert plan(query(spark, sf_dir)).count("FileScan parquet") == 1


def test_moves_hold_no_tenants(spark, sf_dir):
    """Tenants are counted for each state, not for each move."""
    assert "distinct" not in plan(lifecycle.fsm_relations(spark, sf_dir))


class Value:
    """A value state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*value):
            self.calls.append(name)
            if name == "get":
                return self.held
            self.held = value[0] if name == "update" else None

        return call


def fake(processor):
    calls = []
    processor.init(SimpleNamespace(getValueState=lambda *a, **k: Value(calls)))
    return calls


def test_few_state_calls(spark):
    """Each call is a message to the executor: a new event or job needs its state once, however many its commands are."""
    d = outbox.Deliveries()
    calls = fake(d)
    row = lambda kind, at, owner=None: Row(event_id=1, kind=kind, owner=owner, at=at * 60_000_000)
    out = list(d.handleInputRows((1,), iter([row("acknowledge", 2, "a"), row("claim", 1, "a"), row("insert", 0)]), None))
    assert [r.outcome for r in out] == ["inserted", "claimed", "published"] and len(calls) == 3
    assert list(d.handleInputRows((1,), iter([row("claim", 3, "b")]), None))[0].outcome == "refused"

    w = pages.Workflows()
    calls = fake(w)
    event = lambda kind, at, page=0, attempt=0: Row(job_id="j", kind=kind, page=page, attempt=attempt, pages=2, at=at)
    events = [event("create", 0), event("claim", 1, 1), event("success", 2, 1, 1), event("success", 3, 1, 1)]
    assert [r.accepted for r in w.handleInputRows(("j",), iter(events), None)] == [True, True, True, False] and len(calls) == 2
    (late,) = w.handleInputRows(("j",), iter([event("claim", 4, 2)]), None)
    assert late.accepted and late.succeeded == 1


def test_labels_meet_once(spark, sf_dir):
    """Lines meet as one row of each document, in a written table: fields and failures are read from it, without a join that could be broadcast."""
    from leafmill.operators.labels import extract

    fields, failures = extract(labels.label_lines(spark, sf_dir))
    assert "Exchange" not in plan(fields) and "Join" not in plan(fields) + plan(failures)


def test_tasks_by_rows(spark):
    from leafmill.sources.staging import by_key

    df = spark.range(1000).withColumnRenamed("id", "k")
    assert by_key(df, ["k"], rows=50).rdd.getNumPartitions() == 20


def test_pinned_files_hold_many(spark, sf_dir):
    """A file for each supplier would be written and listed one by one."""
    at = f"{spark.conf.get('spark.checkpoint.dir')}/leafmill"
    before = set(glob.glob(f"{at}/pinned-*/file=*")) | set(glob.glob(f"{at}/pinned-*/s_suppkey=*"))
    suppliers = files.pinned_files(spark, sf_dir).count()
    made = (set(glob.glob(f"{at}/pinned-*/file=*")) | set(glob.glob(f"{at}/pinned-*/s_suppkey=*"))) - before
    assert suppliers == 10 and len(made) == 1


def test_labels_are_dealt(spark, sf_dir):
    """Keys of parts stand in a small file; what is made of them is no single task's."""
    assert labels.label_lines(spark, sf_dir).rdd.getNumPartitions() >= 4


def test_few_updates_of_a_key_are_folded_where_they_are_joined(spark, sf_dir):
    """Only keys with more than a block of updates are put in order by range, written and cut."""
    at = f"{spark.conf.get('spark.checkpoint.dir')}/leafmill/updates-*"
    before = len(glob.glob(at))
    assert stores.revision_swap(spark, sf_dir).count() > 0 and len(glob.glob(at)) == before


class Elements(Value):
    """A list state that counts its calls."""

    def __getattr__(self, name):
        def call(*value):
            self.calls.append(name)
            if name == "get":
                return iter(self.held or [])
            self.held = {"put": value[0] if value else [], "appendList": [*(self.held or []), *(value[0] if value else [])], "clear": None}[name]

        return call


def test_state_calls_of_a_group(spark):
    """A group's states are read and written once, however many of its events or jobs have rows."""
    from leafmill.streaming.together import Together

    def together(processor, key, made):
        calls, t = [], Together(processor, key, list(made))
        t.init(SimpleNamespace(getListState=lambda *a, **k: Elements(calls)))
        return t, calls

    t, calls = together(outbox.Deliveries(), "event_id long", outbox.OUTCOME)
    n, minute = 200, 60_000_000
    packed = lambda kind, owner, at: Row(event_id=list(range(n)), kind=[kind] * n, owner=[owner] * n, at=[at * minute] * n, __group=0)
    (out,) = t.handleInputRows((0,), iter([packed("claim", "a", 1), packed("insert", None, 0)]), None)
    assert len(calls) == 3 and sorted(out.outcome) == ["claimed"] * n + ["inserted"] * n
    (out,) = t.handleInputRows((0,), iter([packed("acknowledge", "a", 2)]), None)
    assert len(calls) == 7 and out.outcome == ["published"] * n and calls[-2:] == ["clear", "appendList"]
    (out,) = t.handleInputRows((0,), iter([packed("claim", "b", 3)]), None)
    assert len(calls) == 9 and out.outcome == ["refused"] * n

    t, calls = together(pages.Workflows(), "job_id string", pages.OUTCOME)
    events = Row(job_id=["a", "b", "b"], kind=["create", "create", "claim"], page=[None, None, 1], attempt=[None] * 3, pages=[1, 2, None], at=[0, 0, 1], __group=0)
    (out,) = t.handleInputRows((0,), iter([events]), None)
    assert out.accepted == [True] * 3 and len(calls) == 2


def test_state_of_groups_stands(spark):
    """Events and jobs of one group that have no rows in a batch keep their state; null, negative and large keys are their own."""
    from datetime import datetime, timedelta

    from leafmill.plans.streams import batches, run_once

    t, far = datetime(2024, 3, 31, 1, 59), 2**62 + 1
    commands = lambda *rows: spark.createDataFrame([(k, kind, owner, t + timedelta(minutes=m)) for k, kind, owner, m in rows], outbox.COMMANDS)
    keys = [None, -1, 0, 1, far, far + 1]
    stream = batches(
        spark,
        commands(*[(k, "insert", None, 0) for k in keys], *[(k, "claim", "a", 1) for k in keys if k != 1]),
        commands((1, "claim", "b", 2)), commands((0, "claim", "b", 3), (far + 1, "claim", "b", 3)), commands(*[(k, "acknowledge", "a", 4) for k in keys]),
    )
    got = run_once(spark, outbox.deliveries(stream), by_clock=True)
    assert {(r.event_id, r.outcome, r.lease_expires_at) for r in got.where("outcome not in ('inserted', 'claimed')").collect()} == {
        *((k, "published", None) for k in keys if k != 1), (1, "lease_lost", t + timedelta(minutes=7)), *((k, "refused", t + timedelta(minutes=6)) for k in (0, far + 1)),
    }

    events = lambda *rows: spark.createDataFrame([(k, kind, page, attempt, 2, t + timedelta(minutes=m)) for k, kind, page, attempt, m in rows], pages.EVENTS)
    jobs = [None, "", "j", "job-11", "job-12"]
    stream = batches(
        spark, events(*[(k, "create", None, None, 0) for k in jobs], *[(k, "claim", 1, None, 1) for k in jobs]),
        events(("job-11", "success", 1, 1, 2)), events(*[(k, "success", 1, 1, 3) for k in jobs]),
    )
    got = run_once(spark, pages.page_workflows(stream)).where("kind = 'success'").collect()
    assert sorted((r.job_id or "", r.accepted, r.succeeded) for r in got) == sorted([*((k or "", True, 1) for k in jobs), ("job-11", False, 1)])
