"""Lifecycles, workflows, leases, identifiers, geometry, images and files."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry, ids, jsoncmp
from leafmill.operators import images, lifecycle, regions
from leafmill.streaming import outbox, pages


def test_workflow():
    w = pages.Workflow(3)
    assert all(w.apply("claim", p) for p in (1, 2, 3)) and w.status == "running"
    assert w.apply("success", 1, 1) and w.apply("retryable_failure", 2, 1) and w.apply("success", 3, 1)
    assert not w.apply("success", 2, 1)  # stale
    assert w.apply("claim", 2) and w.apply("success", 2, 2) and w.status == "completed" and w.succeeded == 3
    v = pages.Workflow(2)
    for attempt in (1, 2, 3):
        assert v.apply("claim", 1) and v.apply("retryable_failure", 1, attempt)
    assert v.pages[0] == ("exhausted", 3) and not v.apply("claim", 1)
    assert v.apply("claim", 2) and v.apply("permanent_failure", 2, 1) and v.status == "partial"
    v.apply("cancel")
    assert v.status == "cancelled" and not v.apply("success", 2, 1)


def test_workflow_stream(spark, sf_dir):
    from leafmill.plans.streams import event_stream, run_once

    e = event_stream(spark, sf_dir).where("event_id < 4")
    at = lambda n: (F.col("ts") + F.expr(f"interval {n} seconds")).cast("timestamp")
    event = lambda n, kind, page, attempt: F.struct(F.lit(kind).alias("kind"), F.lit(page).alias("page"), F.lit(attempt).alias("attempt"), F.lit(2).alias("pages"), at(n).alias("at"))
    steps = [event(0, "create", 0, 0), event(1, "claim", 1, 0), event(2, "claim", 2, 0), event(3, "success", 1, 1), event(4, "success", 2, 2), event(5, "success", 2, 1)]
    rows = e.select(F.col("event_id").cast("string").alias("job_id"), F.explode(F.array(*steps)).alias("x")).select("job_id", "x.*")
    out = run_once(spark, pages.page_workflows(rows))
    got = out.groupBy("kind", "accepted").count().collect()
    assert {(r.kind, r.accepted): r["count"] for r in got} == {("create", True): 4, ("claim", True): 8, ("success", True): 8, ("success", False): 4}
    assert out.where("status = 'completed'").count() == 4


def test_leases():
    t = datetime(2024, 1, 1)
    s, o = outbox.step(None, "insert", None, t)
    s, o = outbox.step(s, "claim", "a", t)
    assert o == "claimed" and s[0] == 1
    assert outbox.step(s, "claim", "b", t)[1] == "refused" and outbox.step(s, "claim", "a", t)[1] == "renewed"
    later = t + timedelta(minutes=6)
    assert outbox.step(s, "acknowledge", "a", later)[1] == "lease_lost"
    for n in range(2, 21):
        t += timedelta(minutes=6)
        s, o = outbox.step(s, "claim", "b", t)
        assert (o, s[0]) == ("claimed", n)
    assert outbox.step(s, "claim", "b", t + timedelta(minutes=6))[1] == "dead_lettered"


def test_point_id(spark):
    got = spark.range(1).select(ids.point_id(F.lit("ten_a"), F.lit("mem_é"), F.lit("sha256:1"), F.lit("emb_1"))).first()[0]
    raw = b"ocr-memory-point-v1" + b"".join(len(v.encode()).to_bytes(8, "big") + v.encode() for v in ("ten_a", "mem_é", "sha256:1", "emb_1"))
    b = bytearray(hashlib.sha256(raw).digest()[:16])
    b[6], b[8] = b[6] & 0x0F | 0x80, b[8] & 0x3F | 0x80
    assert got == str(uuid.UUID(bytes=bytes(b)))


def test_identifiers(spark):
    good = {"tenant": "ten_A1", "product": "a-1", "digest": "sha256:" + "0" * 64, "idempotency": "k!", "embedding": "emb_a.b"}
    bad = {"tenant": "ten_", "product": "-a", "digest": "sha256:0", "idempotency": "a b", "embedding": "emb_.a"}
    row = spark.range(1).select(*[ids.valid(k, F.lit(v)).alias(f"g_{k}") for k, v in good.items()], *[ids.valid(k, F.lit(v)).alias(f"b_{k}") for k, v in bad.items()]).first().asDict()
    assert all(v == k.startswith("g_") for k, v in row.items())


def test_transforms(spark):
    step = "named_struct('kind', '{}', 'left', 0.1D, 'top', 0.2D, 'width', 0.5D, 'height', 0.4D, 'degrees', {}D)"
    chain = lambda *steps: F.expr("array(" + ", ".join(step.format(k, d) for k, d in steps) + ")")
    p = spark.range(1).select(geometry.to_original(chain(("crop", 0.0), ("clockwise_90", 0.0)), F.lit(0.25), F.lit(0.75)).alias("a"), geometry.to_original(chain(("deskew", 5.0), ("deskew", -5.0)), F.lit(0.3), F.lit(0.6)).alias("b")).first()
    assert (p.a.x, p.a.y) == pytest.approx((0.475, 0.5)) and (p.b.x, p.b.y) == pytest.approx((0.3, 0.6))


def test_suppression(spark):
    r = [(0.1, 0.1, 0.5, 0.3, 0.9), (0.12, 0.11, 0.5, 0.3, 0.8), (0.1, 0.5, 0.5, 0.7, 0.7)]
    df = spark.createDataFrame([(r,)], "regions array<struct<left:double,top:double,right:double,bottom:double,confidence:double>>")
    kept = df.select(regions.suppress(F.col("regions"), 0.5).alias("k")).first().k
    assert [x.confidence for x in kept] == [0.9, 0.7]
    # Of two that overlap with like confidence the upper one stays, though the lower one is further left.
    tie = spark.createDataFrame([([(0.1, 0.2, 0.5, 0.4, 0.9), (0.2, 0.1, 0.6, 0.35, 0.9)],)], df.schema).select(regions.suppress(F.col("regions"), 0.2).alias("k")).first().k
    assert [(x.left, x.top) for x in tie] == [(0.2, 0.1)]


def test_images(spark):
    flat, ramp = np.full((64, 64), 255, np.uint8), np.tile(np.arange(64, dtype=np.uint8) * 3, (64, 1))
    glare = np.full((128, 128), 120, np.uint8)
    glare[:20, :20] = 255
    made = [("flat", flat), ("ramp", ramp), ("dark", np.tile(np.array([0, 12], np.uint8), (64, 32))), ("glare", glare)]
    df = spark.createDataFrame([(n, bytearray(p.tobytes()), p.shape[1], p.shape[0]) for n, p in made], "name string, luma binary, width int, height int")
    got = {r.name: (r.verdict, r.warnings, r.quality_score) for r in images.quality(df, least_sharpness=0.005).collect()}
    assert got["flat"][0] == "unusable" and got["flat"][2] == 0 and got["ramp"][0] == "usable"
    assert got["dark"][0] == "add_light" and "glare" in got["glare"][1]
    odd = spark.createDataFrame([("null", None, 4, 4), ("short", bytearray(b"abc"), 4, 4), ("size", bytearray(b"abcd"), None, 4), ("flat", bytearray(flat.tobytes()), 64, 64)], df.schema)
    assert {r.name: (r.verdict, r.warnings) for r in images.quality(odd).where("name <> 'flat'").collect()} == dict.fromkeys(["null", "short", "size"], ("unusable", ["unreadable"]))
    assert {r.name: r.decision for r in images.deskew(odd).collect()} == {"null": "unreadable", "short": "unreadable", "size": "unreadable", "flat": "below_material_angle"}


@pytest.mark.parametrize("degrees", [-4.0, 0.0, 3.0])
def test_skew(degrees):
    ruled = np.full((200, 300), 255, np.uint8)
    ruled[20:180:16, 30:270] = 0
    angle, confidence, _ = images.skew(images.rotated(ruled, -degrees))
    assert abs(angle - degrees) <= 0.5 or abs(angle + degrees) <= 0.5


def test_lanczos_and_png():
    import struct
    import zlib

    assert images.lanczos(np.full((4, 5), 77, np.uint8)).tolist() == np.full((12, 15), 77).tolist()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"0000"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"0" * 13) + chunk(b"zTXt", b"k\0\0" + zlib.compress(b"a" * 1000)) + chunk(b"IEND", b"")
    assert images.png_metadata(png) == len(zlib.compress(b"a" * 1000)) + 3 + 1000


def test_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":[1,2.0]}', '{"a":[1.005,2],"b":1}'), ("[1]", "[1,2]"), ('{"a":true}', '{"a":1}'), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(jsoncmp.equivalent("a", "b")).collect()] == [True, False, False, False]
    assert df.select(jsoncmp.canonical(F.col("a"))).first()[0].startswith('{"a":[1,2')
    import hmac

    assert df.select(jsoncmp.keyed_digest(b"k")("a")).first()[0] == hmac.new(b"k", b'{"b":1,"a":[1,2.0]}', hashlib.sha256).hexdigest()


def test_requests_and_tensors(spark):
    from leafmill.operators import rules

    r = spark.createDataFrame([(1, "invoice", "fast", ["en", "fr-FR"], None, None), (2, "poem", "fast", ["en", "en"], "nutrition_label", "9")], "id int, document_type string, processing_class string, language_hints array<string>, schema_id string, schema_version string")
    got = {(x.id, x.rule) for x in rules.violations(r, rules.request_rules(["invoice"], ["fast"], [("nutrition_label", "1")]), "id").collect()}
    assert got == {(2, "document_type"), (2, "hints"), (2, "schema")}
    t = "array<struct<name:string,shape:array<int>,bytes_per_element:int>>"
    m = spark.createDataFrame([(1, [("a", [1, 3, 8, 8], 4)], [("b", [1, 10], 4)]), (2, [("a", [1 << 15, 1 << 14], 4)], [("a", [1], 4)])], f"id int, inputs {t}, outputs {t}")
    assert {(x.id, x.rule) for x in rules.violations(m, rules.tensor_rules(), "id").collect()} == {(2, "bytes"), (2, "disjoint")}


def test_page_rules(spark):
    from leafmill.operators import rules

    rows = [(1, 1, "o1", 0, None, "a"), (1, 1, "o2", 1, "o1", "b"), (1, 1, "o3", 1, "o9", " "), (1, 2, "o1", 0, "o1", "x")]
    df = spark.createDataFrame(rows, "doc int, page int, observation_id string, reading_order int, parent_observation_id string, text string")
    got = {(r.page, r.observation_id, r.rule) for r in rules.page_rules(df, "doc").collect()}
    assert got == {(1, "o2", "unique_order"), (1, "o3", "unique_order"), (1, "o3", "parent_earlier"), (1, "o3", "text_not_blank"), (2, "o1", "parent_earlier")}


def test_promotion_cache_importer(spark):
    s = spark.createDataFrame([("p1", "d1"), ("p2", "d2"), ("p3", "d3")], "path string, digest string")
    held = spark.createDataFrame([("p1", "d1"), ("p2", "dx")], "path string, digest string")
    assert {r.path: r.outcome for r in lifecycle.promotion(s, held).collect()} == {"p1": "replay", "p2": "conflict", "p3": "copy"}
    c = spark.sql("select 'completed' as status, timestamp'2024-01-01' as stored_at union all select 'processing', timestamp'2024-01-01'")
    assert [r.status for r in lifecycle.cached(c, F.lit("2024-01-01 00:10:00").cast("timestamp"), 60, 3600).collect()] == ["completed"]
    u = spark.createDataFrame([("claimed", "infected", "ok", "ok", "ok", "ok"), ("claimed", "clean", "ok", "ok", "ok", "ok"), ("busy", None, None, None, None, None)], "claim string, scan string, read string, inspect string, promote string, accept string")
    assert [r[0] for r in u.select(lifecycle.importer_decision()).collect()] == ["reject:malware", "accept", "skip:busy"]


def test_files(spark, tmp_path):
    import json

    from leafmill.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    (tmp_path / "in" / "b.bin").write_bytes(b"abd")
    want = hashlib.sha256(b"abc").hexdigest()
    e = spark.createDataFrame([("a.bin", want), ("b.bin", want), ("c.bin", want)], "name string, sha256 string")
    assert {r.name: r.outcome for r in files.pinned(spark, str(tmp_path / "in"), e).collect()} == {"a.bin": "ok", "b.bin": "changed", "c.bin": "missing"}
    for folder in ("x", "y"):
        (tmp_path / "in" / folder).mkdir()
        (tmp_path / "in" / folder / "same.bin").write_bytes(folder.encode() * 30)
    deep = spark.createDataFrame([(n, hashlib.sha256(b"x" * 30).hexdigest()) for n in ("x/same.bin", "y/same.bin", "same.bin", "../in/a.bin")] + [("a.bin", None)], "name string, sha256 string")
    assert {r.name: r.outcome for r in files.pinned(spark, str(tmp_path / "in"), deep).collect()} == {"x/same.bin": "ok", "y/same.bin": "changed", "same.bin": "missing", "../in/a.bin": "outside", "a.bin": "changed"}
    assert {r.outcome for r in files.pinned(spark, str(tmp_path / "in"), deep.limit(1), most_bytes=10).collect()} == {"too_large"}

    response = {"document": {"text": "héllo\nworld\n", "pages": [{"pageNumber": 1, "lines": [{"layout": {"textAnchor": {"textSegments": [{"endIndex": "6"}]}, "confidence": 0.9, "boundingPoly": {"normalizedVertices": [{"x": 0.1, "y": 0.2}]}}}, {"layout": {"textAnchor": {"textSegments": [{"startIndex": "6", "endIndex": "12"}]}}}]}]}}
    df = spark.createDataFrame([(1, json.dumps(response))], "id int, json string")
    assert [r.text for r in files.provider_lines(df, "json", "id").orderBy("reading_order").collect()] == ["héllo\n", "world\n"]

    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "cases": [{"id": "a", "sha256": "h", "expected_fields": {"x": 1}, "extraction": {"schema_id": "s", "schema_version": "1"}}]}))
    assert files.manifest(spark, str(tmp_path / "m.json")).first().expected_fields == {"x": "1"}

    (tmp_path / "l.xml").write_text('<doc><page width="100" height="200"><flow><block><line xMin="10" yMin="20" xMax="50" yMax="30"><word xMin="10" yMin="20" xMax="30" yMax="30">two</word><word xMin="30" yMin="20" xMax="50" yMax="30">words</word></line><line xMin="5" yMin="1" xMax="5" yMax="2"></line></block></flow></page></doc>')
    lines = files.layout_lines(spark, str(tmp_path / "l.xml")).collect()
    assert [(r.text, r.left, r.top, r.right, r.bottom) for r in lines] == [("two words", 0.1, 0.1, 0.5, 0.15)]
    assert lines[0].page == 1 and lines[0].document.endswith("l.xml")

    out = str(tmp_path / "out")
    files.create_only(e, out)
    with pytest.raises(Exception, match="exists"):
        files.create_only(e, out)
    assert files.verify(spark.read.parquet(out), e, "name", "sha256").isEmpty()
    got = spark.sql("select 'a=b,c=d' as v union all select 'a=b,a=c' union all select 'a='").select(files.configured(F.col("v"))).collect()
    assert [r[0] for r in got] == [{"a": "b", "c": "d"}, None, None]


def test_hybrid(spark):
    from leafmill.operators.assemble import hybrid_pages

    n = spark.createDataFrame([(1, ["a"]), (2, []), (3, []), (4, [])], "page int, observations array<string>")
    p = spark.createDataFrame([(2, ["b"], None), (3, None, "permanent"), (4, None, "timeout")], "page int, observations array<string>, error string")
    assert {r.page: (r.source, r.observations) for r in hybrid_pages(n, p, ["page"]).collect()} == {1: ("native", ["a"]), 2: ("provider", ["b"]), 3: ("empty_native", []), 4: ("retry", [])}


def test_image_heads(spark):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 30, 20) + b"0" * 9
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"0" * 9
    webp = b"RIFF0000WEBPVP8X" + b"0" * 8 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")
    rows = [("a", png, "image/png"), ("b", jpeg, "image/jpeg"), ("c", webp, "image/webp"), ("d", png, "image/jpeg"), ("e", b"no", "image/png")]
    got = {r.name: (r.outcome, r.image.width, r.image.height) for r in images.inspect(spark.createDataFrame([(n, bytearray(c), m) for n, c, m in rows], "name string, content binary, mime string"), "content", "mime").collect()}
    assert got == {"a": ("ok", 30, 20), "b": ("ok", 30, 20), "c": ("ok", 30, 20), "d": ("mismatch", 30, 20), "e": ("unreadable", None, None)}


def test_retries(spark):
    from leafmill.operators import store

    kinds = ["provider_rate_limited", "dependency_unavailable", "revision_conflict", "invalid_input", "scope_not_found", "iteration_limit", "other"]
    df = spark.createDataFrame([(k, n) for k in kinds for n in (1, 2, 3)], "kind string, attempt int")
    got = {(r.kind, r.attempt): r.w for r in df.select("kind", "attempt", store.retry_plan(F.col("kind"), F.col("attempt")).alias("w")).collect() if r.w is not None}
    assert got == {("provider_rate_limited", 1): 65, ("provider_rate_limited", 2): 65, ("dependency_unavailable", 1): 1, ("dependency_unavailable", 2): 2, ("revision_conflict", 1): 1, ("revision_conflict", 2): 2}


def test_assembly(spark):
    """Citations hold the polygon; texts above the bound are left out; a partial workflow stays partial."""
    from leafmill.operators import assemble

    rows = [(1, 2, 0, "b", "o3", 0.9, [(0.1, 0.2)]), (1, 1, 1, "a2", "o2", 0.5, [(0.3, 0.4)]), (1, 1, 0, "a1", "o1", 0.8, None), (2, 1, 0, "x" * 50, "o4", 0.9, None)]
    df = spark.createDataFrame(rows, "doc int, page int, reading_order int, text string, observation_id string, confidence double, polygon array<struct<x:double,y:double>>")
    got = {r.doc: r for r in assemble.assemble(df, "doc", most_bytes=40).collect()}
    assert got[1].text == "a1\na2\n\nb" and got[1].limit is None and (got[2].text, got[2].limit) == (None, "text")
    assert [(c.page, c.observation_id, c.polygon and tuple(c.polygon[0])) for c in got[1].citations] == [(1, "o1", None), (1, "o2", (0.3, 0.4)), (2, "o3", (0.1, 0.2))]
    assert got[1].confidence == 0.5 and assemble.assemble(df.drop("polygon"), "doc").count() == 2
    facts = spark.createDataFrame([(1, "partial", True), (2, "completed", True), (3, "completed", False), (4, None, False)], "doc int, workflow string, low_confidence boolean").withColumns({"provider": F.lit("native-text"), "empty_page": F.lit(False), "no_text": F.lit(False)})
    assert {r.doc: r.state for r in assemble.review_signals(facts).collect()} == {1: "partial", 2: "review_required", 3: "completed", 4: "completed"}


def test_cache_lookup(spark):
    records = spark.sql("select 'j1' as job_id, 'p' as product_id, 't' as tenant_id, 'completed' as status, timestamp'2024-01-01' as stored_at union all select 'j2', 'p', 'u', 'completed', timestamp'2024-01-01' union all select 'j3', 'p', 't', 'processing', timestamp'2024-01-01'")
    asked = spark.createDataFrame([("j1", "p", "t"), ("j2", "p", "t"), ("j3", "p", "t"), ("j4", "p", "t")], "job_id string, product_id string, tenant_id string")
    got = lifecycle.cache_lookup(asked, records, F.lit("2024-01-01 00:10:00").cast("timestamp"), 60, 3600).collect()
    assert {r.job_id: (r.outcome, r.status) for r in got} == {"j1": ("hit", "completed"), "j2": ("foreign", None), "j3": ("miss", None), "j4": ("miss", None)}


def test_top_k_over_blocks(spark, monkeypatch):
    from leafmill.operators import semantic

    rng = np.random.default_rng(3)
    rows = [(i, "t", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, tenant_id string, embedding array<double>")
    run = lambda: sorted((r.query_id, r.place, r.record_id) for r in semantic.top_k(df.where("vec_id < 5"), df, 7).collect())
    many = run()
    monkeypatch.setattr(semantic, "BLOCKS", 1)
    assert many == run() and len(many) == 35


def test_store_parts(spark):
    from leafmill.operators import store

    a, b = spark.range(3), spark.range(1, 4)
    assert store.same_keys(a, a.union(a), "id") and not store.same_keys(a, b, "id")
    f = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 2), (2, 1, 2)], "doc int, frame int, page_count int")
    assert store.first_frame_only(f, "doc").count() == 3
    p = spark.createDataFrame([(1, 0, 10, 20, 20, 10), (2, 0, 10, 20, 10, 20), (1, 0, 10, 21, 10, 20)], "p int, i int, w int, h int, ww int, wh int")
    assert [r[0] for r in p.select(store.page_source_ok(*map(F.col, p.columns))).collect()] == [True, False, False]
    runs = spark.createDataFrame([("p", "t", "uploads"), ("p", "t", "workflows"), ("p", "u", "uploads")], "product_id string, tenant_id string, outcome string")
    assert tuple(store.dispatch_counters(runs).first()) == (2, 2, 1, 0)
