"""Queries over label lines, quantities, regions, transforms and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, ids
from ..functions import quantity as Q
from ..operators import images, labels, prepare, regions
from ..sources import tables
from ..sources.staging import spread


def label_lines(spark, sf_dir):
    """A label for each part: amounts follow from its key.  Keys are dealt first: a small file is one task's, reading its labels isn't."""
    k = F.col("p_partkey")
    num = lambda m, d: (k * m % d / 10.0).cast("string")
    two = lambda name, m, d, unit: F.concat(F.lit(f"{name} "), num(m, d), F.lit(f"{unit} "), num(m + 2, d), F.lit(unit))
    lines = F.array(
        F.when(k % 3 == 0, "Nutrition Information").when(k % 3 == 1, "Nutrition Facts").otherwise("Label"), F.concat(F.lit("Servings per pack: "), (k % 9 + 1).cast("string")),
        F.when(k % 11 == 0, "Amounts").otherwise("Per Serving (30g)  Per 100g"), F.concat(F.lit("Energy "), (k % 900).cast("string"), F.lit("kJ "), (k % 3000).cast("string"), F.lit("kJ")),
        two("Protein", 3, 300, "g"), two("Fat, total", 5, 400, "g"), two("- Saturated", 7, 300, "g"), two("Carbohydrate", 11, 900, "g"), two("- Sugars", 13, 500, "g"),
        F.concat(F.lit("Sodium <"), (k % 50).cast("string"), F.lit("mg "), (k % 700).cast("string"), F.lit("mg")), F.lpad((k * 7919).cast("string"), 8, "0"),
    )
    rows = spread(tables.read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.posexplode(lines).alias("i", "text"))
    box = F.array(*[F.struct(F.lit(x).alias("x"), ((F.col("i") + y) / 20.0).alias("y")) for x, y in ((0.1, 0), (0.9, 0), (0.9, 0.8), (0.1, 0.8))])
    return rows.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.col("i").cast("int").alias("reading_order"), F.concat(F.lit("obs_"), F.col("i").cast("string")).alias("observation_id"), "text", (0.9 - F.col("i") / 100.0).alias("confidence"), box.alias("polygon"))


def gtin_candidates(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    digits = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 8, "0")
    d = o.select("o_orderkey", digits.alias("digits"))
    return d.where(ids.gtin_valid(F.col("digits")))


def quantity_tokens(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.concat(F.lit("b1 "), (k % 97).cast("string"), F.lit(".5g <"), (k % 13).cast("string"), F.lit(" mg "), (k % 9 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("kj 0,"), (k % 10).cast("string"), F.lit("% less than "), (k % 7).cast("string"), F.lit(" of"))
    q = p.select("p_partkey", F.posexplode(Q.quantities(text)).alias("i", "q"))
    return q.select("p_partkey", F.col("i").cast("long").alias("i"), "q.amount", F.coalesce("q.unit", F.lit("none")).alias("unit"), "q.upper_bound")


def label_row_classifier(spark, sf_dir):
    c = labels.classify(label_lines(spark, sf_dir))
    return c.groupBy("class", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("lines"))


def label_extract_validate(spark, sf_dir):
    fields, failures = labels.extract(label_lines(spark, sf_dir))
    f = fields.select("doc_id", F.lit("field").alias("what"), "name", "value", F.round("confidence", 3).alias("confidence"))
    return f.unionByName(failures.select("doc_id", F.col("severity").alias("what"), F.col("code").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("confidence")))


def spatial_cells(spark, sf_dir):
    """Label, header and cells as lines of their own, on a grid."""
    k = F.col("p_partkey")
    box = lambda x, y: F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((x, y), (x + 0.15, y), (x + 0.15, y + 0.03), (x, y + 0.03))])
    line = lambda text, x, y: F.struct(text.alias("text"), box(x, y).alias("polygon"))
    lines = F.array(
        line(F.lit("per serving"), 0.4, 0.1), line(F.lit("per 100g"), 0.7, 0.1), line(F.lit("protein"), 0.1, 0.2), line(F.concat((k % 90).cast("string"), F.lit("g")), 0.4, 0.2),
        line(F.concat((k % 80).cast("string"), F.lit("g")), 0.7, 0.2), line(F.lit("sodium"), 0.1, 0.3), line(F.when(k % 5 == 0, F.lit("x")).otherwise(F.concat((k % 700).cast("string"), F.lit("mg"))), 0.4, 0.3), line(F.concat((k % 600).cast("string"), F.lit("mg")), 0.7, 0.3),
    )
    rows = tables.read(spark, sf_dir, "part").select("p_partkey", F.posexplode(lines).alias("i", "l"))
    rows = rows.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.col("i").cast("int").alias("reading_order"), F.concat(F.lit("obs_"), F.col("i").cast("string")).alias("observation_id"), "l.text", F.lit(0.9).alias("confidence"), "l.polygon")
    fields, failures = labels.extract(rows)
    got = fields.where("name like 'per%'").select("doc_id", "name", F.col("value").cast("double").alias("value"))
    return got.unionByName(failures.where("severity = 'error'").select("doc_id", F.col("code").alias("name"), F.lit(None).cast("double").alias("value")))


def polygon_overlaps(spark, sf_dir):
    """Two polygons of each line item, a box and a diamond or a box, the second with its points in either direction: area in common and overlap."""
    li = tables.read(spark, sf_dir, "lineitem")
    grid = lambda c, d: F.col(c).cast("long") % d / F.lit(float(d))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = lambda x, y, w: F.array(point(x, y), point(x + w, y), point(x + w, y + w), point(x, y + w))
    a = box(grid("l_partkey", 8) / 2, grid("l_suppkey", 8) / 2, 0.5)
    x, y, r = grid("l_orderkey", 16) / 2 + 0.25, grid("l_quantity", 16) / 2 + 0.25, F.lit(0.25)
    diamond = F.array(point(x - r, y), point(x, y - r), point(x + r, y), point(x, y + r))
    b = F.when(F.col("l_linenumber") % 2 == 0, F.reverse(box(x - r, y - r, 0.5))).otherwise(diamond)
    made = li.select("l_orderkey", "l_linenumber", F.struct(a.alias("a"), b.alias("b")).alias("p"))
    # In one lambda, so that the cut, by far the dearest part, is made once for both columns.
    found = F.transform(F.array("p"), lambda p: F.struct(p.alias("p"), geometry.area(geometry.overlap(p["a"], p["b"])).alias("common")))
    both = F.transform(found, lambda f: F.struct(f["common"].alias("common"), geometry.common_iou(f["common"], f["p"]["a"], f["p"]["b"]).alias("iou")))
    return made.select("l_orderkey", "l_linenumber", F.inline(both)).select("l_orderkey", "l_linenumber", F.round("common", 9).alias("common"), F.round("iou", 9).alias("iou"))


def nms_regions(spark, sf_dir):
    li = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    left, top = F.col("p") % 8 / 16.0, F.col("s") % 8 / 16.0
    r = F.struct(left.alias("left"), top.alias("top"), (left + 0.25).alias("right"), (top + 0.25).alias("bottom"), ((F.col("l_linenumber") * 13 + F.col("p")) % 64 / 64.0).alias("confidence"))
    g = li.groupBy("l_orderkey").agg(F.collect_list(r).alias("regions"))
    kept = regions.suppress(F.filter("regions", regions.region_valid), 0.3)
    return g.select("l_orderkey", F.size("regions").cast("long").alias("candidates"), F.size(kept).cast("long").alias("kept"), F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["confidence"]).alias("confidence"))


def transform_inverse(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    step = lambda kind: F.struct(kind.alias("kind"), F.lit(0.25).alias("left"), F.lit(0.125).alias("top"), F.lit(0.5).alias("width"), F.lit(0.5).alias("height"), F.lit(0.0).alias("degrees"))
    turn = F.when(k % 4 == 0, "clockwise_90").when(k % 4 == 1, "clockwise_180").when(k % 4 == 2, "clockwise_270").otherwise("flip_vertical")
    steps = F.array(step(F.lit("crop")), step(turn), step(F.when(k % 2 == 0, "flip_horizontal").otherwise("flip_vertical")))
    end = geometry.to_original(steps, k % 16 / 16.0, k % 32 / 32.0)
    return o.select("o_orderkey", end["x"].alias("x"), end["y"].alias("y"))


def image_rows(spark, sf_dir):
    """A small image for each supplier: ruled lines, blocks or plain.  Keys are dealt first: a file of few bytes is one task's, its images aren't."""
    s, n = spread(tables.read(spark, sf_dir, "supplier").select("s_suppkey")), 64
    pixel = lambda i: F.when(F.col("s_suppkey") % 4 == 0, F.when(F.floor(i / n) % 8 < 2, 20).otherwise(230)).when(F.col("s_suppkey") % 4 == 1, F.lit(128)).when(F.col("s_suppkey") % 4 == 2, F.when((i % n + F.floor(i / n)) % 2 == 0, 255).otherwise(0)).otherwise(F.pmod(i * F.col("s_suppkey"), F.lit(256)))
    # Every kind comes again after eight rows.
    luma = F.unhex(F.repeat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8 * n - 1)), lambda i: F.lpad(F.hex(pixel(i).cast("int")), 2, "0")), ""), F.lit(n // 8)))
    return s.select("s_suppkey", luma.alias("luma"), F.lit(n).alias("width"), F.lit(n).alias("height"))


def image_quality_scores(spark, sf_dir):
    q = images.quality(image_rows(spark, sf_dir))
    return q.select("s_suppkey", F.round("contrast", 6).alias("contrast"), F.round("mean_luminance", 6).alias("mean_luminance"), F.round("sharpness", 6).alias("sharpness"), "glare", F.array_join("warnings", ",").alias("warnings"), F.round("quality_score", 6).alias("quality_score"), "verdict")


def image_deskew(spark, sf_dir):
    d = images.deskew(image_rows(spark, sf_dir))
    return d.select("s_suppkey", "decision", "skew.degrees", F.round("skew.confidence", 6).alias("confidence"), F.sha2("luma", 256).alias("digest"))


def image_preparation(spark, sf_dir):
    """Suppliers' images with an orientation tag, some cut to half their height: outcome, steps, size when ready and enlarged, and where a point of the ready image was."""
    k = F.col("s_suppkey")
    rows = image_rows(spark, sf_dir).withColumn("orientation", F.when(k % 11 > 0, (k % 11).cast("int")))
    half = k % 5 == 0
    rows = rows.withColumns({"luma": F.when(half, F.substring("luma", 1, 64 * 32)).otherwise(F.col("luma")), "height": F.when(half, 32).otherwise(64)})
    p = prepare.upscaled(prepare.prepare(rows, least_width=1, least_height=1))
    point = geometry.to_original(F.col("transforms"), F.lit(0.25), F.lit(0.5))
    kinds = F.array_join(F.transform("transforms", lambda s: s["kind"]), ",")
    return p.select("s_suppkey", "outcome", "verdict", kinds.alias("steps"), "upscaled", "width", "height", F.octet_length("luma").alias("bytes"), point["x"].alias("x"), point["y"].alias("y"))


def mime_sniff(spark, sf_dir):
    from ..schema import sniff

    heads = ["255044462D", "89504E470D0A1A0A00", "FFD8FFE0", "524946460000000057454250", "49492A0008", "3C68746D6C"]
    p = tables.read(spark, sf_dir, "part").select(F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("content"))
    return p.groupBy(F.coalesce(sniff(F.col("content")), F.lit("unknown")).alias("mime")).agg(F.count("*").alias("files"))


QUERIES = {f.__name__: f for f in (
    gtin_candidates, quantity_tokens, label_row_classifier, label_extract_validate, spatial_cells, polygon_overlaps, nms_regions, transform_inverse, image_quality_scores, image_deskew, image_preparation, mime_sniff,
)}

_GRID = """g as (select s_suppkey, i, i // 64 as y, i % 64 as x, case s_suppkey % 4 when 0 then case when (i // 64) % 8 < 2 then 20 else 230 end when 1 then 128
    when 2 then case when (i % 64 + i // 64) % 2 = 0 then 255 else 0 end else (i * s_suppkey) % 256 end as v from supplier, range(4096) as r(i))"""

ORACLES = {
    "gtin_candidates": """with d as (select o_orderkey, lpad((o_orderkey * 7919 + o_custkey)::varchar, greatest(8, length((o_orderkey * 7919 + o_custkey)::varchar))::integer, '0') as full_digits from orders),
        e as (select o_orderkey, left(full_digits, 8) as digits from d)
        select * from e where (10 - list_sum(list_transform(range(1, 8), lambda i: digits[i]::integer * (case when (8 - i) % 2 = 1 then 3 else 1 end))) % 10) % 10 = digits[8]::integer""",
    "quantity_tokens": """with p as (select p_partkey, p_partkey as k from part),
        t as (select p_partkey, unnest([
          {'i': 0, 'amount': (k % 97) + 0.5, 'unit': 'g', 'upper_bound': false}, {'i': 1, 'amount': (k % 13)::double, 'unit': 'mg', 'upper_bound': true},
          {'i': 2, 'amount': ((k % 9 + 1) * 1000 + k % 1000)::double, 'unit': 'kj', 'upper_bound': false}, {'i': 3, 'amount': (k % 10) / 10.0, 'unit': 'percent', 'upper_bound': false},
          {'i': 4, 'amount': (k % 7)::double, 'unit': 'other', 'upper_bound': true}]) as q from p)
        select p_partkey, q.i::bigint as i, q.amount::double as amount, q.unit as unit, q.upper_bound as upper_bound from t""",
    "label_row_classifier": """with n as (select count(*) as n, count(*) filter (p_partkey % 11 <> 0) as h from part)
        select class, kind, lines from (select 'other' as class, '' as kind, n + n + (n - h) as lines from n union all select 'servings', '', n from n union all select 'header', '', h from n
          union all select 'row', unnest(['energy', 'protein_g', 'fat_g', 'saturated_fat_g', 'carbohydrate_g', 'sugars_g', 'sodium_mg']), n from n) where lines > 0""",
    "spatial_cells": """select p_partkey as doc_id, unnest(['per_serving.protein_g', 'per_100g.protein_g', 'per_100g.sodium_mg']) as name, unnest([p_partkey % 90, p_partkey % 80, p_partkey % 600])::double as value from part
        union all select p_partkey, 'per_serving.sodium_mg', p_partkey % 700 from part where p_partkey % 5 <> 0 union all select p_partkey, 'nutrition_row_incomplete', null from part where p_partkey % 5 = 0""",
    "nms_regions": """with recursive li as (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by all),
        r as (select l_orderkey as o, {'l': p % 8 / 16.0::double, 't': s % 8 / 16.0::double, 'c': ((l_linenumber * 13 + p) % 64) / 64.0::double} as x, row_number() over (partition by l_orderkey order by (l_linenumber * 13 + p) % 64 desc, s % 8, p % 8) as n from li),
        k as (select o, cast(0 as bigint) as n, []::struct(l double, t double, c double)[] as kept from r where r.n = 1
          union all select k.o, r.n, case when len(list_filter(k.kept, lambda q: greatest(0, 0.25 - abs(q.l - r.x.l)) * greatest(0, 0.25 - abs(q.t - r.x.t)) >= 0.3 * (0.125 - greatest(0, 0.25 - abs(q.l - r.x.l)) * greatest(0, 0.25 - abs(q.t - r.x.t))))) > 0
            then k.kept else list_append(k.kept, r.x) end from k join r on r.o = k.o and r.n = k.n + 1)
        select o as l_orderkey, max(n) as candidates, cast(max_by(len(kept), n) as bigint) as kept, max_by(list_sum(list_transform(kept, lambda q: q.c)), n) as confidence from k group by o""",
    "transform_inverse": """with a as (select o_orderkey, o_orderkey as k, (o_orderkey % 16) / 16.0::double as x, (o_orderkey % 32) / 32.0::double as y from orders),
        b as (select o_orderkey, k, case when k % 2 = 0 then 1 - x else x end as x, case when k % 2 = 0 then y else 1 - y end as y from a),
        c as (select o_orderkey, case k % 4 when 0 then y when 1 then 1 - x when 2 then 1 - y else x end as x, case k % 4 when 0 then 1 - x when 1 then 1 - y when 2 then x else 1 - y end as y from b)
        select o_orderkey, 0.25 + x * 0.5 as x, 0.125 + y * 0.5 as y from c""",
    "image_quality_scores": f"""with {_GRID}, m as (select s_suppkey, (max(v) - min(v)) / 255 as contrast, sum(v) / 4096 / 255 as mean_luminance,
          count(*) filter (v >= 250) / 4096 >= 0.01 and quantile_disc(v, 0.75) <= 217 as glare from g group by 1),
        s as (select a.s_suppkey, sum(abs(a.v - coalesce(r.v, a.v)) + abs(a.v - coalesce(d.v, a.v))) / (2 * 63 * 64) / 255 as sharpness
          from g a left join g r on r.s_suppkey = a.s_suppkey and r.y = a.y and r.x = a.x + 1 left join g d on d.s_suppkey = a.s_suppkey and d.x = a.x and d.y = a.y + 1 group by 1),
        j as (select *, contrast < 0.02 as blank from m join s using (s_suppkey)),
        w as (select *, list_filter([case when blank then 'blank' end, case when not blank and sharpness < 0.01 then 'blurry' end, case when not blank and glare then 'glare' end,
          case when not blank and mean_luminance > 0.95 then 'overexposed' end, case when not blank and mean_luminance < 0.05 then 'underexposed' end], lambda x: x is not null) as ws from j)
        select s_suppkey, round(contrast, 6) as contrast, round(mean_luminance, 6) as mean_luminance, round(sharpness, 6) as sharpness, glare, array_to_string(ws, ',') as warnings,
          round(case when blank then 0 else contrast * greatest(1 - abs(mean_luminance - 0.5) * 2, 0) end, 6) as quality_score,
          case when list_contains(ws, 'blank') then 'unusable' when list_contains(ws, 'blurry') then 'hold_steady' when list_contains(ws, 'glare') then 'avoid_glare'
            when list_contains(ws, 'underexposed') then 'add_light' when list_contains(ws, 'overexposed') then 'reduce_light' else 'usable' end as verdict from w""",
    "image_preparation": f"""with {_GRID}, c as (select s_suppkey, v, x, y, case when s_suppkey % 5 = 0 then 32 else 64 end as h from g where s_suppkey % 5 <> 0 or y < 32),
        m as (select s_suppkey, h, (max(v) - min(v)) / 255 as contrast, avg(v) / 255 as mean, count(*) filter (v >= 250) / count(*) >= 0.01 and quantile_disc(v, 0.75) <= 217 as glare from c group by 1, 2),
        s as (select a.s_suppkey, sum(coalesce(abs(a.v - r.v), 0) + coalesce(abs(a.v - d.v), 0)) / (63 * any_value(a.h) + 64 * (any_value(a.h) - 1)) / 255 as sharp
          from c a left join c r on r.s_suppkey = a.s_suppkey and r.y = a.y and r.x = a.x + 1 left join c d on d.s_suppkey = a.s_suppkey and d.x = a.x and d.y = a.y + 1 group by 1),
        q as (select s_suppkey, h, case when contrast < 0.02 then 'unusable' when sharp < 0.01 then 'hold_steady' when glare then 'avoid_glare' when mean < 0.05 then 'add_light' when mean > 0.95 then 'reduce_light' else 'usable' end as verdict,
          case when s_suppkey % 11 > 0 then s_suppkey % 11 else 1 end as tag from m join s using (s_suppkey)),
        o as (select *, verdict = 'usable' as ok, case when verdict = 'usable' then coalesce(['', 'flip_horizontal', 'clockwise_180', 'flip_vertical', 'clockwise_90,flip_horizontal', 'clockwise_90', 'clockwise_270,flip_horizontal', 'clockwise_270'][tag], '') else '' end as steps from q),
        z as (select *, steps like '%0,%' or steps in ('clockwise_90', 'clockwise_270') as turned, tag = 1 and h = 64 as big from o)
        select s_suppkey, case when ok then 'ready' else 'request_better_source' end as outcome, verdict, steps, big as upscaled, cast(case when turned then h else 64 end * case when big then 3 else 1 end as integer) as width,
          cast(case when turned then 64 else h end * case when big then 3 else 1 end as integer) as height, cast(64 * h * case when big then 9 else 1 end as integer) as bytes,
          case when steps in ('flip_horizontal', 'clockwise_180') then 0.75 when turned then 0.5 else 0.25 end as x,
          case when steps in ('clockwise_90,flip_horizontal', 'clockwise_270') then 0.25 when turned then 0.75 else 0.5 end as y from z""",
    "polygon_overlaps": """with p as (select l_orderkey, l_linenumber, (l_partkey % 8) / 16.0 as ax, (l_suppkey % 8) / 16.0 as ay, (l_orderkey % 16) / 32.0 + 0.25 as x, (cast(l_quantity as bigint) % 16) / 32.0 + 0.25 as y from lineitem),
        s as (select l_orderkey, l_linenumber, ax, ay, x, y, greatest(ay, y - 0.25) as y0, least(ay + 0.5, y + 0.25) as y1 from p),
        -- A diamond's width at a height is piecewise linear, so between the heights where a piece ends the trapezoid rule is exact.
        h as (select l_orderkey, l_linenumber, ax, x, y, y0, y1, list_sort(list_distinct(list_filter([y0, y1, y, y - 0.25 + abs(x - 0.25 - ax), y + 0.25 - abs(x - 0.25 - ax), y - 0.25 + abs(ax - x), y + 0.25 - abs(ax - x), y - 0.25 + abs(ax + 0.5 - x), y + 0.25 - abs(ax + 0.5 - x)], lambda v: v >= y0 and v <= y1))) as hs from s where l_linenumber % 2 = 1),
        w as (select l_orderkey, l_linenumber, y0, y1, hs, list_transform(hs, lambda v: greatest(0, least(ax + 0.5, x + 0.25 - abs(v - y)) - greatest(ax, x - 0.25 + abs(v - y)))) as ws from h),
        c as (select l_orderkey, l_linenumber, case when y1 > y0 then coalesce(list_sum(list_transform(range(1, len(hs)), lambda i: (hs[i + 1] - hs[i]) * (ws[i] + ws[i + 1]) / 2)), 0) else 0 end as common, 0.125 as other from w
          union all select l_orderkey, l_linenumber, greatest(0, least(ax + 0.5, x + 0.25) - greatest(ax, x - 0.25)) * greatest(0, y1 - y0), 0.25 from s where l_linenumber % 2 = 0)
        select l_orderkey, l_linenumber, round(common, 9) as common, round(common / (0.25 + other - common), 9) as iou from c""",
    "mime_sniff": """select (['application/pdf', 'image/png', 'image/jpeg', 'image/webp', 'image/tiff', 'unknown'])[p_partkey % 6 + 1] as mime, count(*) as files from part group by 1""",
}
