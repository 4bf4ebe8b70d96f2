"""Label extraction on lines of our own: values are read, never guessed or changed."""

from __future__ import annotations

import json

from leafmill.operators import labels

SCHEMA = "doc_id int, page int, reading_order int, observation_id string, text string, confidence double, polygon array<struct<x:double,y:double>>"


def box(x, y, w=0.15, h=0.03):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def run(spark, *docs):
    rows = [(d, 1, i, f"obs_{i}", *(line if isinstance(line, tuple) else (line, 0.9, box(0.1, i / 40)))) for d, lines in enumerate(docs) for i, line in enumerate(lines)]
    fields, failures = labels.extract(spark.createDataFrame(rows, SCHEMA))
    out = [({}, set()) for _ in docs]
    for r in fields.collect():
        out[r.doc_id][0][r.name] = r.value
    for r in failures.collect():
        out[r.doc_id][1].add(r.code)
    return out


PANEL = [
    "Rolled oats with raisins", "Nutrition Information", "Servings per pack: 12", "Serving size: 45g", "Per Serving  Per 100g", "Sodium 0.09g 200mg", "Protein 5.4g 12g", "Dietary fibre <1g 8g",
    "Carbohydrate 27g 60g", "- sugars 9g 20g", "Fat, total 4.5g 10g", "- saturated 0.9 g 2 g", "Energy 720kJ (172Cal) 1600kJ (382Cal)", "9 300000 000019",
]


def test_two_columns(spark):
    (fields, failures), = run(spark, PANEL)
    assert fields["per_serving.energy_kj"] == "720.0" and fields["per_100g.energy_kcal"] == "382.0"
    assert fields["per_serving.sodium_mg"] == "90.0" and fields["per_100g.sodium_mg"] == "200.0"
    assert "per_serving.fibre_g" not in fields and fields["per_100g.fibre_g"] == "8.0"
    assert fields["servings_per_pack"] == "12.0" and fields["barcode"] == "9300000000019" and fields["locale"] == "en-AU"
    assert json.loads(fields["serving_size"]) == {"amount": 45.0, "unit": "g"} and json.loads(fields["column_headers"]) == ["per_serving", "per_100g"]
    assert failures == set()


def test_missing_parts(spark):
    headless = [x for x in PANEL if "Per Serving" not in x]
    nothing, no_heads, bad_code = run(spark, ["hello", "12345678"], headless, [*PANEL[:-1], "9 300000 000011"])
    assert nothing == ({}, {"nutrition_panel_not_found"})
    assert no_heads[1] == {"nutrition_columns_unidentified"} and not [k for k in no_heads[0] if "." in k]
    assert "barcode" not in bad_code[0]


def test_checks_change_nothing(spark):
    odd = ["per serve (50g) per 100g", "energy 900kJ 100Cal 1000kJ 900Cal", "protein 50g 60g", "fat 1g 40g", "saturated 2g 50g", "carbohydrate 1g 30g", "sugars 2g 40g"]
    (fields, failures), = run(spark, odd)
    assert fields["per_100g.saturated_fat_g"] == "50.0"
    assert failures == {"energy_unit_mismatch", "energy_atwater_mismatch", "saturated_fat_exceeds_fat", "sugars_exceed_carbohydrate", "per_100g_exceeds_100g", "serving_column_mismatch"}


def test_numbers(spark):
    (fields, _), = run(spark, ["per 100g", "energy 1,500kj", "protein 0,5g", "sodium (mg) 120", "calories 33"])
    assert fields["per_100g.energy_kj"] == "1500.0" and fields["per_100g.protein_g"] == "0.5"
    assert fields["per_100g.sodium_mg"] == "120.0" and fields["per_100g.energy_kcal"] == "33.0"


def spatial(*cells):
    return [("per serving", 0.9, box(0.4, 0.1)), ("per 100g", 0.8, box(0.7, 0.1)), ("protein", 0.9, box(0.1, 0.2)), *cells]


def test_spatial(spark):
    both, one, shared = run(
        spark, spatial(("3g", 0.9, box(0.4, 0.2)), ("10g", 0.9, box(0.7, 0.2))), spatial(("10g", 0.9, box(0.7, 0.2))),
        spatial(("3g", 0.9, box(0.4, 0.2)), ("10g", 0.9, box(0.7, 0.2)), ("fat", 0.9, box(0.1, 0.21))),
    )
    assert both[0]["per_serving.protein_g"] == "3.0" and both[0]["per_100g.protein_g"] == "10.0" and not both[1]
    assert "per_serving.protein_g" not in one[0] and one[0]["per_100g.protein_g"] == "10.0" and one[1] == {"nutrition_row_incomplete"}
    assert not [k for k in shared[0] if k.endswith("_g")]


def test_turned(spark):
    flip = lambda polygon: [(1 - y, x) for x, y in polygon]
    (fields, failures), = run(spark, [(t, c, flip(p)) for t, c, p in spatial(("3g", 0.9, box(0.4, 0.2)), ("10g", 0.9, box(0.7, 0.2)))])
    assert fields["per_serving.protein_g"] == "3.0" and fields["per_100g.protein_g"] == "10.0" and not failures
