"""Error rates, field values and benchmark reports on small known cases."""

from __future__ import annotations

import pytest

from leafmill.functions.text import word_distance
from leafmill.operators import evaluate


def scored(spark, pairs, **limits):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, r string, c string")
    return [r.asDict() for r in evaluate.evaluate_text(df, "r", "c", **limits).orderBy("id").collect()]


def test_rates(spark):
    a, b, c, d, e, f = scored(spark, [("hello, worlds", "hello, worlds"), ("hello, worlds", "hello, worldss"), ("café au lait", "café au lait"), ("a\tb\nc", "a b c"), ("", ""), ("", "ab")])
    assert (a["char_edits"], a["char_error_rate"], a["word_edits"]) == (0, 0.0, 0)
    assert b["char_error_rate"] == pytest.approx(1 / 13) and b["word_error_rate"] == pytest.approx(1 / 2)
    assert (c["char_edits"], c["word_edits"]) == (0, 0)
    assert d["word_edits"] == 0
    assert e["char_error_rate"] == 0.0 and f["char_error_rate"] is None and f["char_edits"] == 2


def test_corpus(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "bcdefghij", "bcdefghij")], "id int, r string, c string")
    r = evaluate.corpus_rates(evaluate.evaluate_text(df, "r", "c")).first()
    assert r.char_error_rate == pytest.approx(1 / 10) and r.word_error_rate == pytest.approx(1 / 2)


def test_limits(spark):
    a, b = scored(spark, [("abcdef", "abc"), ("ab", "ab")], most_units=5)
    assert a["limit"] == "units" and a["char_edits"] is None and b["limit"] is None
    assert scored(spark, [("abcd", "abcd")], most_cells=10)[0]["limit"] == "work"


def test_word_distance():
    assert word_distance("a b c d".split(), "a x c".split()) == 2
    assert word_distance([], ["a"]) == 1
    import random

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = (rng.choices("abcd", k=rng.randrange(12)) for _ in range(2))
        assert word_distance(a, b) == slow(a, b)


def test_unknown_digests_and_states(spark):
    """A run with a missing digest or state isn't clean."""
    m = spark.createDataFrame([("a", "h"), ("b", None), ("c", "h"), ("d", "h")], "id string, sha256 string")
    s = spark.createDataFrame([("a", None, "completed"), ("b", None, "completed"), ("c", "h", None), ("d", "h", "completed")], "id string, sha256 string, status string")
    assert {r.id: r.problem for r in evaluate.run_problems(m, s).collect()} == {"a": "digest", "b": "digest", "c": "status"}


def test_all_pairs(spark, tmp_path):
    """Queries over benchmark pairs leave none out: code points of NFC by brute force."""
    from unicodedata import normalize

    from leafmill.plans.documents import QUERIES

    texts = ["cafe au lait", "café au lait", "cafe\u0301 au lait", "日本 語", "日 語", "plain", "", "naïve 😀 plain", "plainer text"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: {r[0]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    pairs = {i: tuple(normalize("NFC", t) for t in ab) for i, ab in enumerate(zip(texts, texts[1:]))}
    chars, words = run("char_error_rate_all_pairs"), run("word_error_rate_pairs")
    want = {i: (word_distance(list(a), list(b)), len(a)) for i, (a, b) in pairs.items()}
    assert {i: (r.char_edits, r.char_units) for i, r in chars.items()} == want
    assert {i: (r.char_edits, r.char_units) for i, r in words.items()} == want
    assert {i: (r.word_edits, r.word_units) for i, r in words.items()} == {i: (word_distance(a.split(), b.split()), len(a.split())) for i, (a, b) in pairs.items()}
    sums = {k: tuple(map(sum, zip(*[want[i] for i in want if i % 4 == k]))) for k in range(4)}
    assert {k: (r.char_edits, r.char_units) for k, r in run("corpus_error_rate_all_pairs").items()} == sums


def test_benchmark(spark):
    m = spark.createDataFrame([("a", "h1", "one two", {"x": "50", "y": "k"}), ("b", "h2", "three", {"x": "1"})], "id string, sha256 string, reference_text string, expected_fields map<string,string>")
    s = spark.createDataFrame([("a", "h1", "completed", 100, "one two", {"x": "50.0"}), ("b", "h2", "failed", 300, "", {"x": "1.1"})], "id string, sha256 string, status string, elapsed_ms long, text string, fields map<string,string>")
    cases, summary = evaluate.score_benchmark(m, s)
    got = {r.id: (r.correct_fields, r.missing_fields, r.wrong_fields) for r in cases.collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 0, 1)}
    assert tuple(summary.select("p50_ms", "p95_ms").first()) == (100, 300)
    with pytest.raises(ValueError):
        evaluate.score_benchmark(m, s.where("id = 'a'"))


def test_reread_pages(spark):
    from leafmill.schema import PAGE, decode_strict, flatten_pages, nest_pages

    text = '{"page":1,"width":10,"height":20,"observations":[{"observation_id":"obs_1","level":"line","text":"x","confidence":0.5,"polygon":{"points":[{"x":0,"y":0}]},"reading_order":0}]}'
    df = spark.createDataFrame([(1, text), (2, text.replace('"page"', '"pages"')), (3, "no")], "id int, json string")
    got = {r.id: (r.decode_error, r.decoded is not None) for r in decode_strict(df, "json", PAGE).collect()}
    assert got == {1: (None, True), 2: ("unknown:pages", False), 3: ("not_an_object", False)}
    pages = decode_strict(df.where("id = 1"), "json", PAGE).selectExpr("id", "array(decoded) as pages")
    flat = flatten_pages(pages, "pages", "id")
    assert flat.count() == 1 and nest_pages(flat, "id").first().pages[0].observations[0].text == "x"
