"""Nulls, empty, long and repeated texts, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import licenses, matroska, near_dedup, packing, quality, sharding, toxicity
from leafmill.llm import bpe_transducer as bpe
from leafmill.llm import token_counts as counts
from leafmill.llm.queries import QUERIES

ROWS = [(1, None), (2, ""), (3, "  \n\t"), (4, "word " * 30_000), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "no id"), (None, None), (7, "\x00퟿\U0010ffff")]
#: Columns that results or inner steps also use.
CLASH = {"source": "queue", "score": "score", "kept": "kept", "id": "id", "n_bytes": "n_bytes", "length": "length", "hash": "print", "value": "value", "__source": "__source"}


def tables(spark, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").where(F.lit(bool(rows))).write.parquet(f"{path}/labels.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 2, "user", "x"), (2, None, "user", "y"), (3, 0, None, "z"), (3, 1, "assistant", "w" * 50_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").where(F.lit(bool(rows))).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("edges"), ROWS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("nothing"), [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, edges, nothing):
    rows = QUERIES[name](spark, edges).collect()
    key = "conv_id" if "conv_id" in rows[0] else "doc_id"
    # One row for each turn, conversation or document; of pieces, the first.
    want = len({1, 2, 3, None}) if name == "op12_conversation_repair" else 7 if key == "conv_id" else len(ROWS)
    whole = [r for r in rows if "sequence_id" not in r or r.start == 0]
    assert len(whole) == want
    twice = [tuple(v for k, v in r.asDict().items() if k not in ("sequence_id", "offset")) for r in rows if r[key] == 5]
    assert len(set(twice)) == 1 or key == "conv_id" or name == "op11_mixture_packing"  # which cuts anywhere
    empty = QUERIES[name](spark, nothing)
    assert empty.count() == 0 and empty.columns == QUERIES[name](spark, edges).columns


def test_pipeline(spark, edges, nothing):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edges)
        assert out.schema == schema, name
        out.collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, edges).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 2, 3, 4, 5, 7]
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage keeps what the brute force of its parts says, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = toxicity.score_texts(docs, ["doc_id"], "text", toxicity.train(docs, labels)).where("score < 0.3").select("doc_id")
    one = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r.doc_id for r in toxic.collect()}
    two = corpus_pipeline.drop_poor(spark, one, sf_dir)
    judged = quality.judge(docs, ["doc_id"], "text", quality.train(docs, labels)).where("kept").select("doc_id").join(toxic, "doc_id")
    assert {r.doc_id for r in two.select("doc_id").collect()} == {r.doc_id for r in judged.collect()}
    from tests_near import brute

    groups = brute([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    three = corpus_pipeline.drop_near_duplicates(spark, two, sf_dir)
    assert {r.doc_id for r in three.select("doc_id").collect()} == {c for _, c in groups.values()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {c for _, c in groups.values()}


def test_operators_take_other_names(spark):
    df = spark.createDataFrame([("k1", "some text", 1), ("k2", None, 2)], "name string, body string, doc_id int")
    assert licenses.license_scan(df, "name", "body").columns[0] == "name"
    assert sharding.shards(df, "name", "body").count() == 2
    assert packing.pack_documents(df, "name", "body", capacity=16).count() == 2
    assert matroska.store_texts(df, "name", "body").count() == 2
    import public_tokenizers as public

    assert counts.count_tokens(df, ["name"], "body", public.path("piece_bpe_32k.model")).count() == 2
    assert bpe.encode_texts(df, ["name"], "body", public.path("byte_bpe_50k.tiktoken"), public.PATTERN).first().name == "k1"
    assert near_dedup.near_duplicates(df, "doc_id", "body").count() == 2
