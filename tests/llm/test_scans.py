"""License scans, shards and tool calls against SQL, brute force and small cases."""

from __future__ import annotations

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import licenses as L
from leafmill.llm import sharding as H
from leafmill.llm import tool_calls as C
from leafmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))


def test_licenses(spark):
    mit = L.TEMPLATES["text-mit"].upper()
    texts = [None, "", "Mit\tLicense mit-LICENSE", "xmit license", "the  Apache, license\nCC BY", mit, " ".join(mit.split()[:12]), "x " * 50_000 + "GNU General Public License", "ÀMIT LICENSE", "mit licenseé"]
    texts.append(texts[2])
    got = [r.asDict() for r in L.license_scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")).orderBy("doc_id").collect()]
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in got[:5]] == [(0, 0, None, None), (0, 0, None, None), (4, 2, 0, 2), (2, 0, None, None), (5, 2, 1, 3)]
    assert [r["base_labels"] for r in got[:5]] == ["", "", "mit", "", "apache,cc-by"]
    assert got[5]["labels"] == "text-mit" and got[5]["score"] == 1.0 and got[6]["labels"] == "" and got[6]["score"] == 0.0
    assert (got[7]["first_word"], got[7]["labels"], got[7]["score"]) == (50_000, "gpl", 0.5)
    assert got[8]["n_base"] == got[9]["n_base"] == 0 and got[10]["labels"] == got[2]["labels"]
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_phrases_that_overlap(spark):
    """All places count, also those within others, at a text's begin and end, with any characters between and around."""
    import re

    texts = ["a a a", "A-a\ta", "aa a", "b a a b", "a b a b a", "é a a", "𝄞 a a 𝄞a a", "x", "B", "a\na b"]
    got = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases={"a a": "two", "A B": "ab", "b": "one"}).orderBy("doc_id").collect()
    for text, r in zip(texts, got):
        words = re.findall(f"{L.WORD}+", text.lower())
        places = [i for p in ("a a", "a b", "b") for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None)), text
    for wrong in ("", "a  b", "a.b", " a"):
        with pytest.raises(ValueError):
            L.license_scan(spark.createDataFrame([], "doc_id long, text string"), phrases={wrong: "x"})


WRAPPED = {
    "text-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "text-gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3",
    "text-apache-2.0": " * Unless required by applicable law or agreed to in writing, software\r\n * distributed under the License is distributed on an \"AS IS\" BASIS,\r\n * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express",
    "text-bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "text-isc": "Permission to use, copy, modify, and/or distribute this software for any\n\npurpose with or without fee is hereby granted, provided",
    "notice-cc0": "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.",
    "notice-mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy",
}


def test_words_far_apart_are_no_license(spark):
    rows = [
        (1, "Researchers at MIT said the study, released in May, put every driver under a new license."), (2, "released " + "x " * 6500 + "under the " + "y " * 6500 + "MIT license"),
        (3, "released\nunder the\n * MIT\n * license"), (4, "Released, in 2020, under the MIT license."), (5, "released under the famous old good MIT license"), (6, "the license: MIT, under which it is released"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("", 0.0), 2: ("mit", 0.5), 3: ("mit,notice-mit", 1.0), 4: ("mit,notice-mit", 1.0), 5: ("mit", 0.5), 6: ("", 0.0)}


def test_wrapped_licenses(spark):
    rows = [(k, f"some code here\n{t}\nand more") for k, t in WRAPPED.items()]
    words = L.TEMPLATES["text-mit"].split()
    rows += [("one a line", "\n".join(words)), ("far apart", "\n".join(words[:9] + ["x"] * 30 + words[9:])), ("too few", "\n".join(words[:12]))]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in L.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(k in got[k][0] and got[k][1] == 1.0 for k in WRAPPED)
    assert got["one a line"] == (["text-mit"], 1.0) and got["far apart"] == got["too few"] == ([""], 0.0)


def test_runs_by_brute_force(spark):
    """Every run of a template's window, against every template."""
    import random
    import re

    rng, sets = random.Random(5), L.template_sets(L.TEMPLATES, L.CONTAINMENT)
    texts = []
    for _ in range(150):
        words = rng.choice(list(L.TEMPLATES.values())).split()
        for _ in range(rng.randrange(14)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "the", "license", "of"]))
        if rng.random() < 0.3:
            words.pop(rng.randrange(len(words)))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n# "]) for w in [*rng.choices(["of", "y", "permission"], k=rng.randrange(9)), *words]))
    want = []
    for text in texts:
        words = re.findall(f"{L.WORD}+", text)
        blocks = lambda size: [set(words[i : i + size]) for i in range(len(words))]
        met = {label: best for label, own, need in sets if (best := max(len(b & set(own)) for b in blocks(L.window(L.TEMPLATES[label]))) / len(own)) * len(own) > need - 0.5}
        want.append((set(met), max(met.values(), default=0.0)))
    got = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases={"no such phrase": "none"}).orderBy("doc_id").collect()
    assert [(set(filter(None, r.labels.split(","))), r.score) for r in got] == want


def shard_of(rows, limit):
    """Buckets by splitting on one bit at a time."""
    import hashlib

    h = [int(hashlib.md5(f"{'' if i is None else i}\n{t or ''}".encode()).hexdigest()[:15], 16) for i, t in rows]
    size = [len((t or "").encode()) for _, t in rows]
    out = {}

    def split(members, depth):
        if sum(size[m] for m in members) <= limit or len(members) == 1 or depth == H.BITS:
            for m in members:
                out[m] = (depth, h[m] >> (H.BITS - depth))
            return
        sides = defaultdict(list)
        for m in members:
            sides[h[m] >> (H.BITS - depth - 1) & 1].append(m)
        for side in sides.values():
            split(side, depth + 1)

    split(range(len(rows)), 0)
    return out


@pytest.mark.parametrize(("limit", "short"), [(50, 14), (50, 3), (300, 14), (5000, 14), (5000, 0)])
def test_shards(spark, limit, short, monkeypatch):
    monkeypatch.setattr(H, "SHORT", short)
    rows = [(i, "x" * (i * 37 % 90)) for i in range(300)] + [(900, "y" * 400), (901, None), (None, "z"), (902, "é" * 30)]
    got = H.shards(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, overflow int"), limit=limit).collect()
    want = shard_of(rows, limit)
    assert sorted((r.doc_id or -1, r.shard_depth, r.shard_prefix) for r in got) == sorted((rows[m][0] or -1, *at) for m, at in want.items())
    assert all(r.shard_bytes <= limit or r.shard_docs == 1 for r in got)


def test_directory(spark):
    """Several entries point to a bucket that split less often; entries that are too large point to none."""
    top = H.BITS - 4
    rows = [(h << top, n) for h, n in ((0, 10), (1, 10), (4, 10), (8, 60), (9, 60), (12, 70), (12, 70))]
    got = {r.entry: r.bucket and (r.bucket.depth, r.bucket.prefix, r.bucket.shard_bytes, r.bucket.shard_docs) for r in H.directory(spark.createDataFrame(rows, "h long, n_bytes long"), 100, 0, 4).collect()}
    assert got == {0: (1, 0, 30, 3), 1: (1, 0, 30, 3), 4: (1, 0, 30, 3), 8: (4, 8, 60, 1), 9: (4, 9, 60, 1), 12: None}


def test_shard_overflow(spark):
    df = spark.createDataFrame([(7, "a" * 40)] * 23 + [(8, "b")] * 3, "doc_id long, text string").repartition(4)
    got = H.shards(df, limit=100).collect()
    seven = [r for r in got if r.doc_id == 7]
    assert len(got) == 26 and len({r.overflow for r in seven}) == 12 and all(r.shard_bytes <= 100 for r in got)
    assert H.shards(df.limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "doc_id long, text string")
    placed = H.shards(df, limit=600)
    H.write_shards(placed, df, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).where("n > 600").isEmpty()


MESSAGES = "conv_id long, turn long, role string, text string, call_id string, name string, arguments string, after array<string>, result_of string"


def test_tool_calls(spark):
    tools = {"add": [C.Parameter("a", "integer", True, 0), C.Parameter("note", "string", False, 2)]}
    call = lambda turn, i, args, *after, name="add": (1, turn, "assistant", None, i, name, args, list(after), None)
    result = lambda turn, of, text="ok": (1, turn, "tool", text, None, None, None, [], of)
    rows = [
        (1, 0, "user", 'say "hi"\n', None, None, None, [], None), call(1, "c1", '{ "note":"xy", "a":1 }'), result(2, "c1"), result(3, "c1", "again"), call(4, "c2", '{"a":"1"}', "c1"),
        call(5, "c3", '{"a":-1,"note":"x","z":[1]}', "c1", "c2", "nope"), call(6, "c3", '{"a":2}'), call(7, "c4", "oops", "c5"), call(8, "c5", '{"a":1}', "c4"), call(9, "c6", "{}", name="sub"), result(10, "gone", None),
    ]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("status", F.lit(0))
    got = {r.turn: r for r in C.link_tool_calls(df, tools).collect()}
    assert [got[t].status for t in range(11)] == ["plain", "answered", "linked", "duplicate_result", "unanswered", "unanswered", "duplicate_call", "circular", "circular", "unanswered", "orphan"]
    assert [got[t].topo for t in range(11)] == [None, 0, 1, 1, 2, 4, 4, None, None, 0, None]
    assert [got[t].errors for t in (1, 4, 5, 7, 9)] == ["", "type:a", "least:a,least:note,unknown:z,no_call:nope", "not_json", "unknown_tool"]
    assert got[1].canonical == '{"arguments":{"a":1,"note":"xy"},"id":"c1","name":"add","role":"assistant"}'
    assert json.loads(got[0].canonical) == {"content": 'say "hi"\n', "role": "user"} and json.loads(got[10].canonical)["content"] is None
    assert C.link_tool_calls(df.limit(0), tools).count() == 0
    twice = C.link_tool_calls(df.union(df), tools)
    assert twice.count() == 22 and twice.distinct().count() == 11


def test_calls_of_other_conversations(spark):
    """Conversations share identifiers; nothing links across them, and a null conversation is one of its own."""
    rows = []
    for conv in (1, 2, 11, None):
        rows += [(conv, 0, "assistant", None, "call_0", "add", '{"a":1}', ["call_9"] if conv == 2 else [], None), (conv, 1, "tool", "ok", None, None, None, [], "call_0")]
    rows += [(1, 2, "assistant", None, "call_9", "add", '{"a":1}', ["call_0"], None), (3, 0, "tool", "ok", None, None, None, [], "call_0"), (1, 5, "tool", "x", None, None, None, [], "1:call_0")]
    got = {(r.conv_id, r.turn): (r.status, r.topo, r.errors) for r in C.link_tool_calls(spark.createDataFrame(rows, MESSAGES), {"add": [C.Parameter("a", "integer", True)]}).collect()}
    for conv in (1, 11, None):
        assert got[conv, 0] == ("answered", 0, "") and got[conv, 1] == ("linked", 1, "")
    assert got[2, 0] == ("answered", 0, "no_call:call_9") and got[1, 2] == ("unanswered", 2, "") and got[3, 0][0] == got[1, 5][0] == "orphan"


def canonical_by_hand(text):
    """Canonical JSON by Python's exact numbers; null for what isn't JSON or repeats a key."""
    from decimal import Decimal

    def number(x):
        d = Decimal(x)
        if not d:
            return "0"
        sign, digits, power = d.normalize().as_tuple() if len(d.as_tuple().digits) < 28 else d.as_tuple()
        short = "".join(map(str, digits))
        power += len(short) - len(short.rstrip("0"))
        short = short.rstrip("0")
        point, sign = len(short) + power, "-" * sign
        if 0 <= power <= 20:
            return sign + short + "0" * power
        if power < 0 < point:
            return sign + short[:point] + "." + short[point:]
        if power < 0 and -20 < point:
            return sign + "0." + "0" * -point + short
        return sign + short[0] + ("." + short[1:] if len(short) > 1 else "") + ("e+" if point > 0 else "e") + str(point - 1)

    class Number(str):
        pass

    def single(pairs):
        if len(dict(pairs)) < len(pairs):
            raise ValueError
        return dict(pairs)

    def write(x):
        if isinstance(x, Number):
            return number(x)
        if isinstance(x, dict):
            return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + write(x[k]) for k in sorted(x, key=str.encode)) + "}"
        return "[" + ",".join(map(write, x)) + "]" if isinstance(x, list) else json.dumps(x, ensure_ascii=False)

    def refuse(x):
        raise ValueError

    try:
        return write(json.loads(text, parse_int=Number, parse_float=Number, parse_constant=refuse, object_pairs_hook=single))
    except (ValueError, TypeError):
        return None


def test_canonical_json(spark):
    """Equal values have one spelling; other values have others."""
    import random

    rng = random.Random(12)
    numbers = ["0", "-0", "-0.0", "0e5", "1", "1.0", "1e0", "10E-1", "100", "1e2", "-1.50", "123456789" * 6, "0." + "123456789" * 5, "1e20", "1e21", "1E+400", "-2.5e-400", "0.0000001", "12e-22", "1e-25", "9007199254740993", "1.0000000000000000000000000001"]
    strings = ["a", "", 'q"u', "b\\", "￿5", "\\uffff7", "\\\\uffff", "tab\\t", "é", "1.0", "\\u0041", "\\/", "￿￿"]
    broken = ["{", "[1", "[1] x", "[1],[2]", '{"a":1} ,"b":2', "[01]", "[1.]", "[.5]", "[+1]", "{1:2}", "[1 2]", "[tru]", "", " ", "[NaN]", '{"a":1,"a":1}', '[{"a":{"b":1,"b":2}}]', "[1]]", "[1]}", "'a'", '{"a":1}}', "[-]", '"a" 1']

    def value(depth):
        k = rng.random()
        if k < 0.4 or depth > 3:
            return rng.choice(numbers)
        if k < 0.6:
            return json.dumps(rng.choice(strings), ensure_ascii=rng.random() < 0.5) if rng.random() < 0.4 else '"' + rng.choice(strings).replace('q"u', "q").replace("b\\", "b") + '"'
        if k < 0.7:
            return rng.choice(["true", "false", "null"])
        space = rng.choice(["", " ", "\n\t"])
        if k < 0.85:
            return "[" + f"{space},".join(value(depth + 1) for _ in range(rng.randrange(4))) + "]"
        return "{" + f",{space}".join(json.dumps(rng.choice(["a", "b", "B", "é", "z z", "￿"]) + str(i)) + f"{space}:" + value(depth + 1) for i in range(rng.randrange(4))) + "}"

    texts = [*broken, *(f"[{n}]" for n in numbers), *(value(0) for _ in range(400)), '["' + "\\n" * 60_000 + '"]', "[" + ",".join(["1.0"] * 20_000) + "]", "[" * 300 + "]" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", C.canonical(C.parsed(F.col("t"))).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == canonical_by_hand(t), t[:80]
    assert got[len(broken) + 8] == got[len(broken) + 9] == "[100]"


def test_argument_errors(spark):
    """Each reason by itself, with numbers of all spellings."""
    tools = {"t": [C.Parameter("i", "integer", True, 1, 9), C.Parameter("n", "number", False, 0, 1), C.Parameter("s", "string", False, 2, 3), C.Parameter("b", "boolean", False), C.Parameter("l", "array", False), C.Parameter("o", "object", False)]}
    cases = {
        '{"i":1}': "", '{"i":1.0,"n":5e-1,"s":"ab","b":false,"l":[],"o":{}}': "", "{}": "missing:i", '{"i":1.5}': "type:i", '{"i":null}': "type:i", '{"i":"1"}': "type:i", '{"i":10}': "most:i", '{"i":0e9}': "least:i",
        '{"i":' + "9" * 50 + "}": "most:i", '{"i":1e400}': "most:i", '{"i":2,"n":"0"}': "type:n", '{"i":2,"n":1.0000000001}': "most:n", '{"i":2,"s":"a"}': "least:s", '{"i":2,"s":"abcd"}': "most:s", '{"i":2,"s":"￿5"}': "", '{"i":2,"s":5}': "type:s",
        '{"i":2,"b":0}': "type:b", '{"i":2,"l":{}}': "type:l", '{"i":2,"o":[]}': "type:o", '{"i":2,"x":1,"w":1}': "unknown:w,unknown:x", "[1]": "not_an_object", '"x"': "not_an_object", "{": "not_json", '{"i":1} 2': "not_json", '{"i":1,"i":1}': "repeated_key", '{"i":1,"o":{"a":1,"a":1}}': "repeated_key",
    }
    df = spark.createDataFrame([("t", k) for k in cases] + [("t", None), ("u", "{}"), (None, "{}")], "name string, a string")
    got = df.select("name", "a", F.array_join(C.argument_errors(F.col("name"), F.col("a"), C.parsed(F.col("a")), tools), ",").alias("e")).collect()
    assert {r.a: r.e for r in got if r.name == "t" and r.a is not None} == cases
    assert [r.e for r in got[-3:]] == ["not_json", "unknown_tool", "unknown_tool"]


def test_deep_chains(spark):
    n = 300
    calls = [(str(i), [str(i - 1)] if i else []) for i in range(n)] + [("x", ["5", "40"]), ("y", ["x", "299"])]
    calls += [("left", ["right"]), ("right", ["left", "3"]), ("behind", ["left", "x"])]
    got = {r.call_id: r.level for r in C.levels(spark.createDataFrame(calls, "call_id string, after array<string>")).collect()}
    assert got == {**{str(i): i for i in range(n)}, "x": 41, "y": 300}
