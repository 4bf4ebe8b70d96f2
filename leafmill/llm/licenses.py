"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only.  A template's blocks are the runs of consecutive words, across line ends, that are
a little longer than it (``window``), for license texts are often wrapped and edited; the order of words within a block isn't looked at.  A block's
tokens are those of its words that its templates have, for no other word can add to
an overlap; so a run that begins with another word has no more than the next one
that doesn't, and such runs are left out.  Tokens are ordered by their frequency over all blocks of the corpus, rarest first.  A block
that holds a template to the threshold needs at least ``need`` of its tokens, so

* length: it has that many tokens at all;
* prefix: one of the template's first ``size - need + 1`` tokens is among the
  block's first ``tokens - need + 1``;
* position: from the first token they share, enough are left on both sides.

Most texts have no word that any template can't do without (of each template,
its longest words, one more than may be missing) and aren't cut into words; most others don't hold enough of a template's words
anywhere, and no blocks are made of them.  What passes is verified by the exact overlap.  The templates and so the tokens
that are broadcast are a fixed list; frequencies are one row for each of them.

Cases: null and empty texts have no words and no labels (empty strings) and score
0; texts are read whole; rows that repeat an id and text have equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of words, in lower-cased and in raw text, and those between words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Percentage of a template's distinct words that a block must hold.
CONTAINMENT = 90
#: Score of a text with a base phrase where no template is met.
PHRASE_SCORE = 0.5

# Phrases with their labels, and notices of public licenses; fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "notice-apache-2.0": "licensed under the apache license version 2 0",
    "notice-cc-by-4.0": "this work is licensed under cc by 4 0",
    "notice-cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "notice-cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "notice-cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "notice-gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "notice-mit": "released under the mit license",
    "notice-mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "text-apache-2.0": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    "text-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "text-gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "text-isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
}


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def count_words(raw: Column) -> Column:
    return F.regexp_count(raw, F.lit(f"{RAW}+")).cast("long")


def phrase_pattern(phrase: str) -> str:
    """A place where a phrase begins in raw text; only A-Z are taken in either case.  It is of no width, so places may overlap."""
    return f"(?i)(?<!{RAW})(?=" + f"{GAP}++".join(phrase.split()) + f"(?!{RAW}))"


def checked(phrases: dict[str, str]) -> dict[str, str]:
    """The phrases in lower case; ``ValueError`` for one that isn't words with single spaces."""
    found = {}
    for phrase, label in phrases.items():
        low = "".join(c.lower() if c in UPPER else c for c in phrase)
        if not low or any(not re.fullmatch(f"{WORD}+", w) for w in low.split(" ")):
            raise ValueError(f"not words: {phrase!r}")
        found[low] = label
    return found


def holds_any(text: Column, parts: set[str]) -> Column:
    """Whether a text holds one of the strings; strings that hold another are left out."""
    least = [p for p in sorted(parts) if not any(q != p and q in p for q in parts)]
    out = F.lit(False)
    for p in least:
        out = out | text.contains(p)
    return out


def needed_words(sets: list[tuple[str, list[str], int]]) -> set[str]:
    """Words of which any block that meets a template has one: of each template its longest, one more than may be missing."""
    return {w for _, words, need in sets for w in sorted(words, key=lambda w: (-len(w), w))[: len(words) - need + 1]}


def window(text: str) -> int:
    """Words of a block that is held against a template: a fifth more than it has, and two at least."""
    n = len(text.split())
    return n + max(2, n // 5)


def template_sets(templates: dict[str, str], percent: int) -> list[tuple[str, list[str], int]]:
    """Label, distinct words and needed overlap of each template."""
    sets = [(label, sorted(set(text.split()))) for label, text in sorted(templates.items())]
    return [(label, words, -(-len(words) * percent // 100)) for label, words in sets]


def known_words(text: Column, vocabulary: list[str]) -> Column:
    """Those words of a lower-cased text that are in ``vocabulary``, with their places among all its words."""
    placed = F.transform(words_of(text), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    return F.filter(placed, lambda x: x["word"].isin(vocabulary))


def runs(known: str, length: int, vocabulary: list[str], needed: set[str]) -> Column:
    """Distinct words of each run of ``length`` words that begins with a word of ``vocabulary`` and holds one of ``needed``; ``known`` is a column of ``known_words``."""
    each = F.transform(known, lambda x, i: F.when(x["word"].isin(vocabulary), F.filter(F.slice(known, i + 1, F.lit(length)), lambda y: y["at"] < x["at"] + length)))
    each = F.filter(each, lambda run: run.isNotNull() & F.exists(run, lambda y: y["word"].isin(sorted(needed))))
    return F.transform(each, lambda run: F.array_intersect(strings(vocabulary), run["word"]))


BLOCKS = "array<struct<length:int,least:int,tokens:array<string>>>"


def blocks_for(known: str, length: int, sets: list[tuple[str, list[str], int]]) -> Column:
    """Blocks of ``length`` words that have enough words for one of the templates of that window."""
    words, least = sorted({w for _, ws, _ in sets for w in ws}), min(need for *_, need in sets)
    found = F.filter(runs(known, length, words, needed_words(sets)), lambda x: F.size(x) >= least)
    return F.transform(found, lambda x: F.struct(F.lit(length).alias("length"), F.lit(least).alias("least"), x.alias("tokens")))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def license_scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, percent: int = CONTAINMENT
) -> DataFrame:
    """Words, phrase places, labels and score of each text."""
    spark = df.sparkSession
    sets = template_sets(templates, percent)
    vocabulary, needed = sorted({w for _, words, _ in sets for w in words}), needed_words(sets)
    of_length: dict[int, list] = {}
    for one in sets:
        of_length.setdefault(window(templates[one[0]]), []).append(one)
    phrases = checked(phrases)
    any_phrase = "|".join(map(phrase_pattern, phrases))

    # lower() may also change other letters, but never misses what A-Z in either case spell.
    low = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("print"), F.coalesce(df[text_col], F.lit("")).alias("raw"), F.lower(F.coalesce(df[text_col], F.lit(""))).alias("low"))
    low = low.select("id", "print", "raw", holds_any(F.col("low"), {max(p.split(), key=len) for p in phrases}).alias("maybe"), holds_any(F.col("low"), needed).alias("open"))
    low = low.withColumn("n_base", F.when(F.col("maybe"), sum((F.regexp_count("raw", F.lit(phrase_pattern(p))) for p in phrases), F.lit(0)).cast("long")).otherwise(F.lit(0)))
    none = F.array().cast("array<string>")
    known = F.when(F.col("open"), known_words(F.translate("raw", UPPER, LOWER), vocabulary)).otherwise(F.array().cast("array<struct<at:int,word:string>>"))
    first = count_words(F.regexp_extract("raw", f"(?s)^(.*?)(?:{any_phrase})", 1))
    last = count_words(F.regexp_extract("raw", f"(?s)^(.*)(?:{any_phrase})", 1))
    labelled = [F.when(F.col("raw").rlike(phrase_pattern(p)), F.lit(label)) for p, label in sorted(phrases.items(), key=lambda x: x[1])]
    met = F.col("n_base") > 0
    base = low.select(
        "id", "print", count_words(F.col("raw")).alias("n_words"), "n_base", F.when(met, first).alias("first_word"), F.when(met, last).alias("last_word"),
        F.when(met, F.array_compact(F.array(*labelled))).otherwise(none).alias("found"), known.alias("known"),
    )
    # Which templates a text has enough words for, wherever they stand.
    enough = lambda some: F.exists(F.array(*[F.size(F.array_intersect(strings(words), F.col("known.word"))) >= need for _, words, need in some]), lambda x: x)
    base = base.withColumn("held", F.when(F.size("known") > 0, F.array(*[enough(some) for some in of_length.values()])))
    base = base.withColumn("known", F.when(F.array_contains("held", True), F.col("known")))
    base = settle(base, "licenses")

    blocks_of = [F.when(F.col("held")[i], blocks_for("known", length, some)).otherwise(F.array().cast(BLOCKS)) for i, (length, some) in enumerate(of_length.items())]
    blocks = base.where("known is not null").select("id", "print", F.inline(F.concat(*blocks_of)))
    counted = {r.token: r.n for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # one row for each word of the templates
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}

    index, rarest = [], set()
    for t, (label, words, need) in enumerate(sets):
        ordered = sorted(words, key=place.__getitem__)
        for i, w in enumerate(ordered[: len(ordered) - need + 1]):
            index.append(f"('{w}', {window(templates[label])}, {t}, {len(ordered) - i}, {need})")
            rarest.add(w)
    index = spark.sql(f"select * from values {', '.join(index)} as x(token, length, template, tail, need)")
    texts = F.array(*[strings(words) for _, words, _ in sets])
    names = strings([label for label, *_ in sets])

    ordered = F.array_intersect(strings(order), F.col("tokens"))  # keeps the order of its first argument
    sorted_blocks = blocks.select("id", "print", "length", "least", ordered.alias("tokens"))
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.col("least") + 1)
    probes = sorted_blocks.where(F.arrays_overlap(prefix, strings(sorted(rarest)))).select("id", "print", "length", "tokens", F.size("tokens").alias("size"), F.posexplode(prefix).alias("at", "token"))
    met = (F.col("size") >= F.col("need")) & (F.col("at") <= F.col("size") - F.col("need")) & (F.least(F.col("tail"), F.col("size") - F.col("at")) >= F.col("need"))
    candidates = probes.join(F.broadcast(index), ["token", "length"]).where(met)
    own = F.element_at(texts, F.col("template") + 1)
    shared = F.size(F.array_intersect(own, F.col("tokens")))
    verified = candidates.select("id", "print", F.element_at(names, F.col("template") + 1).alias("label"), "need", shared.alias("shared"), F.size(own).alias("of")).where("shared >= need")
    matches = verified.groupBy("id", "print").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("of")).alias("best"))

    matches = matches.withColumnsRenamed({"id": "match_id", "print": "match_print"})
    out = base.drop("known", "held").join(matches, base["id"].eqNullSafe(F.col("match_id")) & base["print"].eqNullSafe(F.col("match_print")), "left")
    everything = F.array_sort(F.array_distinct(F.concat("found", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("base_labels"), F.array_join(everything, ",").alias("labels"), score.alias("score"),
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and template notices in every text of ``documents``."""
    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows by brute force: every run of a template's window that begins with one of its words, and every word against every phrase."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    starts = [
        "list_filter(range(1, len(w) + 1), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES
    ]
    sets = template_sets(TEMPLATES, CONTAINMENT)
    rows = ", ".join(f"('{label}', {quoted(words)}, {need}, {window(TEMPLATES[label])})" for label, words, need in sets)
    found = ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, label in enumerate(PHRASES.values()))
    pattern = WORD + "+"
    return f"""
with low as (select doc_id, row_number() over () as r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents),
worded as (select doc_id, r, low, regexp_extract_all(low, '{pattern}') as w from low),
placed as (select doc_id, r, len(w) as n_words, {', '.join(f'{s} as p{k}' for k, s in enumerate(starts))} from worded),
based as (select doc_id, r, n_words, list_concat({', '.join(f'p{k}' for k in range(len(PHRASES)))}) as places,
  list_sort(list_distinct(list_filter([{found}], lambda x: x is not null))) as found from placed),
templates(label, words, need, size) as (values {rows}),
begun as (select r, label, words, need, w[i : i + size - 1] as run from worded join templates on len(list_intersect(w, words)) >= need, unnest(range(1, len(w) + 1)) as u(i) where list_contains(words, w[i])),
matches as (select r, list_distinct(list(label)) as more, max(len(list_intersect(words, run)) / len(words)) as best from begun where len(list_intersect(words, run)) >= need group by r)
select doc_id, cast(n_words as bigint) as n_words, cast(len(places) as bigint) as n_base,
  cast(list_min(places) - 1 as bigint) as first_word, cast(list_max(places) - 1 as bigint) as last_word,
  array_to_string(found, ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(found, coalesce(more, []::varchar[])))), ',') as labels,
  greatest(coalesce(best, 0.0), case when len(places) > 0 then {PHRASE_SCORE} else 0.0 end)::double as score
from based left join matches using (r)
"""
