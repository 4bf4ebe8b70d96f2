"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, harm, harm and target in one, misfortune, target
(addressed or not), speaker, intent, copula, article or intensifier, negation, report, quotation mark,
words of phrases, other.  Five transducers, each fed by the one before, run over
each clause that holds an insult, a phrase's word, a harm or a misfortune:

* insults: of several words, and insults said of someone ("you are such a ...");
* threats: harm with an intent and a target ("we will hurt you", "ich werde dich
  schlagen"), orders to harm, misfortune wished on a target.  Harm without such a
  frame ("this soap will kill germs", "he killed time") weighs nothing;
* negation: one shortly before lowers a match's weight;
* reported speech: a report or an opening quotation mark before lowers it to the
  clause's end;
* targets: one shortly before raises it, one shortly after adds to the clause.

A document's score is a logistic function of its clauses' weights.

Insults and their weights come from a fixed list and from labelled rows: words,
and stems with several endings, that occur in many different contexts of toxic
rows and hardly ever in others.  Contexts are counted, not documents, so copies
of a document don't count as many.

At most about ``TRAIN_ROWS`` labelled rows are used; all rows are scored, whole.

Cases: null and empty texts get the score of a text without such clauses; rows
with a null id count as not held out; without labels the fixed list alone is
used; equal texts have equal scores; rows may repeat.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_text, map_text, sampled_texts, settled_labels, table
from .wfst import Arc, Cascade, Matcher, Pattern, latch, window

#: Bound of the labelled rows that the lexicon and the calibration are learned from.
TRAIN_ROWS = 20_000
#: Contexts and word endings that a learned word or stem needs, and the least weight (log odds).
LEAST_CONTEXTS, LEAST_FORMS, LEAST_WEIGHT = 6, 3, 2.5
STEMS = range(4, 9)
THRESHOLD = 0.3

# Word lists of the grammar; fixed values.
INSULTS = "idiot idiots moron morons stupid scum loser losers trash worthless pathetic clown clowns disgusting dumb fool imbecile jerk bastard dumm dummkopf idioten abschaum arschloch trottel crétin imbécile connard débile ordure estúpido imbécil basura escoria payaso".split()
HARM = "kill murder hurt destroy strangle stab shoot beat crush smash töten umbringen verprügeln schlagen erschießen tuer frapper détruire égorger matar golpear destruir".split()
HARM_TARGET = "matarte matarlo matarla golpearte golpearlo destruirte destruirlo".split()
MISFORTUNE = "regret bleed perish suffer bereuen sterben verrecken bluten regretter mourir crever saigner morir sangrar arrepentirte".split()
ADDRESSED = "you your yours yourself yourselves du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú usted ustedes".split()
TARGETS = "he she they them him her his their sie er il elle él ella".split()
SPEAKERS = "i we ich wir je nous yo nosotros".split()
INTENTS = "will shall gonna going want must should werden wird soll vas va".split()
COPULAS = "are is re was were bist seid ist es êtes est eres sos".split()
INTENSIFIERS = "a an the such total complete absolute utter real ein eine so echt un une vrai una tan todo".split()
NEGATIONS = "not no never neither nor nobody isn't aren't wasn't don't won't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says wrote writes quoted quote quotes called reported claims claimed sagte schrieb zitierte nannte dit écrit cité appelé dijo escribió citó llamó".split()
#: Words that stand for several symbols.
CONTRACTIONS = {
    "i'll": "sm", "we'll": "sm", "i'm": "sc", "we're": "sc", "you'll": "um", "he'll": "gm", "she'll": "gm", "they'll": "gm", "you're": "uc", "he's": "gc", "she's": "gc", "they're": "gc",
    "werde": "sm", "vais": "sm", "allons": "sm", "voy": "sm", "vamos": "sm", "quiero": "sm",
}
#: Insults of several words, none of which need be one by itself.
PHRASES = ["waste of space", "piece of shit", "son of a bitch", "good for nothing", "drop dead", "go to hell", "stück scheiße", "fils de pute", "sac à merde", "hijo de puta", "pedazo de mierda"]

CLASSES = {w: s for s, words in (("a", INTENSIFIERS), ("c", COPULAS), ("m", INTENTS), ("s", SPEAKERS), ("u", ADDRESSED), ("g", TARGETS), ("n", NEGATIONS), ("r", REPORTS), ("d", MISFORTUNE), ("k", HARM), ("e", HARM_TARGET)) for w in words}
#: Each word of a phrase that has no class is a symbol of its own.
PHRASE_SYMBOLS = {w: chr(0xE000 + i) for i, w in enumerate(sorted({w for p in PHRASES for w in p.split()} - CLASSES.keys()))}

#: Matches: insult, insult said of someone, insult of several words, threat.
MATCHES = "ifpt"
ALPHABET = [*MATCHES, *"qo", *sorted({*CLASSES.values(), *PHRASE_SYMBOLS.values()})]
#: Weights of matches without learned weight; factors of the grammar.
SEED_WEIGHT, PHRASE_WEIGHT = 4.0, 4.0
THREAT, LIKELY_THREAT, POSSIBLE_THREAT = 4.0, 3.0, 1.5
FRAMED, NEGATED, REPORTED, TARGETED, TARGET_AFTER = 1.25, 0.35, 0.5, 1.25, 0.5


def insults() -> Matcher:
    """Insults of several words, and insults with a target and a copula before them."""
    symbol = lambda w: CLASSES.get(w) or PHRASE_SYMBOLS[w]
    phrases = [Pattern(tuple(map(symbol, p.split())), 0, "p", PHRASE_WEIGHT) for p in PHRASES]
    return Matcher([*phrases, Pattern(("ug", "c", "i"), 3, "f", FRAMED)])


def threats() -> Matcher:
    """Harm and misfortune in the frames that make them a threat, in the orders of words of several languages."""
    return Matcher([
        Pattern(("s", "m", "k", "ug"), 2, "t", THREAT), Pattern(("s", "m", "ug", "k"), 2, "t", THREAT), Pattern(("u", "s", "m", "k"), 2, "t", THREAT), Pattern(("m", "e"), 2, "t", THREAT),
        Pattern(("m", "k", "u"), 2, "t", LIKELY_THREAT), Pattern(("m", "k", "g"), 2, "t", POSSIBLE_THREAT), Pattern(("k", "ug"), 0, "t", LIKELY_THREAT, begins=True), Pattern(("u", "m", "d"), 1, "t", LIKELY_THREAT),
    ])


def grammar() -> Cascade:
    """Insults, threats, negation, reported speech and targets composed; put out matches with their factors and ``+`` for a target after them."""
    near = window("n", 3, {s: Arc(0, s, NEGATED) for s in "if"})
    far = window("n", 6, {s: Arc(0, s, NEGATED) for s in "pt"})  # these matches end some words after they begin
    report = latch("rq", {s: Arc(1, s, REPORTED) for s in MATCHES})
    target = window("ug", 4, {s: Arc(0, s, TARGETED) for s in "ip"})
    after = window(MATCHES, 3, {s: Arc(0, "+", 1.0) for s in "ug"})
    context = near.compose(far, ALPHABET).compose(report, ALPHABET).compose(target, ALPHABET).compose(after, ALPHABET)
    return Cascade(insults(), threats(), context)


class Lexicon(NamedTuple):
    """Insults with their weights, and stems (any ending) with theirs."""

    words: dict[str, float]
    stems: dict[str, float]


class Calibration(NamedTuple):
    """Log odds: ``bias + total * log1p(sum of clause weights) + top * the largest``."""

    bias: float
    total: float
    top: float


WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»„]")
CLAUSE = re.compile(r"[.!?;\n]+")


class Scorer:
    """Clause weights of texts; one for a worker."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.machine = lexicon, grammar()
        self.find = ahocorasick.Automaton()
        for w in {*lexicon.words, *lexicon.stems, *HARM, *HARM_TARGET, *MISFORTUNE, *(max(p.split(), key=len) for p in PHRASES)}:
            self.find.add_word(w, w)
        self.find.make_automaton()

    def symbols(self, word: str) -> tuple[str, float]:
        """The symbols that a word stands for, and its weight as an insult."""
        if (weight := self.lexicon.words.get(word)) is not None:
            return "i", weight
        for n in STEMS:
            if (weight := self.lexicon.stems.get(word[:n])) is not None and len(word) > n:
                return "i", weight
        found = CLASSES.get(word) or PHRASE_SYMBOLS.get(word) or CONTRACTIONS.get(word)
        return found or ("q" if word in '"“”«»„' else "o"), 1.0

    def clause(self, text: str) -> float:
        """Weight of one clause, by one pass of the composed transducers."""
        state, total = self.machine.start, 0.0
        for word in WORD.findall(text):
            symbols, weight = self.symbols(word)
            for symbol in symbols:
                state, out, factor = self.machine.step(state, symbol)
                total += weight * factor if out in MATCHES else TARGET_AFTER if out == "+" else 0.0
        return total

    def clauses(self, text: str | None) -> list[float]:
        """Weights of the clauses with a match; only those that hold a word one can't do without are read."""
        if not text:
            return []
        low = text.lower()
        hits = [end - len(w) + 1 for end, w in self.find.iter(low) if end < len(w) or not low[end - len(w)].isalnum()]
        if not hits:
            return []
        found, begin, i = [], 0, 0
        hits.sort()
        for m in [*CLAUSE.finditer(low), None]:
            end = m.start() if m else len(low)
            if i < len(hits) and hits[i] < end:
                found.append(self.clause(low[begin:end]))
                while i < len(hits) and hits[i] < end:
                    i += 1
            begin = m.end() if m else end
        return [w for w in found if w]


def features(weights: list[float]) -> tuple[float, float]:
    return math.log1p(sum(weights)), max(weights, default=0.0)


def probability(weights: list[float], c: Calibration) -> float:
    a, b = features(weights)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c.bias + c.total * a + c.top * b))))


# -- learning ----------------------------------------------------------------


def fold(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` labelled documents (all, if fewer) whose crc32 remainder is not 2, by hash of their id: ``id``, ``text``, ``toxic``."""
    usable = settled_labels(labels, "toxic").where(F.crc32(F.col("id").cast("string")) % 4 != 2)
    part = min(1.0, rows / max(1, usable.count()))
    usable = usable.where(fold(F.col("id"), 1_000_003) < int(part * 1_000_003) + 1)
    return sampled_texts(docs, usable)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems of toxic rows by contexts, weighed by log odds of documents."""
    schema = T.StructType([T.StructField(n, k()) for n, k in (("term", T.StringType), ("stem", T.BooleanType), ("form", T.StringType), ("context", T.LongType))])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, seen = WORD.findall((text or "").lower()), set()
                for before, w in zip(["", *words], words):
                    context = crc32(before.encode())
                    seen.add((w, False, w, context))
                    seen |= {(w[:n], True, w, context) for n in STEMS if n < len(w)}
                columns = list(zip(*seen)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.int64()))], names=schema.names)

    toxic = rows.where("toxic = 1")
    found = toxic.select("text").mapInArrow(occurrences, schema).groupBy("term", "stem").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("form").alias("forms"))
    found = found.where((F.col("contexts") >= LEAST_CONTEXTS) & (~F.col("stem") | (F.col("forms") >= LEAST_FORMS)))
    terms = {(r.term, r.stem) for r in found.select("term", "stem").collect()}

    counts = T.StructType([T.StructField("term", T.StringType()), T.StructField("stem", T.BooleanType()), T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall((text or "").lower()))
                held = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if n < len(w)}
                total.update((t, s, int(y)) for t, s in held & terms)
                total["", False, int(y)] += 1
        columns = list(zip(*((*k, n) for k, n in total.items()))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int32(), pa.int64()))], names=counts.names)

    n: dict[tuple, int] = {}
    for r in rows.select("text", F.col("toxic").cast("int")).mapInArrow(count, counts).groupBy("term", "stem", "toxic").agg(F.sum("n").alias("n")).collect():
        n[r.term, r.stem, r.toxic] = r.n
    bad, good = n.get(("", False, 1), 0), n.get(("", False, 0), 0)
    weigh = lambda t, s: math.log((n.get((t, s, 1), 0) + 0.5) / (bad + 1)) - math.log((n.get((t, s, 0), 0) + 0.5) / (good + 1))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for term, stem in sorted(terms, key=lambda x: (len(x[0]), x)):
        weight = weigh(term, stem)
        shorter = max((stems[term[:k]] for k in STEMS if term[:k] in stems), default=0.0)
        if weight >= LEAST_WEIGHT and weight > 1.2 * shorter:
            (stems if stem else words)[term] = weight
    for w in INSULTS:  # what the labels speak against is no insult here
        if w not in words and (weight := SEED_WEIGHT if not (n.get((w, False, 0), 0) or n.get((w, False, 1), 0)) else weigh(w, False)) > 0.5:
            words[w] = weight
    return Lexicon(words, stems)


def calibrate(weights: list[list[float]], toxic: list[int]) -> Calibration:
    """Logistic regression on the two features by Newton's method, lightly regularised."""
    x = np.array([(1.0, *features(w)) for w in weights]).reshape(-1, 3)
    y = np.array(toxic, float)
    if len(y) < 20 or y.min() == y.max():
        return Calibration(-3.0, 2.0, 0.3)
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return Calibration(*map(float, beta))


class Model(NamedTuple):
    lexicon: Lexicon
    calibration: Calibration


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon from two thirds of the training rows, calibration from the other third (from all, if there are few)."""
    found = training_rows(docs, labels, rows)
    third = fold(F.concat(F.lit("third"), F.col("id").cast("string")), 3) == 0
    lexicon = learn_lexicon(found.where(~third))

    def start():
        scorer = Scorer(lexicon)
        return lambda texts: [list(map(scorer.clauses, texts))]

    weighed = map_text(found.withColumn("apart", third), start, "text", ["toxic", "apart"], T.StructType([T.StructField("weights", T.ArrayType(T.DoubleType()))]))
    held = weighed.collect()  # clause weights of the bounded sample
    apart = [r for r in held if r.apart]
    if sum(r.toxic for r in apart) < 20:
        apart = held
    return Model(lexicon, calibrate([r.weights for r in apart], [int(r.toxic) for r in apart]))


# -- scoring -----------------------------------------------------------------

SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_clauses", T.IntegerType())])


def score_texts(df: DataFrame, keep: list[str], text_col: str, model: Model) -> DataFrame:
    """Score and number of matched clauses of each text."""

    def start():
        scorer = Scorer(model.lexicon)

        def work(texts):
            found = list(map(scorer.clauses, texts))
            return [probability(w, model.calibration) for w in found], list(map(len, found))

        return work

    return map_text(df, start, text_col, keep, SCORE)


def drop_toxic(df: DataFrame, text_col: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose texts score below ``threshold``, with all their columns."""

    def start():
        scorer = Scorer(model.lexicon)
        return lambda texts: [probability(scorer.clauses(t), model.calibration) < threshold for t in texts]

    return filter_text(df, start, text_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored; learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = score_texts(docs, ["doc_id"], "text", model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")
