"""Quality rules against brute force; classifiers by accuracy on labels; the toxicity grammar's parts."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from leafmill.llm import quality as Q
from leafmill.llm import toxicity as X
from leafmill.llm.common import table

BIG = "/root/testdata/sf0.1"


def brute(text):
    words, windows = re.findall(r"[^\x20\x09-\x0D]+", text), {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_rules(spark, sf_dir):
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices(["a ", "b ", "c", "\n", "# ", " ", "é ", "\x0b", "\x1c", " "], k=rng.randint(0, 60)))
        assert Q.rule_counts(text) == brute(text)
    rows = Q.op3_quality_rules(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        counts = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.base_failed and r.kept)


def slow_grams(text):
    """Every n-gram by itself, as the only one of a small text."""
    words, out = re.findall(r"[^\x20\x09-\x0D]+", text), []
    one = lambda t, k: next(int(i[0]) for i in Q.grams(t) if Q.kind(i) == k)
    out += [one(w, 0) for w in words]
    out += [one(f"{a} {b}", 1) for a, b in zip(words, words[1:])]
    return sorted(out + [one(text[i : i + 4], 2) for i in range(len(text) - 3)])


def test_grams_over_blocks(monkeypatch):
    """No gram is lost or cut where blocks end, and each character counts as one."""
    from leafmill.llm import shingles

    rng = random.Random(4)
    texts = ["", "a", "é日 𝄞", "x" * 50, *("".join(rng.choices(["ab", "é", "日", "𝄞", " ", "\n", "z"], k=60)) for _ in range(20))]
    want = [slow_grams(t) for t in texts]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(shingles, "BLOCK_BYTES", size)
        monkeypatch.setattr(Q, "CHARACTERS_AT_ONCE", size)
        assert [sorted(i for part in Q.grams(t) for i in part.tolist()) for t in texts] == want
    assert len(slow_grams("日本日本")) == 1 + 1 and list(Q.grams(None)) == []


def test_model_by_brute_force():
    """Probabilities from single n-grams and their weights; the fit against plain descent on a dense matrix."""
    rng, texts = random.Random(5), ["good fine words here", "bad junk junk", "é fine", "", "a b c d " * 30]
    weights = np.random.default_rng(1).normal(size=Q.SIZE).astype(np.float32)
    model = Q.Model(weights, 0.25, 1.5, -0.5, True)
    for t in texts:
        logit = 0.25
        for k in range(3):
            own = [i for i in slow_grams(t) if i >> Q.BITS == k]
            logit += sum(float(weights[i]) for i in own) / max(1, len(own))
        assert abs(model.probability(t) - 1 / (1 + np.exp(-(1.5 * logit - 0.5)))) < 1e-6
        index, value = Q.sparse(t)
        assert sorted(set(slow_grams(t))) == sorted(index.tolist()) and abs(model.logit(t) - 0.25 - float(weights[index] @ value)) < 1e-4
    rows = [(" ".join(rng.choices(["fine", "good", "the", "of"] if y else ["junk", "spam", "the", "of"], k=20)), y) for y in (0, 1) * 40]
    found = [Q.sparse(t) for t, _ in rows]
    held = np.arange(len(rows)) % 3 == 0
    sample = Q.Sample(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), np.cumsum([0, *[len(i) for i, _ in found]]), np.array([y for _, y in rows]), held)
    fitted = Q.fit(sample, at_once=7)
    dense = np.zeros((len(rows), Q.SIZE))
    for r, (i, v) in enumerate(found):
        dense[r, i] = v
    assert np.allclose(sample.rows(fitted.weights, fitted.bias, 0, len(rows)), dense @ fitted.weights + fitted.bias, atol=1e-4)
    loss = lambda w, b: np.mean(np.logaddexp(0, -(2 * sample.label[~held] - 1) * (dense[~held] @ w + b)))
    assert loss(fitted.weights, fitted.bias) < 0.05 < loss(np.zeros(Q.SIZE), 0.0)
    p = np.array([fitted.probability(t) for t, _ in rows])
    assert ((p > 0.5) == (sample.label == 1)).all()


def test_sample_bounds(spark):
    """Ids labelled both ways are left out, repeated ids give one text, and features stay within their bound."""
    docs = spark.createDataFrame([(i, f"word{i % 2} text " * 20) for i in range(40)] + [(1, "z other")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    from leafmill.llm import common

    known = {r.id: r.quality for r in common.settled_labels(labels, "quality").collect()}
    assert known == {i: i % 2 for i in range(40) if i != 2}
    texts = common.sampled_texts(docs.repartition(3), common.settled_labels(labels, "quality")).collect()
    assert len(texts) == len({r.id for r in texts}) == 39
    assert Q.train(docs, labels).fitted and not Q.train(docs, labels, entries=5).fitted
    again = [Q.train(docs.repartition(n), labels.repartition(n)) for n in (1, 4)]
    assert (again[0].weights == again[1].weights).all() and again[0][1:] == again[1][1:]


def test_quality_accuracy(spark):
    """Trained on two thirds of the labels, the model tells the rest apart and is calibrated."""
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    model = Q.train(docs, labels.where("doc_id % 3 > 0"))
    rows = Q.judge(docs.join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id"), ["quality"], "text", model).where("not base_failed").collect()
    right = [r.kept == (r.quality == 1) for r in rows]
    assert sum(right) / len(right) > 0.97
    p, y = np.array([r.quality_score for r in rows]), np.array([r.quality for r in rows])
    assert abs(p.mean() - y.mean()) < 0.05


def test_quality_without_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = Q.train(docs, table(spark, sf_dir, "labels").limit(0))
    assert not model.fitted
    assert Q.judge(docs, ["doc_id"], "text", model).where("kept = base_failed").count() == 0


LEXICON = X.Lexicon({"idiot": 4.0}, {"lowei": 4.0})


@pytest.mark.parametrize(
    ("less", "more"),
    [
        ("he is not an idiot", "he is an idiot"), ("the idiot left", "you idiot left"), ('they said "an idiot"', "an idiot"), ("an idiot", "idiot, you"),
        ("nothing here", "an idiot"), ("an idiot", "an idiot. an idiot"), ("i will kill time", "i will kill you"), ("he killed them", "i will kill them"), ("this soap will kill germs", "this man will kill you"), ("they will beat them", "we will beat you"),
        ("i do not want to hurt you", "i want to hurt you"), ("he is not a son of a bitch", "he is a son of a bitch"), ("idiot", "you are such an idiot"), ("a piece of cake", "a piece of shit"), ("go kill time", "kill yourself"),
        ("die sonne wird scheinen", "du wirst es bereuen, du wird sterben"), ("ich werde schlagen", "ich werde dich schlagen"), ("voy a matar el tiempo", "voy a matarte"), ("voy a matar el tiempo", "te voy a matar"), ("viscidiot idiotic", "idiot"), ("lowei", "loweiig"),
    ],
)
def test_grammar(less, more):
    s = X.Scorer(LEXICON)
    assert sum(s.clauses(less)) < sum(s.clauses(more))


def clause_by_hand(scorer, text):
    """A clause's weight from its symbols, rule by rule, without automata."""
    symbols = [(s, w) for word in X.WORD.findall(text) for found, w in [scorer.symbols(word)] for s in found]

    def ends(tape, x, j):
        """Whether a match of pattern ``x`` ends at ``j``."""
        def back(step, at):
            if tape[at] not in x.steps[step]:
                return False
            if not step:
                return not x.begins or at == 0
            return any(back(step - 1, at - 1 - g) for g in range(x.gap + 1) if at - 1 - g >= 0)

        return back(len(x.steps) - 1, j)

    tape, factors = [s for s, _ in symbols], [1.0] * len(symbols)
    for machine in (X.insults(), X.threats()):
        found = [max((x for x in machine.patterns if ends(tape, x, j)), key=lambda x: x.rank(), default=None) for j in range(len(tape))]
        tape, factors = [x.out if x else s for s, x in zip(tape, found)], [f * x.weight if x else f for f, x in zip(factors, found)]
    total = 0.0
    for j, s in enumerate(tape):
        before = lambda n: tape[max(0, j - n) : j]
        if s in X.MATCHES:
            weight = symbols[j][1] * factors[j]
            weight *= X.NEGATED if "n" in before(3 if s in "if" else 6) else 1
            weight *= X.REPORTED if {"r", "q"} & set(tape[:j]) else 1
            weight *= X.TARGETED if s in "ip" and {"u", "g"} & set(before(4)) else 1
            total += weight
        elif s in "ug":
            last = max((i for i in range(j) if tape[i] in X.MATCHES), default=None)
            total += X.TARGET_AFTER if last is not None and j - last <= 3 else 0
    return total


def test_clauses_by_brute_force():
    """Random clauses of the grammar's words weigh what the rules say, one by one."""
    rng, s = random.Random(9), X.Scorer(LEXICON)
    words = ["idiot", "you", "him", "i", "will", "kill", "not", "said", "are", "a", "the", "regret", "matarte", "te", "voy", "i'll", "you're", '"', "o", "x", "waste", "of", "space", "son", "bitch", "loweiig", "don't", "schlagen", "werde", "dich"]
    heavy = 0
    for _ in range(6000):
        text = " ".join(rng.choices(words, k=rng.randint(1, 12)))
        assert abs(s.clause(text) - clause_by_hand(s, text)) < 1e-9, text
        heavy += s.clause(text) > 0
    assert 1000 < heavy < 6000


def test_cascade_forgets(monkeypatch):
    """Results don't depend on the moves that are kept."""
    monkeypatch.setattr(X.Cascade, "MOST", 3)
    small = X.Scorer(LEXICON)
    monkeypatch.undo()
    for text in ("i will not kill you", "you are such an idiot", "he said you idiot", "waste of space"):
        assert small.clause(text) == X.Scorer(LEXICON).clause(text) > 0


def test_scope_of_marks():
    s = X.Scorer(LEXICON)
    assert s.clauses("not now. idiot") == s.clauses("well now. idiot")  # a clause ends a negation
    assert s.clauses("he said so. idiot") == s.clauses("he did so. idiot")
    assert sum(s.clauses("not one two three idiot")) == sum(s.clauses("well one two three idiot"))  # it reaches three words
    assert s.clauses(None) == s.clauses("") == []


def test_composition():
    from leafmill.llm.wfst import Arc, latch, window

    a, b = window("n", 2, {"i": Arc(0, "i", 0.5)}), latch("r", {"i": Arc(1, "i", 0.25)})
    both = a.compose(b, "oinr")
    state, weights = 0, []
    for symbol in "inirooi":
        state, out, weight = both.step(state, symbol)
        weights.append(weight)
    assert weights == [1.0, 1.0, 0.5, 1.0, 1.0, 1.0, 0.25]


def test_toxicity_held_out(spark):
    """English insults of held-out rows are found, their clean rows left alone."""
    r = X.op9_toxicity(spark, BIG).join(table(spark, BIG, "labels"), "doc_id").join(table(spark, BIG, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    rows = r.select("toxic", "predicted", "lang", "score").collect()
    english = [x for x in rows if x.lang == "en"]
    hit = [x.predicted for x in english if x.toxic == 1]
    wrong = [x.predicted for x in english if x.toxic == 0]
    assert len(hit) > 30 and sum(hit) / len(hit) > 0.9 and sum(wrong) / len(wrong) < 0.02
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)


def test_toxicity_ignores_held_out_labels(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.train(docs, labels) == X.train(docs, flipped)
    empty = X.train(docs, labels.limit(0))
    assert "idiot" in empty.lexicon.words and not empty.lexicon.stems
