"""Evaluation: error rates of texts, field scores, benchmark reports, percentiles by nearest rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import staged

#: Bounds before any distance is computed: units of a text, cells of a table.
MOST_UNITS, MOST_CELLS = 1_000_000, 100_000_000
STATUSES = ["completed", "partial", "review_required", "failed", "cancelled"]


def evaluate_text(pairs: DataFrame, reference: str, candidate: str, most_units: int = MOST_UNITS, most_cells: int = MOST_CELLS) -> DataFrame:
    """Edits, units and rates of characters and words for each pair; pairs beyond the bounds get ``limit`` and no work."""
    r, c = X.nfc(F.coalesce(reference, F.lit(""))), X.nfc(F.coalesce(candidate, F.lit("")))
    made = pairs.withColumns({"__r": r, "__c": c})
    units = {"char_units": F.length("__r").cast("long"), "word_units": F.size(X.words(F.col("__r"))).cast("long")}
    made = made.withColumns(units | {"__n": F.greatest(F.length("__r"), F.length("__c")).cast("long"), "__cells": F.length("__r").cast("long") * F.length("__c")})
    over = F.when(F.col("__n") > most_units, "units").when(F.col("__cells") > most_cells, "work")
    made = made.withColumn("limit", over)
    # Bound texts before the batches: functions in Python aren't skipped by a condition.
    short = lambda c: F.when(F.col("limit").isNull(), F.col(c)).otherwise("")
    made = made.withColumns({"__r": short("__r"), "__c": short("__c")})
    made = made.withColumns({"char_edits": X.char_edits(F.col("__r"), F.col("__c")), "word_edits": X.word_edits(F.col("__r"), F.col("__c"))})
    made = made.withColumns({k: F.when(F.col("limit").isNull(), F.col(k)) for k in ("char_edits", "word_edits")})
    rates = {"char_error_rate": X.rate(F.col("char_edits"), F.col("char_units")), "word_error_rate": X.rate(F.col("word_edits"), F.col("word_units"))}
    return made.withColumns(rates).drop("__r", "__c", "__n", "__cells")


def corpus_rates(scored: DataFrame, *keys: str) -> DataFrame:
    """Error rates of a corpus: all edits by all units, not the mean of rates."""
    sums = scored.groupBy(*keys).agg(*[F.sum(f"{k}_{x}").alias(f"{k}_{x}") for k in ("char", "word") for x in ("edits", "units")])
    return sums.withColumns({f"{k}_error_rate": X.rate(F.col(f"{k}_edits"), F.col(f"{k}_units")) for k in ("char", "word")})


def nearest_rank(value: str, percent: int) -> Column:
    """Aggregate: ``sorted[ceil(n * percent / 100) - 1]``."""
    return F.expr(f"percentile_disc({percent / 100}) within group (order by {value})")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, percents: list[int], accuracy: int = 10_000) -> DataFrame:
    """:func:`nearest_rank` of groups of any size, as columns ``n`` and ``p50`` and so on, without a task that holds a group.

    A first pass brackets each rank between two values by a mergeable summary, whose ranks are off by n / ``accuracy`` at most; a
    second one counts the rows below the bracket and those at each value within it, and the rank is found among these few.
    """
    off, v = 3 / accuracy, F.col(value)
    ends = [F.struct(F.lit(p).alias("percent"), *[F.percentile_approx(v, min(1.0, max(0.0, p / 100 + d)), accuracy).alias(c) for c, d in (("low", -off), ("high", off))]) for p in percents]
    bounds = df.groupBy(*keys).agg(F.count(v).alias("n"), F.array(*ends).alias("ends"))
    # Written, so that Spark knows its size and moves the rows only if it is large.
    bounds = staged(bounds.select(*[F.col(k).alias(f"of_{k}") for k in keys], "n", F.inline("ends")), "brackets")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    rows = df.where(v.isNotNull()).select(*keys, v.alias("v")).join(bounds, same).where(F.col("v") <= F.col("high"))
    # Rows below count as one value, null, which comes first.
    counted = rows.groupBy(*keys, "percent", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*keys, "percent").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.ceil(F.col("n") * F.col("percent") / 100)
    found = counted.withColumn("upto", upto).where(F.col("v").isNotNull() & (F.col("upto") >= rank))
    return found.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("percent") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def reliability(df: DataFrame, confidence: str, correct: str, *keys: str, bins: int = 10) -> DataFrame:
    """For each bin of confidence: rows, mean confidence, the part that is correct, and what the bin adds to the calibration error of its ``keys``."""
    number = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    right = F.when(F.col(correct), 1.0).otherwise(0.0)
    judged = df.where(F.col(confidence).between(0, 1) & F.col(correct).isNotNull())
    g = judged.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(right).alias("accuracy"))
    whole = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return g.withColumn("error", F.col("n") / whole * F.abs(F.col("mean_confidence") - F.col("accuracy")))


def calibration_error(df: DataFrame, confidence: str, correct: str, *keys: str, bins: int = 10) -> DataFrame:
    """Expected and greatest calibration error, with the rows behind them."""
    r = reliability(df, confidence, correct, *keys, bins=bins)
    return r.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("error").alias("expected_error"), F.max(F.abs(F.col("mean_confidence") - F.col("accuracy"))).alias("greatest_error"))


def value_outcome(expected: Column, found: Column) -> Column:
    """Of an expected and a found scalar (as strings): missing, correct (numbers within 0.01) or wrong."""
    a, b = expected.try_cast("double"), found.try_cast("double")
    same = F.coalesce(F.abs(a - b) <= 0.01, expected == found)
    return F.when(found.isNull(), "missing").when(same, "correct").otherwise("wrong")


def field_scores(expected: DataFrame, found: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """Correct, missing and wrong fields of each case; fields nobody expects don't count."""
    got = found.select(*keys, field, F.col(value).alias("found_value"))
    joined = expected.join(got, [*keys, field], "left").withColumn("outcome", value_outcome(F.col(value), F.col("found_value")))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("expected_fields"), *[F.count_if(F.col("outcome") == o).alias(f"{o}_fields") for o in ("correct", "missing", "wrong")]
    )


def run_problems(manifest: DataFrame, samples: DataFrame) -> DataFrame:
    """Why a run can't be scored: samples (``id``, ``sha256``, ``status``) held against the manifest (``id``, ``sha256``); no rows if it can."""
    s = samples.groupBy("id").agg(F.count("*").alias("n"), F.min("sha256").alias("sample_digest"), F.bool_and(F.coalesce(F.col("status").isin(STATUSES), F.lit(False))).alias("known"))
    m = manifest.groupBy("id").agg(F.count("*").alias("m"), F.min("sha256").alias("digest"))
    j = m.join(s, "id", "full_outer")
    why = (
        F.when(F.col("m").isNull(), "not_in_manifest").when(F.col("n").isNull(), "no_sample").when((F.col("m") > 1) | (F.col("n") > 1), "duplicate")
        .when(~F.coalesce(F.col("digest") == F.col("sample_digest"), F.lit(False)), "digest").when(~F.col("known"), "status")
    )
    return j.select("id", why.alias("problem")).where("problem is not null")


def score_benchmark(manifest: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for each case and one summary row with p50 and p95 of the elapsed time; raises if the run doesn't fit the manifest.

    manifest: id, sha256, reference_text, expected_fields map<string,string>;
    samples: id, sha256, status, elapsed_ms, text, fields map<string,string>.
    """
    problem = run_problems(manifest, samples).first()
    if problem is not None or manifest.isEmpty():
        raise ValueError(f"the run doesn't fit the manifest: {problem}")
    both = manifest.join(samples.select("id", "status", "elapsed_ms", "text", "fields"), "id")
    rates = evaluate_text(both, "reference_text", "text", most_cells=10_000_000).select("id", "status", "elapsed_ms", "char_error_rate", "word_error_rate")
    expected = manifest.select("id", F.explode("expected_fields").alias("field", "value"))
    found = samples.select("id", F.explode("fields").alias("field", "value"))
    counts = field_scores(expected, found, ["id"], "field", "value")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("expected_fields", "correct_fields", "missing_fields", "wrong_fields")}
    cases = rates.join(counts, "id", "left").withColumns(zero)
    summary = cases.agg(F.lit(X.NORMALISATION).alias("normalization_policy"), nearest_rank("elapsed_ms", 50).cast("long").alias("p50_ms"), nearest_rank("elapsed_ms", 95).cast("long").alias("p95_ms"))
    return cases, summary


def cohorts(facts: DataFrame, by: list[str], truth: str, auto: str) -> DataFrame:
    """Cohort metrics over a roll-up of ``by``: rows, review truth, and accepted rows that needed review (an extension)."""
    return facts.rollup(*by).agg(
        F.count("*").alias("documents"), F.count_if(F.col(truth)).alias("needs_review"), F.count_if(F.col(auto) & F.col(truth)).alias("unsafe_accepted"),
        *[F.grouping(c).cast("int").alias(f"all_{c}") for c in by],
    )
