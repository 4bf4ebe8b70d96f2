"""Checkpointed work on pages: batches are claimed, worked on and recorded in commits, so that a run can end anywhere and go on.

Pages and artifacts stand in a ledger.  Each round claims the next pages of every job, commits the claims, works on them,
and commits outcomes and artifacts together.  What was claimed but not recorded is given out again under
the same attempt.  Rounds are counted in the ledger, so a budget holds over all runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commits import Ledger, Version
from ..sources.staging import staged

PAGES = "job_id string, page int, state string, n int"
# Bounds; fixed values.
MOST_TASKS, MOST_ATTEMPTS, ROUNDS_PER_RUN, MOST_ROUNDS = 64, 3, 50, 3_000


class Conflict(RuntimeError):
    """Another writer was first; nothing of this round is seen, and it can be tried again."""


class Ended(NamedTuple):
    """How a run ended: idle (nothing left), continue (go on with another run) or iteration_limit; with the counts so far."""

    reason: str
    rounds: int
    runs: int


def begin(ledger: Ledger, jobs: DataFrame) -> Version:
    """Pages of ``jobs`` (``job_id``, ``pages``), all pending; an existing ledger stays as it is."""
    head = ledger.head()
    if "pages" in head.tables:
        return head
    pages = jobs.select("job_id", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"), F.lit("pending").alias("state"), F.lit(0).alias("n"))
    return committed(ledger.commit(head, replace={"pages": pages}, notes={"rounds": 0, "runs": 0}))


def committed(version: Version | None) -> Version:
    if version is None:
        raise Conflict("another writer was first")
    return version


def claimed(pages: DataFrame, most: int) -> DataFrame:
    """Pages with the first ``most`` open ones of each job running (pending ones in their next attempt); ``task`` says which."""
    open_ = F.col("state").isin("pending", "running")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.when(open_, 0).otherwise(1), "page"))
    p = pages.withColumn("task", open_ & (place <= most))
    fresh = F.col("task") & (F.col("state") == "pending")
    return p.withColumns({"n": F.when(fresh, F.col("n") + 1).otherwise(F.col("n")), "state": F.when(fresh, "running").otherwise(F.col("state"))})


def after(outcome: Column, n: Column, most: int) -> Column:
    """State of a running page after an outcome: success, permanent_failure or another failure."""
    return F.when(outcome == "success", "succeeded").when(outcome == "permanent_failure", "permanently_failed").when(n >= most, "exhausted").otherwise("pending")


def recorded(pages: DataFrame, outcomes: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Pages after ``outcomes`` (job_id, page, attempt, outcome); those of another attempt than the running one are stale, and of several the least counts."""
    o = outcomes.groupBy("job_id", "page", F.col("attempt").alias("n")).agg(F.min("outcome").alias("outcome")).withColumn("state", F.lit("running"))
    j = pages.join(o, ["job_id", "page", "n", "state"], "left")
    return j.select("job_id", "page", F.when(F.col("outcome").isNotNull(), after(F.col("outcome"), F.col("n"), most)).otherwise(F.col("state")).alias("state"), "n")


def statuses(pages: DataFrame) -> DataFrame:
    """Status and succeeded pages of each job."""
    open_, good = F.bool_or(F.col("state").isin("pending", "running")), F.bool_and(F.col("state") == "succeeded")
    return pages.groupBy("job_id").agg(F.when(good, "completed").when(open_, "running").otherwise("partial").alias("status"), F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.sum("n").alias("attempts"))


def run(
    ledger: Ledger, work: Callable[[DataFrame], DataFrame], batch: int = 8, rounds: int = ROUNDS_PER_RUN, most_rounds: int = MOST_ROUNDS, most_attempts: int = MOST_ATTEMPTS,
) -> Ended:
    """Work on pages until none is open or this run's ``rounds`` are used up.

    ``work`` takes tasks (job_id, page, attempt) and returns them with ``outcome`` and ``artifact``.
    """
    if not 1 <= batch <= MOST_TASKS:
        raise ValueError("a round takes 1 to 64 pages of a job")
    head = ledger.head()
    head = committed(ledger.commit(head, notes={"runs": head.notes["runs"] + 1}))
    for _ in range(rounds):
        if ledger.table("pages", head).where("state in ('pending', 'running')").isEmpty():
            return Ended("idle", head.notes["rounds"], head.notes["runs"])
        if head.notes["rounds"] >= most_rounds:
            return Ended("iteration_limit", head.notes["rounds"], head.notes["runs"])
        head = round_(ledger, head, work, batch, most_attempts)
    done = ledger.table("pages", head).where("state in ('pending', 'running')").isEmpty()
    return Ended("idle" if done else "continue", head.notes["rounds"], head.notes["runs"])


def round_(ledger: Ledger, head: Version, work: Callable[[DataFrame], DataFrame], batch: int, most_attempts: int) -> Version:
    """One round: claims in one commit, outcomes with their artifacts in the next."""
    head = committed(ledger.commit(head, replace={"pages": claimed(ledger.table("pages", head), batch)}))
    pages = ledger.table("pages", head)
    tasks = pages.where("task").select("job_id", "page", F.col("n").alias("attempt"))
    outcomes = staged(work(tasks), "outcomes")
    artifacts = outcomes.where("outcome = 'success'").select("job_id", "page", "attempt", "artifact")
    return committed(ledger.commit(head, replace={"pages": recorded(pages.drop("task"), outcomes, most_attempts)}, append={"artifacts": artifacts}, notes={"rounds": head.notes["rounds"] + 1}))


Change = tuple[Mapping[str, DataFrame], Mapping[str, DataFrame]]


def once_each(ledger: Ledger, name: str, change: Callable[[DataFrame, Version], Change]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function whose every batch changes the ledger once.

    The number of the last batch of stream ``name`` is committed with its change, so
    a batch that is replayed after a failure finds itself done.  ``change`` returns the tables to replace and the rows to append.
    """

    def apply(batch: DataFrame, number: int) -> None:
        head = ledger.head()
        if head.notes.get(f"batch of {name}", -1) < number:
            replace, append = change(batch, head)
            committed(ledger.commit(head, replace, append, {f"batch of {name}": number}))

    return apply


def loop(ledger: Ledger, work: Callable[[DataFrame], DataFrame], **bounds: int) -> Ended:
    """Runs one after another until nothing is open or all rounds are used up."""
    while (ended := run(ledger, work, **bounds)).reason == "continue":
        pass
    return ended


def new_ledger(spark: SparkSession, label: str) -> Ledger:
    """A ledger in a new folder of the one that executors share."""
    import uuid

    from ..sources.staging import shared_folder

    return Ledger(spark, f"{shared_folder(spark)}/leafmill/{label}-{uuid.uuid4().hex}")
