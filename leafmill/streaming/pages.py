"""Page workflows as a stateful stream: each job's pages move through their states as outcomes arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .together import by_group

EVENTS = "job_id string, kind string, page int, attempt int, pages int, at timestamp"
OUTPUT = "job_id string, kind string, page int, accepted boolean, status string, succeeded int"
STATE = "pages array<struct<state:string,n:int>>, cancelled boolean"
OUTCOME = Row("job_id", "kind", "page", "accepted", "status", "succeeded")
#: Jobs whose identifiers differ in this many last characters only have their state kept together; in all there are so many groups at most.
NEIGHBOURS, GROUPS = 2, 1 << 16
DONE = {"succeeded", "exhausted", "permanently_failed"}


def move(progress: tuple[str, int], kind: str, attempt: int, most: int) -> tuple[str, int] | None:
    """The page's next state and count, or None for a stale event."""
    state, n = progress
    if kind == "claim":
        return ("running", n) if state == "running" else ("running", n + 1) if state == "pending" else None
    if state != "running" or n != attempt:
        return None
    if kind == "success":
        return "succeeded", n
    if kind == "permanent_failure":
        return "permanently_failed", n
    return ("exhausted", n) if n == most else ("pending", n)


def status(cancelled: bool, states: list[str]) -> str:
    if cancelled:
        return "cancelled"
    if states.count("succeeded") == len(states):
        return "completed"
    return "partial" if DONE.issuperset(states) else "running"


class Workflow:
    """One job: its pages' states, and whether it is cancelled."""

    def __init__(self, pages: int, most: int = 3) -> None:
        self.pages, self.most, self.cancelled = [("pending", 0)] * pages, most, False

    def apply(self, kind: str, page: int = 0, attempt: int = 0) -> bool:
        if kind == "cancel":
            self.cancelled = True
            return True
        if self.cancelled or not 1 <= page <= len(self.pages) or (made := move(self.pages[page - 1], kind, attempt, self.most)) is None:
            return False
        self.pages[page - 1] = made
        return True

    @property
    def status(self) -> str:
        return status(self.cancelled, [s for s, _ in self.pages])

    @property
    def succeeded(self) -> int:
        return [s for s, _ in self.pages].count("succeeded")


class Workflows(StatefulProcessor):
    """State of each job: its pages in their order, and whether it is cancelled; one value, read and written once for all events of a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        flow = None
        if (held := self.job.get()) is not None:
            flow = Workflow(0)
            flow.pages, flow.cancelled = [tuple(p) for p in held[0]], held[1]
        for e in sorted(rows, key=lambda e: (e.at is None, e.at or 0)):
            if e.kind == "create":
                ok = flow is None and 1 <= (e.pages or 0) <= 1000
                flow = Workflow(e.pages) if ok else flow
            else:
                ok = flow is not None and flow.apply(e.kind, e.page or 0, e.attempt or 0)
            yield OUTCOME(key[0], e.kind, e.page, ok, flow.status if flow else "unknown", flow.succeeded if flow else 0)
        if flow:
            self.job.update((flow.pages, flow.cancelled))

    def close(self) -> None:
        pass


def page_workflows(events: DataFrame) -> DataFrame:
    """Accepted and stale events of each job with its status after each."""
    timed = events.select("job_id", "kind", "page", "attempt", "pages", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    # Identifiers that follow one another differ in their last characters.
    prefix = F.left("job_id", F.greatest(F.length("job_id") - F.lit(NEIGHBOURS), F.lit(0)))
    return by_group(timed, F.pmod(F.xxhash64(prefix), F.lit(GROUPS)), Workflows(), "job_id string", OUTPUT)


def checkpointed(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None):
    """Run ``work`` on each micro-batch; Spark's checkpoint says which are done.  Without ``seconds``, what is there is run once."""
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()
