"""Streaming forms of outbox and upload leases: state for each event.

Leases end by the commands' own times, so results don't depend on when a batch
runs.  When an event is published or dead its delivery state goes, and a mark of its end stays for a time (``keep``, of
the processing clock) so that commands that come late find it so; then Spark drops the mark, too.  So state
grows with the events that are under way, and with those that ended within that time.  An event that is
inserted again after its mark is gone is a new one: ``keep`` must be longer than any producer repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.outbox import LEASE_MINUTES, MOST_ATTEMPTS
from .together import by_group

STATE = "attempts int, owner string, expires long"
ENDED = "attempts int, published boolean"
#: For how long the end of an event is known.
KEEP = timedelta(days=7)
MADE = "event_id long, owner string, outcome string, attempts int, lease_expires_at long"
EPOCH, MICROSECOND = datetime(1970, 1, 1), timedelta(microseconds=1)
OUTCOME = Row("event_id", "owner", "outcome", "attempts", "lease_expires_at")
COMMANDS = "event_id long, kind string, owner string, at timestamp"
#: Bits of the numbers of events whose state is kept together: at most 2^8 events, however many there are.
NEIGHBOURS = 8


def step(state: tuple | None, kind: str, owner: str | None, at: datetime) -> tuple[tuple, str]:
    """New delivery state (attempts, owner, expires, published, dead) and outcome for one command: insert, claim or acknowledge."""
    if state is None:
        return ((0, None, None, False, False), "inserted") if kind == "insert" else ((0, None, None, False, False), "not_found")
    attempts, holder, expires, published, dead = state
    live = expires is not None and expires > at
    if kind == "insert":
        return state, "existing"
    if not published and not dead and attempts == MOST_ATTEMPTS and expires is not None and not live:
        return (attempts, None, None, False, True), "dead_lettered"
    if kind == "acknowledge":
        if published:
            return state, "existing"
        return ((attempts, None, None, True, False), "published") if live and holder == owner and not dead else (state, "lease_lost")
    if published or dead or attempts >= MOST_ATTEMPTS or (live and holder != owner):
        return state, "refused"
    renewed = live and holder == owner
    return (attempts + (not renewed), owner, at + timedelta(minutes=LEASE_MINUTES), False, False), "renewed" if renewed else "claimed"


def micros(at: datetime | None) -> int | None:
    """Microseconds since 1970; times are kept so, and no time zone has a part in them."""
    return None if at is None or at is pd.NaT else (at - EPOCH) // MICROSECOND


class Deliveries(StatefulProcessor):
    """Delivery state of each outbox event; commands of one batch are taken in the order of their time."""

    def __init__(self, keep: timedelta = KEEP) -> None:
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.delivery = handle.getValueState("delivery", STATE)
        self.ended = handle.getValueState("ended", ENDED, ttlDurationMs=self.keep)

    def known(self) -> tuple | None:
        """The state as :func:`step` takes it.  An event has one of the two, so most are known by one call or two."""
        if (held := self.delivery.get()) is not None:
            attempts, owner, expires = held
            return attempts, owner, None if expires is None else EPOCH + timedelta(microseconds=expires), False, False
        if (held := self.ended.get()) is not None:
            attempts, published = held
            return attempts, None, None, published, not published
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # Rows, not frames: most events have a handful of commands.
        commands = sorted(rows, key=lambda c: (c.at is None, c.at or 0, c.kind is None, c.kind or ""))
        before = state = self.known()
        for c in commands:
            made, outcome = step(state, c.kind, c.owner, pd.NaT if c.at is None else EPOCH + timedelta(microseconds=c.at))
            if outcome != "not_found":
                state = made
            yield OUTCOME(key[0], made[1], outcome, made[0], micros(made[2]))
        over = state is not None and (state[3] or state[4])
        # A mark isn't written anew by those that only find it, so its time runs from the event's end.
        if over and not (before and (before[3] or before[4])):
            if before:
                self.delivery.clear()
            self.ended.update((state[0], state[3]))
        elif state is not None and not over:
            self.delivery.update((*state[:2], micros(state[2])))

    def close(self) -> None:
        pass


def deliveries(commands: DataFrame, keep: timedelta = KEEP) -> DataFrame:
    """Outcomes of a stream of commands (``event_id``, kind, owner, at) against each event's delivery state."""
    # Times as numbers, so that no time zone has a part in what Python makes of them.
    timed = commands.select("event_id", "kind", "owner", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    made = by_group(timed, F.shiftright("event_id", NEIGHBOURS), Deliveries(keep), "event_id long", MADE, "ProcessingTime")
    return made.withColumn("lease_expires_at", F.timestamp_micros("lease_expires_at"))


def once(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """At-least-once delivery made once: the first of each key within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def with_deadline(df: DataFrame, at: str, minutes: int = LEASE_MINUTES) -> DataFrame:
    return df.withColumn("lease_expires_at", F.col(at) + F.expr(f"interval {minutes} minutes"))
