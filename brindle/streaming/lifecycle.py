"""T4: the life of keys as a stream, moved on by events and by time alone.

A key is PENDING from its creation, ACTIVE after ``grace``, RETIRED after ``rotation`` more and
DELETED after ``retention`` more; each of these steps can come earlier by an event. Steps by age happen
at the moment they are due, which a timer on event time sees to once the watermark has passed it, so they
need no later event of the key, and results don't depend on how events fall into batches.

Of a deleted key nothing is kept, and a new creation begins anew. Events that a status doesn't allow (activation
of an active key, anything of an unknown one) change nothing. Events of one time are taken by their number.
Null keys and times are left out; events behind the watermark are late and dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PENDING, ACTIVE, RETIRED, DELETED = "PENDING", "ACTIVE", "RETIRED", "DELETED"
NEXT = {PENDING: ACTIVE, ACTIVE: RETIRED, RETIRED: DELETED}
#: Of each event the statuses at which it counts, and the status that it gives; None is a key that isn't there.
EVENTS = {"created": ((None,), PENDING), "activated": ((PENDING,), ACTIVE), "retired": ((ACTIVE,), RETIRED), "deleted": ((PENDING, ACTIVE, RETIRED), DELETED)}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class KeyLife(StatefulProcessor):
    """State of a key: its status, since when (microseconds), and the timer that is set (milliseconds)."""

    def __init__(self, grace: int, rotation: int, retention: int):
        self._stay = {PENDING: grace * 1_000_000, ACTIVE: rotation * 1_000_000, RETIRED: retention * 1_000_000}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("life", "status string, since long, timer long")

    def _read(self) -> tuple[str | None, int, int]:
        held = self._state.get()
        return (None, 0, 0) if held is None else tuple(held)

    def _age(self, status: str | None, since: int, until: int, out: list) -> tuple[str | None, int]:
        """Steps by age that are due up to a moment."""
        while status in self._stay and since + self._stay[status] <= until:
            since, before, status = since + self._stay[status], status, NEXT[status]
            out.append((since, before, status, "age"))
        return (None, 0) if status == DELETED else (status, since)

    def _keep(self, status: str | None, since: int, timer: int, held: bool) -> None:
        due = -(-(since + self._stay[status]) // 1000) if status else 0
        if timer and timer != due:
            self._handle.deleteTimer(timer)
        if due and timer != due:
            self._handle.registerTimer(due)
        if status:
            self._state.update((status, since, due))
        elif held:
            self._state.clear()

    def _rows(self, key, out: list) -> Iterator[Row]:
        return (Row(key_id=key[0], us=us, before=before, after=after, cause=cause) for us, before, after, cause in out)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, since, timer = self._read()
        held = status is not None
        out: list[tuple] = []
        for us, _, event in sorted((row["us"], row["seq"], row["event"]) for row in rows):
            status, since = self._age(status, since, us, out)
            allowed, after = EVENTS.get(event, ((), None))
            if status in allowed:
                out.append((us, status, after, "event"))
                status, since = (None, 0) if after == DELETED else (after, us)
        status, since = self._age(status, since, timerValues.getCurrentWatermarkInMs() * 1000, out)
        self._keep(status, since, timer, held)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        status, since, timer = self._read()
        held = status is not None
        out: list[tuple] = []
        status, since = self._age(status, since, timerValues.getCurrentWatermarkInMs() * 1000, out)
        fired = expiredTimerInfo.getExpiryTimeInMs()
        self._keep(status, since, 0 if timer == fired else timer, held)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def key_life(events: DataFrame, grace: int, rotation: int, retention: int, lateness: str) -> DataFrame:
    """key_id, us (microseconds), before, after, cause ('event' or 'age') of each step of each key.

    ``events`` is a stream of key_id, seq, event and at (a timestamp); the first three intervals are in seconds, ``lateness`` is how late events may come.
    """
    own = events.filter("key_id is not null and at is not null").withWatermark("at", lateness)
    own = own.select(F.col("key_id").cast("string").alias("key_id"), F.col("seq").cast("long").alias("seq"), "event", "at", F.unix_micros("at").alias("us"))
    return own.groupBy("key_id").transformWithState(
        statefulProcessor=KeyLife(grace, rotation, retention), outputStructType="key_id string, us long, before string, after string, cause string", outputMode="Append", timeMode="EventTime"
    )
