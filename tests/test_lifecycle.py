"""Keys' lives as a stream against a plain replay, whole and in two parts."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Row

from brindle.streaming import jobs
from brindle.streaming.lifecycle import KeyLife, key_life, state_in_rocksdb

GRACE, ROTATION, RETENTION, LATE = 100, 300, 200, 10
BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "key_id string, seq long, event string, at timestamp"


def replay(rows, until):
    stay, after = {"PENDING": GRACE, "ACTIVE": ROTATION, "RETIRED": RETENTION}, {"PENDING": "ACTIVE", "ACTIVE": "RETIRED", "RETIRED": "DELETED"}
    allowed = {"created": [None], "activated": ["PENDING"], "retired": ["ACTIVE"], "deleted": list(stay)}
    gives = {"created": "PENDING", "activated": "ACTIVE", "retired": "RETIRED", "deleted": "DELETED"}
    out = []
    for key in sorted({r[0] for r in rows if r[0] is not None}):
        status, since = None, 0.0
        for at, event in [*((s, e) for s, _, e in sorted((s, q, e) for k, q, e, s in rows if k == key)), (until, None)]:
            while status and since + stay[status] <= at:
                since, before, status = since + stay[status], status, after[status]
                out.append((key, since, before, status, "age"))
                status = None if status == "DELETED" else status
            if event in allowed and status in allowed[event]:
                out.append((key, at, status, gives[event], "event"))
                status, since = (None, 0.0) if event == "deleted" else (gives[event], at)
    return sorted(out, key=str)


def run(spark, folder, parts):
    with state_in_rocksdb(spark):
        for part in parts:
            rows = [(k, q, e, BEGIN + dt.timedelta(seconds=s)) for k, q, e, s in part]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = jobs.new_files(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema)
            jobs.run_available(key_life(stream, GRACE, ROTATION, RETENTION, f"{LATE} seconds"), f"{folder}/out", f"{folder}/checkpoint")
    begin = int(BEGIN.replace(tzinfo=dt.timezone.utc).timestamp())
    found = spark.read.parquet(f"{folder}/out").collect()
    return sorted(((r["key_id"], r["us"] / 1e6 - begin, r["before"], r["after"], r["cause"]) for r in found), key=str)


def test_events_and_time_alone(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(12)}", q, rng.choice(["created", "created", "activated", "retired", "deleted", "odd"]), float(rng.randrange(4000))) for q in range(150)]
    rows += [("quiet", 900, "created", 50.0), (None, 901, "created", 60.0), ("clock", 902, "odd", 4000.0)]
    want = replay(rows, 4000.0 - LATE)
    assert run(spark, str(tmp_path / "one"), [rows]) == want
    assert [x[2:] for x in sorted(want, key=lambda x: x[1]) if x[0] == "quiet"] == [(None, "PENDING", "event"), ("PENDING", "ACTIVE", "age"), ("ACTIVE", "RETIRED", "age"), ("RETIRED", "DELETED", "age")]


def test_goes_on_from_its_checkpoint(spark, tmp_path):
    first = [("a", 1, "created", 0.0), ("b", 2, "created", 10.0), ("b", 3, "activated", 20.0), ("clock", 4, "odd", 150.0)]
    second = [("a", 5, "retired", 160.0), ("clock", 6, "odd", 900.0)]
    assert run(spark, str(tmp_path), [first, second]) == replay(first + second, 900.0 - LATE)


class Held:
    """State of one value that counts the calls, each of which asks the JVM."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        pass

    deleteTimer = registerTimer


class Watermark:
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_state_is_asked_twice_a_key_whatever_its_rows():
    held, reader = Held(), jobs.ReadOnce()
    reader.init(held)
    rows = [Row(key="k", seq=i, op=("put", "get", "get")[i % 3], value=str(i), at=float(i), ttl=10.0) for i in range(300)] + [Row(key="k", seq=300, op="put", value="last", at=300.0, ttl=5.0), Row(key="k", seq=301, op="get", value=None, at=None, ttl=5.0)]
    found = {r["seq"]: r["value"] for r in reader.handleInputRows(("k",), iter(rows[::-1]), None)}
    assert found == {i: str(i - 1) if i % 3 == 1 else None for i in range(300) if i % 3} | {301: None}
    assert (held.calls, held.value) == (1, None)
    list(reader.handleInputRows(("k",), iter(rows[-2:-1]), None))
    assert (held.calls, held.value) == (3, ("last", 305.0))
    held, life = Held(), KeyLife(GRACE, ROTATION, RETENTION)
    life.init(held)
    list(life.handleInputRows(("k",), iter([Row(us=i, seq=i, event="created") for i in range(100)]), Watermark()))
    assert (held.calls, held.value[:2]) == (2, ("PENDING", 0))
