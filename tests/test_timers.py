"""Timers in event time: they fire as the watermark passes, late events are dropped, and state ends with its trip."""

import datetime

import pytest

from pricewright.operators.files import scratch
from pricewright.streaming import feeds, timers

BEGIN = datetime.datetime(2024, 1, 1)
HOUR = timers.HOUR
START = int(BEGIN.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def run(spark, batches, processor, schema):
    """Each list of (key, hour, kind) is a file, and each file a batch of its own, in append mode."""
    folder = f"{scratch(spark)}/events"
    rows, out = spark.createDataFrame([], "key long, ts timestamp, order long, kind string").schema, []
    for i, batch in enumerate(batches):
        spark.createDataFrame([(k, BEGIN + datetime.timedelta(hours=h), 10 * i + j, kind) for j, (k, h, kind) in enumerate(batch)], rows).coalesce(1).write.mode("append").parquet(folder)
        stream = timers.timed(spark.readStream.schema(rows).parquet(folder), processor, schema)

        def keep(found, number):
            out.extend((number, *r) for r in found.collect())

        timers.with_timers(spark, lambda: stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}-state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination())  # noqa: B023
    return [tuple((x - START) / HOUR if isinstance(x, int) and x > START - 1 else x for x in r[1:]) for r in sorted(out)]


def test_idle_trips(spark):
    batches = [
        [(1, 0, "seen"), (1, 10, "seen"), (2, 5, "list"), (3, 1, "seen"), (3, 60, "seen")],  # 3 has a gap of over two days
        [(9, 70, "seen")],  # the watermark passes 58: trip 1 ends
        [(1, 20, "seen"), (1, 75, "seen"), (2, 100, "seen")],  # hour 20 is late and counts for nothing
        [(9, 300, "seen")],
    ]
    got = run(spark, batches, timers.IdleTrips(), timers.IDLE_SCHEMA)
    assert sorted(got) == sorted([(3, 1.0, 1.0, False, 1), (1, 0.0, 10.0, False, 2), (1, 75.0, 75.0, False, 1), (3, 60.0, 60.0, False, 1), (2, 5.0, 100.0, True, 2), (9, 70.0, 70.0, False, 1)])


def test_lapsing(spark):
    week = 168
    batches = [[(1, 0, "propose"), (2, 0, "propose"), (3, 1, "confirm")], [(1, 30, "confirm"), (2, 20, "propose"), (4, 40, "propose")], [(9, 200, "decline")], [(2, 201, "confirm"), (4, 202, "propose"), (4, 203, "decline"), (5, 230, "propose")]]
    got = run(spark, batches, timers.LapsingSettlements(), timers.SETTLED_SCHEMA)
    assert sorted(got) == [(1, 0.0, "confirmed", 30.0), (2, 0.0, "lapsed", float(week)), (4, 40.0, "declined", 203.0)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_batches_dont_matter(spark, cuts):
    rows = [(k, 3 * i * (k + 1), ["seen", "seen", "list"][i % 3] if k % 2 else "seen") for k in range(4) for i in range(40)]
    rows.sort(key=lambda r: r[1])
    size = len(rows) // cuts
    got = run(spark, [rows[i : i + size] for i in range(0, len(rows), size)], timers.IdleTrips(12, 30), timers.IDLE_SCHEMA)
    assert {x[0] for x in got} and len(got) == len({(x[0], x[1]) for x in got})
    whole = run(spark, [rows], timers.IdleTrips(12, 30), timers.IDLE_SCHEMA)
    assert sorted(map(str, got)) == sorted(map(str, whole))


def test_setting_comes_back(spark):
    assert spark.conf.get(timers.PROVIDER) != timers.ROCKS and feeds
