from __future__ import annotations

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest

from spanloom.streaming.dedup import LiveScan, dedup_stream


class Cell:
    """Value, list and map states of one key, with the calls the processor makes."""

    def __init__(self):
        self.value, self.writes = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    put = update

    def clear(self):
        self.value = None


class Table(dict):
    writes = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Cell())

    getListState = getValueState

    def getMapState(self, name, key, schema):
        return self.states.setdefault(name, Table())

    def registerTimer(self, due):
        self.timers.add(due)

    def deleteTimer(self, due):
        self.timers.remove(due)

    def size(self):
        return len(json.dumps({n: list(s.items()) if isinstance(s, Table) else s.value for n, s in self.states.items()}, default=str))


def clock(now):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now, getCurrentWatermarkInMs=lambda: now)


def processor(timeout_ms=None):
    live, handle = LiveScan(0.5, 60.0, timeout_ms, False), Handle()
    live.init(handle)
    return live, handle


def windows(*rows):
    return pd.DataFrame(rows, columns=["video_id", "window_idx", "window_start", "is_last", "activities"])


def activity(start, end, text):
    return {"start": start, "end": end, "description": text}


def rows_of(frames):
    return [tuple(r)[1:] for f in frames for r in f.itertuples(index=False)]


def run(live, *batches, now=0):
    return rows_of(live.handleInputRows(("v",), iter(batches), clock(now)))


def expire(live, handle, now):
    (due,) = handle.timers
    assert due <= now
    handle.timers.clear()
    return rows_of(live.handleExpiredTimer(("v",), clock(now), SimpleNamespace(getExpiryTimeInMs=lambda: due)))


def test_missing_window_is_given_up_after_the_timeout():
    live, handle = processor(1000)
    first = windows(("v", 0, 0.0, False, [activity(0.0, 10.0, "a"), activity(50.0, 70.0, "bb"), activity(None, 3.0, "no")]))
    third = windows(("v", 2, 120.0, True, [activity(130.0, 140.0, "c")]))
    assert run(live, first, third, now=5) == [(0, 0.0, 10.0, "a")]
    assert handle.timers == {1005}
    assert run(live, first, now=10) == [] and handle.timers == {1010}  # only one timer at a time
    assert expire(live, handle, 1010) == [(1, 50.0, 70.0, "bb"), (2, 130.0, 140.0, "c")]
    assert run(live, first, now=1500) == [] and handle.timers == {2500}  # closed
    assert expire(live, handle, 2500) == []
    assert not handle.timers and not any(s if isinstance(s, Table) else s.exists() for s in handle.states.values())


def test_state_holds_only_what_crosses_the_horizon():
    live, handle = processor()
    out, sizes = [], []
    for w in range(50):
        acts = [activity(60.0 * w + i, 60.0 * w + i + 0.9, "x" * i) for i in range(1, 59)]
        out += run(live, windows(("v", w, 60.0 * w, w == 49, acts)))
        sizes.append(handle.size())
    assert len(out) == 50 * 58 and [o[0] for o in out] == list(range(50 * 58))
    assert max(sizes) < 200 and not handle.timers


def test_early_windows_are_rows_that_are_written_once():
    live, handle = processor()
    early = handle.states["early"]
    late = [windows(("v", w, 60.0 * w, w == 39, [activity(60.0 * w, 60.0 * w + 5, f"w{w}")])) for w in range(40)]
    for w in range(1, 40):
        assert run(live, late[w]) == []
    assert len(early) == 39 and early.writes == 39
    assert handle.states["open"].writes == handle.states["waiting"].writes == 0
    assert len(run(live, late[0])) == 40
    assert not early and handle.states["book"].value[3]


def test_a_late_video_is_closed_by_event_time(spark, tmp_path):
    """Video a lacks window 1 and falls silent; the others go on and move the watermark."""
    begin = datetime(2024, 1, 1)
    kind = "video_id string, window_idx bigint, window_start double, is_last boolean, activities array<struct<start: double, end: double, description: string>>, at timestamp"

    def batch(number, *rows):
        full = [(v, w, 60.0 * w, last, [(60.0 * w + 1, 60.0 * w + 30, f"{v}{w}")], begin + timedelta(minutes=m)) for v, w, last, m in rows]
        spark.createDataFrame(full, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))

    batch(0, ("a", 0, False, 0), ("a", 2, True, 1), ("b", 0, False, 1))
    batch(1, ("b", 1, False, 30))
    batch(2, ("b", 2, False, 60))
    batch(3, ("b", 3, True, 90), ("a", 1, False, 90))
    feed = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed")).withWatermark("at", "5 minutes")
    kept = dedup_stream(feed, timeout_ms=10 * 60_000, event_time="at")
    writer = kept.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [r for r in got if r[0] == "a"] == [("a", 0, 1.0, 30.0, "a0"), ("a", 1, 121.0, 150.0, "a2")]
    assert [r[4] for r in got if r[0] == "b"] == ["b0", "b1", "b2", "b3"]
    with pytest.raises(ValueError):
        dedup_stream(feed, event_time="at")
