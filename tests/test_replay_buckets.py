"""Replays: keys that share a state are counted and forgotten one by one."""

import datetime as dt

import pandas as pd

from brokerlens.streaming import replay
from tests.helpers import msg
from tests.test_shared_passes import T0, streamed


class Value:
    def __init__(self):
        self.row, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.row is not None

    def get(self):
        self.calls += 1
        return self.row

    def update(self, row):
        self.calls += 1
        self.row = row

    def clear(self):
        self.row = None


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), []

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)


class Times:
    def __init__(self, watermark, fired=0):
        self.watermark, self.fired = watermark, fired

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.fired


def test_calls_to_the_state_store_do_not_grow_with_the_keys():
    handle, counter = Handle(), replay.ReplayCounter(1000)
    counter.init(handle)
    rows = pd.DataFrame([(f"id{i % 500}", "v", 10 * (i // 500)) for i in range(1000)], columns=["general_full_id", "mqtt_message_value", "at"])
    out = pd.concat(counter.handleInputRows((0,), iter([rows[:300], rows[300:]]), Times(0)))
    assert len(out) == 500 and set(out["count"]) == {2}
    assert handle.value.calls <= 3 and len(handle.timers) == 1
    late = pd.DataFrame([("id0", "v", 900), ("new", "v", 1200)], columns=rows.columns)
    assert list(pd.concat(counter.handleInputRows((0,), iter([late]), Times(0)))["count"]) == [3]
    assert list(counter.handleExpiredTimer((0,), Times(1300), Times(1300, handle.timers[0]))) == []
    assert sorted(handle.value.row[0]) == ["id0", "new"] and len(handle.timers) == 2      # the others are forgotten
    list(counter.handleExpiredTimer((0,), Times(10_000), Times(10_000, handle.timers[1])))
    assert handle.value.row is None and len(handle.timers) == 2


def test_keys_of_one_bucket_expire_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "BUCKETS", 1)
    at = lambda h, i, v: msg(i, ip="10.0.0.1", value=v, ts=T0 + dt.timedelta(hours=h))
    batches = [[at(0, 1, "a"), at(0.1, 2, "a"), at(0.2, 3, "b")],
               [at(0.9, 4, "b"), at(1.0, 5, "c")],
               [at(1.8, 6, "b"), at(1.8, 7, "a")],           # a came back after its hour
               [at(9, 8, "b"), at(9.1, 9, "c")],
               [at(9.2, 10, "c"), at(0.3, 11, "b")]]         # the second is late
    got = {r.mqtt_message_value: r["count"] for r in replay.replay_alerts(
        spark, streamed(spark, str(tmp_path / "in"), batches), str(tmp_path), keep_seconds=3600, watermark="30 minutes").collect()}
    assert got == {"a": 2, "b": 3, "c": 2}
