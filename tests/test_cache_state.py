"""Keys of a bucket share their state: newest put each, expiry by timer."""

import pandas as pd

from fathomline.streaming.cache_state import AnswerState


class Handle:
    """One value and the timers, as the engine keeps them for a key."""

    def __init__(self):
        self.held, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_bucket_keeps_the_newest_put_of_each_key_and_expires_it():
    handle, state = Handle(), AnswerState()
    state.init(handle)
    frame = lambda rows: pd.DataFrame([(k, pd.Timestamp(t, unit="s"), a, e) for k, t, a, e in rows], columns=["cache_key", "ts", "answer", "expires_ms"])
    said = lambda out: sorted((r.cache_key, r.answer, r.event) for pdf in out for r in pdf.itertuples())
    put = lambda *parts: said(state.handleInputRows((0,), iter([frame(p) for p in parts]), At(0)))
    assert put([("k", 1, "a", 100), ("j", 5, "x", 900), ("k", 1, "b", 100)], [("j", 2, "y", 50), ("i", 3, "z", 300)]) == [("i", "z", "put"), ("j", "x", "put"), ("k", "b", "put")]
    assert put([("k", 1, "b", 100), ("j", 4, "later is not newer", 999)]) == []
    assert put([("k", 2, "c", 500), ("j", 5, "x", 900)]) == [("k", "c", "put")]
    assert said(state.handleExpiredTimer((0,), At(100), At(100))) == [] and 300 in handle.timers
    assert said(state.handleExpiredTimer((0,), At(500), At(300))) == [("i", "z", "expired"), ("k", "c", "expired")] and 900 in handle.timers
    assert said(state.handleExpiredTimer((0,), At(900), At(900))) == [("j", "x", "expired")] and handle.held is None
    assert said(state.handleExpiredTimer((0,), At(901), At(901))) == []
