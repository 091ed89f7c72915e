import pandas as pd
from freshet.streaming.stateful import _Limits


class Handle:
    """State and timers of one key, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return sorted(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_batch_of_many_windows_makes_few_calls_to_the_state():
    limits, handle = _Limits((("ten", 600, 2), ("day", 86_400, 300))), Handle()
    limits.init(handle)
    rows = pd.DataFrame([{"at_us": i * 200_000_000, "row_id": str(i), "over": None, "counts": True, "limit_key": "k"} for i in range(3000)])
    one = list(limits.handleInputRows(("k",), iter([rows[700:1500], rows[:700]]), Times(0)))
    two = list(limits.handleInputRows(("k",), iter([rows[1500:]]), Times(1500 * 200_000)))
    assert handle.calls <= 6 and len(handle.timers) == 1
    for i, r in enumerate(pd.concat(one + two).to_dict("records")):  # three in ten minutes, 432 a day: all count, also those refused
        assert r["over"] == ("ten" if i % 3 == 2 else "day" if i % 432 >= 300 else None), i
    list(limits.handleExpiredTimer(("k",), Times(0), Times(min(handle.timers))))
    assert handle.value is None and not handle.timers
