"""The accumulator's deadlines and the packets of a batch, without a stream."""

import numpy as np
import pandas as pd

from strandpack.functions import mavlink
from strandpack.streaming.accumulator import Accumulator


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, *_):
        return State()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def give(a, now, values):
    rows = pd.DataFrame({"ord": range(len(values)), "tie": 0, "v": values})
    return [n for out in a.handleInputRows((1,), [rows], Clock(now)) for n in out["n"].tolist()]


def test_a_deadline_counts_from_the_rows_that_a_batch_began_with():
    a, h = Accumulator(4, 100), Handle()
    a.init(h)
    assert give(a, 0, [1, 2]) == [] and h.timers == {100}
    assert give(a, 50, [3]) == [] and h.timers == {100}
    assert give(a, 60, [4, 5]) == [4] and h.timers == {160}
    assert give(a, 70, [6, 7, 8]) == [4] and h.timers == set()
    assert give(a, 90, [9]) == [] and h.timers == {190}
    assert [n for out in a.handleExpiredTimer((1,), Clock(190), None) for n in out["n"].tolist()] == [1]
    assert h.timers == set() and not a.held.exists()


def test_batches_are_cut_by_halves_that_fit():
    size = lambda start, counts: 10 + 7 * np.asarray(counts)
    for records in range(60):
        for mtu in (5, 17, 30, 100, 1000):
            want, start = [], 0
            while start < records:
                n = records - start
                while n > 1 and 10 + 7 * n > mtu:
                    n //= 2
                want.append((start, n, 10 + 7 * n <= mtu))
                start += n
            assert mavlink.cut_batch(size, records, mtu) == want
