"""A batch calls the state once per page, however many keys a page has; keys of many events stay split by day."""

import random

import pytest
from pyspark.sql import Row

from covermill.streaming.chain_state import DAY, ChainState
from covermill.streaming.profile_state import PartsState, SliceState
from covermill.streaming.score_state import ScoreState
from covermill.streaming.signal_state import NewestEvents


class Handle:
    """State variables as dicts that count their calls."""

    def __init__(self):
        self.calls, self.values, self.maps = 0, {}, {}

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self, name)

    def getMapState(self, name, key, value):  # noqa: N802
        return Map(self, self.maps.setdefault(name, {}))

    getListState = getValueState


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls += 1
        return self.handle.values.get(self.name)

    def exists(self):
        self.handle.calls += 1
        return self.name in self.handle.values

    def update(self, value):
        self.handle.calls += 1
        self.handle.values[self.name] = value

    put = update


class Map:
    def __init__(self, handle, held):
        self.handle, self.held = handle, held

    def containsKey(self, key):  # noqa: N802
        self.handle.calls += 1
        return key in self.held

    def getValue(self, key):  # noqa: N802
        self.handle.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.handle.calls += 1
        self.held[key] = value


def note(user, nid, at, is_read=False, receipt=False):
    return Row(user_id=user, warranty_id=None, type="x", audience="user", id=nid, at=at, is_read=is_read, receipt=receipt)


PROFILE = {"user_id": 1, "product_type": "ac", "warranty_id": "w"}
MANY = range(200)
CASES = {
    "chain": (lambda: ChainState(7), [note(i, f"n{i}", i) for i in MANY]),
    "score": (ScoreState, [Row(user_id=i, warranty_id="w", id=i, brand="b", region_code=None, risk_label="HIGH", warranty_known=True) for i in MANY]),
    "signal": (lambda: NewestEvents(50), [Row(user_id=i, warranty_id="w", slot=0, at=i, id="e", event_type="usage", hours=1.0, errors=0) for i in MANY]),
    "slices": (SliceState, [Row(**PROFILE, part=i, at=i, id=i, step_a=1, step_b=None, good=1, prompt=0) for i in MANY]),
    "parts": (lambda: PartsState("block"), [Row(**PROFILE, block=i, part=i, answers=1, good=1, prompt=0, last_at=i, lo=0, hi=100, d=1) for i in MANY]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_a_page_of_keys_costs_two_calls(name):
    make, rows = CASES[name]
    state, handle = make(), Handle()
    state.init(handle)
    for _ in range(2):
        handle.calls = 0
        list(state.handleInputRows((0,), iter(rows), None))
        assert handle.calls <= 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keys_of_many_events_are_split_by_day(seed):
    rng = random.Random(seed)
    sent = [note(rng.choice([1, 1, 1, 2, None]), f"n{i}", rng.randrange(60 * DAY), rng.random() < 0.2) for i in range(400)]
    sent += [note(n.user_id, n.id, n.at + rng.randrange(-DAY, 9 * DAY), None, True) for n in sent if rng.random() < 0.4]
    rng.shuffle(sent)
    results = []
    for few in (5, 150, 10**9):
        state, handle, last = ChainState(7, few), Handle(), {}
        state.init(handle)
        for k in range(5):
            for r in state.handleInputRows((0,), iter(sent[k::5]), None):
                last[r.user_id, r.id, r.at] = (r.is_read, r.kept)
        results.append(last)
        assert bool(handle.maps["days"]) == (few < 10**9)
        # what a batch redoes of a split key is its days, not the key
        if few == 5:
            handle.calls = 0
            list(state.handleInputRows((0,), iter([note(1, "late", 60 * DAY + 1, True)]), None))
            assert handle.calls < 30
    assert results[0] == results[1] == results[2] and 0 < sum(kept for _, kept in results[0].values()) < 400
