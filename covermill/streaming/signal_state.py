"""The newest events of a pair as keyed state of bounded size."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Row

from covermill.streaming.paged_state import PagedState

EVENT_SCHEMA = "at BIGINT, id STRING, event_type STRING, hours DOUBLE, errors INT"
_FIELDS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


def _newness(event: dict) -> tuple:
    """Order by time, then id; a missing one is oldest."""
    at, nid = event["at"], event["id"]
    return (at is not None, at or 0, nid is not None, nid or "")


class NewestEvents(PagedState):
    """Keeps the newest events of each key, whenever they arrive: a late row enters by its time.

    What a window before any day needs of a key are its newest events, so older ones are dropped
    without a timer. A batch's rows are read once and no more than twice the bound are held of a key. Nothing is emitted.
    """

    keys = ["user_id", "warranty_id", "slot"]

    def __init__(self, max_events: int):
        self.max_events = max_events

    def add(self, mine: list, row: Row) -> None:
        mine.append({c: row[c] for c in _FIELDS})
        if len(mine) > 2 * self.max_events:
            mine[:] = heapq.nlargest(self.max_events, mine, key=_newness)

    def change(self, key: tuple, held: dict | None, mine: list[dict]) -> Iterator[Row]:
        events = held["events"] + mine if held else mine
        return {"events": heapq.nlargest(self.max_events, events, key=_newness) if len(events) > self.max_events else events}
        yield  # nothing
