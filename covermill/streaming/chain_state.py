"""The chained seven-day rule as keyed state, so that a batch decides on its own rows and on what they change."""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessorHandle

from covermill.streaming.paged_state import PagedState

DAY = 86_400_000_000
#: Events and receipts of a key that are kept in its page, and values that the ids of a key with more are spread over.
FEW, BUCKETS = 256, 1024
#: [time, id, until, whether a receipt ended it early]
Anchor = list


def suppressed(anchor: Anchor | None, at: int, nid: str) -> bool:
    """Whether an event falls under the anchor before it; its own event does not."""
    if anchor is None or (at, nid) <= (anchor[0], anchor[1]):
        return False
    return at < anchor[2] or (at == anchor[2] and (not anchor[3] or nid <= anchor[1]))


def anchor_of(at: int, nid: str, read_at: int | None, gap: int) -> Anchor:
    early = read_at is not None and read_at <= at + gap
    return [at, nid, read_at if early else at + gap, early]


def _bucket(nid: str) -> int:
    return crc32(nid.encode("utf-8", "surrogatepass")) % BUCKETS


class ChainState(PagedState):
    """Decides which notifications of a key are kept, and decides again what a late row or receipt changes.

    State per key: its events by day, in order, with their decisions and the anchor after the day; and for
    each id the times of its events and receipts, so that a receipt finds its event whichever comes first.
    A key of few events has all of that in its page. One of many has its days in the page, and each day's events and
    each bucket of its ids as values of their own, of which a batch loads those that it can change.
    A row redoes its day and those after it until the anchor is again the one it was. Nothing expires, so
    no row comes too late. Events that repeat in id and time count once, and a null id counts as an empty one. All times are microseconds.
    """

    keys = ["user_id", "warranty_id", "type", "audience"]

    def __init__(self, days: int, few: int = FEW):
        self.gap = days * DAY
        self.look_back = days + 1
        self.few = few

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.days = handle.getMapState("days", "key STRING, day LONG", "value STRING")
        self.ids = handle.getMapState("ids", "key STRING, bucket INT", "value STRING")

    def _open(self, key: tuple, held: dict | None) -> None:
        self.name, self.loaded, self.known, self.buckets, self.changed = json.dumps(key), {}, {}, set(), {}
        self.stored = set(held["days"]) if held and "days" in held else None
        if held and self.stored is None:
            self.loaded, self.known = {day: record for day, record in held["events"]}, held["ids"]

    def _close(self) -> dict | None:
        mine = {day: record for day, record in self.loaded.items() if record is not None}
        if self.stored is None and sum(len(r["events"]) for r in mine.values()) + sum(len(i["read"]) for i in self.known.values()) <= self.few:
            return {"events": list(mine.items()), "ids": self.known} if mine or self.known else None
        grouped: dict[int, dict] = {}
        for nid, times in self.known.items():
            grouped.setdefault(_bucket(nid), {})[nid] = times
        for bucket, ids in grouped.items():
            self.ids.updateValue((self.name, bucket), (json.dumps(ids),))
        for day in mine if self.stored is None else self.changed:
            self.days.updateValue((self.name, day), (json.dumps(mine[day]),))
        return {"days": sorted((self.stored or set()) | set(mine))}

    def _day(self, day: int) -> dict | None:
        if day not in self.loaded:
            self.loaded[day] = json.loads(self.days.getValue((self.name, day))[0]) if self.stored and day in self.stored else None
        return self.loaded[day]

    def _id(self, nid: str) -> dict:
        bucket = _bucket(nid)
        if self.stored is not None and bucket not in self.buckets:
            self.buckets.add(bucket)
            if self.ids.containsKey((self.name, bucket)):
                self.known.update(json.loads(self.ids.getValue((self.name, bucket))[0]))
        return self.known.setdefault(nid, {"at": [], "read": []})

    def add(self, mine: list, row: Row) -> None:
        mine.append((row["id"], row["at"], row["is_read"], row["receipt"]))

    def change(self, key: tuple, held: dict | None, mine: list[tuple]) -> Iterator[Row]:
        names = dict(zip(self.keys, key, strict=True))
        self._open(key, held)
        touched: set[int] = set()
        for given, at, is_read, receipt in mine:
            nid = given or ""
            if at is None:
                if not receipt:
                    yield Row(**names, id=given, at=None, is_read=is_read, kept=True)
                continue
            times = self._id(nid)
            if receipt:
                insort(times["read"], at)
                touched.update(x // DAY for x in times["at"] if x <= at)
            elif at not in times["at"]:
                times["at"].append(at)
                day = at // DAY
                if self._day(day) is None:
                    self.loaded[day] = {"events": []}
                # time, id, whether it is read already, whether it is kept: not decided yet
                insort(self.loaded[day]["events"], [at, nid, is_read is not False, None], key=lambda e: (e[0], e[1]))
                touched.add(day)
        for at, nid, read, kept in list(self._decide(sorted(touched))):
            yield Row(**names, id=nid, at=at, is_read=read, kept=kept)
        return self._close()

    def _before(self, day: int) -> Anchor | None:
        """The anchor at the beginning of a day; older ones no longer suppress."""
        for back in range(1, self.look_back + 1):
            if self._day(day - back) is not None:
                return self.loaded[day - back]["after"]
        return None

    def _decide(self, touched: list[int]) -> Iterator[tuple]:
        done = None
        for first in touched:
            if done is not None and first <= done:
                continue
            day, anchor, missing = first, self._before(first), 0
            was = anchor
            while missing <= self.look_back:
                record = self._day(day)
                if record is None:
                    missing += 1
                else:
                    missing = 0
                    # a day that is new had no anchor of its own
                    was = record.get("after", was)
                    for e in record["events"]:
                        kept = not suppressed(anchor, e[0], e[1])
                        if kept and not e[2] and (anchor is None or (e[0], e[1]) != (anchor[0], anchor[1])):
                            read = next((x for x in self._id(e[1])["read"] if x >= e[0]), None)
                            anchor = anchor_of(e[0], e[1], read, self.gap)
                        if kept != e[3]:
                            e[3] = kept
                            yield e[0], e[1], e[2], kept
                    record["after"] = anchor
                    self.changed[day] = True
                done = day
                if anchor == was and not (day + 1 in touched):
                    break
                day += 1
