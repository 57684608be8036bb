"""Keyed state in pages: the keys of one hash share a value of the state.

Each call of the state from Python costs more than the work on a row, so a call serves all keys of a page. A batch
reads and writes the pages of its own keys, once each, however many keys it has.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Pages that the keys of an operator are spread over; a checkpoint keeps to the number it began with.
PAGES = 1 << 13
PAGE_SCHEMA = "page INT"


def by_page(df: DataFrame, *keys: str) -> GroupedData:
    """The rows grouped by their key's page; equal keys, nulls included, share it."""
    return df.withColumn("page", F.pmod(F.xxhash64(*keys), F.lit(PAGES)).cast("int")).groupBy("page")


class PagedState(StatefulProcessor):
    """State of many keys as one JSON list of objects: each holds a key's fields and what is kept for it.

    A subclass names the key's fields and says what a key's rows change. It may hold less of them than
    all while they are read.
    """

    keys: list[str]
    variable = "page"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState(self.variable, "value STRING")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        arrived: dict[tuple, list] = {}
        for r in rows:
            self.add(arrived.setdefault(tuple(r[c] for c in self.keys), []), r)
        value = self.page.get()
        held = {tuple(e[c] for c in self.keys): e for e in json.loads(value[0])} if value else {}
        for k, mine in arrived.items():
            fields = dict(zip(self.keys, k, strict=True))
            new = yield from self.change(k, held.get(k), mine)
            if new is None:
                held.pop(k, None)
            else:
                held[k] = fields | new
        self.page.update((json.dumps(list(held.values()), separators=(",", ":")),))

    def add(self, mine: list, row: Row) -> None:
        """Takes one more row of a key."""
        mine.append(row)

    def change(self, key: tuple, held: dict | None, mine: Iterable) -> Iterator[Row]:
        """Yields what a key's rows emit and returns what is kept for it, None for nothing."""
        raise NotImplementedError

    def close(self) -> None:
        pass
