"""A profile's last score as keyed state: a new score takes back what the old one counted."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row

from covermill.streaming.paged_state import PagedState


class ScoreState(PagedState):
    """Turns scores into changes of their groups' numbers of profiles and of HIGH ones.

    A profile whose warranty isn't known counts nowhere. Of scores of one profile in one batch the last in order of their
    values counts. A page emits one change per group.
    """

    keys = ["user_id", "warranty_id", "id"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.changes: dict[tuple, list[int]] = {}
        yield from super().handleInputRows(key, rows, timerValues)
        for (brand, region), (total, high) in self.changes.items():
            yield Row(brand=brand, region_code=region, total=total, high=high)

    def _count(self, held: dict, sign: int) -> None:
        change = self.changes.setdefault((held["brand"], held["region_code"]), [0, 0])
        change[0] += sign
        change[1] += sign * held["high"]

    def change(self, key: tuple, held: dict | None, mine: list[Row]) -> Iterator[Row]:
        row = mine[0] if len(mine) == 1 else max(mine, key=lambda r: [str(r[c]) for c in ("warranty_known", "risk_label", "brand", "region_code")])
        if held is not None:
            self._count(held, -1)
        if not row["warranty_known"]:
            return None
        new = {"brand": row["brand"], "region_code": row["region_code"], "high": int(row["risk_label"] == "HIGH")}
        self._count(new, 1)
        return new
        yield  # groups are emitted with the page
