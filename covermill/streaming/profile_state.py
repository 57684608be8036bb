"""Behaviour profiles as a tree of composed shifts in keyed state: slices of time, blocks of slices, the profile."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Row

from covermill.streaming.paged_state import PagedState

PROFILE = ["user_id", "product_type", "warranty_id"]

#: What a slice, a block or a profile adds: counts of answers, the newest time, and the clamped shift x -> min(hi, max(lo, x + d)).
SUM_SCHEMA = "answers BIGINT, good BIGINT, prompt BIGINT, last_at BIGINT, lo INT, hi INT, d INT"
_FIELDS = [c.split()[0] for c in SUM_SCHEMA.split(", ")]
_NOTHING = (0, 0, 0, None, 0, 100, 0)
_STEP_FIELDS = ["at", "id", "step_a", "step_b"]


def _clamped(x: int) -> int:
    return max(0, min(100, x))


def _newer(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def joined(parts: Iterable[tuple]) -> tuple:
    """The sums of parts that follow each other in time."""
    answers, good, prompt, last, lo, hi, d = _NOTHING
    for n, g, p, at, low, high, by in parts:
        answers, good, prompt, last = answers + n, good + g, prompt + p, _newer(last, at)
        lo, hi, d = min(high, max(low, lo + by)), min(high, max(low, hi + by)), d + by
    return answers, good, prompt, last, lo, hi, d


def _step(delta: int) -> tuple:
    return 0, 0, 0, None, _clamped(delta), _clamped(delta + 100), delta


def _order(step: tuple) -> tuple:
    """Time, then id, missing ones first; rows that tie in both by their steps."""
    return tuple((v is not None, v or 0) for v in step)


def _row(key: tuple, part: int, sums: tuple) -> Row:
    return Row(user_id=key[0], product_type=key[1], warranty_id=key[2], part=part, **dict(zip(_FIELDS, sums, strict=True)))


class SliceState(PagedState):
    """The answers of a profile in one slice of time: a row redoes its slice only, however late it comes.

    Steps are kept, because a late answer goes between them; answers without an effect are counted only. Emits the
    slice's sums.
    """

    keys = [*PROFILE, "part"]

    def change(self, key: tuple, held: dict | None, mine: list[Row]) -> Iterator[Row]:
        answers, good, prompt, last = held["sums"] if held else (0, 0, 0, None)
        steps = [tuple(s) for s in held["steps"]] if held else []
        for r in mine:
            answers, good, prompt, last = answers + 1, good + r["good"], prompt + r["prompt"], _newer(last, r["at"])
            if r["step_a"] is not None:
                steps.append(tuple(r[c] for c in _STEP_FIELDS))
        steps.sort(key=_order)
        shift = joined(_step(delta) for s in steps for delta in s[2:] if delta is not None)
        yield _row(key, key[3], (answers, good, prompt, last, *shift[4:]))
        return {"sums": (answers, good, prompt, last), "steps": steps}


class PartsState(PagedState):
    """The sums of a block's slices, or of a profile's blocks: changed ones are replaced, the whole is joined again.

    ``part`` names a part and orders it in time. The sums of the whole are emitted, with the key's fourth field as
    their part, and kept with the parts.
    """

    variable = "whole"

    def __init__(self, *more: str):
        self.keys = [*PROFILE, *more]

    def change(self, key: tuple, held: dict | None, mine: list[Row]) -> Iterator[Row]:
        parts = {p[0]: tuple(p[1:]) for p in held["parts"]} if held else {}
        parts.update((r["part"], tuple(r[c] for c in _FIELDS)) for r in mine)
        ordered = sorted(parts.items())
        sums = joined(s for _, s in ordered)
        yield _row(key, key[3] if len(key) > 3 else 0, sums)
        return dict(zip(_FIELDS, sums, strict=True)) | {"parts": [(part, *s) for part, s in ordered]}
