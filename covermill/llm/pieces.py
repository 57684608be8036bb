"""Cutting texts where byte-level BPE always has a token boundary, and caches of what a piece encodes to.

The pre-tokenizer of the byte-level vocabularies starts a new word at every single space that stands
between two characters that are not white space, whatever else the text holds. A text cut there can
be encoded piece by piece, and most pieces have been seen before.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
import regex

T = TypeVar("T")

#: White space other than the line feed; rare, and then the plain split below may not be safe.
_RARE_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_RARE_UNICODE = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
#: Where in a text the plain split may not be safe, for Arrow's regular expressions.
_ODD = r"^ | $|  | \n|\n |[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def safe_pieces(text: str) -> list[str]:
    """The text cut at each safe space, without that space.

    Joining the result with single spaces gives the text back. Every piece but the first is to be
    read with one leading space.
    """
    odd = text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE_ASCII)
    if odd or (not text.isascii() and _RARE_UNICODE.search(text)):
        return _SAFE_SPACE.split(text)
    return text.split(" ")


def safe_lists(texts: pa.Array) -> pa.ListArray:
    """The ``safe_pieces`` of each text of an array without nulls, in its order."""
    odd = pc.match_substring_regex(texts, _ODD)
    if not pc.any(odd).as_py():
        return pc.split_pattern(texts, " ")
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    cut = pa.array([_SAFE_SPACE.split(x) for x in texts.filter(odd).to_pylist()], plain.type)
    at = pc.sort_indices(pc.sort_indices(odd.cast(pa.int8())))
    return pa.concat_arrays([plain, cut]).take(at)


def safe_chunks(text: str, chars: int = 1 << 20) -> Iterator[tuple[str, bool]]:
    """A long text in parts of about ``chars`` code points, each cut at a safe space, which is left out.

    The flag says whether the part follows such a space. A text without a safe space stays whole.
    """
    start, follows = 0, False
    while len(text) - start > chars:
        cut = _SAFE_SPACE.search(text, start + chars)
        if cut is None:
            break
        yield text[start : cut.start()], follows
        start, follows = cut.end(), True
    yield text[start:], follows


class RecentCache(dict):
    """A bounded map that keeps what is in use: when full it becomes the older generation."""

    def __init__(self, size: int = 300_000):
        super().__init__()
        self.size, self.older = size, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def fill(self, wanted: set, make: Callable[[list], list]) -> None:
        """Makes the values of all keys present; ``make`` gets those that are new, once each."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        older = self.older
        new = [k for k in wanted if k not in self and k not in older]
        if new:
            self.update(zip(new, make(new), strict=True))


_HELD: dict = {}


def _give_back() -> None:
    """Returns memory that is no longer used to the system, which the allocators would keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def one_per_worker(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` builds, kept for all tasks of a Python worker until another one is asked for.

    Stages that follow each other on the same workers so don't add up their models and caches.
    """
    if key not in _HELD:
        none_held()
        _HELD[key] = make()
    return _HELD[key]


def none_held() -> None:
    """Gives back what an earlier stage left in this Python worker; for tasks that need no model."""
    if _HELD:
        _HELD.clear()
        _give_back()


def slices_by_bytes(array: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """The array in slices of about ``limit`` bytes of text, one row at least, in order."""
    if not len(array):
        return
    sizes = pc.fill_null(pc.binary_length(array), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield array.slice(start, i - start)
            start, total = i, 0
        total += size
    yield array.slice(start)


def by_slices(function: Callable[[list], pa.Array], batches: Iterator[pa.Array], limit: int = 4 << 20) -> Iterator[pa.Array]:
    """Applies ``function`` to the values of each slice; one result array for each batch."""
    for batch in batches:
        parts = [function(part.to_pylist()) for part in slices_by_bytes(batch, limit)]
        yield pa.concat_arrays(parts) if parts else function([])
