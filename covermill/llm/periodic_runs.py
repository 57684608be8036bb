"""Maximal periodic runs of words, by a suffix automaton and link-cut access to its tree of suffix links.

The automaton of a word sequence holds one state per class of substrings, and the path from a prefix's
state to the root holds all suffixes of that prefix. Appending word i *accesses* that path and colours
it with i. Before that, the path falls into segments of one colour each: the substrings of a segment
last ended at that colour, e. If i - e lies within the lengths of the segment, the suffix of that length
ended directly before itself, which is a square of period i - e; being its last occurrence, the root of
the square is no power. Squares of one period that end at consecutive words make up a run. The access is
that of a link-cut tree: each segment is a splay tree, and the number of segments met is
O(n log n) in all, whatever the text.

A run of at least ``min_length`` and at least two periods is covered by windows of half ``min_length``
words that stand in it twice. So a text is first cut at the words that no repeated window covers, and
each remaining stretch again, until nothing changes: no run that is wanted crosses a cut.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.pieces import by_slices

MIN_LENGTH = 12
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


def words_of(text: str | None) -> list[str]:
    """The words between ASCII white space; none of a null text."""
    return _WORD.findall(text or "")


def stretches(ids: np.ndarray, window: int, least: int) -> list[tuple[int, int]]:
    """Half-open ranges outside which no run of ``least`` words or more can lie, in order.

    ``ids`` may give two words one number; that only cuts less.
    """
    out, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        n = b - a
        if n < max(least, window + 1):
            continue
        hashes = np.zeros(n - window + 1, dtype=np.uint64)
        for k in range(window):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[a + k : b - window + 1 + k]
            hashes ^= hashes >> np.uint64(29)
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order[1:]] == hashes[order[:-1]]
        again = np.zeros(len(hashes), dtype=np.int64)
        again[order[1:][equal]] = 1
        again[order[:-1][equal]] = 1
        # a word is covered if one of the windows that hold it stands here twice
        total = np.concatenate([[0], np.cumsum(again)])
        at = np.arange(n)
        covered = total[np.minimum(at + 1, len(hashes))] > total[np.maximum(at - window + 1, 0)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        parts = [(a + int(x), a + int(y)) for x, y in zip(edges[::2], edges[1::2])]
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo.extend(parts)
    return sorted(out)


def automaton(word_ids: list[int]) -> tuple[array, array, array]:
    """The suffix automaton's ``lengths`` and suffix ``links`` per state, and the state of each prefix.

    State 0 is the empty word. Most states have one way on, which is kept in two arrays; a state with
    more has a map.
    """
    lengths, links = array("i", [0]), array("i", [-1])
    only_word, only_state, more = array("i", [-1]), array("i", [-1]), {}
    prefixes, last = array("i"), 0

    def set_way(p: int, c: int, q: int) -> None:
        if p in more:
            more[p][c] = q
        elif only_word[p] in (-1, c):
            only_word[p], only_state[p] = c, q
        else:
            more[p] = {only_word[p]: only_state[p], c: q}

    def way(p: int, c: int) -> int:
        if p in more:
            return more[p].get(c, -1)
        return only_state[p] if only_word[p] == c else -1

    def state(length: int) -> int:
        lengths.append(length)
        links.append(0)
        only_word.append(-1)
        only_state.append(-1)
        return len(lengths) - 1

    for c in word_ids:
        new, p = state(lengths[last] + 1), last
        q = way(p, c)
        while p != -1 and q == -1:
            set_way(p, c, new)
            p = links[p]
            q = way(p, c) if p != -1 else -1
        if p != -1:
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = state(lengths[p] + 1)
                links[copy] = links[q]
                only_word[copy], only_state[copy] = only_word[q], only_state[q]
                if q in more:
                    more[copy] = dict(more[q])
                links[q] = links[new] = copy
                while p != -1 and way(p, c) == q:
                    set_way(p, c, copy)
                    p = links[p]
        prefixes.append(new)
        last = new
    return lengths, links, prefixes


class LinkCut:
    """A rooted tree under accesses: splay trees hold the paths of one colour, ordered by depth.

    ``up`` is a node's parent in its splay tree, or, at the root of one, the tree node above the
    path. The colour of a path is kept at the root of its splay tree; -1 is a node never met.
    """

    def __init__(self, parents: array):
        n = len(parents)
        self.up, self.left, self.right, self.colour = array("i", parents), array("i", [-1]) * n, array("i", [-1]) * n, array("i", [-1]) * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            moved = left[p] = right[x]
            right[x] = p
        else:
            moved = right[p] = left[x]
            left[x] = p
        if moved != -1:
            up[moved] = p
        up[p], up[x] = x, g
        if g != -1:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                # p was the root of its splay tree
                self.colour[x] = self.colour[p]
        else:
            self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        while True:
            p = up[x]
            if p == -1 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g != -1 and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from ``v`` to the root one colour; the segments it had as (deepest node, colour), deepest first."""
        met, below, x = [], -1, v
        up, right = self.up, self.right
        while x != -1:
            self._splay(x)
            met.append((x, self.colour[x]))
            cut = right[x]
            if cut != -1:
                # what hangs below stays a path of its own, of the colour it had
                self.colour[cut] = self.colour[x]
            right[x] = below
            if below != -1:
                up[below] = x
            below, x = x, up[x]
        self._splay(v)
        self.colour[v] = colour
        return met


def squares(word_ids: list[int]) -> Iterator[tuple[int, int]]:
    """(period, last word) of every square whose root is no power, by its last word."""
    lengths, links, prefixes = automaton(word_ids)
    tree = LinkCut(links)
    for i, v in enumerate(prefixes):
        met = tree.access(v, i)
        for k, (x, last) in enumerate(met):
            if last >= 0 and x:
                shortest = lengths[met[k + 1][0]] if k + 1 < len(met) else 0
                if shortest < i - last <= lengths[x]:
                    yield i - last, i


def periodic_runs(words: list[str], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``min_length`` words and two periods, by start, then period."""
    if len(words) < min_length:
        return []
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    out = []
    for a, b in stretches(hashes, max(1, min_length // 2), min_length):
        numbers: dict[str, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        # period -> first and last end of the squares in a row
        going: dict[int, list[int]] = {}

        def close(period: int, first: int, last: int, a: int = a) -> None:
            start = first - 2 * period + 1
            if last - start + 1 >= min_length:
                out.append((a + start, last - start + 1, period))

        for period, end in squares(ids):
            row = going.get(period)
            if row and row[1] == end - 1:
                row[1] = end
            else:
                if row:
                    close(period, *row)
                going[period] = [end, end]
        for period, row in going.items():
            close(period, *row)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(words[i] for i in np.flatnonzero(keep))


def _find(min_length: int):
    def one(texts: list[str | None]) -> pa.Array:
        rows = []
        for text in texts:
            words = words_of(text)
            runs = periodic_runs(words, min_length)
            rows.append({"n_words": len(words), "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs], "collapsed": collapse(words, runs)})
        return pa.array(rows, _FOUND)

    @F.arrow_udf("struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_slices(one, batches)

    return find


def with_runs(docs: DataFrame, text: str = "text", into: str = "periodic", min_length: int = MIN_LENGTH) -> DataFrame:
    """Adds the struct ``into``: ``n_words``, ``runs`` (start, length, period in words) and ``collapsed``.

    Every row and column is kept, but a column that already has the name ``into`` is replaced. Null
    and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows get the same
    result each, an empty table none. Runs come by start, then period, so there are no ties. Texts are
    taken whole; a text is one task's work, in time n log n of the words of its repetitive stretches.
    ``min_length`` is at least 2.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")
    return docs.withColumn(into, _find(min_length)(F.col(text)))
