"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are joined by the seeds they share: windows of ``min_tile`` words with the
same Karp-Rabin hash. Seeds on one diagonal grow into the longest common runs. The longest run whose
words are all unmarked in both becomes a tile, its words are marked, what is left of overlapping runs
competes again, and so on until no run of ``min_tile`` words is left. The share of an item's words under
tiles decides, so passages in another order are caught as well.

The benchmark is the query set. It is taken in blocks of bounded size, each held by every task while
all documents pass; documents aren't shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.pieces import RecentCache, one_per_worker, slices_by_bytes
from covermill.llm.token_files import new_folder

MIN_TILE = 5
MIN_COVERAGE = 0.5
#: Bytes of benchmark text that a task holds at a time.
BLOCK_BYTES = 8 << 20

#: Scripts written without spaces between words: Thai to Myanmar, kana, Han.
_UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{_UNSPACED}]+|[^\W_]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "array<struct<item_id: bigint, n_item_words: bigint, n_covered: bigint, tiles: array<struct<doc_word: int, item_word: int, words: int>>>>"
_TILE = pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])
_ITEM = pa.struct([("item_id", pa.int64()), ("n_item_words", pa.int64()), ("n_covered", pa.int64()), ("tiles", pa.list_(_TILE))])
_EMPTY = np.zeros(0, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of a text's words: runs of letters and digits, in lower case; single characters in scripts without spaces."""

    def __init__(self):
        self.known = RecentCache()

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        self.known.fill(set(words), lambda new: [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of each window of ``k`` words, modulo 2**64."""
    n = len(words) - k + 1
    if n < 1:
        return _EMPTY
    out = words[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += words[j : n + j]
    return out


def tile(runs: list[tuple[int, int, int]], min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of maximal common runs (length, start in the item, start in the document).

    The longest run goes first, ties in order of the item, then the document. A run that meets marked
    words competes again with its unmarked parts.
    """
    heap = [(-n, p, t) for n, p, t in runs if n >= min_tile]
    heapq.heapify(heap)
    item_marked: set[int] = set()
    doc_marked: set[int] = set()
    tiles = []
    while heap:
        n, p, t = heapq.heappop(heap)
        start, free = 0, []
        for i in range(-n + 1):
            if i == -n or p + i in item_marked or t + i in doc_marked:
                if i - start >= min_tile:
                    free.append((start, i - start))
                start = i + 1
        if free == [(0, -n)]:
            tiles.append((t, p, -n))
            item_marked.update(range(p, p - n))
            doc_marked.update(range(t, t - n))
        else:
            for start, size in free:
                heapq.heappush(heap, (-size, p + start, t + start))
    return tiles


class SeedIndex:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], min_tile: int):
        hashes = WordHashes()
        self.min_tile = min_tile
        self.ids = [i for i, _ in items]
        self.words = [hashes(text or "") for _, text in items]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        seeds = [rolling(w, min_tile) for w in self.words]
        item = np.concatenate([np.full(len(s), k, dtype=np.int64) for k, s in enumerate(seeds)] or [np.zeros(0, dtype=np.int64)])
        place = np.concatenate([np.arange(len(s)) for s in seeds] or [np.zeros(0, dtype=np.int64)])
        seed = np.concatenate([*seeds, _EMPTY])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        # a bit for the top bits of each seed lets most windows of a document pass at once
        bits = max(16, min(26, int(len(seed) * 64).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[seed >> self.shift] = True

    def find(self, words: np.ndarray, min_coverage: float) -> list[tuple]:
        """(item id, its words, words covered, tiles) of each item whose coverage reaches ``min_coverage``."""
        windows = rolling(words, self.min_tile)
        at = np.flatnonzero(self.filter[windows >> self.shift])
        if not len(at):
            return []
        order = np.argsort(windows[at], kind="stable")
        at, windows = at[order], windows[at][order]
        seeds = np.unique(windows)
        first = np.searchsorted(self.seed, seeds, "left")
        count = np.searchsorted(self.seed, seeds, "right") - first
        hit = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        hit = hit[np.lexsort((self.place[hit], self.item[hit]))]
        item, p = self.item[hit], self.place[hit]
        if not len(item):
            return []
        # tiles consist of seeds: an item whose seeds in the text cover too few of its words is left out before any pair is made
        begin = np.flatnonzero(np.diff(item, prepend=-1))
        reach = np.where(np.diff(item, append=-1) != 0, self.min_tile, np.minimum(np.diff(p, append=0), self.min_tile))
        enough = np.add.reduceat(reach, begin) >= min_coverage * self.sizes[item[begin]]
        out = []
        for a, b in zip(begin[enough].tolist(), np.append(begin[1:], len(item))[enough].tolist()):
            found = self._pairs(int(item[a]), p[a:b], self.seed[hit[a:b]], at, windows, words, min_coverage)
            if found:
                out.append(found)
        return out

    def _pairs(self, k: int, p: np.ndarray, seeds: np.ndarray, at: np.ndarray, windows: np.ndarray, words: np.ndarray, min_coverage: float) -> tuple | None:
        """One item's seeds with each of their places in the text, which ``windows`` lists in order of the hash."""
        first = np.searchsorted(windows, seeds, "left")
        count = np.searchsorted(windows, seeds, "right") - first
        t = at[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
        p = np.repeat(p, count)
        order = np.lexsort((p, t - p))
        return self._tiles(k, p[order], t[order], words, min_coverage)

    def _tiles(self, k: int, p: np.ndarray, t: np.ndarray, words: np.ndarray, min_coverage: float) -> tuple | None:
        theirs, m = self.words[k], self.min_tile
        # seeds of equal hash but different words are none
        same = np.ones(len(p), dtype=bool)
        for j in range(m):
            same &= theirs[p + j] == words[t + j]
        p, t = p[same], t[same]
        reach = np.zeros(len(theirs) + 1, dtype=np.int64)
        np.add.at(reach, p, 1)
        np.add.at(reach, p + m, -1)
        if np.count_nonzero(np.cumsum(reach[:-1])) < min_coverage * len(theirs):
            return None  # tiles consist of seeds, so they cover no more
        new = np.flatnonzero((np.diff(p, prepend=-2) != 1) | (np.diff(t, prepend=-2) != 1))
        sizes = np.diff(new, append=len(p)) + m - 1
        tiles = tile(list(zip(sizes.tolist(), p[new].tolist(), t[new].tolist())), m)
        covered = sum(n for _, _, n in tiles)
        return (self.ids[k], len(theirs), covered, tiles) if covered >= min_coverage * len(theirs) else None


def _finder(block, block_id: str, min_tile: int, min_coverage: float, batch_bytes: int = 4 << 20):
    @F.arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, hashes = one_per_worker(("seeds", block_id, min_tile), lambda: (SeedIndex(block.value, min_tile), WordHashes()))
        for batch in batches:
            out = []
            for part in slices_by_bytes(batch, batch_bytes):
                for text in part.to_pylist():
                    found = index.find(hashes(text), min_coverage)
                    out.append([{"item_id": i, "n_item_words": n, "n_covered": c, "tiles": [dict(zip(("doc_word", "item_word", "words"), x, strict=True)) for x in tiles]} for i, n, c, tiles in found])
            yield pa.array(out, pa.list_(_ITEM))

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``leaks``: the items of ``benchmark`` (``item_id``, ``text``) that a text holds, with their tiles.

    An item is held if tiles of ``min_tile`` words or more cover ``min_coverage`` of its words. Items with
    fewer words than a tile, empty and null ones are never held; repeated items count once. Null and
    empty texts hold none. All other columns and all rows are kept, repeated ones too, and texts are taken
    whole, however long; an empty benchmark gives empty lists.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    folder = new_folder(spark, "leaks") if blocks > 1 else ""
    docs = docs.withColumn("leaks", F.lit(None).cast(_FOUND))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
        block = spark.sparkContext.broadcast(rows)
        find = _finder(block, f"{spark.sparkContext.applicationId}-{block._jbroadcast.id()}", min_tile, min_coverage)
        docs = docs.withColumn("leaks", F.concat(F.coalesce("leaks", F.array().cast(_FOUND)), find(F.coalesce(F.col(text), F.lit("")))))
        if k < blocks - 1:
            # a pass per block: a worker never holds two
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    return docs


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document and item it holds: ``item_id``, ``n_item_words``, ``n_covered``, ``coverage`` and ``tiles``."""
    found = with_leaks(docs.select(doc_id, text), benchmark, text, **options)
    pairs = found.select(doc_id, F.explode("leaks").alias("l"))
    return pairs.select(doc_id, "l.item_id", "l.n_item_words", "l.n_covered", (F.col("l.n_covered") / F.col("l.n_item_words")).alias("coverage"), "l.tiles")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with the columns they came with, whatever their names."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col(text).alias("text"))
    return with_leaks(held, benchmark, "text", **options).where(F.size("leaks") == 0).select("held.*")
