"""Token ids and counts as the tokenizers library gives them, for byte-level BPE files.

The pieces of many texts (see ``pieces``) are cut and numbered by Arrow, and each distinct one is
looked up once; the library encodes those that are new, word by word where that is safe, once per
cache generation of a Python worker. A text's ids are those of its pieces in order.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from covermill.llm.pieces import RecentCache, one_per_worker, safe_chunks, safe_lists

#: Pieces given to the library as one text.
_TOGETHER = 48
#: Code points of texts whose pieces are looked up together, more for a text without a safe space.
_AT_ONCE = 4 << 20
#: Fixed value: the words of the byte-level pre-tokenizer. Used on pieces in characters whose class
#: has been the same in every version of Unicode since long; all others are left to the library.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LATIN = r"^[\n!-~\x{a1}-\x{24f}]+$"


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class LibraryEncoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library, special tokens not added.

    Strings of special tokens inside a text become their ids, which is the library's default. Null
    counts as an empty text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        special = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in special.values()]
        cutter = self.tokenizer.pre_tokenizer
        self.by_words = isinstance(cutter, ByteLevel) and cutter.use_regex and not cutter.add_prefix_space and self.tokenizer.normalizer is None
        space = cutter.pre_tokenize_str(" ")[0][0]
        self.opens = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith(space) and i not in special
        self.first, self.later, self.words = RecentCache(50_000), RecentCache(600_000), RecentCache(400_000)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, cache: RecentCache, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The cached ids of each key; only keys that the cache doesn't hold are gathered for ``make``."""
        found = list(map(cache.get, keys))
        unknown = [k for k, x in enumerate(found) if x is None]
        missing = [keys[k] for k in unknown]
        cache.fill(set(missing), make)
        for k, x in zip(unknown, map(cache.__getitem__, missing)):
            found[k] = x
        return found

    def _joined(self, values: list[bytes], which: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The values numbered ``which``, one after another, cut before each of ``bounds``."""
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
        counts = sizes[which]
        ends = np.cumsum(counts)
        # where each id lies among those of the values
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - counts), counts)
        at += np.arange(len(at))
        data = np.frombuffer(b"".join(values), self.dtype)[at].tobytes()
        cuts = (np.concatenate([[0], ends])[bounds] * width).tolist()
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def _encode_spaced(self, pieces: list[str]) -> list[bytes]:
        """Pieces that follow a space, many as one text: each begins at the only token that begins with a space."""
        joined = [p for p in pieces if " " not in p]
        texts = [" " + " ".join(joined[k : k + _TOGETHER]) for k in range(0, len(joined), _TOGETHER)]
        found = b"".join(self._encode(texts))
        starts = np.flatnonzero(self.opens[np.frombuffer(found, self.dtype)])
        if len(starts) != len(joined):
            return self._encode([" " + p for p in pieces])
        at = [*(starts * self.dtype.itemsize).tolist(), len(found)]
        plain, other = (found[i:j] for i, j in zip(at, at[1:])), iter(self._encode([" " + p for p in pieces if " " in p]))
        return [next(other if " " in p else plain) for p in pieces]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words as the pre-tokenizer cuts them, most of which begin with a space."""
        spaced, bare = iter(self._encode_spaced([w[1:] for w in words if w[0] == " "])), iter(self._encode([w for w in words if w[0] != " "]))
        return [next(spaced if w[0] == " " else bare) for w in words]

    def _encode_later(self, pieces: list[str]) -> list[bytes]:
        """Pieces that follow a space. Those in Latin letters are made of words, which come back with other marks around them."""
        texts = pa.array(pieces, pa.string())
        latin = pc.match_substring_regex(texts, _LATIN) if self.by_words else pa.nulls(len(pieces), pa.bool_()).fill_null(False)
        for token in self.added:
            latin = pc.and_not(latin, pc.match_substring(texts, token))
        latin = latin.to_numpy(zero_copy_only=False)
        words = _WORDS.findall(" " + " ".join(compress(pieces, latin))) if latin.any() else []
        bounds = [k for k, w in enumerate(words) if w[0] == " "]
        if len(bounds) != latin.sum():
            return self._encode_spaced(pieces)
        coded = pa.array(words, pa.string()).dictionary_encode()
        values = self._known(self.words, _strings(coded.dictionary), self._encode_words)
        by_words = iter(self._joined(values, coded.indices.to_numpy(), np.array([*bounds, len(words)])))
        whole = iter(self._encode_spaced(list(compress(pieces, ~latin))))
        return [next(by_words if x else whole) for x in latin.tolist()]

    def _encode_parts(self, texts: list[str], follows: list[bool]) -> list[bytes]:
        """The ids of texts, of which some follow a space; every distinct piece is looked up once for all of them."""
        lists = safe_lists(pa.array(texts, pa.string()))
        flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        opening = bounds[:-1][~np.array(follows, dtype=bool)]
        inside = np.ones(len(flat), dtype=bool)
        inside[opening] = False
        coded = flat.filter(pa.array(inside)).dictionary_encode()
        which = np.empty(len(flat), dtype=np.int64)
        which[inside] = coded.indices.to_numpy()
        which[opening] = len(coded.dictionary) + np.arange(len(opening))
        values = self._known(self.later, _strings(coded.dictionary), self._encode_later)
        values += self._known(self.first, _strings(flat.take(pa.array(opening))), self._encode)
        return self._joined(values, which, bounds)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian integers of ``dtype``."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts, follows, size = [], [], [], 0
        for i, text in enumerate(texts):
            for part, follow in safe_chunks(text or ""):
                if parts and size + len(part) > _AT_ONCE:
                    for k, data in zip(owners, self._encode_parts(parts, follows), strict=True):
                        out[k].append(data)
                    owners, parts, follows, size = [], [], [], 0
                owners.append(i)
                parts.append(part)
                follows.append(follow)
                size += len(part)
        for k, data in zip(owners, self._encode_parts(parts, follows), strict=True):
            out[k].append(data)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def count(self, texts: list[str | None]) -> list[int]:
        """Each text's number of ids."""
        width = self.dtype.itemsize
        return [len(x) // width for x in self.encode(texts)]


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder, with its caches, for all tasks of a Python worker."""
    return one_per_worker(("library", path), lambda: LibraryEncoder(path))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; looked up on the worker that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)
