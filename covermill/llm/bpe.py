"""BPE encoding and decoding: exact merges in linear time by backtracking, decoding by an offset table.

Encoding. An Aho-Corasick automaton over all tokens gives the longest token at each position of a
pre-token. Tokens are taken greedily; a token may follow another only if the pair is *compatible*,
that is if BPE on the two tokens' bytes gives just these two. Otherwise the next shorter token that
is a prefix is tried, and if none is left the previous token is taken back. Any sequence whose
neighbours are compatible is the result of the merges, so the first one found is exact, and a
position given up once isn't entered again, which keeps the work linear.

Decoding. All tokens' bytes lie in one array; a table of offsets says where each begins.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.library_tokens import tokenizer_path
from covermill.llm.names import unused
from covermill.llm.pieces import RecentCache, by_slices, one_per_worker, safe_chunks, safe_pieces

VOCABULARY = "byte_bpe_50k.json"

#: The pre-tokenizer's pattern, with white space written out as Unicode defines it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: printable bytes stand for themselves, the others follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(0x100)]


class BacktrackingBpe:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        #: Tokens are handled by rank: bytes first, then merges in the order they are applied. Inside, a
        #: byte is the character of its number, so that a word is one decode away.
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        spelled = [*letters, *(a + b for a, b in pairs)]
        plain = str.maketrans({x: chr(b) for b, x in enumerate(letters)})
        names = [x.translate(plain) for x in spelled]
        pairs = [(a.translate(plain), b.translate(plain)) for a, b in pairs]
        rank = {}
        for i, name in enumerate(names):
            rank.setdefault(name, i)
        self.rank = rank
        self.halves = [(i, i) for i in range(256)]
        self.pair_rank: dict[int, int] = {}
        for i, (a, b) in enumerate(pairs, 256):
            halves = rank[a], rank[b]
            self.halves.append(halves)
            self.pair_rank.setdefault(halves[0] << 32 | halves[1], i)
        self.lengths = [len(x) for x in names]
        self.ids = [vocab.get(x, 0) for x in spelled]
        self.shorter = [next((rank[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in rank), -1) for x in names]
        self.automaton = ahocorasick.Automaton()
        for name, i in rank.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.pretokens = regex.compile(_PRETOKEN)
        self.compatible: dict[int, bool] = {}
        self.cache_first, self.cache_later, self.cache_words = RecentCache(20_000), RecentCache(140_000), RecentCache(60_000)
        self._make_decoder(vocab, {x: b for b, x in enumerate(letters)})

    def _make_decoder(self, vocab: dict[str, int], byte_of: dict[str, int]) -> None:
        size = max([*vocab.values(), *self.added.values()]) + 1
        table = [b""] * size
        for name, i in [*vocab.items(), *self.added.items()]:
            table[i] = bytes(map(byte_of.__getitem__, name)) if all(c in byte_of for c in name) else name.encode()
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(x) for x in table], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when one follows the other.

        Undoes the later of the merges inside the two tokens step by step. If a pair that faces the
        boundary could have been merged before the merge undone last, the boundary wouldn't be there.
        """
        a, b, limit, good = left, right, sys.maxsize, True
        while True:
            merged = self.pair_rank.get(a << 32 | b)
            if merged is not None and merged < limit:
                good = False
                break
            # a merge on the left at the same rank happens first, one on the right after it
            if a > b and a >= 256 or b < 256 <= a:
                limit, a = a, self.halves[a][1]
            elif b >= 256:
                limit, b = b + 1, self.halves[b][0]
            else:
                break
        if len(self.compatible) > 250_000:
            self.compatible.clear()
        self.compatible[left << 32 | right] = good
        return good

    def ranks_of(self, word: str) -> list[int]:
        """The tokens, as ranks, of one pre-token whose bytes are given as characters."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        longest = [0] * len(word)
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        for end, token in self.automaton.iter(word):
            longest[end - lengths[token] + 1] = token  # later ends are longer
        out: list[int] = []
        closed = bytearray(len(word) + 1)
        at, token, size = 0, longest[0], len(word)
        while True:
            end = at + lengths[token]
            if not closed[end]:
                if out:
                    fits = compatible.get(out[-1] << 32 | token)
                    if fits is None:
                        fits = self._fits(out[-1], token)
                else:
                    fits = True
                if fits:
                    out.append(token)
                    at = end
                    if at == size:
                        return out
                    token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                closed[at] = 1
                last = out.pop()
                at -= lengths[last]
                token = shorter[last]

    def _words(self, words: list[str]) -> list[bytes]:
        of, ranks_of = self.ids.__getitem__, self.ranks_of
        return [array("i", map(of, ranks_of(word.encode().decode("latin-1")))).tobytes() for word in words]

    def _pieces(self, pieces: list[str], lead: str = "") -> list[bytes]:
        together = "\n".join(pieces)
        special = [x for x in self.added if x in together]
        # a piece that is one word is kept as a piece, so words are only kept for pieces of several
        cut: list[list | None] = []
        single: list[str] = []
        for piece in pieces:
            if piece.isalpha():
                single.append(lead + piece)
                cut.append(None)
            elif piece[-1:] in (".", ",") and piece[:-1].isalpha():
                cut.append([lead + piece[:-1], piece[-1]])
            else:
                cut.append(self._split(lead + piece, bool(special)))
        words, alone = self.cache_words, iter(self._words(single))
        words.fill({x for parts in cut if parts for x in parts if isinstance(x, str)}, self._words)
        return [next(alone) if parts is None else b"".join([words[x] if isinstance(x, str) else array("i", [x]).tobytes() for x in parts]) for parts in cut]

    def _split(self, piece: str, special: bool) -> list:
        """Pre-tokens, and the ids of special tokens between them."""
        if not special:
            return self.pretokens.findall(piece)
        parts, at = [], 0
        for m in self.special.finditer(piece):
            parts += [*self.pretokens.findall(piece[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return parts + self.pretokens.findall(piece[at:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as native 32-bit integers; a special token's string becomes its id."""
        cut = [[(safe_pieces(part), follows) for part, follows in safe_chunks(text or "")] for text in texts]
        firsts, laters = set(), set()
        for parts in cut:
            for pieces, follows in parts:
                (laters if follows else firsts).add(pieces[0])
                laters.update(pieces[1:])
        first, later = self.cache_first, self.cache_later
        first.fill(firsts, self._pieces)
        later.fill(laters, lambda new: self._pieces(new, " "))
        out = []
        for parts in cut:
            out.append(b"".join([(later if follows else first)[pieces[0]] + b"".join(map(later.__getitem__, pieces[1:])) for pieces, follows in parts]))
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where the bytes of the first ``ends[i]`` ids end."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        to = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(sizes, out=to[1:])
        index = np.arange(to[-1])
        index += np.repeat(starts - to[:-1], sizes)
        return self.bytes[index], to[ends]


def backtracking_bpe(path: str) -> BacktrackingBpe:
    """One encoder, with its caches, for all tasks of a Python worker."""
    return one_per_worker(("bpe", path), lambda: BacktrackingBpe(path))


def bpe_encoder(vocabulary: str = VOCABULARY, batch_bytes: int = 1 << 20):
    """An Arrow function from a text to its ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = backtracking_bpe(tokenizer_path(vocabulary))

        def ids(texts: list) -> pa.Array:
            data = bpe.encode(texts)
            offsets = np.zeros(len(data) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in data], out=offsets[1:])
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), dtype=np.int32)))

        yield from by_slices(ids, batches, batch_bytes)

    return encode


def bpe_decoder(vocabulary: str = VOCABULARY, batch_ids: int = 1 << 18):
    """An Arrow function from ids to their text; bytes that aren't UTF-8 become U+FFFD. Null ids give null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = backtracking_bpe(tokenizer_path(vocabulary))
        for batch in batches:
            texts, start, counts = [], 0, pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(counts)])
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(before, before[start] + batch_ids, "right")) - 1)
                part = batch.slice(start, stop - start)
                data, ends = bpe.decode(part.flatten().to_numpy(zero_copy_only=False), before[start : stop + 1] - before[start])
                data = data.tobytes()
                texts += [data[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())]
                start = stop
            yield pa.array(texts, pa.string(), mask=batch.is_null().to_numpy(zero_copy_only=False)) if texts else pa.array([], pa.string())

    return decode


def with_ids(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the ids of every whole text; null and empty texts have an empty list.

    All other columns are kept, one named as ``ids`` is replaced; repeated rows are encoded each for
    itself; an empty table gives an empty result.
    """
    return df.withColumn(ids, bpe_encoder(vocabulary)(F.coalesce(F.col(text), F.lit(""))))


def with_decoded(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the text of a list of ids; an empty list gives an empty text, null gives null."""
    return df.withColumn(text, bpe_decoder(vocabulary)(F.col(ids)))


def round_trip(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, batch_bytes: int = 1 << 20) -> DataFrame:
    """Adds ``ids`` and ``decoded``, the ids' text, by one function, so that a task needs one Python worker.

    Null and empty texts have no ids and an empty text; columns of these names are replaced, all others kept.
    """

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = backtracking_bpe(tokenizer_path(vocabulary))

        def convert(texts: list) -> pa.Array:
            data = bpe.encode(texts)
            before = np.zeros(len(data) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in data], out=before[1:])
            ids = np.frombuffer(b"".join(data), dtype=np.int32)
            out, ends = bpe.decode(ids, before)
            out = out.tobytes()
            decoded = [out[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())]
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(before), pa.array(ids)), pa.array(decoded, pa.string())], ["ids", "decoded"])

        yield from by_slices(convert, batches, batch_bytes)

    found = both(F.coalesce(F.col(text), F.lit("")))
    held = unused(df, "__both")
    return df.withColumn(held, found).withColumns({c: F.col(held)[c] for c in ("ids", "decoded")}).drop(held)
