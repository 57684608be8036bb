"""Quality rules by tokeniser fertility: how a public vocabulary takes a text tells prose from junk.

A text's words are encoded with a vocabulary that has byte fallback. Prose of a language the
vocabulary knows takes a typical number of characters per token, falls back on bytes or bare symbols
hardly ever, and spreads over many tokens; symbol noise, broken encodings and text that repeats itself
leave these bands, which are set per script and may be set per language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermill.llm.library_tokens import tokenizer_path
from covermill.llm.names import unused
from covermill.llm.pieces import RecentCache, one_per_worker, slices_by_bytes

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
#: Marks that symbol noise is made of; Unicode has some of them as punctuation.
_BARE = "#*%&@\\_/"
_BLANKS = " \t\n\x0b\x0c\r"

_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_subwords long, n_byte_tokens long, n_symbol_tokens long, token_entropy double, script string"
_SCHEMA = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("n_subwords", pa.int64()), ("n_byte_tokens", pa.int64()), ("n_symbol_tokens", pa.int64()), ("token_entropy", pa.float64()), ("script", pa.string()),
])


class Fertility:
    """Ids of words under a sentencepiece vocabulary, each word taken for itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        # neither letters nor digits nor the marks of written language
        bare = [self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.vocab_size())]
        self.is_symbol = np.array([bool(x) and all(c in _BARE or unicodedata.category(c)[0] == "S" for c in x) for x in bare])
        self.words = RecentCache()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.model.encode([w.decode() for w in words], num_threads=1)
        return [np.array(ids, dtype="<u2").tobytes() for ids in found]

    def measure(self, texts: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(tokens, byte tokens, symbol tokens, entropy in bits) of each text's words."""
        cut = [text.split() for text in texts]
        wanted: set = set()
        for words in cut:
            wanted.update(words)
        self.words.fill(wanted, self._encode)
        out = []
        for words in cut:
            ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u2")
            if not len(ids):
                out.append((0, 0, 0, 0.0))
                continue
            used, counts = np.unique(ids, return_counts=True)
            share = counts / len(ids)
            out.append((len(ids), int(counts[self.is_byte[used]].sum()), int(counts[self.is_symbol[used]].sum()), float(-(share * np.log2(share)).sum())))
        return out


def fertility(path: str) -> Fertility:
    """One model, with its cache, for all tasks of a Python worker."""
    return one_per_worker(("fertility", path), lambda: Fertility(path))


def repeated_words(words: list, window: int = 3) -> int:
    """Words that stand in a window of ``window`` words found twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen = list(zip(*(islice(words, k, None) for k in range(window))))
    counts: dict = {}
    if len(set(seen)) == n:
        return 0
    for x in seen:
        counts[x] = counts.get(x, 0) + 1
    marked = bytearray(len(words))
    one = b"\x01" * window
    for i, x in enumerate(seen):
        if counts[x] > 1:
            marked[i : i + window] = one
    return sum(marked)


#: First and last code points of letters by script.
_SCRIPTS = [
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xAA, 0xAA), ("Latin", 0xBA, 0xBA), ("Latin", 0xC0, 0xD6), ("Latin", 0xD8, 0xF6), ("Latin", 0xF8, 0x2AF),
    ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x531, 0x587), ("Hebrew", 0x5D0, 0x5F2), ("Arabic", 0x620, 0x6FF), ("Devanagari", 0x904, 0x97F),
    ("Bengali", 0x985, 0x9B9), ("Tamil", 0xB85, 0xBB9), ("Thai", 0xE01, 0xE4E), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3041, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7A3), ("Han", 0x20000, 0x323AF),
]
_NAMES = [name for name, _, _ in _SCRIPTS]
_FIRST = np.array([a for _, a, _ in _SCRIPTS])
_LAST = np.array([b for _, _, b in _SCRIPTS])
_ASCII_LETTER = regex.compile("[A-Za-z]")


def script_of(text: str) -> str:
    """The script of most letters; ``other`` if none of the listed scripts has a letter in the text. Ties go to the first in the alphabet."""
    if text.isascii():
        return "Latin" if _ASCII_LETTER.search(text) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    at = np.searchsorted(_FIRST, points, "right") - 1
    hits = np.bincount(at[(at >= 0) & (points <= _LAST[at])], minlength=len(_NAMES))
    totals: dict[str, int] = {}
    for name, n in zip(_NAMES, hits.tolist(), strict=True):
        totals[name] = totals.get(name, 0) + n
    best = min(totals, key=lambda x: (-totals[x], x))
    return best if totals[best] else "other"


def _measure(texts: list[str], model: Fertility) -> list[tuple]:
    raw = [t.encode() for t in texts]
    out = []
    for text, data, tokens in zip(texts, raw, model.measure(raw), strict=True):
        words = data.split()  # of bytes: ASCII white space only
        chars = len(text) - sum(map(text.count, _BLANKS))
        lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
        out.append((len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), *tokens, script_of(text)))
    return out


def measures(vocabulary: str = VOCABULARY, batch_bytes: int = 4 << 20):
    """An Arrow function from a text to its measures."""

    @F.arrow_udf(_MEASURES)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = fertility(tokenizer_path(vocabulary))
        for batch in batches:
            rows = [x for part in slices_by_bytes(batch, batch_bytes) for x in _measure(part.to_pylist(), model)]
            columns = list(zip(*rows)) if rows else [()] * len(_SCHEMA)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], fields=list(_SCHEMA))

    return measure


#: Bands (low, high) of characters per token, and the largest byte share, the largest symbol share and the
#: least entropy in bits. Wide enough for any prose: the vocabulary takes 1.6 to 2.6 characters of the
#: hardest and 3 to 6 of the easiest Latin text; scripts it spells in bytes take less than one.
BANDS = {
    "Latin": (1.3, 8.0, 0.10, 0.07, 4.0),
    "Cyrillic": (1.0, 8.0, 0.10, 0.07, 4.0),
    "Greek": (0.7, 8.0, 0.30, 0.07, 4.0),
    "Han": (0.3, 4.0, 0.80, 0.07, 4.0),
    "Kana": (0.3, 4.0, 0.80, 0.07, 4.0),
    "Hangul": (0.3, 4.0, 0.80, 0.07, 4.0),
}
#: For every other script: any share of bytes, since the vocabulary may not hold its letters.
ANY_SCRIPT = (0.2, 8.0, 1.0, 0.07, 4.0)


def _in_band(m: Column, bands: tuple) -> Column:
    low, high, most_bytes, most_symbols, least_entropy = bands
    per_token = m["word_chars"] / m["n_subwords"]
    return (
        per_token.between(low, high)
        & (m["n_byte_tokens"] <= most_bytes * m["n_subwords"])
        & (m["n_symbol_tokens"] <= most_symbols * m["n_subwords"])
        & (m["token_entropy"] >= least_entropy)
    )


def with_quality(df: DataFrame, text: str = "text", lang: str | None = None, bands: dict | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept`` to every row.

    ``base_failed``: fewer than 50 words, or more than half of them in 3-word windows found before or
    again. ``kept`` needs the base rules and every band of the text's script; with ``lang``, a column, a
    language named in ``bands`` goes by its own. Null and empty texts have no words and fail. Columns
    of the new names are replaced, all others kept; repeated rows are measured each for itself,
    and texts whole, however long.
    """
    bands = {**BANDS, **(bands or {})}
    body = F.coalesce(F.col(text), F.lit(""))
    held = unused(df, "__measures")
    m = F.col(held)
    kind = F.coalesce(F.when(F.col(lang).isin(*bands), F.col(lang)), m["script"]) if lang else m["script"]
    good = _in_band(m, ANY_SCRIPT)
    for name, band in bands.items():
        good = F.when(kind == name, _in_band(m, band)).otherwise(good)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    new = {f.name: m[f.name] for f in _SCHEMA}
    return df.withColumn(held, measures(vocabulary)(body)).withColumns({**new, "base_failed": failed, "kept": ~failed & F.coalesce(good, F.lit(False))}).drop(held)


def keep_good(df: DataFrame, text: str = "text", lang: str | None = None, bands: dict | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows that pass, with the columns they came with, whatever their names."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("held"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    return with_quality(held, "text", "lang" if lang else None, bands, vocabulary).where("kept").select("held.*")
