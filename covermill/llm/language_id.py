"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text recognises every substring of that text. A text is
parsed into phrases: from where the last one ended, the longest match in the automaton, one character
at least. The language whose automaton needs the fewest phrases explains the text best (Ziv-Merhav
cross entropy): a phrase costs the logarithm of the longest training text, the same in all languages, so
a language with little text only needs more phrases. Phrases end with words, so a word's phrases
are counted once per cache generation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.functions.topk import first_rows_per_key
from covermill.llm.names import unused
from covermill.llm.pieces import RecentCache, one_per_worker, slices_by_bytes

#: The bounded sample that the automata are built of: documents per language, and characters of words.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 200, 60_000
#: Characters of all languages together; beyond so many languages each has an equal share of them.
TOTAL_CHARS = 64 * SAMPLE_CHARS
UNKNOWN = "und"

_RUN = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """Runs of letters and marks in lower case, each with a leading space."""
    return [" " + w for w in _RUN.findall(text.lower())]


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of each state, 0 being the start; a walk exists for exactly the substrings."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    return step


def phrases(step: list[dict[str, int]], word: str) -> int:
    """The number of longest matches that make up a word; an unknown character is a phrase."""
    n, state, start = 0, 0, step[0]
    for c in word:
        state = step[state].get(c, 0) if state else start.get(c, 0)
        if not state:
            n += 1
            state = start.get(c, 0)
    return n + (state > 0)


class Model:
    """The automata of all languages. A phrase costs all of them the same, so their numbers of phrases compare."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = [lang for lang, _ in samples]
        self.automata = [suffix_automaton(text) for _, text in samples]
        self.words = RecentCache(200_000)

    def _parse(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple([phrases(a, w) for a in self.automata]) for w in words]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            words = words_of(text)
            if not words or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            self.words.fill(set(words), self._parse)
            needed = np.array(list(map(self.words.__getitem__, words))).sum(axis=0)
            order = np.argsort(needed, kind="stable")
            best, second = needed[order[0]], needed[order[1]] if len(order) > 1 else np.inf
            out.append((self.languages[order[0]], float(1 - best / second)))
        return out


_SCHEMA = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predictor(samples, model_id: str, batch_bytes: int = 4 << 20):
    """An Arrow function from a text to (``lang_pred``, ``score``), given a broadcast of (language, text)."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = one_per_worker(("languages", model_id), lambda: Model(samples.value))
        for batch in batches:
            rows = [x for part in slices_by_bytes(batch, batch_bytes) for x in model.predict(part.to_pylist())]
            langs, scores = zip(*rows) if rows else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(_SCHEMA))

    return predict


def training_text(texts: list[str], chars: int) -> str:
    """About ``chars`` characters of words, an equal share from each text in turn, so that no long text fills it."""
    share = max(200, chars // max(1, len(texts)))
    parts, left = [], chars
    for text in texts:
        part = "".join(words_of(text[: 4 * share]))[:share]
        parts.append(part[:left])
        left -= len(parts[-1])
        if left <= 0:
            break
    return "".join(parts)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_documents: int = SAMPLE_DOCUMENTS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """Training text per language from a bounded sample: the first documents of each language in order of a hash.

    Every language is learned; rows with a null text or language teach nothing. Beyond ``TOTAL_CHARS``
    divided by ``sample_chars`` languages, each gets an equal share of ``TOTAL_CHARS``, 200 characters at least.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    languages = rows.select("lang").distinct().count()
    sample_chars = max(200, min(sample_chars, TOTAL_CHARS // max(1, languages)))
    sample_documents = max(1, min(sample_documents, sample_chars // 200))
    # ranked by hash alone, so that no text is moved before it is chosen
    chosen = first_rows_per_key(rows.select("lang", F.xxhash64("text").alias("h")).distinct(), ["lang"], [F.col("h")], sample_documents)
    share = 4 * max(200, sample_chars // sample_documents)
    # pairs of a name and a number, TOTAL_CHARS / 200 at most, or one per language
    chosen = F.broadcast(chosen)
    picked = rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, share).alias("text")).join(chosen, ["lang", "h"], "left_semi").distinct()
    by_lang: dict[str, list] = {}
    for r in picked.orderBy("lang", "h").collect():
        by_lang.setdefault(r.lang, []).append(r.text)
    samples = [(name, training_text(texts, sample_chars)) for name, texts in sorted(by_lang.items())]
    return [(name, s) for name, s in samples if s]


def with_language(df: DataFrame, samples: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1: how many fewer phrases than the next language) to every row.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was
    learned. Ties go to the first language in the alphabet. All other columns and all rows are kept, repeated
    ones too; a prediction uses the whole text, however long, and nothing else.
    """
    sc = df.sparkSession.sparkContext
    block = sc.broadcast(samples)
    found = predictor(block, f"{sc.applicationId}-{block._jbroadcast.id()}")(F.coalesce(F.col(text), F.lit("")))
    held = unused(df, "__lang")
    return df.withColumn(held, found).withColumns({c: F.col(held)[c] for c in ("lang_pred", "score")}).drop(held)
