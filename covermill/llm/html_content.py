"""HTML extraction: the maximum-scoring run of a page's words and tags.

A page is read as a sequence of words and tags. Words score positive, tags negative, with weights by
where a word stands and what a tag is, learned from pages whose authors marked the main content. One
linear scan finds the contiguous run of the highest sum; the weights decide no more than where it begins
and ends. Inside it, elements that are never content (menus, forms, adverts, comments ...) are left out,
unless they hold the page's content.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.pieces import slices_by_bytes
from covermill.llm.sampling import bounded_sample

#: Pages that the weights are learned from: the first of an order by hash of those with marked content.
SAMPLE_PAGES = 1_000
#: Elements whose content is the label; they are no feature.
LABELS = ("article", "main")

#: Fixed values of HTML: elements without content, elements whose text is no markup, elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "audio button canvas datalist iframe map math noscript object select svg template textarea video".split()
)
#: Those whose own blocks do not end the paragraph around them.
ISLANDS = frozenset("audio button canvas datalist iframe map math noscript object select svg template textarea video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never main content, and words that say so as a whole class, id or role of a block.
#: As a part of such a name, and as names that may stand for content too, they only lower the score of what the block holds.
NEVER = frozenset("head nav footer aside form script style noscript template svg button select option textarea iframe menu datalist".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal overlay "
    "comment comments reply replies disqus nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar widget widgets footer header masthead toolbar "
    "copyright complementary contentinfo".split()
)
DOUBT_WORDS = frozenset("share sharing social related recommended newsletter subscribe subscription signup login search hidden".split())
_INSIDE_WORDS = NEVER_WORDS - {"header"}
#: What an element inside a line that is left out costs the run: its paragraph goes on behind it.
_GAP = -0.1
_CLOSED_BY_BLOCK = frozenset(("p",))
_CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<raw>script|style)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>?",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_SPLIT_NAME = re.compile(r"[^a-z]+")

WORD, TAG, SKIPPED, DOUBTFUL = 0, 1, 2, 3
#: What a name says of its block.
NOTHING, DOUBT, HIDE = 0, 1, 2


def _names(name: str, rest: str, inside: bool) -> tuple[str, int]:
    """The first class of a tag, and what its class, id or role says of it: HIDE, DOUBT or NOTHING.

    A header inside the main content is its title. What is hidden at first may be shown later, so it is doubtful only.
    """
    words = _INSIDE_WORDS if inside else NEVER_WORDS
    first, says = "", DOUBT if _HIDDEN.search(rest) else NOTHING
    for kind, value in _NAMED.findall(rest):
        value = html.unescape(value.strip("\"'")).lower()
        if kind.lower() == "class" and not first:
            first = (value.split() or [""])[0]
        if name in INLINE or name in HEADINGS:
            continue
        if not words.isdisjoint(value.split()):
            says = HIDE
        elif says == NOTHING:
            parts = _SPLIT_NAME.split(value)
            says = NOTHING if words.isdisjoint(parts) and DOUBT_WORDS.isdisjoint(parts) else DOUBT
    return first, says


def _walk(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(event, name or text, attributes, place) in page order: ``text``, ``open``, ``void``, ``close`` per element, ``break`` of a line."""
    stack: list[str] = []
    at = 0
    for m in [*_TOKEN.finditer(page), None]:
        text = page[at : m.start()] if m else page[at:]
        if text:
            yield "text", text, "", at
        if m is None:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            yield "break", "", "", at
        closed = len(stack)
        if m["end"]:
            closed = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] == name), closed)
        elif name not in INLINE and name not in VOID and not m["rest"].endswith("/"):
            near = list(takewhile(lambda k: stack[k] not in ISLANDS, range(len(stack) - 1, max(-1, len(stack) - 4), -1)))
            closed = next((k for k in near if stack[k] in _CLOSED_BY_BLOCK or (stack[k] == name and name in _CLOSED_BY_SAME)), closed)
        while len(stack) > closed:
            yield "close", stack.pop(), "", at
        if m["end"]:
            continue
        if name in VOID or m["rest"].endswith("/"):
            yield "void", name, m["rest"], at
        else:
            yield "open", name, m["rest"], at
            stack.append(name)
    while stack:
        yield "close", stack.pop(), "", at


def _spared(events: list[tuple[str, str, str, int]]) -> set[int]:
    """The places of elements that hold the page's content whatever their names say.

    Those are elements around an article or main, unless another of more words stands outside; in a page
    without, blocks and forms of more than half of its words.
    """
    found: list[tuple[int, str, int, int, int, int]] = []  # place, name, first and last event, words, words of the largest label inside
    stack: list[list] = []
    words = dark = 0
    for k, (event, name, _, at) in enumerate(events):
        if event == "text" and not dark:
            words += len(name.split())
        elif event == "open":
            stack.append([at, name, k, words, -1])
            dark += name in ("head", "noscript", "template")
        elif event == "close":
            start, name, first, before, largest = stack.pop()
            dark -= name in ("head", "noscript", "template")
            found.append((start, name, first, k, words - before, largest))
            if stack:
                stack[-1][4] = max(stack[-1][4], largest, words - before if name in LABELS else -1)
    marked = [x for x in found if x[1] in LABELS]
    if not marked:
        return {start for start, name, _, _, n, _ in found if 2 * n > words and (name == "form" or name not in NEVER) and name != "header"}
    # the most words of labels that end before, or begin after, an event
    ends, starts = sorted((x[3], x[4]) for x in marked), sorted(((x[2], x[4]) for x in marked), reverse=True)
    upto, after = np.maximum.accumulate([n for _, n in ends]), np.maximum.accumulate([n for _, n in starts])
    end_at, start_at = [k for k, _ in ends], [-k for k, _ in starts]
    out = set()
    for start, _, first, last, _, largest in found:
        before, behind = bisect_left(end_at, first), bisect_left(start_at, -last)
        outside = max(upto[before - 1] if before else 0, after[behind - 1] if behind else 0)
        if largest >= outside:  # it is -1 without a label inside
            out.add(start)
    return out


def tokens(page: str) -> Iterator[tuple[int, str, str, bool, bool]]:
    """(kind, feature, text, whether a block ends before it, whether it is inside a label) in page order.

    A word token is one text node with its context, ``element.class`` of the nearest block with ``>a`` inside
    a link; a tag token is an opening tag. What is never content is one token for the whole element.
    """
    events = list(_walk(page))
    spared: set[int] | None = None
    stack: list[tuple[str, str, bool, bool]] = []  # name, context, never content, doubtful
    contexts = ["body"]
    labels = links = never = doubts = 0
    broken = True
    for event, name, rest, at in events:
        if event == "break":
            broken = True
        elif event == "text":
            if not never:
                yield DOUBTFUL if doubts and not labels else WORD, contexts[-1] + ">a" * (links > 0), name, broken, labels > 0
                broken = False
        elif event == "close":
            _, block, hidden, doubt = stack.pop()
            labels -= name in LABELS
            links -= name == "a"
            never -= hidden
            doubts -= doubt
            if block:
                contexts.pop()
        elif event == "void":
            if not never:
                yield TAG, name, "", broken, labels > 0
        else:
            first, says = _names(name, rest, labels > 0) if rest else ("", NOTHING)
            if name in NEVER or (name == "header" and not labels):
                says = HIDE
            elif name == "dialog" and says == NOTHING:
                says = DOUBT
            if name in ("html", "body", *LABELS):
                says = NOTHING
            if says != NOTHING and not never and name != "head":
                spared = _spared(events) if spared is None else spared
                says = NOTHING if at in spared else says
            hidden, doubt = says == HIDE, says == DOUBT
            feature = f"{name}.{first}" if first else name
            if name not in LABELS and not never:
                yield (SKIPPED, name, "", broken, labels > 0) if hidden else (TAG, feature, "", broken, labels > 0)
            block = "" if name in INLINE or name in LABELS else feature
            stack.append((name, block, hidden, doubt))
            labels += name in LABELS
            links += name == "a"
            never += hidden
            doubts += doubt
            if block:
                contexts.append(block)


def _plain(feature: str) -> str:
    """A feature without its class: what is used where the class hasn't been seen."""
    name, link, _ = feature.partition(">")
    return name.partition(".")[0] + link + ("a" if link else "")


def count_features(page: str) -> Counter:
    """(kind, feature, inside) counts of a page with marked content; words count each."""
    counts: Counter = Counter()
    for kind, feature, text, _, inside in tokens(page):
        if kind == DOUBTFUL:
            continue
        n = len(text.split()) if kind == WORD else 1
        if not n:
            continue  # white space says nothing of where it stands
        for f in {feature, _plain(feature)}:
            counts[kind, f, inside] += n
    return counts


def learn_weights(counts: dict[tuple[int, str, bool], int]) -> dict[tuple[int, str], float]:
    """Log odds of standing inside the content: -1 to 1 for words, -1 to -0.05 for tags."""
    weights = {}
    for kind, feature in {(k, f) for k, f, _ in counts}:
        odds = float(np.log((counts.get((kind, feature, True), 0) + 1) / (counts.get((kind, feature, False), 0) + 1)))
        weights[kind, feature] = max(-1.0, min(1.0, odds)) if kind == WORD else max(-1.0, min(-0.05, odds))
    return weights


def main_text(page: str, weights: dict[tuple[int, str], float]) -> str:
    """The text of the best run: character references decoded, white space in blocks as one space, blocks joined by one."""
    best, run = 0.0, 0.0
    parts: list[tuple[str, bool]] = []  # text, block ends before
    start = first = last = 0
    for kind, feature, text, broken, _ in tokens(page):
        if kind == WORD:
            text = html.unescape(text)
            score = len(text.split()) * weights.get((WORD, feature), weights.get((WORD, _plain(feature)), 0.5))
        elif kind == DOUBTFUL:
            text = html.unescape(text)
            score = -0.5 * len(text.split())
        else:
            score = (_GAP if feature in INLINE else -0.5) if kind == SKIPPED else weights.get((TAG, feature), weights.get((TAG, _plain(feature)), -0.2))
        # blanks between elements separate, but neither begin nor end a run
        if run <= 0:
            run, start = 0.0, len(parts)
        run += score
        parts.append((text, broken))
        if run > best:
            best, first, last = run, start, len(parts)
    out = []
    for text, broken in parts[first:last]:
        if broken:
            out.append(" ")
        out.append(text)
    return " ".join("".join(out).split())


_COUNTS = "kind int, feature string, inside boolean, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for part in slices_by_bytes(batch.column(0)):
            for page in part.to_pylist():
                total.update(count_features(page))
        rows = [(k, f, i, n) for (k, f, i), n in total.items()]
        columns = list(zip(*rows)) or [(), (), (), ()]
        types = (pa.int32(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "feature", "inside", "n"])


def learn(pages: DataFrame, column: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[tuple[int, str], float]:
    """Weights from a bounded sample of the pages that mark their main content with ``article`` or ``main``."""
    marked = pages.select(F.col(column).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    rows = bounded_sample(marked, ["html"], sample_pages).mapInArrow(_count, _COUNTS).groupBy("kind", "feature", "inside").agg(F.sum("n").alias("n")).collect()
    return learn_weights({(r.kind, r.feature, r.inside): r.n for r in rows})


def extractor(weights, batch_bytes: int = 4 << 20):
    """An Arrow function from a page to its main text, given the broadcast weights."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [main_text(page, weights.value) for part in slices_by_bytes(batch, batch_bytes) for page in part.to_pylist()]
            yield pa.array(texts, pa.string())

    return extract


def with_main_text(pages: DataFrame, weights: dict[tuple[int, str], float], column: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text and ``n_chars``, its code points, to every row.

    A null or empty page, and one without content, has an empty text. Without any weights words count
    0.5 and tags -0.2. Columns of the new names are replaced, all others kept.
    """
    block = pages.sparkSession.sparkContext.broadcast(weights)
    return pages.withColumn(text, extractor(block)(F.coalesce(F.col(column), F.lit("")))).withColumn("n_chars", F.length(text).cast("long"))
