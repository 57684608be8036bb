"""Text of the first page element with a class or id, in Arrow batches.

Elements nest, which no column expression can follow, so a tag parser reads each page.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get this module's code with the task, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

# A class or id whose value may be written with character references.
_REFERENCE = re.compile(r"""(?:class|id)\s*=+\s*(?:"[^"]*&|'[^']*&|[^\s>]*&)""", re.I)


class _Block:
    """The text of the first element that matches '.class' or '#id', nested elements included."""

    def __init__(self, selector: str):
        self.attr = "class" if selector[0] == "." else "id"
        self.want = selector[1:]
        self.open: list[str] = []
        self.found = self.done = False
        self.texts: list[str] = []

    def _matches(self, attrs) -> bool:
        value = next((v for k, v in attrs if k == self.attr), None) or ""
        return self.want in value.split() if self.attr == "class" else self.want == value

    def start(self, tag: str, attrs, closed: bool) -> None:
        if self.done or not (self.open or self._matches(attrs)):
            return
        self.found = True
        if not closed and tag not in _VOID:
            self.open.append(tag)
        self.done = not self.open

    def end(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.done = not self.open

    def data(self, text: str) -> None:
        if self.open and not self.done and self.open[-1] not in ("script", "style"):
            self.texts.append(text)


class _Blocks(HTMLParser):
    """One pass over a page for the first elements of several selectors."""

    def __init__(self, selectors: set[str]):
        super().__init__(convert_charrefs=True)
        self.blocks = {s: _Block(s) for s in selectors}

    def handle_starttag(self, tag, attrs):
        for b in self.blocks.values():
            b.start(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        for b in self.blocks.values():
            b.start(tag, attrs, True)

    def handle_endtag(self, tag):
        for b in self.blocks.values():
            b.end(tag)

    def handle_data(self, data):
        text = data.strip()
        if text:
            for b in self.blocks.values():
                b.data(text)


def block_texts(page: str, kinds: list[list[str]]) -> list[str | None]:
    """For each list of selectors, the text of the first element that the first matching selector finds."""
    wanted = {s for selectors in kinds for s in selectors}
    if wanted and not _REFERENCE.search(page):
        # a name that the page doesn't hold can't be found, and most pages hold none
        wanted = {s for s in wanted if s[1:] in page}
    parser = _Blocks(wanted)
    if parser.blocks:
        parser.feed(page)
        parser.close()
    found = [next((parser.blocks[s] for s in selectors if s in wanted and parser.blocks[s].found), None) for selectors in kinds]
    return [(" ".join(b.texts) or None) if b else None for b in found]


def block_text(page: str, selectors: list[str]) -> str | None:
    return block_texts(page, [selectors])[0]


def block_udf(selectors: dict[str, dict[str, list[str]]], kinds: list[str]):
    """A function of (page, brand) columns to a struct with one block per kind."""
    names = [f"{k}_block" for k in kinds]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def blocks(page: pd.Series, brand: pd.Series) -> pd.DataFrame:
        rows = [
            block_texts(p, [selectors.get(b or "", {}).get(k, []) for k in kinds]) if p else [None] * len(kinds) for p, b in zip(page, brand)
        ]
        return pd.DataFrame(rows, columns=names, dtype=object)

    return F.pandas_udf(blocks, schema)
