"""Web pages into text, tables, links and metadata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx

_HIDDEN = {"script", "style", "nav", "footer", "header"}
_EMPTY = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


#: What a tag's beginning closes, and the end of what bars that: as browsers read tables.
_CLOSES = {"td": ({"td", "th"}, "tr"), "th": ({"td", "th"}, "tr"), "tr": ({"tr", "td", "th"}, "table")}


class _Reader(HTMLParser):
    """Text and tables of a page. Tags may be unclosed, crossed or nested; no text is lost for that."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []  # the tags that are open
        self.text: list[str] = []
        self.late: list[tuple[int, list[str]]] = []  # text inside hidden tags that may never be closed
        self.tables: list[list[list[list[str]]]] = []  # open tables: rows of cells of pieces of text
        self.found: list[tuple[int, str]] = []  # closed tables, in order of their beginnings
        self.begun = 0
        self.numbers: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in _EMPTY:
            return
        if tag in _CLOSES:
            closes, bar = _CLOSES[tag]
            while self.open and self.open[-1] in closes and self.open[-1] != bar:
                self.open.pop()
        if tag in _HIDDEN:
            self.late.append((len(self.text), []))
        elif tag == "table":
            self.tables.append([])
            self.numbers.append(self.begun)
            self.begun += 1
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append([])
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:  # closes what stands open inside, too
            last = self.open.pop()
            if last in _HIDDEN and self.late:
                self.late.pop()
            elif last == "table":
                self._close_table()
            if last == tag:
                break

    def _close_table(self) -> None:
        rows = [" | ".join(" ".join(c) for c in r) for r in self.tables.pop() if any(map(any, r))]
        number = self.numbers.pop()
        if rows:
            self.found.append((number, "\n".join(rows)))

    def handle_data(self, data):
        data = data.strip()
        if not data:
            return
        if self.late:
            if not any(t in ("script", "style") for t in self.open):
                self.late[-1][1].append(data)
            return
        self.text.append(data)
        if self.tables and self.tables[-1] and self.tables[-1][-1] and any(t in ("td", "th") for t in self.open):
            self.tables[-1][-1][-1].append(data)

    def close(self):
        super().close()
        # A hidden tag that nothing closes hides nothing: its text is put back where it began.
        for at, pieces in reversed(self.late):
            self.text[at:at] = pieces
        while self.tables:
            self._close_table()
        self.found.sort()


def extract(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, kind, index, content): a page's text, one piece of text a line, and each of its tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, kind, index, content = [], [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                reader = _Reader()
                reader.feed(page or "")
                reader.close()
                for k, x, items in [("text", 0, ["\n".join(reader.text)]), *[("table", n, [t]) for n, (_, t) in enumerate(reader.found)]]:
                    if items[0]:
                        of.append(i), kind.append(k), index.append(x), content.append(items[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(kind, pa.string()), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=[id_col, "kind", "index", "content"])

    return pages.select(id_col, html).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, kind string, index int, content string")


def title(html: Column) -> Column:
    return F.nullif(tx.strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'(?is)<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"', 1), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def visible_text(html: Column) -> Column:
    """Text without tags and hidden elements, by patterns alone: the fast way for well-formed pages."""
    c = tx.replace(html, r"(?is)<(script|style|nav|footer|header)\b.*?</(script|style|nav|footer|header)>", " ")
    return tx.strip(tx.collapse(tx.replace(c, r"(?s)<[^>]*>", " ")))
