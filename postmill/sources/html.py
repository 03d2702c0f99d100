"""Visible text, links and tables of HTML pages, read in Arrow batches with the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

LINKS = ArrayType(StructType().add("href", "string").add("text", "string"))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    def __init__(self, skip: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.deep, self.text = skip, [], []
        self.links: list[dict[str, str]] = []
        self.open_link: dict[str, str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.skip and tag not in VOID:
            self.deep.append(tag)
        if tag == "a" and not self.deep:
            self.open_link = {"href": dict(attrs).get("href") or "", "text": ""}
            self.links.append(self.open_link)

    def handle_endtag(self, tag: str) -> None:
        if self.deep and tag == self.deep[-1]:
            self.deep.pop()
        if tag == "a":
            self.open_link = None

    def handle_data(self, data: str) -> None:
        if not self.deep and data.strip():
            self.text.append(data.strip())
            if self.open_link is not None:
                self.open_link["text"] = " ".join([self.open_link["text"], data.strip()]).strip()


def read_page(html: str | None, skip: frozenset[str] = frozenset({"dialog", "nav", "footer", "script", "style"})) -> tuple[str, list[dict[str, str]]]:
    r = _Reader(skip)
    r.feed(html or "")
    r.close()
    return " ".join(" ".join(r.text).split()), r.links


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """The text of a page without dialogs, navigation, footers, scripts and styles, joined by spaces."""
    return html.map(lambda x: read_page(x)[0])


@F.pandas_udf(LINKS)
def anchors(html: pd.Series) -> pd.Series:
    """The links of a page in order, with their text."""
    return html.map(lambda x: read_page(x)[1])


@F.pandas_udf(StringType())
def _tagless(html: pd.Series) -> pd.Series:
    return html.map(lambda x: read_page(x, frozenset({"script", "style"}))[0])


def plain_text(html: Column) -> Column:
    """The text of a piece of HTML, joined by single spaces; text without marks never leaves the JVM."""
    plain = F.trim(F.regexp_replace(html, r"(?U)\s+", " "))
    return F.when(F.contains(html, F.lit("<")) | F.contains(html, F.lit("&")), _tagless(html)).otherwise(plain)


def posting_links(html: Column, pattern: str) -> Column:
    """The links whose address matches a pattern, each address once, in order."""
    hits = F.filter(anchors(html), lambda a: a["href"].rlike(pattern))
    return F.array_distinct(F.transform(hits, lambda a: a["href"]))
