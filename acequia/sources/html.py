"""Landed HTML pages: search cards and detail pages (survey S1, S4-S6, T7), by the standard library.

Selectors are a tag with classes ("h1.title"), several joined by commas; the first element
of the document that fits any of them counts. Unclosed tags are tolerated.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "classes", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.classes, self.children = tag, attrs, frozenset(attrs.get("class", "").split()), []

    def walk(self) -> Iterator[Node]:
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                stack.extend(reversed(n.children))
            else:
                yield n

    def text(self, sep: str = "") -> str:
        """The stripped text pieces, joined."""
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)

    def fits(self, selector: str) -> bool:
        tag, *classes = selector.strip().split(".")
        return (not tag or self.tag == tag) and self.classes.issuperset(classes)

    def first(self, selectors: str) -> Node | None:
        options = selectors.split(",")
        return next((n for n in self.walk() if any(n.fits(s) for s in options)), None)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag == "li":  # an item ends the one before it in the same list
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ("ul", "ol"):
                    break
                if self.open[i].tag == "li":
                    del self.open[i:]
                    break
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def search_cards(html: str | None) -> list[tuple[str, str, str, str, str]]:
    """(address, title, company, place, date) of each card with an address and a title."""
    out = []
    for li in parse(html).walk():
        card = li.first("div.base-search-card") if li.tag == "li" else None
        if card is None:
            continue
        get = lambda s: (n.text() if (n := card.first(s)) else "")  # noqa: E731, B023
        link, when = card.first("a.base-card__full-link"), card.first("time.job-search-card__listdate")
        url = link.attrs.get("href", "").split("?")[0] if link else ""
        title = get("h3.base-search-card__title")
        if url and title:
            date = when.attrs.get("datetime", "") if when else ""
            out.append((url, title, get("h4.base-search-card__subtitle"), get("span.job-search-card__location"), date))
    return out


# Where the fields of detail pages are; a name with "+" joins its texts by spaces.
DETAIL_SELECTORS = {
    "job": {
        "title": "h1.topcard__title, h1.top-card-layout__title, h3.t-24",
        "company": "a.topcard__org-name-link, span.topcard__flavor",
        "location": "span.topcard__flavor--bullet, span.topcard__flavor.topcard__flavor--bullet",
        "description+": "div.description__text, div.show-more-less-html__markup",
    },
    "person": {
        "name": "h1.top-card-layout__title, h1.font-bold",
        "headline": "div.top-card-layout__second-headline, h2.top-card-layout__headline",
        "about+": "section.summary, div.inline.break-words",
    },
    "company": {
        "name": "h1.org-top-card-summary__title, h1.org-page-details__name",
        "tagline": "p.org-top-card-summary__tagline, h2.org-page-details__tagline",
        "industry": "dd.org-page-details__definition-text, span.org-top-card-summary__info-item",
    },
}


def detail_page(html: str | None, kind: str, key: str = "") -> dict[str, str]:
    """The fields of a detail page; a company without a name element gets its key."""
    root = parse(html)
    out = {}
    for name, selectors in DETAIL_SELECTORS[kind].items():
        node = root.first(selectors)
        missing = key if kind == "company" and name == "name" else ""
        out[name.rstrip("+")] = node.text(" " if name.endswith("+") else "") if node else missing
    return out


CARD_SCHEMA = "pos int, job_url string, title string, company string, location string, posted_date string"


def card_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """S1 over a table of search pages: one row per card."""
    kind = dict(pages.dtypes)[key]
    names = [key, *[c.split()[0] for c in CARD_SCHEMA.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, i, *c) for k, h in zip(pdf.k, pdf.h) for i, c in enumerate(search_cards(h))], columns=names)

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"{key} {kind}, {CARD_SCHEMA}")


def detail_records(pages: DataFrame, key: str, html: str, kind: str) -> DataFrame:
    """S4-S6 over a table of detail pages."""
    fields = [n.rstrip("+") for n in DETAIL_SELECTORS[kind]]
    schema = f"{key} string, " + ", ".join(f"{f} string" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *detail_page(h, kind, k or "").values()) for k, h in zip(pdf.k, pdf.h)]
            yield pd.DataFrame(rows, columns=[key, *fields])

    return pages.select(F.col(key).cast("string").alias("k"), F.col(html).alias("h")).mapInPandas(run, schema)
