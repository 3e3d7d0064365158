"""Article texts of HTML pages, by Arrow batches: JSON-LD bodies, article elements, paragraphs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

LEAST_BODY, LEAST_ARTICLE, LEAST_PARAGRAPH, LEAST_TEXT = 200, 300, 25, 180
_SKIPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template"))
_BLOCKS = frozenset(("p", "h1", "h2", "h3", "li", "blockquote"))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.published, self.blocks, self.article, self.ld = "", "", [], [], []
        self._text: list[str] = []
        self._skip = self._in_article = 0
        self._tag = ""
        self._ld = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "meta":
            key = a.get("property") or a.get("name") or ""
            if key in ("article:published_time", "date", "datePublished", "pubdate") and not self.published:
                self.published = a.get("content") or ""
            if key == "og:title" and not self.title:
                self.title = a.get("content") or ""
        self._ld = tag == "script" and a.get("type") == "application/ld+json"
        self._skip += tag in _SKIPPED
        self._in_article += tag in ("article", "main")
        if tag in _BLOCKS or tag == "title":
            self._flush()
            self._tag = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS or tag == "title":
            self._flush()
        self._skip = max(0, self._skip - (tag in _SKIPPED))
        self._in_article = max(0, self._in_article - (tag in ("article", "main")))
        self._ld = False

    def handle_data(self, data: str) -> None:
        if self._ld:
            self.ld.append(data)
        elif not self._skip:
            self._text.append(data)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if self._tag == "title":
            self.title = self.title or text
        elif self._tag and len(text) >= LEAST_PARAGRAPH:
            self.blocks.append(text)
            if self._in_article:
                self.article.append(text)
        self._tag = ""


def jsonld_bodies(blocks: list[str]) -> list[str]:
    """Article bodies of JSON-LD, depth first through graphs, main entities and lists; broken JSON has none."""
    out = []
    for block in blocks:
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = [*x, *todo]
            elif isinstance(x, dict):
                body = x.get("articleBody")
                if isinstance(body, str) and len(body) > LEAST_BODY:
                    out.append(body)
                todo = [*(x[k] for k in ("@graph", "mainEntity", "itemListElement") if k in x), *todo]
    return out


def extract(html: str | None) -> tuple[str, str, str, str]:
    """``(title, published, text, status)``; status ok, thin or empty."""
    if not html:
        return "", "", "", "empty"
    page = _Page()
    page.feed(html)
    page.close()
    article = "\n".join(page.article)
    text = article if len(article) > LEAST_ARTICLE else "\n".join(page.blocks)
    if len(text) < LEAST_TEXT and (bodies := jsonld_bodies(page.ld)):
        text = bodies[0]
    return page.title, page.published, text, "ok" if len(text) >= LEAST_TEXT else "thin" if text else "empty"


def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([extract(h) for h in s], columns=["title", "published", "text", "status"])


def article(html: Column) -> Column:
    """``struct<title, published, text, status>`` of a page; null and empty pages have the status empty. Needs a session."""
    return F.pandas_udf(_extracted, "title string, published string, text string, status string", PandasUDFType.SCALAR_ITER)(html)
