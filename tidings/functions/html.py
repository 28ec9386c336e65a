"""HTML to text and links: the one place where a row needs Python.

Each function is an Arrow-batched ``pandas_udf`` over one HTML column, so Spark still prunes
columns, splits files and spreads rows. Documents are parsed whole.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings import lexicon

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINK_SCHEMES = frozenset(["http", "https", "mailto"])
_fields = lambda **types: T.StructType([T.StructField(n, t) for n, t in types.items()])
_string, _int = T.StringType(), T.IntegerType()
LINK_TYPE = T.ArrayType(_fields(href=_string, text=_string, char_start_idx=_int, char_end_idx=_int))
DOC_TYPE = _fields(article_text=_string, links=LINK_TYPE)
ANCHOR_TYPE = T.ArrayType(_fields(text=_string, href=_string))
HYPERLINK_TYPE = T.ArrayType(
    _fields(href=_string, title=_string, itemscope=_string, itemprop=_string, text=_string)
)


class _Pieces(HTMLParser):
    """Flat list of text pieces and anchors of a page, without the content of some tags.

    ``items`` holds ("text", str), ("open", attributes) and ("close", None) in page order.
    """

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.items: list[tuple[str, object]] = []
        self._skipping: list[str] = []  # open dropped tags
        self._in_anchor = False

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            if tag not in VOID_TAGS:
                self._skipping.append(tag)
            return
        if tag == "body" and self._skipping and self._skipping[0] == "head":
            self._skipping.clear()  # a body ends a head nobody closed
        if self._skipping or tag != "a":
            return
        if self._in_anchor:  # anchors do not nest: a new one closes the old one
            self.items.append(("close", None))
        self.items.append(("open", {k: v or "" for k, v in attrs}))
        self._in_anchor = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self._skipping:
            while self._skipping.pop() != tag:
                pass
        elif not self._skipping and tag == "a" and self._in_anchor:
            self.items.append(("close", None))
            self._in_anchor = False

    def handle_data(self, data):
        if not self._skipping:
            self.items.append(("text", data))


def page_items(html: str | None, dropped=frozenset(lexicon.DROPPED_TAGS)) -> list[tuple[str, object]]:
    parser = _Pieces(dropped)
    parser.feed(html or "")
    parser.close()
    if parser._in_anchor:
        parser.items.append(("close", None))
    return parser.items


def page_anchors(html: str | None, dropped=frozenset()) -> list[tuple[dict, str]]:
    """(attributes, inner text) of every anchor."""
    out: list[tuple[dict, str]] = []
    current: tuple[dict, list[str]] | None = None
    for kind, value in page_items(html, dropped):
        if kind == "open":
            current = (value, [])
        elif kind == "close" and current:
            out.append((current[0], "".join(current[1])))
            current = None
        elif kind == "text" and current:
            current[1].append(value)
    return out


def page_text(html: str | None) -> str:
    pieces = [v for k, v in page_items(html) if k == "text"]
    return re.sub(r"\n+\s*", "\n", " ".join(pieces))


def plain_text(html: str | None) -> str:
    pieces = [v for k, v in page_items(html, frozenset()) if k == "text"]
    return " ".join(pieces).strip()


def text_with_link_offsets(html: str | None) -> dict:
    """Text of a page together with its links and where they lie in that text.

    Between links the text is one trimmed chunk; a link is its own text with one space either
    side. Text is the concatenation of both, so ``text[start:end]`` is always the link text.
    Markup signs in the text stay escaped. An anchor without an address, or with one of another
    scheme (``javascript:``), goes together with its text.
    """
    chunks: list[str] = [""]
    links: list[tuple[str, str]] = []
    anchor: tuple[str, list[str]] | None = None
    for kind, value in page_items(lexicon.to_ascii(html or "")):
        if kind == "open":
            anchor = (value.get("href", "").strip(), [])
        elif kind == "close" and anchor:
            href, inner = anchor
            scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.\-]*):(?!\d)", href)
            if href and (not scheme or scheme[1].lower() in LINK_SCHEMES):
                links.append((href, f" {_one_line(''.join(inner)).strip()} "))
                chunks.append("")
            else:
                chunks[-1] += " "
            anchor = None
        elif kind == "text":
            piece = escape(value, quote=False)
            if anchor:
                anchor[1].append(piece)
            else:
                chunks[-1] += piece
    out, text, at = [], [], 0
    for i, chunk in enumerate(chunks):
        chunk = _one_line(chunk).strip()
        text.append(chunk)
        at += len(chunk)
        if i < len(links):
            href, shown = links[i]
            out.append({"href": href, "text": shown, "char_start_idx": at, "char_end_idx": at + len(shown)})
            text.append(shown)
            at += len(shown)
    return {"article_text": "".join(text), "links": out}


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text)


@F.pandas_udf(_string)
def html_to_text(html: pd.Series) -> pd.Series:
    """Text of a page without scripts, navigation and the like; one line end at a time."""
    return html.map(page_text)


@F.pandas_udf(_string)
def html_plain(html: pd.Series) -> pd.Series:
    """All text of a page, pieces joined by spaces."""
    return html.map(plain_text)


@F.pandas_udf(DOC_TYPE)
def links_with_offsets(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_with_link_offsets(h) for h in html], columns=["article_text", "links"])


@F.pandas_udf(ANCHOR_TYPE)
def extract_links(html: pd.Series) -> pd.Series:
    """Anchors with an address and non-empty text."""
    return html.map(
        lambda h: [{"text": t, "href": a["href"]} for a, t in page_anchors(h) if "href" in a and t != ""]
    )


@F.pandas_udf(HYPERLINK_TYPE)
def hyperlink_attributes(html: pd.Series) -> pd.Series:
    """Anchors with a non-empty address, their attributes and trimmed text."""
    fields = ("href", "title", "itemscope", "itemprop")
    return html.map(
        lambda h: [
            {**{f: a.get(f) for f in fields}, "text": t.strip()} for a, t in page_anchors(h) if a.get("href")
        ]
    )
