"""Receipts read from HTML pages: labelled tables with or without class names, and the modern layout with generated class names.

A page is read as its pieces of text in order, each with the elements around it. Labels are told by their words, items by the
element that holds a title, and every amount by what stands before it; no layout has a parser of its own.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "base_name string, format_detected string, apple_id string, receipt_date date, order_id string, document_number string, "
    "subtotal_cents long, tax_cents long, total_cents long, items array<struct<title:string,cents:long,quantity:int,subscription:boolean>>"
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNSEEN = frozenset(("script", "style", "title"))
_MAIL, _MONEY = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"), re.compile(r"[$£€¥]\s*(\d[\d,]*)(?:\.(\d{1,2}))?")
#: Layouts of dates on receipts.
_DATES = ("%b %d, %Y", "%B %d, %Y", "%Y-%m-%d")
_DAY = re.compile(r"[A-Z][a-z]+ \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2}")
#: What ends the list of items, and the heading of the block whose last amount was charged.
_SUMS, _PAYMENT = re.compile(r"(?i)(order )?(sub)?total\b|tax\b"), re.compile(r"(?i)billing and payment")


class _Leaf:
    __slots__ = ("cents", "path", "text")

    def __init__(self, text: str, path: tuple[tuple[int, str, str], ...]):
        self.text, self.path = text, path  # path: (number, tag, classes) of the elements around it, the outermost first
        self.cents = cents(text)

    def inside(self, tag: str) -> int:
        """The number of the innermost element of that tag."""
        return next((n for n, t, _ in reversed(self.path) if t == tag), -1)

    def within(self, part: str) -> int | None:
        """The number of the outermost element with a class that contains ``part``."""
        return next((n for n, _, c in self.path if part in c), None)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[int, str, str]] = []
        self.leaves: list[_Leaf] = []
        self.seen = 0
        self.path: tuple | None = None

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.seen += 1
            self.open.append((self.seen, tag, dict(attrs).get("class") or ""))
            self.path = None

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not any(tag in _UNSEEN for _, tag, _ in self.open):
            if self.path is None:
                self.path = tuple(self.open)
            self.leaves.append(_Leaf(text, self.path))

    def handle_endtag(self, tag):
        if self.open and self.open[-1][1] != tag and not any(t == tag for _, t, _ in self.open):
            return
        self.path = None
        while self.open:
            if self.open.pop()[1] == tag:
                return


#: A plain tag; what is left between plain tags must have no bracket. Elements whose content is no markup are no plain ones.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z-]*=(?:\"[^\"<>]*\"|'[^'<>]*'))*)[ \t\n\r\f]*>")
_CLASS = re.compile(r"([a-zA-Z-]+)=(?:\"([^\"]*)\"|'([^']*)')")
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())


def _plain(html: str, page: _Page) -> bool:
    """Feed a page of plain tags only, without the general parser; False if the page has anything else, ``page`` is then of no use."""
    at = 0
    for m in _TAG.finditer(html):
        end, tag, attrs = m.groups()
        text = html[at : m.start()]
        tag = tag.lower()
        if "<" in text or tag in _RAW or (end and attrs):
            return False
        if text:
            page.handle_data(unescape(text))
        if end:
            page.handle_endtag(tag)
        else:
            page.handle_starttag(tag, [(k.lower(), unescape(x or y)) for k, x, y in _CLASS.findall(attrs)] if attrs else ())
        at = m.end()
    text = html[at:]
    if "<" in text:
        return False
    if text:
        page.handle_data(unescape(text))
    return True


def cents(text: str) -> int | None:
    m = _MONEY.search(text) if any(c in text for c in "$£€¥") else None
    return int(m[1].replace(",", "")) * 100 + int((m[2] or "0").ljust(2, "0")) if m else None


@lru_cache(maxsize=10_000)
def day(text: str):
    for m in _DAY.finditer(text):
        for form in _DATES:
            try:
                return datetime.strptime(m[0], form).date()
            except ValueError:
                pass
    return None


_MODERN, _TABLE = re.compile(r"class=[\"'][^\"']*custom-"), re.compile(r"class=[\"'][^\"']*aapl-|<table|Order ID", re.I)


def _layout(html: str) -> str:
    """The name of the layout; a page that does not look like a receipt is ``unknown``."""
    if _MODERN.search(html):
        return "modern_format"
    return "table_format" if _TABLE.search(html) else "unknown"


def _after(label: str) -> re.Pattern:
    return re.compile(rf"(?i)(?:{label})(?!\w)\.?\s*:?\s*(.*)")


#: By field: what stands before its value, and the value.
_FIELDS = {
    "subtotal_cents": (_after("Subtotal"), _MONEY), "tax_cents": (_after("Tax"), _MONEY), "total_cents": (_after("(?:Order )?Total"), _MONEY),
    "apple_id": (_after("Apple ID|Apple Account|Email Address"), _MAIL), "order_id": (_after("Order ID"), re.compile(r"\b[A-Z0-9]{6,}\b")),
    "document_number": (_after(r"Document(?: No)?"), re.compile(r"\b\d{6,}\b")),
}
#: What any label begins with.
_LABEL = re.compile("(?i)subtotal|tax|order|total|apple|email|document")


def _labelled(leaves: list[_Leaf]) -> dict[str, str]:
    """The fields' values: each after its label, in the same piece of text or in one of the next two; the first that is found counts."""
    found: dict[str, str] = {}
    for i, leaf in enumerate(leaves):
        if not _LABEL.match(leaf.text):
            continue
        for name, (label, value) in _FIELDS.items():
            if name not in found and (m := label.match(leaf.text)):
                for rest in (m[1], *(x.text for x in leaves[i + 1 : i + 3])):
                    if v := value.search(rest):
                        found[name] = v[0]
                        break
    return found


_TITLE, _RENEW = re.compile(r"(^|[\s-])(title|item-name)(\s|$)"), re.compile("[Rr]enew")


def _titles(leaves: list[_Leaf]) -> list[int]:
    """Where items begin: at an element of class title or name; else where a lockup's content begins; else rows of text and amount."""
    by_class = [i for i, x in enumerate(leaves) if x.path and x.path[-1][2] and _TITLE.search(x.path[-1][2])]
    if by_class:
        return by_class
    lockups = {x.within("lockup__content"): i for i, x in reversed(list(enumerate(leaves)))}
    lockups.pop(None, None)
    if lockups:
        return sorted(lockups.values())
    rows: dict[int, list[int]] = {}
    for i, x in enumerate(leaves):
        rows.setdefault(x.inside("tr"), []).append(i)
    rows.pop(-1, None)
    return sorted(r[0] for r in rows.values() if len(r) > 1 and not leaves[r[0]].cents and not _SUMS.match(leaves[r[0]].text) and leaves[r[-1]].cents is not None)


def _items(leaves: list[_Leaf]) -> list[dict]:
    """Each title with the first amount behind it; it renews if the words between say so."""
    end = next((i for i, x in enumerate(leaves) if _PAYMENT.match(x.text) or _SUMS.match(x.text)), len(leaves))
    starts = [i for i in _titles(leaves) if i < end]
    items = []
    for i, stop in zip(starts, [*starts[1:], end]):
        between = leaves[i + 1 : stop]
        price = next((x.cents for x in between if x.cents is not None), None)
        if price is not None:
            renews = any(re.search("[Rr]enews", x.text) for x in between)
            items.append({"title": leaves[i].text, "cents": price, "quantity": 1, "subscription": renews})
    return items


def parse(base_name: str, html: str | None) -> dict:
    """A receipt's fields; what a page does not say is null.

    Pages that say everything twice, for desktop and for mobile, are read once. ``total`` is the amount behind a label of that
    name, never the subtotal's; without the label it is the last amount under the heading of the payment.
    """
    html = html or ""
    page = _Page()
    if not _plain(html, page):
        page = _Page()
        page.feed(html)
        page.close()
    leaves = [x for x in page.leaves if len(x.text) <= 200]
    wide = [x for x in leaves if x.within("aapl-mobile") is None]
    if any(x.cents is not None for x in wide):
        leaves = wide
    said = _labelled(leaves)
    amounts = {name: cents(said[name]) if name in said else None for name in ("subtotal_cents", "tax_cents", "total_cents")}
    if amounts["total_cents"] is None:
        paid = next((i for i, x in enumerate(leaves) if _PAYMENT.match(x.text)), len(leaves))
        charged = [x.cents for before, x in zip(leaves[paid:], leaves[paid + 1 :]) if not _SUMS.match(before.text) and x.cents is not None]
        amounts["total_cents"] = charged[-1] if charged else None
    return {
        "base_name": base_name, "format_detected": _layout(html), "apple_id": said.get("apple_id"), "receipt_date": next((d for x in leaves if (d := day(x.text))), None),
        "order_id": said.get("order_id"), "document_number": said.get("document_number"), **amounts, "items": _items(leaves),
    }


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages (base_name, html) to receipts, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([parse(n, h) for n, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], schema=fields)

    return pages.select("base_name", "html").mapInArrow(run, SCHEMA)
