"""Synthetic pages with the structure of the seven sample layouts; no personal values."""

import datetime as dt

import pytest

from centime.operators import receipt_html

HEAD = "<html><head><title>Receipt</title><style>.x{color:red}</style></head><body>"


def meta(mail, date, order, number):
    cell = lambda k, v: f"<td><span>{k}</span><br>{v}</td>"
    return f"<table><tr>{cell('APPLE ID', mail)}<td>BILLED TO<br>Card .... 1234<br>Some One<br>1 Main St</td></tr><tr>{cell('DATE', date)}</tr><tr>{cell('ORDER ID', f'<span><a href=x>{order}</a></span>')}{cell('DOCUMENT NO.', number)}</tr></table>"


def table_item(title, price, note="", extra=""):
    return f"""<tr><td class="item-cell{extra}"><span class="title">{title}</span><br><span class="artist">Maker</span><br><span class="type">App</span>{note}<br>
<span class="item-links"><a>Write a Review</a> | <a>Report a Problem</a></span></td><td class="price-cell{extra}"><table><tr><td><span>{price}</span></td></tr></table></td></tr>"""


def table_page(mail, date, order, number, items, sums):
    """Everything stands twice: for desktop, and for mobile in cells of that class."""

    def body(extra):
        rows = "".join(table_item(*i, extra=extra) for i in items)
        ends = "".join(f"<tr><td{extra and ' class=' + extra}>{k}</td><td>{v}</td></tr>" for k, v in sums)
        return f"<table><tr><td>App Store</td></tr>{rows}</table><table>{ends}</table><p>Save 3% on all purchases.</p>"

    mobile = f'<div class="aapl-mobile-div"><table><tr><td class="aapl-mobile-cell">{meta(mail, date, order, number)}{body(" aapl-mobile-cell")}</td></tr></table></div>'
    return f'{HEAD}<div class="aapl-desktop-div">{meta(mail, date, order, number)}{body("")}</div>{mobile}</body></html>'


def plain_page():
    """The layout between the two: bold labels, an item told by its style only, the total in the payment block."""
    return f"""{HEAD}<table><tr><td><h1>Receipt &amp; Renewal Notice</h1></td></tr><tr><td><span>June 16, 2024</span></td></tr><tr><td><span><b>Order ID:</b> MQA1B2C3D4</span><br>
<span><b>Document:</b> 210000000001</span><br><span><b>Email Address:</b> someone@example.com</span></td></tr></table>
<table><tr><td><img src=x></td><td><table><tr><td valign="top"><span style="font-weight: 600;">Care Plan+</span><br>Your Annual Plan<br>Agreement number 970000000000000<br>Next Billing Date: June 16, 2025</td>
<td align="right"><span style="font-weight:600;">$99.99</span></td></tr></table></td></tr></table>
<table><tr><td>Billing and Payment</td></tr><tr><td>Some One<br>1 Main St</td></tr><tr><td><table><tr><td>MasterCard 0000</td><td>$99.99</td></tr></table></td></tr></table><table><tr><td>This notice confirms your purchase.</td></tr></table></body></html>"""


def modern_page(date, items, subtotal, tax, total):
    rows = ""
    for title, price, notes in items:
        more = "".join(f'<p class="custom-b">{n}</p>' for n in notes)
        rows += f"""<tr class="subscription-lockup custom-z"><td class="subscription-lockup__content custom-y"><p class="custom-a">{title}</p>{more}</td>
<td class="subscription-lockup__bottom-text__col custom-w"><p class="custom-c">{price}</p></td></tr>"""
    pair = lambda k, v: f'<div><p class="custom-m">{k}</p></div><div><p class="custom-n">{v}</p></div>'
    return f"""{HEAD}<h1 class="custom-h">Receipt</h1><p class="custom-d">{date}</p>{pair("Order ID:", "MQD3XXXX01")}{pair("Document:", "770000000002")}{pair("Apple Account:", "someone@example.com")}
<table>{rows}</table><p class="custom-q">Billing and Payment</p><p class="custom-r">Some One</p><p class="custom-r">1 Main St</p>{pair("Subtotal", subtotal)}{pair("Tax", tax)}{pair("Card", total)}
<p class="custom-s">TM and © 2025</p></body></html>"""


MAIL, GAME = "someone@example.com", "Puzzle Works!"
CASES = {
    "one app": (table_page(MAIL, "Oct 23, 2020", "MQBQLG0001", "110000000003", [("Tower Climb", "$9.99")], [("TOTAL", "$9.99")]), "table_format", (2020, 10, 23), (None, None, 999), [("Tower Climb", 999, False)]),
    "one renewal": (
        table_page(MAIL, "Mar 1, 2022", "MQBXTT0002", "190000000004", [("Weather Bird", "$14.99", "<br>Premium (Yearly)<br>Renews Mar 1, 2023")], [("Subtotal", "$14.99"), ("Tax", "$0.90"), ("TOTAL", "$15.89")]),
        "table_format", (2022, 3, 1), (1499, 90, 1589), [("Weather Bird", 1499, True)],
    ),
    "five purchases": (
        table_page(MAIL, "Jan 22, 2025", "MQ8XNQ0005", "140000000005", [(GAME, p) for p in ("$1.99", "$6.99", "$6.99", "$1.99", "$6.99")], [("Subtotal", "$24.95"), ("Tax", "$1.50"), ("TOTAL", "$26.45")]),
        "table_format", (2025, 1, 22), (2495, 150, 2645), [(GAME, c, False) for c in (199, 699, 699, 199, 699)],
    ),
    "plan": (plain_page(), "table_format", (2024, 6, 16), (None, None, 9999), [("Care Plan+", 9999, False)]),
    "two renewals": (
        modern_page("October 11, 2025", [("SLEEP: Tracker", "$9.99", ["Membership (Monthly)", "Renews November 2, 2025", "Some phone"]), ("Budget", "$14.99", ["Monthly", "Renews November 10, 2025"])], "$24.98", "$1.50", "$26.48"),
        "modern_format", (2025, 10, 11), (2498, 150, 2648), [("SLEEP: Tracker", 999, True), ("Budget", 1499, True)],
    ),
    "one bundle": (modern_page("February 20, 2025", [("Bundle", "$37.95", ["Monthly", "Renews March 20, 2025"])], "$37.95", "$1.94", "$39.89"), "modern_format", (2025, 2, 20), (3795, 194, 3989), [("Bundle", 3795, True)]),
    "mixed": (
        modern_page("April 20, 2025", [("Budget", "$14.99", ["Renews May 10, 2025"]), ("Caches®", "$6.99", ["Lifetime"])], "$21.98", "$1.32", "$1,023.30"),
        "modern_format", (2025, 4, 20), (2198, 132, 102330), [("Budget", 1499, True), ("Caches®", 699, False)],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    html, layout, date, sums, items = CASES[name]
    r = receipt_html.parse("x", html)
    assert (r["format_detected"], r["receipt_date"], r["apple_id"]) == (layout, dt.date(*date), MAIL)
    assert len(r["order_id"]) == 10 and len(r["document_number"]) == 12
    assert (r["subtotal_cents"], r["tax_cents"], r["total_cents"]) == sums
    assert [(i["title"], i["cents"], i["subscription"]) for i in r["items"]] == items and all(i["quantity"] == 1 for i in r["items"])


def test_rows_without_class_names_and_broken_pages():
    rows = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in (("First", "$2.00"), ("Second", "$3.50"), ("Subtotal", "$5.50"), ("Tax", "$0.50"), ("Total", "$6.00")))
    r = receipt_html.parse("x", f"<table><tr><th>Apple ID</th><td>{MAIL}</td></tr></table><table>{rows}</table>")
    assert [(i["title"], i["cents"]) for i in r["items"]] == [("First", 200), ("Second", 350)] and (r["subtotal_cents"], r["tax_cents"], r["total_cents"]) == (550, 50, 600)
    named = receipt_html.parse("x", '<div class="custom-item"><div class="custom-item-name">Songs</div><div class="custom-item-cost">$9.99</div></div>')
    assert [(i["title"], i["cents"]) for i in named["items"]] == [("Songs", 999)]
    for broken in (None, "", "<td>unclosed $5", "plain words", "<table><tr><td>x" * 200, "</p></div>"):
        assert receipt_html.parse("x", broken)["items"] == []
    assert receipt_html.parse("x", "plain words")["format_detected"] == "unknown"


def test_plain_pages_are_read_as_the_general_parser_reads_them():
    """F8: pages of plain tags take a short way; anything else goes to the general parser, with the same pieces of text."""
    from centime.operators import receipt_html

    def leaves(page):
        return [(x.text, x.path) for x in page.leaves]

    plain = "<table><tr><TD class='a &amp; title'>A &amp; B</td><td>$1,200.50</td></tr></table></p>tail &lt;"
    for html, short in ((plain, True), ("<p>a<!-- $1 --></p>", False), ("<script>if (a<b) $2</script>", False), ("a < b", False), ("<td class=x>y</td>", False)):
        mine, other = receipt_html._Page(), receipt_html._Page()
        other.feed(html)
        other.close()
        assert receipt_html._plain(html, mine) is short
        assert not short or leaves(mine) == leaves(other)


def test_pages_are_parsed_by_many_tasks(spark):
    """F8: the customers' file is one split, so one task parsed all pages."""
    from centime.plans import bridge

    assert bridge.receipt_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
