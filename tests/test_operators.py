import datetime as dt
import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from centime.operators import cashflow, edits, order_matching, orders, receipt_html, receipt_matching, splits
from centime.operators.graph import components
from centime.operators.subset_sum import can_reach, first_subset, subset_sums
from centime.plans import queries

DAY = dt.date(2024, 1, 10)
ITEM = "account int, order_id string, idx int, cents long, order_date date, ship_date date"


def day(n):
    return DAY + dt.timedelta(days=n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=9), st.integers(1, 150))
def test_subset_sum_agrees_with_all_subsets(cents, target):
    items = list(enumerate(cents))
    found = first_subset(items, target)
    possible = any(sum(c) == target for k in range(1, len(cents) + 1) for c in combinations(cents, k))
    assert (found is not None) == possible
    assert found is None or sum(cents[i] for i in found) == target


def test_subset_sum_prefers_single_items_then_largest_first():
    assert first_subset([(0, 5), (1, 10), (2, 5), (3, 10)], 10) == [1]
    assert first_subset([(0, 3), (1, 7), (2, 4), (3, 6)], 10) == [1, 0]
    assert first_subset([(i, 1) for i in range(25)], 25) == list(range(25))
    assert first_subset([(i, 1) for i in range(25)], 24) is None


def test_complete_match_scores(spark):
    items = spark.createDataFrame([(0, "a", 1, 4599, DAY, DAY), (0, "b", 1, 8999, DAY, DAY), (0, "b", 2, 4000, DAY, day(1)), (1, "c", 1, 500, DAY, None)], ITEM)
    tx = spark.createDataFrame([("t1", DAY, -4599), ("t2", day(4), -12999), ("t3", DAY, -99999), ("t4", day(30), -4599), ("t5", DAY, -500)], "tx_id string, date date, cents long")
    best = order_matching.best_match(order_matching.complete_matches(tx, orders.group_orders(items)))
    rows = {r["tx_id"]: (r["matched"], r["order_id"], r["score"], r["unmatched_cents"]) for r in order_matching.match_result(tx, best).collect()}
    assert rows == {"t1": (True, "a", 100, 0), "t2": (True, "b", 95, 0), "t3": (False, None, None, 99999), "t4": (False, None, None, 4599), "t5": (True, "c", 80, 0)}


def test_split_payments_use_items_up(spark):
    items = spark.createDataFrame([(0, "a", 1, 100, DAY, DAY), (0, "a", 2, 250, DAY, DAY), (0, "a", 3, 100, DAY, DAY), (1, "b", 1, 350, DAY, day(3)), (1, "c", 1, 70, DAY, None), (1, "c", 2, 9, DAY, None)], ITEM)
    rows = [("p1", 1, 0, 100), ("p2", 2, 0, 350), ("p3", 3, 0, 100), ("p4", 4, 40, 350), ("p5", 5, 0, 450), ("p6", 6, 0, 79), ("p7", 7, 0, 70), ("p8", 8, 0, 70)]
    pay = spark.createDataFrame([(t, s, day(d), -c) for t, s, d, c in rows], "tx_id string, seq int, date date, cents long")
    got = {r["tx_id"]: (r["order_id"], r["method"], r["score"], r["items"]) for r in order_matching.match_orders(pay, orders.group_orders(items)).collect()}
    # p2: b's whole (3 days) ties with a's rest (same day); the first account takes it. p4: only b's item is left, far away.
    assert got == {
        "p1": ("a", "split", 95, [1]), "p2": ("a", "split", 95, [2, 3]), "p4": ("b", "split", 71, [1]), "p5": ("a", "complete", 100, None),
        "p6": ("c", "complete", 80, None), "p7": ("c", "split", 81, [1]),
    }
    gated = order_matching.match_result(pay.withColumn("payee", F.when(F.col("tx_id") == "p1", "Shop").otherwise("AMZN")), order_matching.match_orders(pay.where("tx_id <> 'p1'"), orders.group_orders(items)))
    assert {r["tx_id"]: r["message"] for r in gated.collect()} == {f"p{i}": "not an order payee" if i == 1 else None for i in range(1, 9)}
    assert order_matching.match_orders(pay.limit(0), orders.group_orders(items)).count() == order_matching.match_orders(pay, orders.group_orders(items.limit(0))).count() == 0


def test_large_orders_split_too(spark):
    cents = [1000 + 7 * i for i in range(24)]
    items = spark.createDataFrame([(0, "big", i, c, DAY, DAY) for i, c in enumerate(cents)], ITEM)
    rows = [("one", 1, cents[3]), ("none", 2, 999), ("rest", 3, sum(cents) - cents[3]), ("pair", 4, 2007)]
    pay = spark.createDataFrame([(t, s, DAY, -c) for t, s, c in rows], "tx_id string, seq int, date date, cents long")
    got = {r["tx_id"]: sorted(r["items"]) for r in order_matching.match_splits(pay, orders.group_orders(items)).collect()}
    assert got == {"one": [3], "rest": [i for i in range(24) if i != 3]}


def test_reachable_sums():
    rnd = random.Random(1)
    for _ in range(50):
        cents = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 8))]
        sums = {sum(c) for k in range(1, len(cents) + 1) for c in combinations(cents, k)}
        assert set(subset_sums(cents).tolist()) == sums and all(can_reach(cents, a) == (a in sums) for a in range(1, 200))
    assert set(subset_sums([5, -2]).tolist()) == {5, -2, 3} and can_reach([5, -2], 77)


def test_receipts(spark):
    r = spark.createDataFrame([("x", DAY, 999), ("y", day(2), 999), ("z", None, 5)], "base_name string, receipt_date date, total_cents long")
    t = spark.createDataFrame([("a", DAY, -999), ("b", day(5), -999), ("c", day(9), -999), ("d", day(1), -999)], "tx_id string, date date, cents long")
    rows = {r["tx_id"]: (r["base_name"], r["method"], r["score"]) for r in receipt_matching.match_receipts(t, r).collect()}
    assert rows == {"a": ("x", "exact_match", 100), "b": ("y", "date_window_match", 75), "c": (None, "no_match", 0), "d": ("x", "date_window_match", 95)}
    assert receipt_matching.match_receipts(t, r, 7).where("tx_id = 'c'").first()["score"] == 0


def test_receipt_tax(spark):
    cents = (29999, 19999, 4999, 1410)
    rows = [("t", -599960, i, "n", c, 56407, 3589) for i, c in enumerate(cents)] + [("u", -108000, i, "n", 5000, None, 800) for i in range(2)]
    out = splits.receipt_splits(spark.createDataFrame(rows, "tx_id string, tx_mu long, idx int, name string, cents long, subtotal_cents long, tax_cents long")).collect()
    assert all(r["ok"] for r in out) and sum(r["amount_mu"] for r in out if r["tx_id"] == "t") == -599960
    assert [r["amount_mu"] for r in out if r["tx_id"] == "u"] == [-54000, -54000]


def test_balance_is_that_before_the_days_transactions(spark):
    tx = spark.createDataFrame([("a", DAY, -500), ("b", day(3), 100)], "account string, date date, cents long")
    bal = spark.createDataFrame([("a", 1_000_000), ("b", 50)], "account string, cents long")
    got = {(r["account"], r["date"]): r["balance"] for r in cashflow.account_balances(tx, bal).collect()}
    assert got == {("a", DAY): 1_000_500, **{("a", day(i)): 1_000_500 for i in (1, 2)}, ("a", day(3)): 1_000_000, **{("b", day(i)): -50 for i in range(4)}}


def test_trend_of_a_line_and_of_a_constant(spark):
    line = spark.createDataFrame([(day(i), 100 * i + 7) for i in range(10)], "date date, total long")
    t = cashflow.trend(line).first()
    assert (round(t["slope"], 6), round(t["intercept"], 6), round(t["r"], 6), round(t["stderr"], 6)) == (100, 7, 1, 0)
    flat = cashflow.trend(spark.createDataFrame([(day(i), 5) for i in range(4)], "date date, total long")).first()
    assert (flat["slope"], flat["r"], flat["stderr"]) == (0, 0, 0)
    assert abs(cashflow.p_value(0.5, 10) - 0.141111) < 1e-5


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<html><body class="aapl-mail"><table><tr><td>Apple ID</td><td>someone@example.com</td></tr><tr><td>Date</td><td>Jan 22, 2025</td></tr>
<tr><td>Order ID</td><td>MX1234567</td></tr><tr><td>Document No.</td><td>123456789012</td></tr>
<tr><td><span class="title">First App</span></td><td class="price-cell">$1.99</td></tr><tr><td><span class="title">Paper Plus</span> Renews Feb 22, 2025</td><td class="price-cell">$1,006.99</td></tr>
<tr><td>Subtotal</td><td>$1,008.98</td></tr><tr><td>Tax</td><td>$1.50</td></tr><tr><td>TOTAL</td><td>$1,010.48</td></tr></table></body></html>"""


def test_receipt_page(spark):
    r = receipt_html.parse_pages(spark.createDataFrame([("p", PAGE), ("e", None)], "base_name string, html string")).orderBy("base_name").collect()
    assert (r[0]["total_cents"], r[0]["items"], r[0]["format_detected"]) == (None, [], "unknown")
    got = r[1]
    assert (got["format_detected"], got["apple_id"], str(got["receipt_date"]), got["order_id"], got["document_number"]) == ("table_format", "someone@example.com", "2025-01-22", "MX1234567", "123456789012")
    assert (got["subtotal_cents"], got["tax_cents"], got["total_cents"]) == (100898, 150, 101048)
    assert [(i["title"], i["cents"], i["subscription"]) for i in got["items"]] == [("First App", 199, False), ("Paper Plus", 100699, True)]


def replay(items_of, payments):
    """One payment after the other against every order, as plain loops."""
    used, want, sums = {}, {}, {}
    for key, items in items_of.items():
        reach = set()
        for c, _ in items:
            reach |= {x + c for x in reach} | {c}
        for x in reach:
            sums.setdefault(x, []).append(key)
    for tx, when, amount in payments:
        options = []
        for account, order in sums.get(amount, ()):
            items = items_of[account, order]
            ships = {s for _, s in items}
            gap = min(abs((when - s).days) for s in ships)
            if sum(c for c, _ in items) == amount and gap <= 7:
                steps = ((2, 100), (3, 95), (5, 89), (7, 84)) if len(ships) > 1 else ((0, 100), (1, 98), (2, 95), (3, 90), (5, 85), (7, 80))
                score = next(s for g, s in steps if gap <= g)
                options.append((-score - 10, account, 0, order, "complete", score, None))
            left = sorted((i for i in range(len(items)) if i not in used.get(order, ())), key=lambda i: -items[i][0])
            found = next(([i] for i in left if items[i][0] == amount), None) or first_of(left, [items[i][0] for i in left], amount)
            if found:
                score = 95 if gap == 0 else 90 if gap <= 2 else 81 if gap <= 5 else 71
                options.append((-score - 5, account, 1, order, "split", score, found))
        if options:
            _, _, _, order, method, score, found = min(options, key=lambda o: o[:4])
            want[tx] = (order, method, score, [i + 1 for i in found] if found else None)
            used.setdefault(order, set()).update(found or ())
    return want


def first_of(left, cents, amount):
    """The first subset, depth first, an item taken before it is left out."""
    stack = [(0, 0, ())]
    rest = [sum(cents[i:]) for i in range(len(cents) + 1)]
    while stack:
        at, total, taken = stack.pop()
        if taken and total == amount:
            return [left[i] for i in taken]
        if at < len(cents) and total < amount <= total + rest[at]:
            stack += [(at + 1, total, taken), (at + 1, total + cents[at], (*taken, at))]
    return None


def ledger_of(spark, sf):
    items_of = {}
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    for r in sorted(rows, key=lambda r: (r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"], r["l_shipdate"])):
        items_of.setdefault((r["l_orderkey"] % 2, r["l_orderkey"]), []).append((round(r["l_extendedprice"] * 100), r["l_shipdate"].date()))
    return items_of


@pytest.mark.parametrize("name", ["split_consume", "order_match_best"])
def test_order_matching_agrees_with_a_replay(spark, name):
    sf = "/root/testdata/sf0.001"
    items_of, pay = ledger_of(spark, sf), []
    for (_, order), items in sorted(items_of.items(), key=lambda x: x[0][1]):
        cents, first = [c for c, _ in items], min(s for _, s in items)
        if name == "order_match_best":
            pay.append((order * 10, first + dt.timedelta(order % 10 + (30 if order % 4 == 0 else 0)), sum(cents)))
        for seq, amount in enumerate((cents[0], sum(cents[:2]), sum(cents[2:]) if cents[2:] else None, sum(cents) + 1), 1):
            if amount is not None:
                pay.append((order * 10 + seq, first + dt.timedelta(1), amount))
    df = queries.QUERIES[name](spark, sf)
    if name == "split_consume":
        want = {t: (o, i, s) for t, (o, m, s, i) in replay(items_of, pay).items() if m == "split"}
        assert {r["tx_id"]: (r["order_id"], r["items"], r["score"]) for r in df.collect()} == want
        assert max(len(i) for _, i, _ in want.values()) > 2
        return
    want = replay(items_of, [p for p in pay if p[0] % 7])
    rows = df.collect()
    assert {r["tx_id"]: (r["order_id"], r["method"], r["score"]) for r in rows if r["matched"]} == {t: w[:3] for t, w in want.items()}
    assert {r["tx_id"] for r in rows} == {p[0] for p in pay} and {m for _, m, _, _ in want.values()} == {"split", "complete"}
    assert all((r["message"] is not None) == (r["tx_id"] % 7 == 0) for r in rows)


def test_configured_cash_flow(spark):
    """Deleted transactions, closed accounts and what is before the start don't count; accounts off budget do."""
    accounts = spark.createDataFrame([("check", False, True, 10_000_000), ("card", False, False, 5_000_000), ("old", True, True, 7_000_000), ("other", False, True, 1)], "name string, closed boolean, on_budget boolean, balance_mu long")
    rows = [("check", DAY, -500, False), ("check", DAY, -50000, True), ("card", DAY, -1000, False), ("old", DAY, -9, False), ("check", day(-9), -7, False), ("other", DAY, -1, None)]
    tx = spark.createDataFrame(rows, "account string, date date, cents long, deleted boolean")
    live, balances = cashflow.configured(tx, accounts, ["check", "card", "old"], str(DAY))
    got = {(r["account"], r["date"]): r["balance"] for r in cashflow.account_balances(live, balances).collect()}
    assert got == {("check", DAY): 1_000_500, ("card", DAY): 501_000}


def test_p_value_and_line_beside_the_trend(spark):
    totals = spark.createDataFrame([(day(i), v) for i, v in enumerate((5, 7, 6, 9, 12))], "date date, total long")
    t = cashflow.with_p_value(cashflow.trend(totals)).first()
    assert abs(t["p"] - cashflow.p_value(t["r"], 5)) < 1e-12 and 0 < t["p"] < 0.05
    fitted = [r["fitted"] for r in cashflow.trend_line(totals).orderBy("date").collect()]
    assert abs(sum(fitted) - 39) < 1e-9 and abs(fitted[1] - fitted[0] - t["slope"]) < 1e-9
    health = cashflow.health(totals).first()
    assert (health["up_pct"], health["down_pct"]) == (60.0, 20.0) and health["mean_monthly_range"] == 7


def test_generic_splits_edits_and_streams(spark):
    rows = [("t", i, n, c, "cat") for i, (n, c) in enumerate((("a", 6000), ("b", 2500), ("c", 1500)))]
    out = splits.generic_splits(spark.createDataFrame(rows, "tx_id string, idx int, name string, cents long, category_id string")).orderBy("idx").collect()
    assert [(r["amount_mu"], r["memo"], r["category_id"]) for r in out] == [(-60000, "a", "cat"), (-25000, "b", "cat"), (-15000, "c", "cat")]
    items = spark.createDataFrame([(0, "o", 1, "x", 2, 100), (0, "o", 2, "y", 1, 250)], "account int, order_id string, idx int, name string, quantity int, cents long")
    best = spark.createDataFrame([("p", -1000, 0, "o", [1]), ("q", -3500, 0, "o", None), ("r", -3000, 0, "o", None), ("s", -1, None, None, None)], "tx_id string, tx_mu long, account int, order_id string, item_idx array<int>")
    rows = edits.order_edit_rows(best, items)
    got = {r["transaction_id"]: [(x["amount"], x["memo"]) for x in r["splits"]] for r in edits.edit_batch(rows).collect()}
    assert got == {"p": [(-1000, "x (qty: 2)")], "q": [(-1000, "x (qty: 2)"), (-2500, "y")]}
    assert [(r["tx_id"], r["n_splits"]) for r in edits.rejected(rows).collect()] == [("r", 2)]
