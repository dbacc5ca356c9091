import random

from centime.operators import edits
from centime.plans import edit_queries


def by_key(rows):
    return sorted((r["transaction_id"], r["source"], [(x["amount"], x["memo"]) for x in r["splits"]]) for r in rows)


def both(spark, flat, nested):
    """The edits and rejects of rows of items and of nested rows."""
    assert by_key(nested.where("ok").withColumnRenamed("tx_id", "transaction_id").collect()) == by_key(edits.edit_batch(flat).collect())
    refused = sorted((r["tx_id"], r["source"], len(r["splits"])) for r in nested.where("not ok").collect())
    assert refused == sorted(tuple(r) for r in edits.rejected(flat).collect()) and refused


def test_nested_items_make_the_same_edits(spark):
    """each item went through an exchange for its order's sum, another for its edit, with its texts."""
    rnd, items, best, receipts, matches = random.Random(5), [], [], [], []
    for k in range(60):
        cents = [rnd.choice([rnd.randrange(1, 999), rnd.randrange(-50, 50), 0, None]) if k % 5 == 0 else rnd.randrange(1, 999) for _ in range(rnd.randrange(1, 6))]
        items += [(k % 2, k, i + 1, f"n{i}" if rnd.random() < 0.9 else None, rnd.choice([1, 2, None]), c) for i, c in enumerate(cents)]
        known, some = [c for c in cents if c is not None], rnd.choice([None, None, [1], [1, 2], [9]])
        paid = sum(c for i, c in enumerate(cents, 1) if c is not None and (some is None or i in some))
        best.append((k, rnd.choice([-paid * 10, -paid * 10, -paid * 10 - 1, None]), k % 2, k if k % 9 else None, some))
        sub, tax = rnd.choice([sum(known), sum(known), None, 0]), rnd.choice([None, 0, 7, sum(known) * 7 // 100])
        receipts.append((k, sub, tax, [(f"t{i}", c) for i, c in enumerate(cents)]))
        matches.append((k, -(sum(known) + (tax or 0)) * 10 - k % 3, k % 8 != 0, [k] if k % 7 else [k, k + 1]))
    item = spark.createDataFrame(items, "account int, order_id long, idx int, name string, quantity int, cents long")
    found = spark.createDataFrame(best, "tx_id long, tx_mu long, account int, order_id long, item_idx array<int>")
    orders = item.groupBy("account", "order_id").agg({"idx": "count"}).drop("count(idx)").join(item.selectExpr("account", "order_id", "struct(idx, name, quantity, cents) AS x").groupBy("account", "order_id").agg({"x": "collect_list"}), ["account", "order_id"])
    orders = orders.selectExpr("account", "order_id", "array_sort(`collect_list(x)`) AS items")
    both(spark, edits.order_edit_rows(found, item), edits.order_edits(found, orders))
    receipt = spark.createDataFrame(receipts, "base_name long, subtotal_cents long, tax_cents long, items array<struct<title:string,cents:long>>")
    match = spark.createDataFrame(matches, "transaction_id long, transaction_mu long, matched boolean, receipt_ids array<long>")
    both(spark, edits.receipt_edit_rows(match, receipt), edits.receipt_edits(match, receipt))


def test_edits_exchange_orders_not_items(spark):
    """no window or aggregate over items is left once orders are kept."""
    plan = edit_queries.match_to_edits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Window ") <= 1 and plan.count("Aggregate ") == 1
