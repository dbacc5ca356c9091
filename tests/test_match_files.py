import json

from centime.operators import edits, splits
from centime.sources import matches


def item(name, amount, quantity=1):
    return {"name": name, "amount": amount, "quantity": quantity, "asin": "A1", "unit_price": amount // quantity}


def match(order_id, items, method="complete_order", **more):
    order = {"order_id": order_id, "items": items, "total": sum(i["amount"] for i in items), "order_date": "2024-01-02", "ship_dates": ["2024-01-03"], "grouping_level": "order"}
    return {"account": "home", "amazon_orders": [order], "match_method": method, "confidence": 0.98, "total_match_amount": order["total"], "unmatched_amount": 0, "matched_item_indices": [], "metadata": {"note": "x"}} | more


def transaction(i, mu):
    return {"id": i, "amount": mu, "date": "2024-01-04", "payee_name": "Shop", "memo": None, "account_name": "Card"}


def write(folder, name, found):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"metadata": {"timestamp": name, "accounts": "all"}, "summary": {"total_transactions": len(found)}, "matches": found}))


def test_order_matches_are_read_back_and_lead_to_edits(spark, tmp_path):
    a, b = match("o1", [item("lamp", 8990, 2), item("bulb", 10)]), match("o2", [item("part", 500)], "split_payment", matched_item_indices=[3])
    two = a | {"amazon_orders": a["amazon_orders"] + b["amazon_orders"]}
    found = [
        {"ynab_transaction": transaction("t1", -90000), "matches": [b, a], "best_match": a, "message": None},
        {"ynab_transaction": transaction("t2", -5000), "matches": [b], "best_match": b},
        {"ynab_transaction": transaction("t3", -1), "matches": [], "best_match": None, "message": "not an order payee"},
        {"ynab_transaction": transaction("t4", -95000), "matches": [two], "best_match": two, "message": None},
    ]
    write(tmp_path / "m", "2024-01-01_00-00-00_x_matching_results.json", found[:1])
    write(tmp_path / "m", "2024-02-01_00-00-00_x_matching_results.json", found)
    (tmp_path / "m" / "2023-01-01_00-00-00_x_matching_results.json").write_text("[1, 2]")
    r = matches.read_order_matches(spark, str(tmp_path / "m"))
    assert [(x["tx_id"], x["tx_mu"], str(x["date"]), x["payee"], x["message"]) for x in r.orderBy("place").collect()] == [("t1", -90000, "2024-01-04", "Shop", None), ("t2", -5000, "2024-01-04", "Shop", None), ("t3", -1, "2024-01-04", "Shop", "not an order payee"), ("t4", -95000, "2024-01-04", "Shop", None)]
    assert matches.read_order_matches(spark, str(tmp_path / "m"), latest=False).count() == 5
    c = {(x["tx_id"], x["rank"]): (x["is_best"], x["method"], x["order_ids"], x["item_idx"], x["metadata"]) for x in matches.candidates(r).collect()}
    assert c[("t1", 0)] == (False, "split_payment", ["o2"], [3], {"note": "x"}) and c[("t1", 1)][:3] == (True, "complete_order", ["o1"]) and c[("t4", 0)][2] == ["o1", "o2"] and len(c) == 4
    rows = splits.order_splits(matches.best_items(r))
    assert {(x["tx_id"], x["amount_mu"], x["memo"], x["ok"]) for x in rows.collect()} == {
        ("t1", -89900, "lamp (qty: 2)", True), ("t1", -100, "bulb", True), ("t2", -5000, "part", True), ("t4", -89900, "lamp (qty: 2)", True), ("t4", -100, "bulb", True), ("t4", -5000, "part", True),
    }


def test_receipt_matches_are_read_back_and_lead_to_edits(spark, tmp_path):
    row = lambda i, mu, ids: {"transaction_id": i, "transaction_date": "2024-01-04", "transaction_amount": mu, "receipt_ids": ids, "matched": bool(ids), "confidence": 0.95, "match_method": "date_window_match", "date_difference": 1, "amount_difference": 0, "unmatched_amount": 0}
    write(tmp_path / "r", "2024-01-01_matching_results.json", [row("t1", -10700, ["r1"]), row("t2", -5, []), row("t3", -5, ["r1", "r2"])])
    r = matches.read_receipt_matches(spark, str(tmp_path / "r"))
    assert [(x["transaction_id"], x["matched"], x["receipt_ids"], x["date_difference"]) for x in r.orderBy("place").collect()] == [("t1", True, ["r1"], 1), ("t2", False, [], 1), ("t3", True, ["r1", "r2"], 1)]
    receipts = spark.createDataFrame([("r1", 1000, 70, [("x", 600), ("y", 400)])], "base_name string, subtotal_cents long, tax_cents long, items array<struct<title:string,cents:long>>")
    assert [(x["tx_id"], x["amount_mu"], x["ok"]) for x in edits.receipt_edit_rows(r, receipts).orderBy("idx").collect()] == [("t1", -6420, True), ("t1", -4280, True)]
    (tmp_path / "none").mkdir()
    assert matches.read_receipt_matches(spark, str(tmp_path / "none")).count() == 0
