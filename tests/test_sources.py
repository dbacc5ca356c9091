import json

from centime.operators import accounts, receipts
from centime.sources import ledger


def test_ledger_shapes(spark, tmp_path):
    tx = [{"id": "1", "date": "2024-01-02T00:00", "amount": -45995, "account_id": "a", "account_name": "My Bank", "subtransactions": [{"id": "s", "amount": 1}]}]
    for name, body in (("bare", tx), ("wrapped", {"transactions": tx}), ("other", {"x": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    for name in ("bare", "wrapped"):
        r = ledger.read_transactions(spark, str(tmp_path / f"{name}.json")).first()
        assert (r["cents"], str(r["date"]), r["account_name"], r["is_split"], r["deleted"], r["cleared"]) == (-4600, "2024-01-02", "My Bank", True, False, "uncleared")
    assert ledger.read_transactions(spark, str(tmp_path / "other.json")).count() == 0


def test_categories(spark, tmp_path):
    body = {"category_groups": [{"id": "g", "name": "Home", "hidden": False, "categories": [{"id": "c", "name": "Rent", "hidden": False}]}]}
    (tmp_path / "c.json").write_text(json.dumps(body))
    assert ledger.read_categories(spark, str(tmp_path / "c.json")).first()["full_name"] == "Home: Rent"


def test_newest_export_of_each_account(spark, tmp_path):
    head = "Order ID,ASIN,Product Name,Quantity,Unit Price,Total Owed,Order Date,Ship Date\n"
    for folder, total in (("2024-01-01_my_home_amazon_data", "1.00"), ("2024-02-01_my_home_amazon_data", "$1,002.50"), ("2024-01-05_work_amazon_data", "3")):
        path = tmp_path / folder / "Retail.OrderHistory.1"
        path.mkdir(parents=True)
        (path / "Retail.OrderHistory.1.csv").write_text(head + f"o1,A,Thing,2,1.00,{json.dumps(total)},2024-01-02T03:04:05Z,Not Available\no2,A,Bad,1,1,1,never,\n")
    rows = {r["account"]: (r["cents"], r["quantity"], r["ship_date"]) for r in ledger.read_order_items(spark, str(tmp_path)).collect()}
    assert rows == {"my_home": (100250, 2, None), "work": (300, 2, None)}
    assert ledger.read_order_items(spark, str(tmp_path), ("work",)).count() == 1


def test_mail_and_results(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: no_reply@example.com\r\nSubject: =?utf-8?q?Re=C3=A7u?=\r\nMessage-ID: <1@x>\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hi</p>\r\n")
    r = ledger.read_mail(spark, str(tmp_path)).first()
    assert (r["subject"], r["html"].strip(), r["text"]) == ("Reçu", "<p>Hi</p>", None)
    out = str(tmp_path / "results")
    for run in ("1", "2"):
        ledger.write_results(spark.createDataFrame([(run,)], "v string"), out, run)
    assert [x["v"] for x in ledger.read_latest(spark, out).collect()] == ["2"]
    assert ledger.file_summary(spark, str(tmp_path), "*.eml").first()["files"] == 1


def test_accounts_and_their_projections(spark, tmp_path):
    body = {"accounts": [{"id": str(i), "name": n, "type": "otherAsset", "on_budget": False, "closed": i == 3, "balance": 1000 * i} for i, n in enumerate(("Zed:\u00a0Roth", "Al's Vault: 401k", "plain", "shut"))], "server_knowledge": 5}
    (tmp_path / "a.json").write_text(json.dumps(body))
    found = accounts.retirement_accounts(ledger.read_accounts(spark, str(tmp_path / "a.json")))
    assert [(r["name"], r["provider"], r["account_type"]) for r in found.collect()] == [("Al's Vault: 401k", "Vault", "401(k)"), ("Zed: Roth", "Zed", "Roth IRA"), ("plain", "Unknown", "Investment")]
    assert tuple(accounts.retirement_totals(found).first()) == (3, 3000)


def test_receipts_of_the_newest_export(spark, tmp_path):
    for folder, total in (("2024-01-01_receipts", 5), ("2024-03-01_receipts", 7)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.json").write_text(json.dumps({"base_name": "r", "receipt_date": "Mar 2, 2024", "total": total, "items": [{"title": "x", "cost": 7}]}))
        (tmp_path / folder / "r.html").write_text("<p>hi</p>")
    r = ledger.read_newest_receipts(spark, str(tmp_path)).collect()
    assert [(x["total_cents"], str(x["receipt_date"]), x["item_count"], x["currency"]) for x in r] == [(7, "2024-03-02", 1, "USD")]
    assert ledger.read_receipts(spark, str(tmp_path / "2024-01-01_receipts")).first()["total_cents"] == 5
    page = ledger.read_receipt_pages(spark, str(tmp_path / "2024-01-01_receipts")).first()
    assert (page["base_name"], page["html"]) == ("r", "<p>hi</p>")
    kept = receipts.by_date(spark.createDataFrame([("a", None, None, None), ("b", "2024-01-01", "o", [1])], "base_name string, receipt_date string, order_id string, items array<int>"))
    assert [(x["base_name"], x["order_id"], x["item_count"]) for x in kept.collect()] == [("b", "o", 1), ("a", "", 0)]


def test_written_matches_receipts_edits_and_mail_come_back(spark, tmp_path):
    schema = "tx_id string, date date, tx_mu long, payee string, memo string, account_name string, matches array<struct<order_id:string,confidence:double>>, best_match struct<order_id:string,confidence:double>, message string"
    rows = [("t", None, -5, "AMZN", "m", "acc", [("o", 0.9)], ("o", 0.9), None), ("u", None, -6, "x", None, "acc", [], None, "not an order payee")]
    out = str(tmp_path / "m")
    ledger.write_match_file(spark.createDataFrame(rows, schema), out, "2024-01-01", ("home",))
    s = spark.read.json(f"{out}/summary").first()
    assert (s["summary"]["total_transactions"], s["summary"]["matched_transactions"], s["summary"]["average_confidence"], s["metadata"]["accounts"]) == (2, 1, 0.9, ["home"])
    assert sorted(r["transaction"]["id"] for r in spark.read.json(f"{out}/matches").collect()) == ["t", "u"]
    pages = lambda total: spark.createDataFrame([("r1", total), ("r2", 3)], "base_name string, total_cents long")
    ledger.write_receipts(pages(1), str(tmp_path / "r"))
    ledger.write_receipts(pages(9).where("base_name = 'r1'"), str(tmp_path / "r"))
    assert sorted((r["base_name"], r["total_cents"]) for r in spark.read.json(str(tmp_path / "r")).collect()) == [("r1", 9), ("r2", 3)]
    for run in ("1", "2"):
        ledger.write_results(spark.createDataFrame([(run,)], "transaction_id string"), str(tmp_path / "e"), run)
    assert ledger.read_edits(spark, str(tmp_path / "e")).count() == 2 and ledger.read_edits(spark, str(tmp_path / "e"), True).count() == 1
    mail = spark.sql("select date'2024-01-02' as sent_on, 'A receipt!' as subject, '<1@x>' as message_id, '<p>hi</p>' as html, cast(null as string) as text")
    ledger.write_mail(mail, str(tmp_path / "mail"))
    found = spark.read.text(str(tmp_path / "mail")).collect()
    assert [(r["value"], r["kind"]) for r in found] == [("<p>hi</p>", "html")] and found[0]["name"].startswith("20240102_A_receipt__")
