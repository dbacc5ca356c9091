import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from centime.sources import ledger, records


def test_records_are_files_in_few_folders_and_later_runs_win(spark, tmp_path):
    at = str(tmp_path / "out")
    assert records.read_records(spark, at).count() == 0
    rows = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("name"), F.concat(F.lit("{"), "id", F.lit("}")).alias("content"))
    records.save_records(rows.repartition(4), at)
    files = [p for p in (tmp_path / "out").rglob("r*") if p.is_file()]
    assert len(files) == 3000 and len([p for p in (tmp_path / "out").rglob("*") if p.is_dir()]) <= 1 + 8
    odd = ["a/b", "..", ".hidden", "per%cent +plus", "é ü", "x" * 80]
    records.save_records(spark.createDataFrame([(n, n) for n in odd] + [("r7", "again"), ("r8", None), (None, "x")], "name string, content string"), at)
    got = {r["name"]: bytes(r["content"]).decode() for r in records.read_records(spark, at).collect()}
    assert got == {f"r{i}": "{%d}" % i for i in range(3000)} | {n: n for n in odd} | {"r7": "again"}
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.startswith("run-")]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "out")
    bad = spark.range(400).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise("x").alias("content")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        records.save_records(bad, at)
    assert not list((tmp_path / "out").rglob("*")) and records.read_records(spark, at).count() == 0
    records.save_records(bad.limit(0), at)
    assert records.read_records(spark, at).count() == 0


def test_receipts_and_mail_come_back(spark, tmp_path):
    at, schema = str(tmp_path), "base_name string, total long, items array<struct<title:string,cost:bigint>>"
    records.save_receipts(spark.createDataFrame([("a", 5, [("x", 5)]), ("b", 6, [])], schema), f"{at}/r")
    records.save_receipts(spark.createDataFrame([("a", 9, None)], schema), f"{at}/r")
    got = {r["base_name"]: (r["total"], r["items"]) for r in records.load_receipts(spark, f"{at}/r", schema).collect()}
    assert got == {"a": (9, None), "b": (6, [])}
    mail = [(date(2024, 1, 2), "Your réceipt\nno. 1", "<1@x>", "shop@example.com", "<p>hé</p>", None), (date(2024, 1, 3), None, None, None, None, "plain")]
    records.save_mail(spark.createDataFrame(mail, "sent_on date, subject string, message_id string, sender string, html string, text string"), f"{at}/m")
    files = {r["name"]: bytes(r["content"]) for r in records.read_records(spark, f"{at}/m").collect()}
    assert sorted(n.rpartition(".")[2] for n in files) == ["eml", "eml", "html", "json", "json", "txt"]
    known = [json.loads(c) for n, c in files.items() if n.startswith("20240102") and n.endswith(".json")][0]
    assert known["message_id"] == "<1@x>" and known["has_html"] and not known["has_text"] and known["date"] == "2024-01-02"
    (tmp_path / "eml").mkdir()
    for n, c in files.items():
        if n.endswith(".eml"):
            (tmp_path / "eml" / f"{len(c)}.eml").write_bytes(c)
    back = {r["message_id"]: r for r in ledger.read_mail(spark, f"{at}/eml").collect()}
    assert (back["<1@x>"]["subject"], back["<1@x>"]["html"].strip(), back["<1@x>"]["sender"]) == ("Your réceipt no. 1", "<p>hé</p>", "shop@example.com")
    assert back[None]["text"].strip() == "plain" and back[None]["html"] is None
