import random
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from centime.operators import orders, rejects
from centime.operators.subset_sum import first_subset
from centime.sources import ledger
from centime.sources.runs import RunStore
from centime.streaming import consume, incremental

# ---- refused rows


def test_every_transaction_is_accepted_or_refused_with_a_code(spark):
    tr = spark.createDataFrame([("ok", -300), ("plus", 300), ("off", -310), ("bare", -300), ("mute", -300), ("none", -300), ("null", None), ("null none", None)], "tx_id string, tx_mu long")
    rows = [(t, a, m) for t in ("ok", "plus", "off", "null") for a, m in ((-100, "x"), (-200, "y"))]
    sp = spark.createDataFrame([*rows, ("bare", None, "x"), ("bare", -300, "y"), ("mute", -300, ""), ("stray", -5, "z")], "tx_id string, amount_mu long, memo string")
    v, seen = rejects.tallied(rejects.split_verdicts(tr, sp), list(rejects.SPLIT_CODES))
    got = {r["tx_id"]: (r["n_splits"], r["gap_mu"], r["code"]) for r in v.collect()}
    want = {"ok": (2, 0, None), "plus": (2, 0, None), "off": (2, 10, "sum_differs"), "bare": (2, 0, "split_without_amount"), "mute": (1, 0, "split_without_memo"), "none": (0, None, "no_splits"), "null": (2, None, "no_amount"), "null none": (0, None, "no_amount")}
    assert got == want
    assert seen.get == {"rows": 8, "accepted": 2, "no_amount": 2, "no_splits": 1, "split_without_amount": 1, "split_without_memo": 1, "sum_differs": 1}
    assert {r["tx_id"] for r in rejects.accepted(v).collect()} | {r["tx_id"] for r in rejects.refused(v).collect()} == set(want)
    assert rejects.accepted(v).count() + rejects.refused(v).count() == 8
    assert {r["code"] for r in rejects.split_verdicts(tr.where("tx_id = 'off'"), sp, tolerance=10).collect()} == {None}
    assert rejects.split_verdicts(tr.limit(0), sp).count() == 0


def test_money_is_read_strictly_or_refused(spark):
    texts = {"$1,234.5": (123450, None), "-3": (-300, None), "": (0, None), " $ ": (None, "no_number"), "1.2.3": (None, "no_number"), "abc": (None, "no_number"), None: (None, "missing"), "9" * 30: (None, "too_large"), "9" * 30 + "x": (None, "no_number"), "1" * 16: (int("1" * 16) * 100, None)}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["cents"], r["code"]) for r in rejects.strict_money(rows, "text").collect()}
    assert got | {" $ ": None} == texts | {" $ ": None}


# ---- runs


def test_a_run_counts_once_and_half_a_run_is_never_seen(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    assert store.read("t") is None and store.runs().count() == 0 and store.prune() == 0
    assert [store.write("a", {"t": table(1, 2), "u": table(9)}), store.write("b", {"t": table(3)}), store.write("a", {"t": table(1, 2, 4), "u": table(8)})] == [1, 2, 3]
    bad = table(5).withColumn("x", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        store.write("c", {"t": table(7), "u": bad})
    see = lambda d: sorted((r["run"], r["x"]) for r in d.collect())
    every = [("a", 1), ("a", 2), ("a", 4), ("b", 3)]
    assert see(store.read("t")) == every and see(store.read("t", run="a")) == every[:3] and see(store.read("t", newest=True)) == every[3:]
    assert see(store.read("u")) == [("a", 8)] and store.read("t", run="c") is None
    assert {r["run"]: (r["number"], r["rows"]) for r in store.runs().collect()} == {"a": (3, {"t": 3, "u": 1}), "b": (2, {"t": 1})}
    (tmp_path / "store/manifests/000000000004.json").write_text('{"number": 4, "run": "b", "attempt": "elsewhere", "rows": {}}')
    assert store._commit({"run": "d", "attempt": "x", "rows": {}}) == 5
    assert store.prune() > 0 and see(store.read("t", run="a")) == every[:3]


# ---- places in files


def test_places_in_a_file_do_not_depend_on_how_it_is_cut(spark, tmp_path):
    rnd = random.Random(3)
    for name, n in (("one", 700), ("two", 3), ("none", 0)):
        (tmp_path / f"{name}.csv").write_text("v,text\n" + "".join(f"{i},{'x' * rnd.randrange(60)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("900b", "20k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = spark.read.csv(str(tmp_path), header=True).select("v", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
            assert (raw.select("block").distinct().count() > 10) == (size == "900b")
            got = ledger.with_place(raw, "file", "block", "idx").collect()
            assert len(got) == 703 and all(int(r["v"]) == r["idx"] for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# ---- streams

PAY = "tx_id long, seq long, ts timestamp, order_id long, cents long"


def put(spark, folder, rows, schema):
    time.sleep(0.02)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_kept_apart_and_nothing_counts_twice(spark, tmp_path):
    day, at = datetime(2024, 1, 1), str(tmp_path)
    batches = [[(0, "a", 5), (1, "a", 7)], [(10, "b", 1), (7.9, "a", 2)], [(8, "a", 3), (7, "b", 4), (12, "a", 6)], [(None, "a", 9), (9.5, "a", 8), (10, "b", 10)]]
    schema = "ts timestamp, kind string, cents long"
    stream = lambda: incremental.flow_with_late(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), f"{at}/out", f"{at}/state").awaitTermination()
    for k, batch in enumerate(batches):
        put(spark, f"{at}/in", [(d if d is None else day + timedelta(days=d), kind, c) for d, kind, c in batch], schema)
        if k == 1:
            stream()
    stream()
    stream()
    flow, late = incremental.flow_tables(spark, f"{at}/out")
    # marks: 1 - 2, 10 - 2, 12 - 2: of the third batch day 7 is late, of the fourth day 9.5
    assert sorted(r["cents"] for r in late.collect()) == [4, 8]
    got = {((r["day"] - day).days, r["kind"]): (r["cents"], r["n"], r["final"]) for r in flow.collect()}
    assert got == {(0, "a"): (5, 1, True), (1, "a"): (7, 1, True), (7, "a"): (2, 1, True), (8, "a"): (3, 1, True), (10, "b"): (11, 2, False), (12, "a"): (6, 1, False)}


def test_items_are_used_up_over_batches_and_a_restart(spark, tmp_path):
    rnd, at = random.Random(4), str(tmp_path)
    by_order = {k: [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 6))] for k in range(12)}
    rows = [(0, k, i, c, None, None) for k, cents in by_order.items() for i, c in enumerate(cents)]
    table = orders.group_orders(spark.createDataFrame(rows, "account int, order_id long, idx int, cents long, order_date date, ship_date date"))
    pays = [(t, t, datetime(2024, 1, 1) + timedelta(days=t), k := rnd.randrange(13), -rnd.choice([rnd.randrange(1, 40), sum(by_order.get(k, [3])[:2])])) for t in range(60)]
    pays.append((99, 99, datetime(2025, 6, 1), 0, -sum(by_order[0])))
    left, want = {k: list(enumerate(c)) for k, c in by_order.items()}, {}
    for t, _, _, k, c in pays[:60]:
        if k in left:
            found = first_subset(left[k], -c) if left[k] else None
            code = None if found else "no_subset" if left[k] else "used_up"
            left[k] = [x for x in left[k] if x[0] not in (found or ())]
            want[t] = (k, found, code, sum(x[1] for x in left[k]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", consume.STORE)

    def run():
        stream = spark.readStream.schema(PAY).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        consume.use_up(stream, table).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
        return {r["tx_id"]: (r["order_id"], r["items"], r["code"], r["left_cents"]) for r in spark.read.parquet(f"{at}/out").collect()}

    try:
        for k in range(10):
            put(spark, f"{at}/in", pays[6 * k : 6 * k + 6], PAY)
            if k == 3:
                assert set(run()) == {t for t in want if t < 24}
        assert run() == want
        assert len({c for _, _, c, _ in want.values()}) == 3
        put(spark, f"{at}/in", [(98, 98, datetime(2025, 5, 30), 12, -1)], PAY)  # a year on: the watermark forgets all orders
        run()
        put(spark, f"{at}/in", pays[60:], PAY)
        assert sorted(run()[99][1]) == list(range(len(by_order[0])))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    once = consume.use_up(spark.createDataFrame(pays[:60], PAY), table).collect()
    assert {r["tx_id"]: (r["order_id"], r["items"], r["code"], r["left_cents"]) for r in once} == want


class _Handle:
    """A state handle in memory that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.remove(ms)


def test_orders_share_calls_to_the_state_and_are_forgotten_one_by_one():
    """each order had six calls and a frame of its own, which took most of the time."""
    h, items = _Handle(), consume._Items(1000)
    items.init(h)

    def pay(rows):
        frame = pd.DataFrame([(100 * t + k, t, pd.Timestamp(t, unit="ms"), k, amount, np.array([0, 1]), np.array([10 + k, 5])) for t, k, amount in rows], columns=["tx_id", "seq", "ts", "order_id", "amount", "idx", "item_cents"])
        return pd.concat(items.handleInputRows((0,), iter([frame]), None)).set_index("tx_id")

    def expire(mark):
        while h.timers and (t := min(h.timers)) <= mark:
            list(items.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
            h.timers.discard(t)

    got = pay([(k, k, 10 + k) for k in range(90)])
    assert h.calls <= 3 and got["order_id"].tolist() == list(range(90)) and got["items"].tolist() == [[0]] * 90 and set(got["left_cents"]) == {5} and h.timers == {1000}
    got = pay([(200, 3, 5), (201, 3, 5), (200, 4, 7)])
    assert got["code"].where(got["code"].notna(), None).to_dict() == {20003: None, 20103: "used_up", 20004: "no_subset"} and got["left_cents"].to_dict() == {20003: 0, 20103: 0, 20004: 5}
    expire(1050)  # orders 0 to 50 go, but for 3 and 4, which were paid later
    assert sorted(h.value[0]) == [3, 4, *range(51, 90)] and h.timers == {1051}
    assert pay([(300, 50, 60), (300, 51, 61), (300, 4, 5)])["items"].tolist() == [[1], [0], None]
    expire(5000)
    assert h.value is None and not h.timers


def test_stored_runs_match_once(spark, monkeypatch):
    """each of the four writes of a run matched all receipts again."""
    from centime.plans import stream_queries

    plans, write = [], stream_queries.RunStore.write
    monkeypatch.setattr(stream_queries.RunStore, "write", lambda self, run, tables: plans.extend(t._jdf.queryExecution().optimizedPlan().toString() for t in tables.values()) or write(self, run, tables))
    rows = stream_queries.stored_runs(spark, "/root/testdata/sf0.001").collect()
    assert {r["run"] for r in rows} == {"2024-01", "2024-02"} and len(plans) == 3 and not any("Join" in p for p in plans)
