from datetime import date, timedelta

from centime.operators import cashflow, dashboard, receipt_matching

DAY = date(2024, 1, 30)


def board(spark):
    tx = spark.createDataFrame([("a", DAY, -500), ("b", DAY + timedelta(days=3), 100), ("c", DAY, -1)], "account string, date date, cents long")
    now = spark.createDataFrame([("a", 1000), ("b", -50), ("c", 0)], "account string, cents long")
    return dashboard.Dashboard(cashflow.account_balances(tx, now))


def test_layers_lie_on_one_another_and_debts_do_not(spark):
    rows = {(r["account"], (r["date"] - DAY).days): (r["balance"], r["side"], r["base"], r["top"]) for r in board(spark).composition().collect()}
    assert rows["a", 0] == (1500, "positive", 0, 1500) and rows["c", 0] == (1, "positive", 1500, 1501) and rows["b", 0] == (-150, "negative", None, None)
    assert rows["a", 3] == (1000, "positive", 0, 1000) and rows["b", 3] == (-150, "negative", None, None) and len(rows) == 12


def test_tables_of_a_short_series(spark):
    b = board(spark)
    assert [(r["total"], r["a"], r["b"], r["c"]) for r in b.wide().orderBy("date").collect()] == [(1351, 1500, -150, 1)] * 3 + [(850, 1000, -150, 0)]
    assert [(r["velocity"], r["side"]) for r in b.velocity().orderBy("date").collect()] == [(None, None), (0, "up"), (0, "up"), (-501, "down")]
    assert [(str(r["month_end"]), r["net_change"], r["side"], r["mean_net"]) for r in b.monthly_flow().orderBy("month_end").collect()] == [("2024-01-31", 0, "loss", -250.5), ("2024-02-29", -501, "loss", -250.5)]
    assert [r["end"] for r in b.volatility().orderBy("month_end").collect()] == [1351, 850]
    s = b.statistics().first()
    assert (s["last_total"], s["least"], s["most"], s["down_days"], s["direction"]) == (850, 850, 1351, 1, "declining") and abs(s["down_pct"] - 25) < 1e-9
    assert [r["ma_7"] for r in b.main_trend().orderBy("date").collect()][:2] == [1351, 1351]


def test_the_cube_adds_up_at_every_level(spark):
    rows = [("a", DAY, 5), ("a", DAY, -2), ("b", DAY, 0), ("b", DAY + timedelta(days=5), -7)]
    cube = dashboard.flow_cube(spark.createDataFrame(rows, "account string, date date, cents long")).collect()
    by = {(r["level"], str(r["month"]), r["account"], r["side"]): (r["cents"], r["n"]) for r in cube}
    assert by[("all", "None", None, "in")] == (5, 2) and by[("all", "None", None, "out")] == (-9, 2) and by[("month", "2024-02-01", None, "out")] == (-7, 1)
    assert by[("account", "None", "b", "in")] == (0, 1) and by[("month-account", "2024-01-01", "a", "out")] == (-2, 1)
    assert len(cube) == 2 + 3 + 4 + 4


def test_near_misses_across_blocks_of_amounts(spark):
    edge = receipt_matching.BLOCK
    totals = [edge * k + d for k in range(4) for d in (-3, -1, 0, 2, 30_000)]
    r = spark.createDataFrame([(f"r{i:02}", DAY, abs(t)) for i, t in enumerate(totals)], "base_name string, receipt_date date, total_cents long")
    t = spark.createDataFrame([(k, DAY, -a) for k, a in enumerate((edge, edge * 2 + 1, 5, edge * 9))], "tx_id int, date date, cents long")
    got = {}
    for x in receipt_matching.near_misses(t, r, most=4).collect():
        got.setdefault(x["tx_id"], {})[x["rank"]] = (x["off"], x["base_name"])
    for k, a in enumerate((edge, edge * 2 + 1, 5, edge * 9)):
        want = sorted((abs(abs(v) - a), f"r{i:02}") for i, v in enumerate(totals) if abs(v) != a)[:4]
        assert [got[k][n + 1] for n in range(4)] == want
