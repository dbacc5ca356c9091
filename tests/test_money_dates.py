from pyspark.sql import functions as F

from centime.functions import dates, money
from centime.operators.splits import receipt_splits


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_lenient_parse(spark):
    cases = [("$45.99", 4599), ("45.99", 4599), ("", 0), ("FREE", 0), ("invalid", 0), ("1,234.56", 123456), ("12", 1200), ("12.5", 1250), ("-12.34", -1234), ("nan", 0)]
    assert values(spark, [(a,) for a, _ in cases], "s string", money.lenient_cents(F.col("s"))) == [b for _, b in cases]


def test_strict_parse(spark):
    cases = [("$1,234.567", 123456), ("-0.05", -5), ("", 0), ("7", 700), ("x1", None), ("1.2.3", None), (".5", 50)]
    assert values(spark, [(a,) for a, _ in cases], "s string", money.strict_cents(F.col("s"))) == [b for _, b in cases]


def test_formats(spark):
    rows = [(5,), (-4599,), (123456789,)]
    assert values(spark, rows, "c long", money.plain(F.col("c"))) == ["0.05", "-45.99", "1,234,567.89"]
    assert values(spark, rows, "c long", money.with_symbol(F.col("c")))[1] == "$-45.99"
    assert values(spark, rows, "c long", money.signed_symbol(F.col("c")))[1] == "-$45.99"


def test_milliunits_round_down(spark):
    assert values(spark, [(-45995,), (45995,), (None,)], "c long", money.milliunits_to_cents(F.col("c"))) == [-4600, 4599, None]


def test_symbol_amounts(spark):
    text = [("total $1,234.56",), ("£7",), ("none",)]
    assert values(spark, text, "s string", money.symbol_cents(F.col("s"))) == [123456, 700, None]
    assert values(spark, text, "s string", money.symbol_cents(F.col("s"), thousands=False))[0] == 100


def test_arrays(spark):
    rows = [([1, 2, 3], 10), ([], 5), ([4], 0)]
    assert values(spark, rows, "a array<long>, t long", money.with_remainder(F.col("a"), F.col("t"))) == [[1, 2, 7], [], [0]]
    assert values(spark, rows, "a array<long>, t long", money.normalised(F.col("a"), F.col("t"))) == [[1, 2, 7], [], [4]]


def test_proportional(spark):
    assert values(spark, [(1, 3, 100), (5, 0, 10), (-1, 3, 100)], "n long, d long, t long", money.proportional(F.col("n"), F.col("d"), F.col("t"))) == [33, 0, -34]


def test_dates(spark):
    rows = [("2024-01-02T03:04",), ("Jan 2, 2024",), ("January 2, 2024",), ("bad",), (None,)]
    assert [str(d) for d in values(spark, rows, "s string", dates.receipt_date(F.col("s")))] == ["2024-01-02"] * 3 + ["None", "None"]
    assert [str(d) for d in values(spark, [("Not Available",), ("",), ("2024-05-06",)], "s string", dates.ship_date(F.col("s")))] == ["None", "None", "2024-05-06"]


def test_exact_beyond_doubles_and_contexts(spark):
    big = (1 << 60) + 7
    assert values(spark, [(big,), (-big,), (-30,), (-25,)], "c long", money.floor_div(F.col("c"), 30)) == [big // 30, -big // 30, -1, -1]
    assert values(spark, [(big,)], "c long", money.plain(F.col("c"))) == [f"{big // 100:,}.{big % 100:02}"]
    assert values(spark, [(-45_990, "tax"), (45_990, ""), (5, None)], "c long, t string", money.with_context(F.col("c"), F.col("t"))) == ["-$45.99 (tax)", "$45.99", "$0.00"]
    assert values(spark, [(19.99,), (0.005,)], "d double", money.dollars_to_milliunits(F.col("d"))) == [19990, 10]
    assert values(spark, [(19.99,)], "d double", money.truncated_cents(F.col("d"))) == [1998]


def test_proportional_keeps_a_remainder_just_under_a_whole(spark):
    """shares of 0.9999997 were rounded to one before they were cut; products over a long failed."""
    d = 3_000_001
    rows = [(d - 1, d, 1), (1, d, 2 * d - 1), (1 - d, d, 1), (d - 1, -d, 1), (1 << 40, 1 << 41, 1 << 40)]
    expected = [n * t // by for n, by, t in rows]
    assert values(spark, rows, "n long, d long, t long", money.proportional(F.col("n"), F.col("d"), F.col("t"))) == expected


def test_receipt_tax_is_shared_without_rounding_up(spark):
    base, tax, first = 30_000_011, 2_400_000, 1_363_638  # first * tax % base is base - 1
    rows = [(1, -1, 0, "a", first, base, tax), (1, -1, 1, "b", base - first, base, tax)]
    found = receipt_splits(spark.createDataFrame(rows, "tx_id long, tx_mu long, idx int, name string, cents long, subtotal_cents long, tax_cents long"))
    assert [r["tax_cents"] for r in found.orderBy("idx").collect()] == [first * tax // base, tax - first * tax // base]
