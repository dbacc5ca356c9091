"""Money as whole cents in long columns: conversion, parsing, formatting and exact division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WORDS = ("", "0", "nan", "none", "free")


def floor_div(n: Column, d: int) -> Column:
    """Division of longs by a positive number that rounds down for either sign, exact for all of them."""
    cut = F.call_function("div", n, F.lit(d))
    return F.when(n % d < 0, cut - 1).otherwise(cut)


def milliunits_to_cents(mu: Column) -> Column:
    return floor_div(mu, 10)


def cents_to_milliunits(cents: Column) -> Column:
    return cents * 10


def from_double(dollars: Column) -> Column:
    """Cents of a double that holds whole cents; anything finer rounds."""
    return (dollars.cast("decimal(18,2)") * 100).cast("long")


def dollars_to_cents(dollars: Column) -> Column:
    """Half a cent is added and the rest cut off, for either sign."""
    return F.expr("bigint(0)") + (dollars * 100 + F.lit(0.5)).cast("long")


def dollars_to_milliunits(dollars: Column) -> Column:
    return dollars_to_cents(dollars) * 10


def truncated_cents(dollars: Column) -> Column:
    """A float times 100, cut off toward zero."""
    return (dollars * 100).cast("long")


def lenient_cents(text: Column) -> Column:
    """Cents of text such as ``$1,234.56``; empty, ``free`` and malformed text give 0; digits past the cents are cut off."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"[$, ]", ""))
    value = (bare.try_cast("decimal(20,6)") * 100).try_cast("decimal(20,6)")
    cents = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).try_cast("long")
    return F.when(F.lower(bare).isin(*ZERO_WORDS), F.lit(0)).otherwise(F.coalesce(cents, F.lit(0))).cast("long")


def strict_cents(text: Column) -> Column:
    """Cents of ``[-]digits[.digits]`` with ``$`` and commas; digits past the second are dropped; empty is 0; else null."""
    bare = F.regexp_replace(F.trim(text), r"[$,]", "")
    m = lambda g: F.regexp_extract(bare, r"^(-?)([0-9]*)(?:\.([0-9]*))?$", g)
    whole = F.coalesce(m(2).try_cast("long"), F.lit(0)) * 100
    cents = F.rpad(F.substring(m(3), 1, 2), 2, "0").cast("long")
    amount = F.when(m(1) == "-", -(whole + cents)).otherwise(whole + cents)
    return F.when(bare == "", F.lit(0)).when(bare.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), amount).cast("long")


def is_valid_currency(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[$,]", "").try_cast("decimal(30,10)").isNotNull()


def symbol_cents(text: Column, thousands: bool = True) -> Column:
    """The first amount after a currency sign. Without ``thousands`` a comma ends the number."""
    digits = r"(\d[\d,]*)" if thousands else r"(\d+)"
    pattern = r"[$£€¥]\s*" + digits + r"(?:\.(\d{1,2}))?"
    whole = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    part = F.rpad(F.regexp_extract(text, pattern, 2), 2, "0")
    return F.when(text.rlike(pattern), whole.cast("long") * 100 + part.cast("long"))


def plain(cents: Column) -> Column:
    """``-1,234.05``"""
    a = F.abs(cents)
    whole = F.regexp_replace(floor_div(a, 100).cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")
    return F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def with_symbol(cents: Column) -> Column:
    """``$-45.99``: the sign after the symbol."""
    return F.concat(F.lit("$"), plain(cents))


def signed_symbol(cents: Column) -> Column:
    """``-$45.99``: the sign before the symbol."""
    return F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), plain(F.abs(cents)))


def milliunits_text(mu: Column) -> Column:
    """``-$45.99`` of milliunits."""
    return signed_symbol(milliunits_to_cents(mu))


def with_context(mu: Column, context: Column) -> Column:
    """``$45.99 (context)`` of milliunits; without a context the amount alone."""
    return F.concat(milliunits_text(mu), F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(" ("), context, F.lit(")"))).otherwise(F.lit("")))


def proportional(n: Column, d: Column, total: Column) -> Column:
    """floor(n * total / d); 0 if d is 0. Whole numbers throughout: a quotient with decimals is rounded, so a remainder of d - 1 could count up."""
    product, by = n.cast("decimal(19,0)") * total.cast("decimal(19,0)"), F.nullif(d, F.lit(0)).cast("decimal(19,0)")
    cut, rest = F.call_function("div", product, by), product % by
    return F.when(d == 0, F.lit(0)).otherwise(F.when((rest != 0) & ((rest < 0) != (by < 0)), cut - 1).otherwise(cut)).cast("long")


def with_remainder(amounts: Column, total: Column) -> Column:
    """The array with its last element replaced by what the others leave of the total."""
    rest = F.slice(amounts, 1, F.greatest(F.size(amounts) - 1, F.lit(0)))
    others = F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(amounts) == 0, amounts).otherwise(F.concat(rest, F.array(total - others)))


def normalised(amounts: Column, total: Column) -> Column:
    """The array with its sum's gap to the total added to its first largest element; unchanged if empty or the total is 0."""
    gap = total - F.aggregate(amounts, F.lit(0).cast("long"), lambda a, x: a + x)
    at = F.array_position(amounts, F.array_max(amounts)) - 1
    return F.when((F.size(amounts) == 0) | (total == 0), amounts).otherwise(F.transform(amounts, lambda x, i: F.when(i == at, x + gap).otherwise(x)))
