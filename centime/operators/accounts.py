"""Projections of accounts, payees, categories and e-mails."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of account types in the order they are tried.
ACCOUNT_TYPES = (("401k", "401(k)"), ("403b", "403(b)"), ("roth", "Roth IRA"), ("ira", "IRA"), ("tsp", "TSP"))


def clean_name(name: Column) -> Column:
    return F.translate(name, " ", " ")


def payee_contains(payee: Column, pattern: str) -> Column:
    """Case-insensitive substring; an empty pattern passes all, a null payee only then."""
    return F.lit(True) if not pattern else F.coalesce(F.contains(F.lower(payee), F.lit(pattern.lower())), F.lit(False))


def provider(name: Column) -> Column:
    """What stands before ``:``, cut at a possessive; ``Unknown`` without a colon."""
    head = F.trim(F.substring_index(name, ":", 1))
    return F.when(F.contains(name, F.lit(":")), F.element_at(F.split(head, "'s "), -1)).otherwise("Unknown")


def account_type(name: Column) -> Column:
    low, found = F.lower(name), F.lit("Investment")
    for mark, kind in reversed(ACCOUNT_TYPES):
        found = F.when(F.contains(low, F.lit(mark)), kind).otherwise(found)
    return found


def retirement_accounts(accounts: DataFrame) -> DataFrame:
    """Open tracked accounts of other assets with provider and type, in order of name."""
    kept = accounts.where("type = 'otherAsset' and not on_budget and not closed")
    return kept.withColumns({"provider": provider(F.col("name")), "account_type": account_type(F.col("name"))}).orderBy("name")


def retirement_totals(accounts: DataFrame) -> DataFrame:
    """One row: how many retirement accounts there are and the sum of their balances in milliunits."""
    return accounts.agg(F.count("*").alias("accounts"), F.coalesce(F.sum("balance"), F.lit(0)).alias("balance"))


def folders(mail: DataFrame) -> DataFrame:
    """Folders of mail (folder) with their counts, the fullest first."""
    return mail.groupBy("folder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder")


def categories(groups: DataFrame) -> DataFrame:
    """Nested category groups (id, name, categories array) to one row a category, with its full name."""
    flat = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"), F.inline("categories"))
    return flat.withColumn("full_name", F.concat_ws(": ", "group_name", "name"))


def matches_any(text: Column, phrases: list[str]) -> Column:
    """Does the text hold one of the phrases, whatever the case?"""
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(p.lower()) for p in phrases)), F.lit(False))


def is_receipt_mail(sender: Column, subject: Column, body: Column, senders: list[str], subjects: list[str], contents: list[str], excluded: list[str]) -> Column:
    return matches_any(sender, senders) & matches_any(subject, subjects) & matches_any(body, contents) & ~matches_any(F.concat_ws(" ", subject, body), excluded)


def unprocessed(pages: DataFrame, receipts: DataFrame) -> DataFrame:
    return pages.join(receipts.select("base_name"), "base_name", "left_anti")


def mail_file_name(day: Column, subject: Column, message_id: Column) -> Column:
    return F.concat_ws("_", F.date_format(day, "yyyyMMdd"), F.regexp_replace(F.substring(subject, 1, 50), r"[^\w\-_.]", "_"), F.substring(F.sha2(message_id.cast("binary"), 256), 1, 8))
