"""The sheets of the ledger as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions.fields import account_label, account_or_unknown, cadence_text, last_four
from kontolith.functions.money import exact_share

_null = lambda c: F.nullif(F.col(c), F.lit(""))


def ledger_order() -> list:
    """Date with missing ones last, account, place."""
    return [F.col("datum").asc_nulls_last(), F.col("konto"), F.col("seq")]


def account_suffixes(bookings: DataFrame) -> DataFrame:
    """``konto, suffix``: the last four characters; accounts that share them are numbered in order of their first booking."""
    firsts = bookings.groupBy(account_or_unknown(F.col("konto")).alias("konto")).agg(F.min("seq").alias("_first")).withColumn("_base", last_four(F.col("konto")))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("_first", "konto"))
    return firsts.select("konto", F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), n.cast("string"))).alias("suffix"))


def account_overview(bookings: DataFrame, masked: bool = False) -> DataFrame:
    """A row per account: label, sheet, number, first and last date, worst status."""
    konto = account_or_unknown(F.col("konto"))
    by = bookings.groupBy(konto.alias("konto")).agg(
        F.count("*").alias("anzahl"), F.min("datum").alias("von"), F.max("datum").alias("bis"),
        F.when(F.bool_or(F.col("status") == S.CHECK), S.CHECK).when(F.bool_or(F.col("status") == S.OK), S.OK).otherwise(S.NO_BALANCE).alias("status"),
    )
    named = by.join(account_suffixes(bookings), "konto")
    return named.select(account_label(F.col("konto"), masked).alias("konto"), F.concat(F.lit("Journal_"), "suffix").alias("blatt"), "anzahl", "von", "bis", "status")


def journal(bookings: DataFrame) -> DataFrame:
    """Journal columns; the cell that doesn't apply and empty texts are null."""
    up = F.col("betrag") >= 0
    texts = ("empfaenger", "verwendungszweck", "art", "referenz", "mandatsref", "glaeubiger_id", "vertragsnr", "typ", "vermerk")
    return bookings.select(account_or_unknown(F.col("konto")).alias("konto"), "datum", *(_null(c).alias(c) for c in texts), F.when(up, F.col("betrag")).alias("einnahme"), F.when(~up, F.col("betrag")).alias("ausgabe"), "status", "seq")


def journal_sheets(bookings: DataFrame) -> DataFrame:
    """The journal with ``blatt``, the sheet of its account, in each sheet's order."""
    rows = journal(bookings).join(account_suffixes(bookings), "konto")
    return rows.withColumn("blatt", F.concat(F.lit("Journal_"), "suffix")).drop("suffix").orderBy("blatt", F.col("datum").asc_nulls_last(), "seq")


def fixed_costs(bookings: DataFrame) -> DataFrame:
    """Bookings of fixed costs with their group, in order of group and date."""
    group = F.coalesce(_null("empfaenger"), F.substring("verwendungszweck", 1, 30))
    rows = bookings.where(F.col("kategorie") == S.FIXED).withColumn("gruppe", group)
    return rows.select("gruppe", "konto", "datum", "verwendungszweck", F.abs("betrag").cast(S.MONEY).alias("betrag"), "turnus", cadence_text(F.col("turnus")).alias("erklaerung"), "vermerk", "seq").orderBy(F.lower("gruppe"), F.col("datum").asc_nulls_last(), "seq")


def fixed_cost_totals(bookings: DataFrame) -> DataFrame:
    """One row: the sum of all amounts (all years and accounts) and a twelfth of it."""
    total = F.coalesce(F.sum(F.abs("betrag")), F.lit(0)).cast(S.MONEY)
    return bookings.where(F.col("kategorie") == S.FIXED).agg(total.alias("summe")).select("summe", exact_share(F.col("summe"), F.lit(12)).alias("monatlich"))


def consumption_totals(bookings: DataFrame) -> DataFrame:
    """Per consumption category the sum and the average of the months with bookings; both categories always."""
    both = bookings.sparkSession.createDataFrame([(S.LIVING,), (S.FUEL,)], "kategorie string")
    sums = bookings.where(F.col("kategorie").isin(S.LIVING, S.FUEL)).groupBy("kategorie").agg(F.sum(F.abs("betrag")).cast(S.MONEY).alias("summe"), F.countDistinct(F.trunc("datum", "MM")).alias("monate"))
    joined = both.join(sums, "kategorie", "left").select("kategorie", F.coalesce("summe", F.lit(0)).cast(S.MONEY).alias("summe"), F.greatest(F.lit(1), F.coalesce("monate", F.lit(0))).cast("long").alias("monate"))
    return joined.withColumn("schnitt", exact_share(F.col("summe"), F.col("monate")))


def consumption(bookings: DataFrame) -> DataFrame:
    return bookings.where(F.col("kategorie").isin(S.LIVING, S.FUEL)).select("kategorie", "konto", "datum", "verwendungszweck", F.abs("betrag").cast(S.MONEY).alias("betrag"), "seq")


def recurring_view(groups: DataFrame) -> DataFrame:
    """Recurring groups by falling size of their sum; groups by reference before those by payee."""
    by_payee = F.startswith("schluessel", F.lit("emp:"))
    out = groups.withColumn("schwankung", F.when(F.col("schwankung"), "ja").otherwise("nein"))
    return out.orderBy("konto", F.abs("summe").desc(), by_payee, "seq").select("konto", "empfaenger", "art", "turnus", "anzahl", "erster", "letzter", "schnitt", "summe", "klassifikation", "schwankung")


def to_check(bookings: DataFrame) -> DataFrame:
    return bookings.where(F.col("status") == S.CHECK).select("konto", "datum", "verwendungszweck", "betrag", "auszug_differenz", "quelle_pdf")


def with_placeholder(view: DataFrame, column: str, text: str) -> DataFrame:
    """``view``, or one row with ``text`` if it has none."""
    row = view.sparkSession.range(1).select(*(F.lit(text if c == column else None).cast(t).alias(c) for c, t in view.dtypes))
    return view.unionByName(row.join(view.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))
