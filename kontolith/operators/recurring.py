"""Recurring payments of an account: by reference, else by payee with steady amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontolith.functions.fields import account_or_unknown, booking_type, cadence_name, payee_key, payee_name, reference_key
from kontolith.functions.money import exact_share
from kontolith.operators.cadence import intervals
from kontolith.schemas import MONEY

SURE, LIKELY = "SICHER", "WAHRSCHEINLICH"


def regular(n: Column, mid: Column, low: Column, high: Column) -> Column:
    """At least two intervals, all within 35 % of their median: the shortest and the longest say so for all."""
    return F.coalesce((n >= 2) & (mid > 0) & (high - mid <= 0.35 * mid) & (mid - low <= 0.35 * mid), F.lit(False))


def keyed_bookings(bookings: DataFrame) -> DataFrame:
    """Bookings with ``konto`` filled in and ``schluessel`` (``ref:`` or ``emp:``); those without a key go."""
    by_payee = lambda c: F.nullif(payee_key(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    key = F.coalesce(F.concat(F.lit("ref:"), reference_key(F.col("mandatsref"), F.col("vertragsnr"))), F.concat(F.lit("emp:"), F.coalesce(by_payee("verwendungszweck"), by_payee("empfaenger"))))
    return bookings.withColumn("konto", account_or_unknown(F.col("konto"))).withColumn("schluessel", key).where("schluessel is not null")


def most_frequent(rows: DataFrame, key: list[str], value: str, order: str, name: str) -> DataFrame:
    """The most frequent ``value`` of each group; of equally frequent ones that which came first by ``order``."""
    counted = rows.groupBy(*key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*key).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(name))


def recurring_groups(bookings: DataFrame, all_groups: bool = False) -> DataFrame:
    """A row per recurring group and account, with ``klassifikation``; needs ``seq``.

    Groups need three bookings at regular intervals; those by payee also amounts within 10 % of their mean. With
    ``all_groups`` every group is returned and ``klassifikation`` is null where it isn't recurring.
    """
    key = ["konto", "schluessel"]
    rows = intervals(keyed_bookings(bookings), key).withColumn("art", F.coalesce(F.nullif(F.col("art"), F.lit("")), booking_type(F.col("verwendungszweck"))))
    size = F.abs("betrag")
    shown = F.coalesce(F.nullif(F.col("empfaenger"), F.lit("")), payee_name(F.col("verwendungszweck")))
    g = rows.groupBy(*key).agg(
        F.count("*").alias("anzahl"),
        F.min("datum").alias("erster"),
        F.max("datum").alias("letzter"),
        F.sum("betrag").cast(MONEY).alias("summe"),
        F.sum(size).alias("_abs"),
        F.min(size).alias("_low"),
        F.max(size).alias("_high"),
        F.count("days").alias("_gaps"),
        F.median("days").alias("_mid"),
        F.min("days").alias("_short"),
        F.max("days").alias("_long"),
        F.min_by(shown, "seq").alias("empfaenger"),
        F.min("seq").alias("seq"),
    )
    n, mid = F.col("anzahl"), F.col("_mid")
    even = regular(F.col("_gaps"), mid, F.col("_short"), F.col("_long"))
    spaced = even | ((F.col("_gaps") == 1) & (cadence_name(mid) != "unregelmaessig"))
    in_band = (F.col("_abs") > 0) & ((n * F.col("_high") - F.col("_abs")) * 10 <= F.col("_abs")) & ((F.col("_abs") - n * F.col("_low")) * 10 <= F.col("_abs"))
    recurs = (n >= 3) & spaced & (F.startswith("schluessel", F.lit("ref:")) | in_band)
    kind = F.when(recurs, F.when(even, SURE).otherwise(LIKELY))
    out = g.withColumn("klassifikation", kind).withColumn("turnus", cadence_name(mid)).withColumn("schnitt", exact_share(F.col("summe"), n)).withColumn("schwankung", F.col("_high") > F.col("_low"))
    out = out.join(most_frequent(rows, key, "art", "seq", "art"), key)
    columns = [*key, "empfaenger", "art", "turnus", "anzahl", "erster", "letzter", "schnitt", "summe", "klassifikation", "schwankung", "seq"]
    return (out if all_groups else out.where("klassifikation is not null")).select(*columns)
