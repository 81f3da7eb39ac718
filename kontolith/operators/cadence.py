"""Cadence of fixed costs and notes on changed amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions.fields import cadence_name, group_key
from kontolith.functions.money import german


def intervals(rows: DataFrame, key: list[str], date: str = "datum", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``rows`` with ``days``: positive days since the group's previous dated row, else null."""
    dated = F.col(date).isNotNull()
    by = Window.partitionBy(*key, dated).orderBy(date, *order)
    gap = F.datediff(F.col(date), F.lag(date).over(by))
    return rows.withColumn("days", F.when(dated & (gap > 0), gap))


def group_cadence(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key, turnus``: the name of the median interval; ``einmalig/unklar`` if there is one dated row only."""
    return rows.groupBy(*key).agg(F.when(F.count("datum") == 1, "einmalig/unklar").otherwise(cadence_name(F.median("days"))).alias("turnus"))


def price_note(amount: Column, before: Column) -> Column:
    """Note on an amount that differs from the one before; null if it doesn't."""
    now, was = F.abs(amount).cast(S.MONEY), F.abs(before).cast(S.MONEY)
    text = F.concat(german(was), F.lit(" -> "), german(now))
    return F.when(now > was, F.concat(F.lit("Preiserhoehung: "), text)).when(now < was, F.concat(F.lit("Betragsaenderung: "), text))


def cadence_and_prices(bookings: DataFrame, per_account: bool = False) -> DataFrame:
    """``turnus`` and ``vermerk`` of fixed costs, grouped by purpose key (across accounts unless ``per_account``); needs ``seq``.

    A price note replaces what ``vermerk`` held.
    """
    fixed = F.col("kategorie") == S.FIXED
    key = ["_key", "konto"] if per_account else ["_key"]
    keyed = bookings.where(fixed).withColumn("_key", group_key(F.col("verwendungszweck")))
    named = group_cadence(intervals(keyed, key), key)
    dated = F.col("datum").isNotNull()
    by = Window.partitionBy(*key, dated).orderBy("datum", "seq")
    noted = keyed.withColumn("_note", F.when(dated, price_note(F.col("betrag"), F.lag("betrag").over(by)))).drop("turnus").join(named, key)
    done = noted.withColumn("vermerk", F.coalesce("_note", "vermerk")).select(*bookings.columns)
    return bookings.where(~F.coalesce(fixed, F.lit(False))).unionByName(done)
