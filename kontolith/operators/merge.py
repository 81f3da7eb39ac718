"""Append of new bookings to stored ones without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontolith.functions.fields import squeezed
from kontolith.schemas import MONEY


def dedup_key(date: str = "datum", purpose: str = "verwendungszweck", amount: str = "betrag", account: str = "konto") -> Column:
    """Date, squeezed lower-case purpose, amount and account, never null, so that equal keys join."""
    return F.struct(
        F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("")).alias("d"),
        F.lower(squeezed(F.coalesce(F.col(purpose), F.lit("")))).alias("z"),
        F.coalesce(F.col(amount).cast(MONEY), F.lit(0).cast(MONEY)).alias("b"),
        F.trim(F.coalesce(F.col(account), F.lit(""))).alias("k"),
    )


def append_merge(old: DataFrame, new: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """All of ``old``, and of ``new`` the first row (by ``order``) of each key that ``known`` (``old``) lacks; columns of ``old``."""
    keyed = new.withColumn("_key", dedup_key())
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1")
    fresh = first.join((old if known is None else known).select(dedup_key().alias("_key")).distinct(), "_key", "left_anti")
    return old.unionByName(fresh.select(*old.columns))
