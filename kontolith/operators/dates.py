"""Completed dates: the year runs along a statement's bookings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Null for what is no date."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def smart_year(rows: DataFrame, key: list[str], order: list[str], base: str = "jahr") -> DataFrame:
    """``datum`` from ``day, month, year`` and the base year.

    A stated year holds from there on; a month at least six below the one before begins the next year. Rows without a
    day have no date and take no part.
    """
    dated = F.col("day").isNotNull()
    run = Window.partitionBy(*key, "_dated").orderBy(*order)
    anchored = rows.withColumn("_dated", dated)
    stated = anchored.withColumn("_group", F.count("year").over(run)).withColumn("_before", F.lag("month").over(run))
    drop = F.when(F.col("year").isNull() & (F.col("_before") - F.col("month") >= 6), 1).otherwise(0)
    within = Window.partitionBy(*key, "_dated", "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    year = F.coalesce(F.first("year", ignorenulls=True).over(within), F.col(base)) + F.sum("_drop").over(within)
    out = stated.withColumn("_drop", drop).withColumn("_year", year)
    return out.withColumn("datum", F.when(F.col("_dated"), safe_date(F.col("_year"), F.col("month"), F.col("day")))).drop("_dated", "_group", "_before", "_drop", "_year")
