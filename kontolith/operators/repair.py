"""Repair of one misread amount on a page by its carried balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontolith.functions import patterns as P
from kontolith.functions.money import cents
from kontolith.operators.lines import DOC
from kontolith.schemas import MONEY


def digit_variants(amount: Column) -> Column:
    """Distinct amounts that deleting one digit of the cents leaves, with the same sign."""
    digits = F.abs(cents(amount)).cast("string")
    shorter = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.concat(F.substr(digits, F.lit(1), i - 1), F.substr(digits, i + 1)))
    value = lambda x: (x.cast("bigint") * F.when(amount < 0, -1).otherwise(1)).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")
    return F.array_distinct(F.transform(F.filter(shorter, lambda x: x != ""), lambda x: value(x).cast(MONEY)))


def page_gaps(lines: DataFrame, bookings: DataFrame) -> DataFrame:
    """``gap`` of pages with a carry-over line and at least two carried amounts: last less first, less the bookings' sum; only if not 0."""
    last = F.try_element_at("amounts", F.lit(-1))["v"]
    carried = lines.groupBy(DOC, "page_no").agg(
        F.bool_or(F.col("line").rlike(P.CARRY_OVER)).alias("over"),
        F.count_if(F.col("is_carry") & last.isNotNull()).alias("n"),
        F.min_by(F.when(F.col("is_carry"), last), F.when(F.col("is_carry") & last.isNotNull(), F.col("line_no"))).alias("first"),
        F.max_by(F.when(F.col("is_carry"), last), F.when(F.col("is_carry") & last.isNotNull(), F.col("line_no"))).alias("last"),
    )
    sums = bookings.groupBy(DOC, "page_no").agg(F.sum("betrag").alias("sum"))
    gap = (F.col("last") - F.col("first") - F.coalesce("sum", F.lit(0))).cast(MONEY)
    return carried.where("over and n >= 2").join(sums, [DOC, "page_no"], "left").select(DOC, "page_no", gap.alias("gap")).where("gap <> 0")


def repair_by_checkpoints(lines: DataFrame, bookings: DataFrame) -> DataFrame:
    """Where exactly one deleted digit of one booking closes a page's gap, that amount is replaced and noted in ``vermerk``."""
    keys = [DOC, "page_no"]
    tried = bookings.join(page_gaps(lines, bookings), keys).select(*keys, "line_no", "betrag", "gap", F.explode(digit_variants(F.col("betrag"))).alias("v")).where(F.col("v") - F.col("betrag") == F.col("gap"))
    sole = tried.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n = 1").select(*keys, "line_no", F.col("v").alias("fixed"))
    out = bookings.join(sole, [*keys, "line_no"], "left")
    note = F.concat(F.lit("OCR-Korrektur via Saldo-Checkpoint: "), F.col("betrag").cast("string"), F.lit(" -> "), F.col("fixed").cast("string"))
    return out.withColumn("vermerk", F.coalesce(note, F.lit(""))).withColumn("betrag", F.coalesce("fixed", "betrag")).drop("fixed")
