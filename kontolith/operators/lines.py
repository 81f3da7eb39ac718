"""Statement texts to pages and lines; everything a later stage asks of a line is computed here, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontolith.functions import money
from kontolith.functions import patterns as P

DOC = "quelle_pdf"


def pages(docs: DataFrame) -> DataFrame:
    """``quelle_pdf, page_no, page`` of ``quelle_pdf, ocr_text``; blank pages go."""
    split = docs.select(DOC, F.posexplode(F.split("ocr_text", P.PAGE_BREAK)).alias("page_no", "page"))
    return split.where(F.regexp_replace("page", r"(?U)\s", "") != "")


def lines(docs: DataFrame) -> DataFrame:
    """A row per non-blank line with ``page_no, line_no``, its amounts, whether it is a booking day, carried line, head, bare date or amount.

    ``apart``: the columns of its page came apart, that is at least three lines are a date alone and three an amount alone.
    """
    bare = lambda pattern: F.size(F.filter("all", lambda x: x.rlike(pattern)))
    split = pages(docs).select(DOC, "page_no", F.split("page", P.LINE_BREAK).alias("all"))
    flagged = split.select(DOC, "page_no", "all", ((bare(P.BARE_DATE) >= 3) & (bare(P.BARE_AMOUNT) >= 3)).alias("apart"))
    raw = flagged.select(DOC, "page_no", "apart", F.posexplode("all").alias("line_no", "line")).where(F.regexp_replace("line", r"(?U)\s", "") != "")
    low = F.lower("line")
    year = F.regexp_extract("line", P.BOOKING_DAY, 3)
    contains_any = lambda labels: _any(low, labels)
    return (
        raw.withColumn("head_end", F.regexp_extract("line", P.BOOKING_DAY, 0))
        .withColumn("is_day", (F.col("head_end") != "") & (F.length(year) != 4))
        .withColumn("day", F.when(F.col("is_day"), F.regexp_extract("line", P.BOOKING_DAY, 1).try_cast("int")))
        .withColumn("month", F.when(F.col("is_day"), F.regexp_extract("line", P.BOOKING_DAY, 2).try_cast("int")))
        .withColumn("year", F.when(F.col("is_day") & (F.length(year) == 2), year.try_cast("int") + 2000))
        .withColumn("amounts", money.amounts(F.col("line")))
        .withColumn("is_carry", F.col("line").rlike(P.CARRY) | contains_any(P.OLD_BALANCE + P.NEW_BALANCE))
        .withColumn("is_head", contains_any(P.HEAD_LABELS))
        .withColumn("bare_date", F.col("line").rlike(P.BARE_DATE))
        .withColumn("bare_amount", F.col("line").rlike(P.BARE_AMOUNT))
        .withColumn("starts", F.col("line").rlike(P.TRANSACTION))
    )


def _any(text, labels):
    out = F.contains(text, F.lit(labels[0]))
    for x in labels[1:]:
        out = out | F.contains(text, F.lit(x))
    return out
