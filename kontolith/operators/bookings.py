"""Bookings of statement pages: from lines that begin with a booking day, or from columns that came apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontolith.functions import patterns as P
from kontolith.operators.headers import bare_sign, bare_value
from kontolith.operators.lines import DOC
from kontolith.schemas import MONEY

#: Order of bookings within a statement.
SEQ = ("page_no", "line_no")


def running_balance(lines: DataFrame) -> Column:
    """Whether a page's booking lines carry a running balance: as the layout says, else if three fifths have two amounts."""
    page = Window.partitionBy(DOC, "page_no")
    share = F.avg(F.when(F.col("is_day"), (F.size("amounts") >= 2).cast("int"))).over(page)
    return F.coalesce(F.col("profile.laufender_saldo"), share >= 0.6, F.lit(False))


def amount_and_purpose(line: Column, amounts: Column, head: Column, running: Column) -> tuple[Column, Column, Column]:
    """``betrag, verwendungszweck, explicit`` of a booking line.

    The line's text between its amounts is what splitting at the amounts leaves; the chosen amount's place is the sum of
    what stands before it, and a sign before its digits stays in the purpose.
    """
    n = F.size(amounts)
    k = F.when(running & (n >= 2), n - 1).otherwise(n)  # number of the chosen amount, from 1
    tokens = F.regexp_extract_all(line, F.lit(P.AMOUNT), F.lit(0))
    gaps = F.split(line, P.AMOUNT, -1)
    before = F.concat(F.array_join(F.transform(F.slice(tokens, 1, F.greatest(k - 1, F.lit(0))), lambda t, i: F.concat(F.get(gaps, i), t)), ""), F.get(gaps, k - 1))
    own = F.try_element_at(tokens, F.nullif(k, F.lit(0)))
    lead = F.regexp_extract(own, rf"(?iuU)^([-+]?\s*)(?:{P.AMOUNT_BODY})", 1)
    chosen = F.try_element_at(amounts, F.nullif(k, F.lit(0)))
    rest = F.concat(F.array_join(F.transform(F.slice(tokens, k + 1, F.greatest(n - k, F.lit(0))), lambda t, i: F.concat(F.get(gaps, k + i), t)), ""), F.get(gaps, n))
    tail = F.trim(F.regexp_replace(F.coalesce(rest, F.lit("")), r"(?U)\s+", " "))
    debit, credit = ~chosen["explicit"] & tail.rlike(r"^[5sS$§]$"), ~chosen["explicit"] & tail.rlike("^[hH]$")
    value = F.when(debit, -F.abs(chosen["v"])).when(credit, F.abs(chosen["v"])).otherwise(chosen["v"]).cast(MONEY)
    text = F.when(n > 0, F.concat(before, F.coalesce(lead, F.lit("")))).otherwise(line)
    purpose = _strip(F.substr(text, F.length(head) + 1))
    return value, F.when(n > 0, _strip(F.regexp_replace(purpose, P.VALUE_DATE, ""))).otherwise(purpose), F.when(n > 0, chosen["explicit"] | debit | credit).otherwise(False)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def row_bookings(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Bookings of pages whose rows are whole: each booking-day line with the text lines up to the next; ``betrag`` may be null."""
    whole = lines.where("not apart").join(heads.select(DOC, "profile"), DOC, "left").withColumn("running", running_balance(lines))
    order = Window.partitionBy(DOC, "page_no").orderBy("line_no")
    island = whole.withColumn("bk", F.sum(F.col("is_day").cast("int")).over(order)).where("bk > 0 and (is_day or not (is_head or is_carry))")
    betrag, zweck, explicit = amount_and_purpose(F.col("line"), F.col("amounts"), F.col("head_end"), F.col("running"))
    parts = island.select(DOC, "page_no", "bk", "line_no", "is_day", "day", "month", "year", _strip(F.col("line")).alias("raw"), F.when(F.col("is_day"), betrag).alias("betrag"), F.when(F.col("is_day"), zweck).otherwise(_strip(F.col("line"))).alias("text"), F.when(F.col("is_day"), explicit).alias("explicit"))
    head = lambda c: F.max(F.when(F.col("is_day"), F.col(c)))
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), lambda t: t != ""), " ")
    grouped = parts.groupBy(DOC, "page_no", "bk").agg(F.min("line_no").alias("line_no"), text.alias("verwendungszweck"), *(head(c).alias(c) for c in ("day", "month", "year", "betrag", "explicit", "raw")))
    return grouped.drop("bk")


def segments(lines: DataFrame) -> DataFrame:
    """Text blocks of transactions, numbered from 0 on each page."""
    order = Window.partitionBy(DOC, "page_no").orderBy("line_no")
    begins = F.col("starts") & ~F.col("is_carry")
    marked = lines.withColumn("seg", F.sum(begins.cast("int")).over(order)).where(F.col("seg") > 0).where(begins | ~(F.col("bare_date") | F.col("bare_amount") | F.col("is_carry") | F.col("is_head")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: _strip(x["line"])), " ")
    return marked.groupBy(DOC, "page_no", (F.col("seg") - 1).alias("i")).agg(text.alias("segment"))


def column_bookings(lines: DataFrame, heads: DataFrame, marks: DataFrame) -> DataFrame:
    """Bookings of pages whose columns came apart: the i-th bare amount with the i-th date (else the last) and the i-th text block."""
    apart = lines.where("apart")
    balances = heads.select(DOC, F.explode(F.array_compact(F.array("saldo_alt", "saldo_neu"))).alias("v"))
    known = marks.union(balances).distinct()
    at = Window.partitionBy(DOC, "page_no").orderBy("line_no")
    bare = apart.where("bare_amount").select(DOC, "page_no", "line_no", bare_value(F.col("line")).alias("v"), bare_sign(F.col("line")).alias("s")).where("s <> ''")
    amounts = bare.join(known, [DOC, "v"], "left_anti").withColumn("i", F.row_number().over(at) - 1)
    dates = apart.where("bare_date and is_day").select(DOC, "page_no", F.struct("day", "month", "year").alias("d"), (F.row_number().over(at) - 1).alias("i"))
    last = dates.groupBy(DOC, "page_no").agg(F.max_by("d", "i").alias("last"))
    keys = [DOC, "page_no"]
    joined = amounts.join(dates, [*keys, "i"], "left").join(last, keys, "left").join(segments(apart), [*keys, "i"], "left")
    d = F.coalesce("d", "last")
    text = F.coalesce("segment", F.lit(""))
    value = F.when(F.col("s") == "S", -F.abs("v")).otherwise(F.abs("v")).cast(MONEY)
    return joined.select(*keys, F.col("i").alias("line_no"), text.alias("verwendungszweck"), d["day"].alias("day"), d["month"].alias("month"), d["year"].alias("year"), value.alias("betrag"), F.lit(True).alias("explicit"), F.when(text != "", text).otherwise("delaminiert").alias("raw"))


def parsed_bookings(lines: DataFrame, heads: DataFrame, marks: DataFrame) -> DataFrame:
    return row_bookings(lines, heads).unionByName(column_bookings(lines, heads, marks))


def complete(bookings: DataFrame) -> DataFrame:
    return bookings.where("betrag is not null")


def incomplete_lines(bookings: DataFrame) -> DataFrame:
    """``quelle_pdf, unvollstaendige``: booking lines without an amount, in order."""
    text = F.concat("raw", F.lit("  [betrag_fehlt]"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*SEQ, text.alias("t")))), lambda x: x["t"])
    return bookings.where("betrag is null").groupBy(DOC).agg(listed.alias("unvollstaendige"))
