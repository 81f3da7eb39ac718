"""German amounts: tokens of a line, signs, decimals, rendering, exact division in cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontolith.functions import patterns as P
from kontolith.schemas import MONEY


def decimal_of(body: Column) -> Column:
    """``1.234,56`` as DECIMAL(18,2); null if it is none."""
    return F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(MONEY)


def _signed(token: Column) -> Column:
    """One matched amount token to ``(v, explicit)``: S and - are negative; H and + win over both."""
    pre, post = F.regexp_extract(token, P.AMOUNT, 1), F.upper(F.regexp_extract(token, P.AMOUNT, 3))
    body = decimal_of(F.regexp_extract(token, P.AMOUNT, 2))
    negative = ((pre == "-") | post.isin("-", "S")) & ~((pre == "+") | post.isin("+", "H"))
    return F.struct(F.when(negative, -body).otherwise(body).cast(MONEY).alias("v"), (pre.isin("-", "+") | post.isin("-", "+", "S", "H")).alias("explicit"))


def amounts(line: Column) -> Column:
    """All amounts of a line in order: array of ``(v, explicit)``."""
    return F.transform(F.regexp_extract_all(line, F.lit(P.AMOUNT), F.lit(0)), _signed)


def amount_of(text: Column) -> Column:
    """The first amount of a text, or null."""
    return F.try_element_at(amounts(text), F.lit(1))["v"]


def german(amount: Column) -> Column:
    """``1.234,56``."""
    return F.translate(F.format_number(amount.cast(MONEY), 2), ",.", ".,")


def cents(amount: Column) -> Column:
    return (amount.cast(MONEY) * 100).cast("bigint")


def exact_share(total: Column, n: Column) -> Column:
    """``total / n`` rounded half away from zero to cents, in integers; null for n = 0."""
    c, k = cents(total), n.cast("bigint")
    twice = 2 * F.abs(c) + k
    whole = ((twice - F.pmod(twice, 2 * k)).cast("decimal(20,0)") / (2 * k)).cast("bigint")  # exact: no remainder is left
    return (F.when(c < 0, -whole).otherwise(whole).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)
