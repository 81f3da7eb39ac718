"""A statement's bank layout, account, base year and labelled balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions import money
from kontolith.functions import patterns as P
from kontolith.operators.lines import DOC


def matched_profile(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``quelle_pdf, profile``: the first layout by priority of which a key word occurs in the text; the others have none.

    Layouts are configuration, a handful of rows, so the comparison is one pass over the texts.
    """
    text = docs.select(DOC, F.lower("ocr_text").alias("_t"))
    hit = F.exists("erkennung", lambda k: F.contains(F.col("_t"), F.lower(k)))
    best = F.min_by(F.struct("name", "saldo_alt", "saldo_neu", "laufender_saldo"), "priority")
    return text.join(F.broadcast(profiles), hit, "inner").groupBy(DOC).agg(best.alias("profile"))


def account_of(text: Column) -> Column:
    iban = F.replace(F.regexp_extract(text, P.IBAN, 0), F.lit(" "), F.lit(""))
    number = F.regexp_extract(text, P.ACCOUNT_NUMBER, 1)
    return F.when(iban != "", iban).when(number != "", number).otherwise(S.UNKNOWN_ACCOUNT)


def base_year_of(text: Column) -> Column:
    """Year of the statement's number, else of its period, else the first plausible one."""
    pick = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    first = F.filter(F.transform(F.regexp_extract_all(text, F.lit(P.FULL_YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: (y >= 1990) & (y <= 2100))
    return F.coalesce(pick(P.YEAR_OF_NUMBER), pick(P.YEAR_OF_PERIOD), F.try_element_at(first, F.lit(1)))


def checkpoints(lines: DataFrame) -> DataFrame:
    """``quelle_pdf, v``: the distinct amounts on carried lines."""
    return lines.where("is_carry").select(DOC, F.explode("amounts").alias("a")).select(DOC, F.col("a.v").alias("v")).distinct()


def bare_value(line: Column) -> Column:
    return money.decimal_of(F.concat(F.regexp_extract(line, P.BARE_AMOUNT, 1), F.lit(","), F.regexp_extract(line, P.BARE_AMOUNT, 2)))


def bare_sign(line: Column) -> Column:
    return F.upper(F.regexp_extract(line, P.BARE_AMOUNT, 3))


def labelled_balances(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """``quelle_pdf, saldo_alt, saldo_neu``: last amount of the first line with a label (the layout's or a usual one) and an amount."""
    low = F.lower("line")
    with_p = lines.where(F.size("amounts") > 0).join(profile, DOC, "left")
    order = F.struct("page_no", "line_no")

    def has(usual: tuple[str, ...], own: str) -> Column:
        labels = F.concat(F.coalesce(F.col(f"profile.{own}"), F.array().cast("array<string>")), F.array(*map(F.lit, usual)))
        return F.exists(labels, lambda x: F.contains(low, x))

    last = F.try_element_at("amounts", F.lit(-1))["v"]
    flagged = with_p.select(DOC, order.alias("o"), last.alias("v"), has(P.OLD_BALANCE, "saldo_alt").alias("old"), has(P.NEW_BALANCE, "saldo_neu").alias("new"))
    return flagged.groupBy(DOC).agg(F.min_by(F.when(F.col("old"), F.col("v")), F.when(F.col("old"), F.col("o"))).alias("saldo_alt"), F.min_by(F.when(F.col("new"), F.col("v")), F.when(F.col("new"), F.col("o"))).alias("saldo_neu"))


def bare_old_balance(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Old balance where the first page's columns came apart: its first bare credit amount that is on no carried line."""
    first = lines.where("page_no = 0 and apart")
    bare = first.where("bare_amount").select(DOC, "line_no", bare_value(F.col("line")).alias("v"), bare_sign(F.col("line")).alias("s")).where("s = 'H'")
    return bare.join(marks, [DOC, "v"], "left_anti").groupBy(DOC).agg(F.min_by("v", "line_no").alias("bare_alt"))


def statement_heads(docs: DataFrame, lines: DataFrame, profiles: DataFrame, marks: DataFrame, zero_is_balance: bool = True) -> DataFrame:
    """``quelle_pdf, konto, jahr, bank_profil, profile, saldo_alt, saldo_neu``. Without ``zero_is_balance`` an old balance of 0,00 counts as missing."""
    profile = matched_profile(docs, profiles)
    text = F.col("ocr_text")
    head = docs.select(DOC, account_of(text).alias("konto"), base_year_of(text).alias("jahr"))
    old = F.col("saldo_alt") if zero_is_balance else F.nullif(F.col("saldo_alt"), F.lit(0).cast(S.MONEY))
    return (
        head.join(profile, DOC, "left")
        .join(labelled_balances(lines, profile), DOC, "left")
        .join(bare_old_balance(lines, marks), DOC, "left")
        .select(DOC, "konto", "jahr", F.coalesce("profile.name", F.lit("generisch")).alias("bank_profil"), "profile", F.coalesce(old, "bare_alt").alias("saldo_alt"), "saldo_neu")
    )
