"""Reconciliation of statements and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontolith import schemas as S


def balance_status(old: Column, new: Column, total: Column) -> tuple[Column, Column]:
    """Status and difference: old balance plus bookings less new balance; no status without both balances."""
    known = old.isNotNull() & new.isNotNull()
    diff = F.when(known, old + F.coalesce(total, F.lit(0)) - new).otherwise(0).cast(S.MONEY)
    return F.when(~known, S.NO_BALANCE).when(diff == 0, S.OK).otherwise(S.CHECK), diff


def check_statements(heads: DataFrame, bookings: DataFrame, key: str) -> DataFrame:
    """``heads`` with ``summe, anzahl, status, saldo_differenz``."""
    sums = bookings.groupBy(key).agg(F.sum("betrag").cast(S.MONEY).alias("summe"), F.count("*").alias("anzahl"))
    status, diff = balance_status(F.col("saldo_alt"), F.col("saldo_neu"), F.col("summe"))
    out = heads.join(sums, key, "left").withColumn("status", status).withColumn("saldo_differenz", diff)
    return out.withColumn("summe", F.coalesce("summe", F.lit(0)).cast(S.MONEY)).withColumn("anzahl", F.coalesce("anzahl", F.lit(0)).cast("long"))


def spread_status(bookings: DataFrame, statements: DataFrame, key: str) -> DataFrame:
    """Every booking with its statement's status and difference; the join is by key, of any number of statements."""
    return bookings.join(statements.select(key, "status", F.col("saldo_differenz").alias("auszug_differenz")), key, "left")


def control_report(statements: DataFrame) -> DataFrame:
    """A row per statement with at most twelve of its incomplete lines and their full number."""
    listed = F.coalesce("unvollstaendige", F.array().cast("array<string>"))
    return statements.select("quelle_pdf", "bank_profil", "konto", "jahr", "anzahl", "saldo_alt", "summe", "saldo_neu", "status", "saldo_differenz", F.size(listed).alias("n_unvollstaendig"), F.slice(listed, 1, 12).alias("unvollstaendige"))


def status_counts(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("status").agg(F.count("*").alias("anzahl"))


def looks_masked(bookings: DataFrame) -> DataFrame:
    """One row: rows with a masked name or account, and whether they are at least a fifth."""
    hit = F.contains("verwendungszweck", F.lit("[NAME]")) | F.contains("verwendungszweck", F.lit("DE**"))
    return bookings.agg(F.count_if(hit).alias("treffer"), F.count("*").alias("anzahl")).select("treffer", "anzahl", (F.col("treffer") >= F.greatest(F.lit(1), F.floor(F.col("anzahl") / 5))).alias("anonymisiert"))
