"""Sources: statement texts, stored bookings, foreign journals, bank layouts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions import patterns as P
from kontolith.functions.money import decimal_of
from kontolith.plans.cuts import row_in_partition
from kontolith.sources.sinks import current_parts

#: Column of a row's place in its source, where a source has an order.
ORDER = "_order"


def read_statement_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``quelle_pdf, ocr_text``: a row per file under ``path``; the column order of sources is their path's."""
    return spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path).select(F.col("_metadata.file_name").alias("quelle_pdf"), F.col("value").alias("ocr_text"))


def source_paths(spark: SparkSession, path: str, pattern: str = "*.txt") -> list[str]:
    """The files that :func:`read_statement_texts` reads."""
    return spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path).inputFiles()


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the PDF files in a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path).select("path", "length").distinct()


def decoded_bookings(rows: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """Any table with some of the booking columns as a full one: casts, defaults for what is missing or null; rows of nulls go.

    ``more``: columns that are kept beside them.
    """
    have = set(rows.columns)
    known = [f.name for f in S.BOOKING if f.name in have]
    rows = rows.where(F.coalesce(*(F.col(c).cast("string") for c in known)).isNotNull()) if known else rows.limit(0)
    cols = []
    for f in S.BOOKING:
        value = F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        default = S.BOOKING_DEFAULTS.get(f.name)
        cols.append((value if default is None else F.coalesce(value, F.lit(default).cast(f.dataType))).alias(f.name))
    return rows.select(*cols, *(more or []))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Stored bookings with ``seq``; an empty table if there are none yet."""
    parts = current_parts(spark, path)
    if not parts:
        return spark.createDataFrame([], S.STATE)
    return decoded_bookings(spark.read.schema(S.STATE).parquet(*parts), [F.col("seq")])


def _number(c: Column) -> Column:
    """German number text, or a plain number with a decimal point."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[-+]?\d+(\.\d{1,2})?$"), text.try_cast(S.MONEY)).otherwise(decimal_of(text))


def journal_bookings(rows: DataFrame) -> DataFrame:
    """A foreign journal as bookings.

    Columns are found by name; ``betrag`` wins, else income plus expense (already negative). A missing purpose is
    replaced by the payee; rows with neither purpose nor amount go.
    """
    found: dict[str, str] = {}
    for c in rows.columns:
        field = P.JOURNAL_COLUMNS.get(c.strip().lower())
        if field and field not in found:
            found[field] = c
    text = lambda f: F.trim(F.coalesce(F.col(f"`{found[f]}`").cast("string"), F.lit(""))) if f in found else F.lit("")
    money = lambda f: _number(F.col(f"`{found[f]}`")) if f in found else F.lit(None).cast(S.MONEY)
    zero = F.lit(0).cast(S.MONEY)
    amount = F.coalesce(money("betrag"), F.coalesce(money("einnahme"), zero) + F.coalesce(money("ausgabe"), zero)).cast(S.MONEY)
    purpose = F.when(text("verwendungszweck") != "", text("verwendungszweck")).otherwise(text("empfaenger"))
    date = F.try_to_date(F.substring(text("datum"), 1, 10), "yyyy-MM-dd")
    kept = [F.col(ORDER)] if ORDER in rows.columns else []
    out = rows.where(F.coalesce(*(F.col(f"`{c}`").cast("string") for c in rows.columns if c != ORDER)).isNotNull()).select(
        *kept,
        text("konto").alias("konto"), date.alias("datum"), purpose.alias("verwendungszweck"), text("empfaenger").alias("empfaenger"), amount.alias("betrag"),
        F.when(text("status") != "", text("status")).otherwise(S.OK).alias("status"), text("typ").alias("typ"), text("art").alias("art"),
    )
    return decoded_bookings(out.where((F.col("verwendungszweck") != "") | (F.col("betrag") != 0)), kept)


def read_journal_csv(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """Foreign journals from CSV files with a head line, with their rows' places in the files as ``_order``."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row_in_partition().alias("row"))
    return journal_bookings(spark.read.option("header", True).option("delimiter", delimiter).csv(path).withColumn(ORDER, place))


def bank_profiles(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Bank layouts by priority: the built-in ones, or those of a JSON file (``{"profile": [...]}`` or a list); an unreadable file gives none."""
    if path is None:
        rows = [(i, *b) for i, b in enumerate(P.BANKS)]
    else:
        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
            listed = data.get("profile", []) if isinstance(data, dict) else data
            rows = [(i, p.get("name", "generisch"), p.get("erkennung", []), p.get("saldo_alt", []), p.get("saldo_neu", []), p.get("laufender_saldo")) for i, p in enumerate(listed)]
        except (OSError, ValueError, AttributeError):
            rows = []
    return spark.createDataFrame(rows, S.PROFILE)
