"""Categories of bookings: a lookup, or any function over the distinct purposes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions.fields import booking_fields, booking_kind, booking_type


def answer_categories(answer: Column) -> Column:
    """A model's JSON answer, ``{"ergebnis": [...]}`` or a bare list, as array of ``(i, kategorie)``; categories outside the set are left out."""
    item = "array<struct<i:int,index:int,kategorie:string>>"
    rows = F.coalesce(F.from_json(answer, f"struct<ergebnis:{item}>")["ergebnis"], F.from_json(answer, item), F.array().cast(item))
    named = F.transform(rows, lambda r: F.struct(F.coalesce(r["i"], r["index"]).alias("i"), F.concat(F.upper(F.substring(r["kategorie"], 1, 1)), F.lower(F.substr(r["kategorie"], F.lit(2)))).alias("kategorie")))
    return F.filter(named, lambda r: r["i"].isNotNull() & (r["kategorie"].isin(*S.CATEGORIES[:-1])))


def open_purposes(bookings: DataFrame) -> DataFrame:
    """Distinct non-blank purposes of bookings without a category."""
    blank = F.trim(F.coalesce("verwendungszweck", F.lit(""))) == ""
    return bookings.where(_open() & ~blank).select("verwendungszweck").distinct()


def _open() -> Column:
    return F.coalesce(F.col("kategorie"), F.lit("")).isin("", S.UNCATEGORISED)


def ask(purposes: DataFrame, model: Callable[[list[str]], dict[int, str]] | None, batch: int = 10, retries: int = 1, parallel: int = 1) -> DataFrame:
    """``verwendungszweck, kategorie`` by ``model`` over batches, ``parallel`` of them at a time; a batch that keeps failing
    stays without. None: no answers."""
    if model is None:
        return purposes.limit(0).withColumn("kategorie", F.lit(None).cast("string"))

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                texts, got = pdf["verwendungszweck"].iloc[at : at + batch].tolist(), {}
                for _ in range(1 + retries):
                    try:
                        got = model(texts)
                        break
                    except Exception:  # noqa: BLE001 - a model's failure leaves its batch open
                        continue
                yield pd.DataFrame({"verwendungszweck": texts, "kategorie": [got.get(i) for i in range(len(texts))]})

    return purposes.repartition(parallel).mapInPandas(run, "verwendungszweck string, kategorie string").where(F.col("kategorie").isin(*S.CATEGORIES))


def apply_categories(bookings: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers for bookings without a category; others keep theirs."""
    named = answers.groupBy("verwendungszweck").agg(F.first("kategorie").alias("_new"))
    out = bookings.join(named, "verwendungszweck", "left")
    return out.withColumn("kategorie", F.when(_open(), F.coalesce("_new", F.lit(S.UNCATEGORISED))).otherwise(F.col("kategorie"))).select(*bookings.columns)


def enrich(bookings: DataFrame) -> DataFrame:
    """Type code (only if missing), fields and kind from purpose, category and amount."""
    out = bookings.withColumn("art", F.coalesce(F.nullif(F.col("art"), F.lit("")), booking_type(F.col("verwendungszweck"))))
    for name, value in booking_fields(F.col("verwendungszweck")).items():
        out = out.withColumn(name, value)
    return out.withColumn("typ", booking_kind(F.col("kategorie"), F.col("betrag")))
