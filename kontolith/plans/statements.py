"""From statement texts to reconciled bookings, and from bookings to the sheets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions.fields import account_or_unknown
from kontolith.functions.masking import identifiable, masked_bookings, masked_groups
from kontolith.functions import patterns as P
from kontolith.operators import bookings as B
from kontolith.operators import headers, views
from kontolith.operators.cadence import cadence_and_prices
from kontolith.operators.categorize import apply_categories, ask, enrich, open_purposes
from kontolith.operators.control import check_statements, spread_status
from kontolith.operators.dates import smart_year
from kontolith.operators.lines import DOC, lines
from kontolith.operators.merge import append_merge
from kontolith.operators.recurring import keyed_bookings, recurring_groups
from kontolith.operators.repair import repair_by_checkpoints
from kontolith.plans.cuts import cut, numbered
from kontolith.sources.readers import ORDER, bank_profiles


@dataclass
class Parsed:
    statements: DataFrame
    bookings: DataFrame


def parse_statements(docs: DataFrame, profiles: DataFrame | None = None, zero_is_balance: bool = True) -> Parsed:
    """Statements (a row per text, with status) and bookings (with ``page_no, line_no``) of ``quelle_pdf, ocr_text``.

    All shuffles are by document or by document and page; nothing is collected.
    """
    profiles = bank_profiles(docs.sparkSession) if profiles is None else profiles
    told = cut(lines(docs), "lines")
    marks = cut(headers.checkpoints(told), "marks")
    heads = cut(headers.statement_heads(docs, told, profiles, marks, zero_is_balance), "heads")
    parsed = cut(B.parsed_bookings(told, heads, marks), "parsed")
    repaired = repair_by_checkpoints(told, B.complete(parsed))
    dated = smart_year(repaired.join(heads.select(DOC, "konto", "jahr"), DOC), [DOC], list(B.SEQ))
    statements = check_statements(heads.drop("profile"), dated, DOC).join(B.incomplete_lines(parsed), DOC, "left")
    full = spread_status(dated, statements, DOC).withColumn("vorzeichen_unsicher", ~F.col("explicit"))
    return Parsed(cut(statements, "statements"), cut(full, "bookings"))


def ranked_sources(parsed: DataFrame) -> DataFrame:
    """``quelle_pdf, _rank``: sources numbered from 1 in their order."""
    return numbered(parsed.select(DOC).distinct(), [DOC], "_rank")


def as_bookings(parsed: DataFrame) -> DataFrame:
    """Booking columns and ``seq`` of parsed bookings, in order of source, page and line.

    ``seq`` packs the source's number with page and line: up to 2^31 sources of 2^12 pages of 2^20 lines.
    """
    seq = F.col("_rank") * (1 << 32) + F.col("page_no") * (1 << 20) + F.col("line_no")
    return decoded_keep(parsed.join(ranked_sources(parsed), DOC).withColumn("seq", seq))


def decoded_keep(rows: DataFrame) -> DataFrame:
    """Booking columns with defaults, and ``seq``."""
    have = set(rows.columns)
    cols = []
    for f in S.BOOKING:
        default = S.BOOKING_DEFAULTS.get(f.name)
        value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((value if default is None else F.coalesce(value, F.lit(default).cast(f.dataType))).alias(f.name))
    return rows.select(*cols, "seq")


def analysed(bookings: DataFrame, model: Callable[[list[str]], dict[int, str]] | None = None, **how) -> DataFrame:
    """Categories (``how``: see :func:`kontolith.operators.categorize.ask`), type codes, fields, kinds, cadence and price notes."""
    named = cut(apply_categories(bookings, ask(open_purposes(bookings), model, **how)), "named")
    return cut(cadence_and_prices(cut(enrich(named), "enriched")), "analysed")


def account_tails(bookings: DataFrame) -> DataFrame:
    """``konto, schluessel, iban_ende``: the last four digits of the first account in a recurring group's purposes."""
    found = F.nullif(F.regexp_extract("verwendungszweck", P.MASK_IBAN, 0), F.lit(""))
    tail = F.min_by(F.right(F.regexp_replace(found, r"\s", ""), F.lit(4)), F.when(found.isNotNull(), F.col("seq")))
    return keyed_bookings(bookings).groupBy("konto", "schluessel").agg(tail.alias("iban_ende"))


def sheets(bookings: DataFrame, masked: bool = False) -> dict[str, DataFrame]:
    """All sheets of analysed bookings. Recurring groups form on real names; a masked set has masked names and no stored rows."""
    groups = recurring_groups(bookings).where(identifiable(F.col("empfaenger")))
    shown = bookings
    if masked:
        groups = masked_groups(groups, account_tails(bookings)).withColumn("konto", views.account_label(F.col("konto"), True))
        shown = masked_bookings(bookings)
    out = {
        "Konten": views.account_overview(bookings, masked),
        "Journal": views.journal(shown),
        "Wiederkehrend": views.with_placeholder(views.recurring_view(groups), "empfaenger", "keine wiederkehrenden Zahlungen gefunden"),
        "Fixkosten": views.fixed_costs(shown),
        "Fixkosten_Summe": views.fixed_cost_totals(shown),
        "Konsum": views.consumption(shown),
        "Konsum_Summe": views.consumption_totals(shown),
        "Pruefen": views.with_placeholder(views.to_check(shown), "verwendungszweck", "nichts zu pruefen"),
    }
    return out if masked else out | {"_Daten": bookings.select(*(f.name for f in S.BOOKING))}


def workbook_sheets(bookings: DataFrame, masked: bool = False, most: int = 200) -> dict[str, DataFrame]:
    """The sheets in a workbook's order: overview, journal and recurring payments of each account, then the views over all.

    Accounts are listed on the driver, at most ``most``; write more as tables.
    """
    all_ = sheets(bookings, masked)
    accounts = views.account_suffixes(bookings).orderBy("suffix").limit(most + 1).collect()
    if len(accounts) > most:
        raise ValueError(f"over {most} accounts; write the sheets as tables")
    journal = views.journal(masked_bookings(bookings) if masked else bookings).drop("konto").join(bookings.select("seq", account_or_unknown(F.col("konto")).alias("konto")), "seq")
    groups = recurring_groups(bookings).where(identifiable(F.col("empfaenger")))
    shown = masked_groups(groups, account_tails(bookings)) if masked else groups
    out = {"Konten": all_["Konten"]}
    for a in accounts:
        own = F.col("konto") == a.konto
        out[f"Journal_{a.suffix}"] = journal.where(own).orderBy(F.col("datum").asc_nulls_last(), "seq").drop("konto", "seq")
        out[f"Wiederkehrend_{a.suffix}"] = views.with_placeholder(views.recurring_view(shown.where(own)).drop("konto"), "empfaenger", "keine wiederkehrenden Zahlungen gefunden")
    return out | {k: v for k, v in all_.items() if k not in ("Konten", "Journal", "Wiederkehrend")}


def reanalyse(journal: DataFrame, model: Callable[[list[str]], dict[int, str]] | None = None, **how) -> DataFrame:
    """Analysis of an existing journal (see ``sources.readers``): no merge, no reconciliation.

    Rows without ``seq`` are numbered by their place in the source, or, if the source has none, by all their columns.
    """
    placed = journal.withColumn("konto", account_or_unknown(F.col("konto")))
    if "seq" not in placed.columns:
        placed = numbered(placed, [ORDER] if ORDER in placed.columns else placed.columns, "seq")
    return analysed(placed.drop(ORDER), model, **how)


def appended(state: DataFrame, parsed: DataFrame) -> DataFrame:
    """New bookings of ``parsed`` that ``state`` lacks, their ``seq`` following the stored ones."""
    last = state.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))  # one row
    new = as_bookings(parsed).join(F.broadcast(last), F.lit(True)).withColumn("seq", F.col("_last") + F.col("seq")).drop("_last")
    return append_merge(state.limit(0), new, ["seq"], known=state)
