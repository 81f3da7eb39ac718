"""The relational test tables seen as a ledger: typed bookings, purposes and statement texts made from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions.money import german

#: Purposes by order key modulo 6; {o}: order key, {c}: customer key.
PURPOSES = (
    "LASTSCHRIFT PN:931 Stadtwerke Neustadt Abschlag EREF: R{o} MREF: M{c}00 CRED: DE98ZZZ{c}",
    "02.01. EURO-UEBERWEISUNG PN:900 Hausverwaltung Lindner VS 91{o}-8 EREF: R{o}",
    "KARTENZAHLUNG girocard Backhaus Sommer {o}",
    "GUTSCHRIFT PN:801 Erstattung Kundennummer 77{c} SVWZ: Ruecklauf {o} IBAN: DE12000000000000{c}",
    "LOHN/GEHALT PN:806 Werkstatt Amsel KR-11{c}-5 EREF: L{o}",
    "Dauerauftrag Vereinsbeitrag TSV Adler",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _purpose(o: str, c: str):
    filled = [F.replace(F.replace(F.lit(p), F.lit("{o}"), F.col(o).cast("string")), F.lit("{c}"), F.col(c).cast("string")) for p in PURPOSES]
    return F.get(F.array(*filled), (F.col(o) % len(PURPOSES)).cast("int"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings of ``orders``: account by customer, category by priority, status by customer."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast(S.MONEY)
    category = F.get(F.array(*map(F.lit, S.CATEGORIES[:5])), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    c = F.col("o_custkey")
    return o.select(
        F.lpad(c.cast("string"), 10, "0").alias("konto"),
        F.col("o_orderdate").cast("date").alias("datum"),
        _purpose("o_orderkey", "o_custkey").alias("verwendungszweck"),
        F.when(F.col("o_orderkey") % 3 == 0, price).otherwise(-price).cast(S.MONEY).alias("betrag"),
        F.when(c % 11 == 0, S.NO_BALANCE).when(c % 7 == 0, S.CHECK).otherwise(S.OK).alias("status"),
        category.alias("kategorie"),
        *(F.lit("").alias(x) for x in ("typ", "art", "empfaenger", "referenz", "mandatsref", "glaeubiger_id", "vertragsnr", "turnus", "vermerk")),
        F.lit(0).cast(S.MONEY).alias("auszug_differenz"),
        F.lit(False).alias("vorzeichen_unsicher"),
        F.lit("").alias("quelle_pdf"),
        F.col("o_orderkey").alias("seq"),
        c.alias("kunde"),
    )


_cases = " ".join(f"WHEN {i} THEN replace(replace('{p}', '{{o}}', CAST(o_orderkey AS VARCHAR)), '{{c}}', CAST(o_custkey AS VARCHAR))" for i, p in enumerate(PURPOSES))
_names = ", ".join(f"'{c}'" for c in S.CATEGORIES[:5])
#: The same in DuckDB, as the first of a query's common table expressions.
LEDGER_SQL = f"""WITH ledger AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS konto, CAST(o_orderdate AS DATE) AS datum,
         CASE o_orderkey % {len(PURPOSES)} {_cases} END AS verwendungszweck,
         CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS betrag,
         CASE WHEN o_custkey % 11 = 0 THEN 'OHNE_SALDO_PRUEFUNG' WHEN o_custkey % 7 = 0 THEN 'PRUEFEN' ELSE 'OK' END AS status,
         [{_names}][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS kategorie, o_orderkey AS seq, o_custkey AS kunde
  FROM orders)"""


def cadence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings at 30, 7 and 91 days by customer modulo 4, else at their order date; one reference per customer."""
    from pyspark.sql import Window

    base = ledger(spark, sf_dir)
    rn = F.row_number().over(Window.partitionBy("kunde").orderBy("seq"))
    days = F.when(F.col("kunde") % 4 == 0, 30).when(F.col("kunde") % 4 == 1, 7).when(F.col("kunde") % 4 == 2, 91)
    paced = F.date_add(F.lit("2020-01-01").cast("date"), (rn * days).cast("int"))
    return base.withColumn("datum", F.coalesce(paced, "datum")).withColumn("mandatsref", F.concat(F.lit("MANDAT"), "konto")).withColumn("empfaenger", F.concat(F.lit("Kunde "), F.col("kunde").cast("string"))).withColumn("art", F.when(F.col("seq") % 2 == 0, "LS").otherwise("UEW"))


CADENCE_SQL = (
    LEDGER_SQL
    + """, paced AS (
  SELECT konto, kunde, seq, betrag, CASE WHEN seq % 2 = 0 THEN 'LS' ELSE 'UEW' END AS art,
         CASE WHEN kunde % 4 = 3 THEN datum
              ELSE CAST(DATE '2020-01-01' + CAST(row_number() OVER (PARTITION BY kunde ORDER BY seq) AS INT) * (CASE kunde % 4 WHEN 0 THEN 30 WHEN 1 THEN 7 ELSE 91 END) AS DATE) END AS datum
  FROM ledger)"""
)


def statement_texts(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """``quelle_pdf, ocr_text``: a statement per customer and year, its bookings in rows or with its columns come ``apart``."""
    rows = ledger(spark, sf_dir).withColumn("jahr", F.year("datum"))
    day = F.date_format("datum", "dd.MM.")
    amount = F.concat(german(F.abs("betrag")), F.when(F.col("betrag") < 0, " S").otherwise(" H"))
    line = F.struct("datum", "seq", day.alias("day"), amount.alias("amount"), F.concat(F.lit("Firma Kunde "), F.col("kunde").cast("string"), F.lit(" EREF: R"), F.col("seq").cast("string")).alias("more"))
    total = F.sum("betrag").cast(S.MONEY)
    off = F.when(F.col("kunde") % 7 == 0, F.lit(1)).otherwise(F.lit(0)).cast(S.MONEY)
    g = rows.groupBy("kunde", "jahr").agg(F.array_sort(F.collect_list(line)).alias("rows"), total.alias("total")).withColumn("neu", (F.lit(1000) + F.col("total") + off).cast(S.MONEY))
    balance = lambda c: F.concat(german(F.abs(c)), F.when(c < 0, " S").otherwise(" H"))
    nl = F.lit("\n")
    head = F.concat(F.lit("LIGA BANK\nAuszug vom 1.1."), F.col("jahr").cast("string"), F.lit("\nIBAN: DE12 7509 "), F.lpad(F.col("kunde").cast("string"), 12, "0"), F.lit("00\nalter Kontostand 1.000,00 H\n"))
    body = F.concat(F.array_join(F.transform("rows", lambda r: F.concat(r["day"], F.lit(" "), r["day"], F.lit(" LASTSCHRIFT PN:931 "), r["amount"], nl, r["more"])), "\n"), nl)
    if apart:  # columns come apart from three bookings on
        columns = F.concat(*(F.concat(F.array_join(F.transform("rows", f), "\n"), nl) for f in (lambda r: r["day"], lambda r: F.concat(F.lit("LASTSCHRIFT PN:931\n"), r["more"]), lambda r: r["amount"])))
        body = F.when(F.size("rows") >= 3, columns).otherwise(body)
    close = F.when(F.col("kunde") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("neuer Kontostand "), balance(F.col("neu"))))
    return g.select(F.concat_ws("-", "kunde", "jahr").alias("quelle_pdf"), F.concat(head, body, close).alias("ocr_text"))
