"""Statement texts to bookings, on invented statements."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from kontolith.plans.cuts import cut
from kontolith.plans.statements import analysed, as_bookings, parse_statements, sheets
from kontolith.schemas import STATEMENT_TEXT


def parse(spark, *texts, **how):
    docs = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], STATEMENT_TEXT)
    p = parse_statements(docs, **how)
    s = {r.quelle_pdf: r for r in p.statements.collect()}
    b = {k: [] for k in s}
    for r in p.bookings.orderBy("quelle_pdf", "page_no", "line_no").collect():
        b[r.quelle_pdf].append(r)
    return s, b


HEAD = "Testbank eG\nAuszug vom 1.2.2025\nKontonummer: 12345678\n"

SIGNS = HEAD + "alter Kontostand 100,00 H\n01.02. 01.02. LASTSCHRIFT PN:931 30,00 S\nStromwerk Nord\n02.02. GUTSCHRIFT 200,00 H\n03.02. Einkauf 5,00\n04.02. KARTENZAHLUNG PN:1 52,65 5\n05.02. Ruecklauf -3,10\nneuer Kontostand 219,25 H"
CARRY = HEAD + "alter Kontostand 1.000,00 H\n03.02. Miete 10,00 S\nÜbertrag auf Blatt 2 990,00 H\n===SEITENENDE===\nÜbertrag von Blatt 1 990,00 H\n04.02. LOHN 500,00 H\nWerk Sued\nneuer Kontostand vom 28.02.2025 1.490,00 H"
MISSING = HEAD + "alter Kontostand 10,00 H\n01.02. ohne Betrag\nBeleg 99\n02.02. Kauf 4,00 S\n31.12.2024 um 12:00:00 Uhr\nneuer Kontostand 6,00 H"
REPAIR = HEAD + "alter Kontostand 1.000,00 H\n907.02. 07.02. Kauf 709,85 S\n08.02. Kauf 20,00 S\nÜbertrag auf Blatt 2 909,15 H\nneuer Kontostand 909,15 H"
TWICE = HEAD + "alter Kontostand 1.000,00 H\n07.02. Kauf 110,00 S\n08.02. Kauf 110,00 S\nÜbertrag auf Blatt 2 879,00 H\nneuer Kontostand 879,00 H"
YEARS = "Haus\nAuszug vom 1.12.2023\n30.12. a 1,00 S\n31.12. b 1,00 S\n02.01. c 1,00 S\n31.02. d 1,00 S\n05.02.25 e 1,00 S\n06.03. f 1,00 S"
RUNNING = "Haus\n01.02. Kauf 5,00 S 95,00 H\n02.02. Lohn 10,00 H 105,00 H\n03.02. Kauf 1,00 S 104,00 H"
APART = HEAD + "01.02.\n02.02.\n03.02.\nLASTSCHRIFT A\nFirma Eins\nGUTSCHRIFT B\nSEPA C\n500,00 H\n10,00 S\n20,00 H\n30,00 S\n40,00 S\nSaldo\n9,00\nneuer Kontostand 440,00 H"
ZERO = HEAD + "alter Kontostand 0,00 H\n01.02. Lohn 5,00 H\nneuer Kontostand 5,00 H"
EMPTY = ""


@pytest.fixture(scope="module")
def parsed(spark):
    return parse(spark, SIGNS, CARRY, MISSING, REPAIR, TWICE, YEARS, RUNNING, APART, ZERO, EMPTY)


def test_signs(parsed):
    s, b = parsed
    assert [r.betrag for r in b["s0"]] == [D("-30.00"), D("200.00"), D("5.00"), D("-52.65"), D("-3.10")]
    assert [r.vorzeichen_unsicher for r in b["s0"]] == [False, False, True, False, False]
    assert b["s0"][0].verwendungszweck == "LASTSCHRIFT PN:931 Stromwerk Nord"
    assert b["s0"][4].verwendungszweck == "Ruecklauf -"  # the sign stays with the purpose
    assert s["s0"].status == "OK" and s["s0"].konto == "12345678" and s["s0"].jahr == 2025 and s["s0"].bank_profil == "generisch"


def test_carried_balances_are_no_bookings(parsed):
    s, b = parsed
    assert [r.betrag for r in b["s1"]] == [D("-10.00"), D("500.00")] and s["s1"].status == "OK"
    assert b["s1"][1].verwendungszweck == "LOHN Werk Sued"


def test_line_without_amount(parsed):
    s, b = parsed
    assert [r.betrag for r in b["s2"]] == [D("-4.00")] and s["s2"].status == "OK"
    assert s["s2"].unvollstaendige == ["01.02. ohne Betrag  [betrag_fehlt]"]
    assert b["s2"][0].verwendungszweck.endswith("31.12.2024 um 12:00:00 Uhr")


def test_repair_only_if_unique(parsed):
    s, b = parsed
    assert [r.betrag for r in b["s3"]] == [D("-70.85"), D("-20.00")] and s["s3"].status == "OK"
    assert b["s3"][0].vermerk == "OCR-Korrektur via Saldo-Checkpoint: -709.85 -> -70.85" and b["s3"][0].datum == date(2025, 2, 7)
    assert [r.betrag for r in b["s4"]] == [D("-110.00"), D("-110.00")] and s["s4"].status == "PRUEFEN"


def test_years_run_on(parsed):
    assert [r.datum for r in parsed[1]["s5"]] == [date(2023, 12, 30), date(2023, 12, 31), date(2024, 1, 2), None, date(2025, 2, 5), date(2025, 3, 6)]


def test_running_balance_column(parsed):
    assert [r.betrag for r in parsed[1]["s6"]] == [D("-5.00"), D("10.00"), D("-1.00")]


def test_columns_apart(parsed):
    s, b = parsed
    assert s["s7"].saldo_alt == D("500.00") and s["s7"].saldo_neu == D("440.00")
    got = [(r.datum, r.betrag, r.verwendungszweck) for r in b["s7"]]
    assert got[0] == (date(2025, 2, 1), D("-10.00"), "LASTSCHRIFT A Firma Eins") or got[0][1] == D("500.00")
    assert D("440.00") not in [r.betrag for r in b["s7"]]


def test_zero_balance(spark, parsed):
    assert parsed[0]["s8"].status == "OK"
    s, _ = parse(spark, ZERO, zero_is_balance=False)
    assert s["s0"].status == "OHNE_SALDO_PRUEFUNG"


def test_empty_text(parsed):
    s, b = parsed
    assert s["s9"].status == "OHNE_SALDO_PRUEFUNG" and s["s9"].anzahl == 0 and b["s9"] == [] and s["s9"].konto == "UNBEKANNT"


def test_full_run_and_sheets(spark):
    docs = spark.createDataFrame([("a", SIGNS), ("b", CARRY)], STATEMENT_TEXT)
    done = analysed(as_bookings(parse_statements(docs).bookings), lambda texts: {i: "Fixkosten" for i in range(len(texts))})
    rows = {r.seq: r for r in done.collect()}
    assert len(rows) == 7 and {r.kategorie for r in rows.values()} == {"Fixkosten"}
    full, masked = sheets(done), sheets(done, masked=True)
    assert full["Fixkosten"].count() == 7 and full["Konsum_Summe"].count() == 2
    assert full["Wiederkehrend"].first().empfaenger == "keine wiederkehrenden Zahlungen gefunden"
    assert {r.konto for r in masked["Fixkosten"].collect()} == {"****5678"} and "_Daten" not in masked


def test_cut_broadcasts_by_measure_only(spark):
    """Like rows are small as a file and large in memory: the file's size must not send them through the driver."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    left, right = (cut(spark.range(20_000).withColumn(c, F.lit("x" * 400)), c) for c in ("a", "b"))
    was = spark.conf.get(key)
    spark.conf.set(key, "1m")  # the file has some 100 kB, the rows 8 MB
    try:
        assert cut(left.join(right, "id"), "both").count() == 20_000
        assert spark.conf.get(key) == "1m" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    finally:
        spark.conf.set(key, was)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = next(p for k in range(runs.size() - 1, -1, -1) if "Join" in (p := runs.apply(k).physicalPlanDescription()))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
