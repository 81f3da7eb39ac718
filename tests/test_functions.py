from datetime import date
from decimal import Decimal as D

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontolith.functions import fields, masking, money
from kontolith.functions import patterns as P
from kontolith.operators import categorize, recurring, repair, views
from kontolith.operators.cadence import cadence_and_prices
from kontolith.operators.merge import append_merge
from kontolith.plans.statements import decoded_keep
from kontolith.sources import readers, sinks


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_amount_literals(spark):
    texts = ["1.234,56", "1234,56", "12,00 S", "12,00 H", "-1.234,56", "1.234,56-", "nichts", "+5,00 S"]
    assert one(spark, money.amount_of, *texts) == [D("1234.56"), D("1234.56"), D("-12.00"), D("12.00"), D("-1234.56"), D("-1234.56"), None, D("5.00")]


def test_amounts_survive_rendering(spark):
    values = [D(c) / 100 for c in (0, 1, 99, 100, 12345, 99999999, 100000000)]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
    assert [r[0] for r in df.select(money.amount_of(money.german(F.col("v")))).collect()] == values


def test_exact_share(spark):
    df = spark.createDataFrame([(D("1.00"), 3), (D("-1.00"), 3), (D("0.05"), 2), (D("-0.05"), 2), (D("10.00"), 12)], "t decimal(18,2), n int")
    assert [r[0] for r in df.select(money.exact_share(F.col("t"), F.col("n"))).collect()] == [D("0.33"), D("-0.33"), D("0.03"), D("-0.03"), D("0.83")]


def test_types_and_fields(spark):
    assert one(spark, fields.booking_type, "Lastschrift x", "02.01. EURO-UVEBERWEISUNG", "GA 7", "Überweisung", None, "x") == ["LS", "UEW", "GA", "UEW", "SONST", "SONST"]
    z = "LASTSCHRIFT PN:931 Nordversicherung AG Haus 56001383962 EREF: A 1 MREF: M2 CRED: C3"
    got = spark.createDataFrame([(z,)], "x string").select(*(c.alias(k) for k, c in fields.booking_fields(F.col("x")).items())).first()
    assert (got.referenz, got.mandatsref, got.glaeubiger_id, got.vertragsnr, got.empfaenger) == ("A 1", "M2", "C3", "Haus 56001383962", "Nordversicherung AG")
    assert one(spark, fields.payee_key, "KARTENZAHLUNG girocard Backhaus Süd 77 Rest") == ["backhaus süd rest"]


def test_cadence_names(spark):
    df = spark.createDataFrame([(7.0,), (9.4,), (30.5,), (45.0,), (800.0,), (None,)], "d double")
    assert [r[0] for r in df.select(fields.cadence_name(F.col("d"))).collect()] == ["woechentlich", "zweiwoechentlich", "monatlich", "zweimonatlich", "unregelmaessig", "unregelmaessig"]


def test_digit_variants(spark):
    df = spark.createDataFrame([(D("-709.85"),), (D("0.05"),)], "v decimal(18,2)")
    a, b = (set(r[0]) for r in df.select(repair.digit_variants(F.col("v"))).collect())
    assert D("-70.85") in a and len(a) == 5 and b == set()


def bookings(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, konto string, datum date, verwendungszweck string, betrag decimal(18,2), kategorie string, mandatsref string")
    return decoded_keep(df)


def test_recurring_needs_three_and_rhythm(spark):
    month = [date(2025, m, 3) for m in (1, 2, 3, 4)]
    rows = [("k", d, f"Beitrag Nordbank {i}", D(-10 - i), "", "MANDAT1") for i, d in enumerate(month)] + [("k", d, "Backhaus Sonne", D(-5), "", "") for d in month[:3]] + [("k", d, "Backhaus Mond", D(-5 * 3**i), "", "") for i, d in enumerate(month[:3])] + [("k", month[0], "einmal dort", D(-1), "", "")]
    got = {r.schluessel: r for r in recurring.recurring_groups(bookings(spark, rows)).collect()}
    assert set(got) == {"ref:mandat1", "emp:backhaus sonne"} and got["ref:mandat1"].klassifikation == "SICHER" and got["ref:mandat1"].turnus == "monatlich" and got["ref:mandat1"].schwankung


def test_cadence_and_price_notes(spark):
    rows = [("k", date(2025, 1, 1), "Strom Nord", D("-10"), "Fixkosten", ""), ("k", date(2025, 2, 1), "Strom Nord", D("-12"), "Fixkosten", ""), ("k", date(2025, 3, 1), "Strom Nord", D("-9.5"), "Fixkosten", ""), ("k", date(2025, 3, 1), "Einmal Kauf", D("-1"), "Fixkosten", ""), ("k", None, "Sonst etwas", D("-1"), "Sonstiges", "")]
    got = {r.seq: (r.turnus, r.vermerk) for r in cadence_and_prices(bookings(spark, rows)).collect()}
    assert got == {0: ("monatlich", ""), 1: ("monatlich", "Preiserhoehung: 10,00 -> 12,00"), 2: ("monatlich", "Betragsaenderung: 12,00 -> 9,50"), 3: ("einmalig/unklar", ""), 4: ("", "")}


def test_merge_keeps_old_repeats(spark):
    row = ("k", date(2025, 1, 1), "Kauf  A", D("-1"), "", "")
    old, new = bookings(spark, [row, row]), bookings(spark, [("k", date(2025, 1, 1), "kauf a ", D("-1"), "", ""), ("k", None, "neu", D("2"), "", ""), ("k", None, "NEU", D("2"), "", "")])
    assert sorted(r.verwendungszweck for r in append_merge(old, new, ["seq"]).collect()) == ["Kauf  A", "Kauf  A", "neu"]


def test_placeholder_row(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert views.with_placeholder(df, "x", "leer").collect()[0].x == "a" and views.with_placeholder(df.where("false"), "x", "leer").collect()[0].x == "leer"


def test_model_failures_leave_rows_open(spark):
    def model(texts):
        if "kaputt" in texts:
            raise ValueError
        return {0: "Tanken", 5: "Tanken", 1: "Unsinn"}

    df = spark.createDataFrame([("a",), ("kaputt",)], "verwendungszweck string").repartition(2)
    assert categorize.ask(df.where("verwendungszweck = 'a'"), model).collect()[0].kategorie == "Tanken"
    assert categorize.ask(df.where("verwendungszweck = 'kaputt'"), model).count() == 0 and categorize.ask(df, None).count() == 0


def test_masking_words(spark):
    two, single = (lambda x: masking.mask_names(x, 2)), (lambda x: masking.mask_names(x, 1))
    assert one(spark, two, "Miete Walburga Ziegenhals Haus", "Walburga", "Walburga Ziegenhals GmbH 7", "1 Walburga Ziegenhals, Miete 2", "", None) == ["Miete [NAME]", "Walburga", "Walburga Ziegenhals GmbH 7", "1 [NAME], Miete 2", "", None]
    assert one(spark, single, "Walburga", "Miete Haus", "A. Ziegenhals und W. Berg") == ["[NAME]", "Miete [NAME]", "[NAME] und [NAME]"]
    assert one(spark, masking.leading_name, "Walburga Ziegenhals Miete", "Nord GmbH", "", "Walburga", "Miete") == ["Walburga Ziegenhals", "", "", "Walburga", ""]
    assert one(spark, masking.identifiable, "Walburga Ziegenhals", "Nord GmbH", "Stadtwerke", "", None, "Miete") == [False, True, True, False, False, False]


def test_no_part_of_a_name_stays(spark):
    rows = [(1, "Walburga Ziegenhals", "Kauf bei ZIEGENHALS-Markt 7", "x  walburga  ziegenhals y", "DE12345678901234567890"), (2, "Nord AG", "Kauf Nord AG", "", ""), (3, "A+B (Ziegen", "von A+B (Ziegen an", "", None)]
    df = spark.createDataFrame(rows, "seq long, empfaenger string, verwendungszweck string, referenz string, mandatsref string").withColumns({c: F.lit("") for c in ("glaeubiger_id", "vertragsnr", "quelle_pdf")}).withColumn("konto", F.lit("DE99 1234"))
    got = {r.seq: r for r in masking.masked_bookings(df).collect()}
    assert not any("ziegenhals" in str(x).lower() or "walburga" in str(x).lower() for x in got[1]) and got[1].empfaenger == "[NAME]"
    assert got[1].referenz == "x  [NAME] y" and got[1].mandatsref == "DE**...7890" and got[1].konto == "****1234"
    assert (got[2].empfaenger, got[2].verwendungszweck) == ("Nord AG", "Kauf Nord AG") and "Ziegen" not in got[3].verwendungszweck


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Walburga", "Ziegenhals", "Miete", "und", "Nord", "GmbH", "7", "A."]), max_size=8), min_size=1, max_size=12), st.integers(1, 2))
def test_masking_twice_changes_nothing(spark, rows, least):
    texts = [" ".join(r) for r in rows]
    once = one(spark, lambda x: masking.mask_names(x, least), *texts)
    again = one(spark, lambda x: masking.mask_names(x, least), *(t.replace(P.NAME, "_") for t in once))
    assert least == 2 or [t.replace("_", P.NAME) for t in again] == once


def test_fixture_text(spark):
    text = "IBAN DE12 3456 7890 1234 5678 90 BIC GENODEF1XYZ\nAnna Maria Berg, Weg 1 EREF: A-77 12345678901 abcDEF1234567890 1.234,56 Kd 88"
    assert one(spark, lambda x: masking.as_fixture(x, ["Berg", "Anna Maria Berg"], ["Weg 1"]), text) == ["IBAN DE00 0000 0000 0000 0000 00 BIC BICXXXXX\nNAME, ADRESSE EREF: REF REFNR REF 1.234,56 Kd 0000000"]


def test_iban_and_bic(spark):
    assert one(spark, masking.mask_iban, "von DE12 3456 7890 1234 5678 90 und DE12345678901234567890") == ["von DE**...7890 und DE**...7890"]
    assert one(spark, masking.mask_bic, "BIC: GENODEF1XYZ und COBADEFF7XX") == ["BIC: BIC*** und BIC***"]


def test_journal_of_another_tool(spark):
    df = spark.createDataFrame([("1", "2025-01-02", "", "Nord AG", "", "-3,50", None), (None, None, None, None, None, None, None), ("1", "nie", "Kauf", "", "2,00", None, None), ("1", "", "", "", "", "", None)], "Konto string, Datum string, Zweck string, `Empfänger` string, Einnahme string, Ausgabe string, Extra string")
    got = [(r.datum, r.verwendungszweck, r.betrag) for r in readers.journal_bookings(df).collect()]
    assert got == [(date(2025, 1, 2), "Nord AG", D("-3.50")), (None, "Kauf", D("2.00"))]


def test_state_and_workbook(spark, tmp_path):
    place = str(tmp_path / "state")
    assert readers.read_state(spark, place).count() == 0
    rows = bookings(spark, [("k", date(2025, 1, 1), "A & B", D("1"), "", "")])
    sinks.write_state(rows, place)
    sinks.write_state(readers.read_state(spark, place).union(rows), place)
    assert readers.read_state(spark, place).count() == 2
    sinks.write_state(rows, place, add=True)
    assert readers.read_state(spark, place).count() == 3 and [r.seq for r in readers.read_state(spark, place).collect()] == [0, 0, 0]
    # a run that ends before its part is whole leaves the state as it was, and the next one goes on
    (tmp_path / "state/00000004-full").mkdir()
    (tmp_path / "state/00000004-full/part-0.parquet").write_bytes(b"half")
    assert readers.read_state(spark, place).count() == 3
    sinks.write_state(rows, place)
    assert readers.read_state(spark, place).count() == 1
    sinks.write_state(rows, place)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["00000004-full", "00000005-full"]
    import zipfile

    rows = rows.drop("seq")
    sinks.write_workbook({"Journal": rows}, str(tmp_path / "x.xlsx"))
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert "A &amp; B" in z.read("xl/worksheets/sheet1.xml").decode()
    sinks.write_sheets({"Journal": rows}, str(tmp_path / "sheets"))
    assert spark.read.parquet(str(tmp_path / "sheets/Journal")).count() == 1


def test_profiles_from_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"profile": [{"name": "X", "erkennung": ["x bank"]}]}')
    assert readers.bank_profiles(spark, str(tmp_path / "p.json")).first().name == "X"
    (tmp_path / "bad.json").write_text("{")
    assert readers.bank_profiles(spark, str(tmp_path / "bad.json")).count() == 0 and readers.bank_profiles(spark).count() == 8
