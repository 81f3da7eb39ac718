"""Workbooks and whole runs."""

from datetime import date
from decimal import Decimal as D

from kontolith.__main__ import main
from kontolith.config import Settings, load_settings
from kontolith.sources.readers import read_state
from kontolith.sources.sinks import write_workbook
from kontolith.sources.workbook import read_journal_workbooks

TEXT = "Haus\nAuszug vom 1.2.2025\nKontonummer: 12345678\nalter Kontostand 100,00 H\n01.02. LASTSCHRIFT Nord AG 30,00 S\n02.02. GUTSCHRIFT 5,00 H\nneuer Kontostand 75,00 H"


def test_workbook_journals(spark, tmp_path):
    other = spark.createDataFrame([("9", "45658", "Kauf", "-2.50"), ("9", "2025-01-05", None, None)], "Konto string, Datum string, Zweck string, Betrag string")
    write_workbook({"Deckblatt": other.limit(0), "Journal_1": other}, str(tmp_path / "a.xlsx"))
    state = spark.createDataFrame([("7", "2025-02-01", "Lohn", "12.00")], "konto string, datum string, verwendungszweck string, betrag string")
    write_workbook({"Journal_1": other, "_Daten": state}, str(tmp_path / "b.xlsx"))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    got = {(r.konto, r.datum, r.verwendungszweck, r.betrag) for r in read_journal_workbooks(spark, str(tmp_path)).collect()}
    assert got == {("9", date(2025, 1, 1), "Kauf", D("-2.50")), ("7", date(2025, 2, 1), "Lohn", D("12.00"))}


def test_run_twice_keeps_each_booking_once(spark, tmp_path):
    texts, out = tmp_path / "texts", str(tmp_path / "out")
    texts.mkdir()
    (texts / "a.txt").write_text(TEXT)
    assert main(["dry-run", str(texts), "--out", str(tmp_path / "dry")]) == 0
    for _ in range(2):
        assert main(["run", str(texts), "--out", out]) == 0
    rows = read_state(spark, f"{out}/state").collect()
    assert sorted(r.betrag for r in rows) == [D("-30.00"), D("5.00")] and {r.status for r in rows} == {"OK"}
    assert spark.read.parquet(f"{out}/masked/Konten").first().konto == "****5678"


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"batch": 3, "other": 1}')
    assert load_settings(str(tmp_path / "s.json")).batch == 3 and load_settings(str(tmp_path / "none")) == Settings() == load_settings()


def test_bad_documents_have_an_error(spark, tmp_path):
    from kontolith.sources import recognise

    (tmp_path / "a.pdf").write_bytes(b"no pdf")
    (tmp_path / "b.txt").write_text("x")
    got = recognise.recognised_texts(spark, str(tmp_path)).collect()
    assert [(r.quelle_pdf, r.ocr_text) for r in got] == [("a.pdf", None)] and got[0].fehler
    assert [recognise.page_number(x) for x in ("page-2.png", "page-10.png", "page.png")] == [2, 10, 0]
    assert isinstance(recognise.missing_programs(), list) and (recognise.has_language("nirgendwo") is False)


def test_grey_maps_are_prepared(tmp_path):
    import numpy as np

    from kontolith.sources import recognise

    grey = np.full((20, 30), 200, np.uint8)
    grey[5:15, 5:15] = 60
    grey[2, 25] = 0  # a speck
    want = np.where(grey == 60, 0, 255)
    got = recognise.prepared(grey)
    assert (got[6:14, 6:14] == 0).all() and got[2, 25] == 255 and (got != want).sum() <= 4
    f = tmp_path / "page-1.pgm"
    f.write_bytes(b"P5\n30 20\n255\n" + grey.tobytes())
    recognise.prepare_file(f)
    assert f.read_bytes() == b"P5\n30 20\n255\n" + got.tobytes()
    f.write_bytes(b"odd")
    recognise.prepare_file(f)
    assert f.read_bytes() == b"odd"


def test_archive_and_text_dump(spark, tmp_path):
    from kontolith.sources.archive import archive_files, read_text_dump, write_text_dump

    for folder in ("in", "more", "old"):
        (tmp_path / folder).mkdir()
    for f in ("in/a.txt", "more/a.txt", "old/a.txt", "in/b"):
        (tmp_path / f).write_text(f)
    got = archive_files(spark, [f"file:{tmp_path}/{f}" for f in ("in/a.txt", "more/a.txt", "in/b")], f"file:{tmp_path}/old")
    assert sorted(p.name for p in (tmp_path / "old").iterdir() if not p.name.startswith(".")) == ["a.txt", "a_2.txt", "a_3.txt", "b"] and len(got) == 3
    docs = spark.createDataFrame([("a.pdf", "one\ntwo"), ("b c.txt", "three")], "quelle_pdf string, ocr_text string")
    write_text_dump(docs, str(tmp_path / "dump"))
    assert {(r.quelle_pdf, r.ocr_text) for r in read_text_dump(spark, str(tmp_path / "dump")).collect()} == {("a", "one\ntwo"), ("b c", "three")}


def test_model_client(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from kontolith.operators.categorize import ask
    from kontolith.sources.model import ModelClient, categories_of, model_of

    calls = []

    class Model(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, data):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(data).encode())

        def do_GET(self):
            self.answer({"data": []})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            if len(calls) == 1:
                return self.send_error(500)
            lines = body["messages"][1]["content"].splitlines()
            self.answer({"choices": [{"message": {"content": json.dumps({"ergebnis": [{"i": i, "kategorie": "TANKEN"} for i in range(len(lines))]})}}]})

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = ModelClient(f"http://127.0.0.1:{server.server_port}/", "m", 10)
    assert client.reachable() and not ModelClient("http://127.0.0.1:9", "m").reachable() and model_of(Settings(model_enabled=False)) is None
    df = spark.createDataFrame([(f"z{i}",) for i in range(7)], "verwendungszweck string")
    assert {r.kategorie for r in ask(df, client, batch=3).collect()} == {"Tanken"} and len(calls) == 4
    server.shutdown()
    assert categories_of('[{"index": 2, "kategorie": "fixkosten"}, {"i": 1, "kategorie": "Unsinn"}, 5]') == {2: "Fixkosten"}


def test_workbooks_and_archive_of_a_run(spark, tmp_path):
    import zipfile

    texts, out = tmp_path / "texts", str(tmp_path / "out")
    texts.mkdir()
    (texts / "a.txt").write_text(TEXT)
    (texts / "b.txt").write_text(TEXT.replace("12345678", "87654321").replace("30,00", "31,00").replace("75,00", "74,00"))
    assert main(["run", str(texts), "--out", out, "--workbook", "--archive", str(tmp_path / "done")]) == 0
    with zipfile.ZipFile(f"{out}/full.xlsx") as z:
        book, first = z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet2.xml").decode()
    names = [x.split('"')[0] for x in book.split('<sheet name="')[1:]]
    assert names == ["Konten", "Journal_4321", "Wiederkehrend_4321", "Journal_5678", "Wiederkehrend_5678", "Fixkosten", "Fixkosten_Summe", "Konsum", "Konsum_Summe", "Pruefen", "_Daten"]
    assert 'state="hidden"' in book and 'state="frozen"' in first and "autoFilter" in first and '<c s="2"><v>-31.00</v></c>' in first
    assert sorted(p.name for p in (tmp_path / "done").iterdir() if p.suffix == ".txt") == ["a.txt", "b.txt"] and not list(texts.glob("*.txt"))
