"""Table schemas and fixed value sets of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# States, categories, booking kinds, booking type codes.
OK, CHECK, NO_BALANCE = "OK", "PRUEFEN", "OHNE_SALDO_PRUEFUNG"
CATEGORIES = ("Fixkosten", "Lebenshaltung", "Tanken", "Sonstiges", "Umbuchung", "unkategorisiert")
FIXED, LIVING, FUEL, OTHER, TRANSFER, UNCATEGORISED = CATEGORIES
INCOME, EXPENSE, TRANSFER_KIND = "Einnahme", "Ausgabe", "UMBUCHUNG"
UNKNOWN_ACCOUNT = "UNBEKANNT"


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


_S = T.StringType()

#: The persisted state: what an append run reads and writes.
BOOKING = _fields(
    ("konto", _S), ("datum", T.DateType()), ("verwendungszweck", _S), ("betrag", MONEY), ("status", _S), ("kategorie", _S), ("typ", _S), ("art", _S), ("empfaenger", _S),
    ("referenz", _S), ("mandatsref", _S), ("glaeubiger_id", _S), ("vertragsnr", _S), ("turnus", _S), ("vermerk", _S), ("auszug_differenz", MONEY), ("vorzeichen_unsicher", T.BooleanType()), ("quelle_pdf", _S),
)
#: What a column holds if a source lacks it.
BOOKING_DEFAULTS = {"konto": "", "verwendungszweck": "", "betrag": 0, "status": NO_BALANCE, "kategorie": UNCATEGORISED, "typ": EXPENSE, "auszug_differenz": 0, "vorzeichen_unsicher": False} | {
    c: "" for c in ("art", "empfaenger", "referenz", "mandatsref", "glaeubiger_id", "vertragsnr", "turnus", "vermerk", "quelle_pdf")
}
#: The stored state: bookings and their place in the order of first appearance, which first-seen rules go by.
STATE = T.StructType([*BOOKING, T.StructField("seq", T.LongType(), True)])
STATEMENT_TEXT = _fields(("quelle_pdf", _S), ("ocr_text", _S))
PROFILE = _fields(("priority", T.IntegerType()), ("name", _S), ("erkennung", T.ArrayType(_S)), ("saldo_alt", T.ArrayType(_S)), ("saldo_neu", T.ArrayType(_S)), ("laufender_saldo", T.BooleanType()))
