"""Registered queries of the ledger engine and the DuckDB SQL that gives the same rows.

Each query applies its operator to whole tables. ``@query`` registers a function; its SQL, if there is any, stands beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions import fields, masking, money
from kontolith.operators import cadence, categorize, control, dates, headers, lines, merge, recurring, repair, views
from kontolith.plans import statements
from kontolith.plans.lens import CADENCE_SQL, LEDGER_SQL, cadence_ledger, ledger, statement_texts, table
from kontolith.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _share(total: str, n: str) -> str:
    """DuckDB: a decimal over an integer, half away from zero, in cents."""
    ct = f"CAST({total} * 100 AS BIGINT)"
    return f"CAST((CASE WHEN {ct} < 0 THEN -1 ELSE 1 END) * ((2 * abs({ct}) + {n}) // (2 * {n})) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2))"


def _german(x: str) -> str:
    return f"translate(format('{{:,.2f}}', {x}), ',.', '.,')"


_WORST = "CASE WHEN bool_or(status = 'PRUEFEN') THEN 'PRUEFEN' WHEN bool_or(status = 'OK') THEN 'OK' ELSE 'OHNE_SALDO_PRUEFUNG' END"
_SUFFIX = """, f AS (SELECT konto, min(seq) AS first FROM ledger GROUP BY konto),
 s AS (SELECT konto, CASE WHEN n = 1 THEN right(konto, 4) ELSE right(konto, 4) || '_' || n END AS suffix
       FROM (SELECT konto, row_number() OVER (PARTITION BY right(konto, 4) ORDER BY first, konto) AS n FROM f))"""


# --- views ---------------------------------------------------------------------------------------------------------


@query(LEDGER_SQL + _SUFFIX + f" SELECT l.konto, 'Journal_' || s.suffix AS blatt, count(*) AS anzahl, min(datum) AS von, max(datum) AS bis, {_WORST} AS status FROM ledger l JOIN s ON l.konto = s.konto GROUP BY l.konto, s.suffix")
def account_overview(spark, d):
    return views.account_overview(ledger(spark, d))


@query(LEDGER_SQL + _SUFFIX + " SELECT konto, suffix FROM s")
def suffix_numbering(spark, d):
    return views.account_suffixes(ledger(spark, d))


@query(LEDGER_SQL + " SELECT konto, datum, verwendungszweck, CASE WHEN betrag >= 0 THEN betrag END AS einnahme, CASE WHEN betrag < 0 THEN betrag END AS ausgabe, status, seq FROM ledger")
def journal_split(spark, d):
    return views.journal(ledger(spark, d)).select("konto", "datum", "verwendungszweck", "einnahme", "ausgabe", "status", "seq")


@query(LEDGER_SQL + " SELECT substr(verwendungszweck, 1, 30) AS gruppe, konto, datum, verwendungszweck, abs(betrag) AS betrag, seq FROM ledger WHERE kategorie = 'Fixkosten'")
def fixed_cost_view(spark, d):
    return views.fixed_costs(ledger(spark, d)).select("gruppe", "konto", "datum", "verwendungszweck", "betrag", "seq")


@query(LEDGER_SQL + f", t AS (SELECT CAST(sum(abs(betrag)) AS DECIMAL(18,2)) AS summe FROM ledger WHERE kategorie = 'Fixkosten') SELECT summe, CAST({_share('summe', '12')} AS DECIMAL(18,2)) AS monatlich FROM t")
def fixed_cost_totals(spark, d):
    return views.fixed_cost_totals(ledger(spark, d))


@query(LEDGER_SQL + " SELECT kategorie, konto, datum, verwendungszweck, abs(betrag) AS betrag, seq FROM ledger WHERE kategorie IN ('Lebenshaltung', 'Tanken')")
def consumption_view(spark, d):
    return views.consumption(ledger(spark, d))


@query(
    LEDGER_SQL
    + f", t AS (SELECT kategorie, CAST(sum(abs(betrag)) AS DECIMAL(18,2)) AS summe, greatest(1, count(DISTINCT date_trunc('month', datum))) AS monate FROM ledger WHERE kategorie IN ('Lebenshaltung', 'Tanken') GROUP BY kategorie) SELECT kategorie, summe, CAST(monate AS BIGINT) AS monate, CAST({_share('summe', 'monate')} AS DECIMAL(18,2)) AS schnitt FROM t"
)
def consumption_totals(spark, d):
    return views.consumption_totals(ledger(spark, d))


@query(LEDGER_SQL + " SELECT konto, datum, verwendungszweck, betrag, CAST(0 AS DECIMAL(18,2)) AS auszug_differenz, '' AS quelle_pdf FROM ledger WHERE status = 'PRUEFEN'")
def review_view(spark, d):
    return views.with_placeholder(views.to_check(ledger(spark, d)), "verwendungszweck", "nichts zu pruefen")


@query(LEDGER_SQL + " SELECT status, count(*) AS anzahl FROM ledger GROUP BY status")
def status_counts(spark, d):
    return control.status_counts(ledger(spark, d))


@query(LEDGER_SQL + " SELECT seq, row_number() OVER (PARTITION BY konto ORDER BY datum NULLS LAST, seq) AS platz FROM ledger")
def ledger_sort(spark, d):
    return ledger(spark, d).select("seq", F.row_number().over(Window.partitionBy("konto").orderBy(*views.ledger_order())).cast("long").alias("platz"))


@query("SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'Zahlung ca. jeden Monat' WHEN 1 THEN 'Zahlung ca. alle 7 Tage' WHEN 2 THEN 'kein klarer Rhythmus erkennbar' ELSE '' END AS erklaerung FROM orders")
def cadence_texts(spark, d):
    name = F.get(F.array(*map(F.lit, ("monatlich", "woechentlich", "unregelmaessig", "anderes"))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), fields.cadence_text(name).alias("erklaerung"))


# --- control, repair, merge ----------------------------------------------------------------------------------------


@query(
    LEDGER_SQL
    + """, g AS (SELECT kunde, CAST(sum(betrag) AS DECIMAL(18,2)) AS summe, count(*) AS anzahl FROM ledger GROUP BY kunde),
 h AS (SELECT kunde, summe, anzahl, CASE WHEN kunde % 11 = 0 THEN NULL ELSE CAST(100 AS DECIMAL(18,2)) END AS saldo_alt,
       CAST(100 + summe + CASE WHEN kunde % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS saldo_neu FROM g)
 SELECT kunde, saldo_alt, saldo_neu, summe, anzahl,
        CASE WHEN saldo_alt IS NULL THEN 'OHNE_SALDO_PRUEFUNG' WHEN saldo_alt + summe = saldo_neu THEN 'OK' ELSE 'PRUEFEN' END AS status,
        CAST(coalesce(saldo_alt + summe - saldo_neu, 0) AS DECIMAL(18,2)) AS saldo_differenz FROM h"""
)
def balance_control(spark, d):
    rows = ledger(spark, d)
    c = F.col("kunde")
    sums = rows.groupBy("kunde").agg(F.sum("betrag").alias("s"))
    heads = sums.select("kunde", F.when(c % 11 != 0, F.lit(100)).cast(S.MONEY).alias("saldo_alt"), (F.lit(100) + F.col("s") + F.when(c % 7 == 0, 1).otherwise(0)).cast(S.MONEY).alias("saldo_neu"))
    return control.check_statements(heads, rows, "kunde").select("kunde", "saldo_alt", "saldo_neu", "summe", "anzahl", "status", "saldo_differenz")


_PAGES = LEDGER_SQL + """, p AS (SELECT kunde, seq, betrag, (n - 1) // 10 AS page_no, (n - 1) % 10 AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY kunde ORDER BY seq) AS n FROM ledger)),
 m AS (SELECT kunde, seq, page_no, line_no, betrag AS wahr, CASE WHEN line_no = 1 AND kunde % 3 = 0
        THEN CAST((CASE WHEN betrag < 0 THEN -1 ELSE 1 END) * CAST(substr(c, 1, 1) || '9' || substr(c, 2) AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) ELSE betrag END AS betrag
       FROM (SELECT *, CAST(CAST(abs(betrag) * 100 AS BIGINT) AS VARCHAR) AS c FROM p))"""


def _misread_pages(spark, d) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("kunde").orderBy("seq")) - 1
    paged = ledger(spark, d).withColumn("page_no", F.floor(n / 10)).withColumn("line_no", n % 10)
    c = F.abs(money.cents(F.col("betrag"))).cast("string")
    wrong = F.concat(F.substring(c, 1, 1), F.lit("9"), F.substr(c, F.lit(2))).cast("bigint") * F.when(F.col("betrag") < 0, -1).otherwise(1)
    bad = (F.col("line_no") == 1) & (F.col("kunde") % 3 == 0)
    value = F.when(bad, (wrong.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(S.MONEY)).otherwise(F.col("betrag"))
    return paged.select(F.col("kunde").cast("string").alias(lines.DOC), "kunde", "seq", "page_no", "line_no", F.col("betrag").alias("wahr"), value.cast(S.MONEY).alias("betrag"))


@query(
    _PAGES
    + """, gap AS (SELECT kunde, page_no, CAST(sum(wahr) - sum(betrag) AS DECIMAL(18,2)) AS gap FROM m GROUP BY kunde, page_no HAVING sum(wahr) <> sum(betrag)),
 v AS (SELECT DISTINCT m.kunde, m.page_no, m.seq, CAST((CASE WHEN betrag < 0 THEN -1 ELSE 1 END) * CAST(substr(c, 1, i - 1) || substr(c, i + 1) AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS v, betrag, gap
       FROM (SELECT *, CAST(CAST(abs(betrag) * 100 AS BIGINT) AS VARCHAR) AS c FROM m) m JOIN gap g ON m.kunde = g.kunde AND m.page_no = g.page_no, unnest(range(1, length(c) + 1)) AS t(i)),
 one AS (SELECT seq, v FROM (SELECT *, count(*) OVER (PARTITION BY kunde, page_no) AS n FROM v WHERE v - betrag = gap) WHERE n = 1)
 SELECT m.kunde, m.seq, coalesce(one.v, m.betrag) AS betrag, CASE WHEN one.v IS NULL THEN '' ELSE 'OCR-Korrektur via Saldo-Checkpoint: ' || m.betrag || ' -> ' || one.v END AS vermerk FROM m LEFT JOIN one ON m.seq = one.seq"""
)
def checkpoint_repair(spark, d):
    rows = _misread_pages(spark, d)
    sums = rows.groupBy(lines.DOC, "page_no").agg(F.sum("wahr").cast(S.MONEY).alias("t"))
    carried = lambda no, v: sums.select(lines.DOC, "page_no", F.lit(no).alias("line_no"), F.lit("Übertrag").alias("line"), F.lit(True).alias("is_carry"), F.array(F.struct(v.cast(S.MONEY).alias("v"), F.lit(True).alias("explicit"))).alias("amounts"))
    return repair.repair_by_checkpoints(carried(-1, F.lit(0)).union(carried(99, F.col("t"))), rows).select("kunde", "seq", "betrag", "vermerk")


@query(
    "SELECT o_orderkey AS seq, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END * CAST(substr(c, 1, i - 1) || substr(c, i + 1) AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS v FROM (SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) AS c FROM orders), unnest(range(1, length(c) + 1)) AS t(i) GROUP BY ALL"
)
def digit_variants(spark, d):
    return ledger(spark, d).select("seq", F.explode(repair.digit_variants(F.col("betrag"))).alias("v"))


@query(
    LEDGER_SQL
    + """, old AS (SELECT konto, datum, verwendungszweck, betrag FROM ledger WHERE seq % 2 = 0),
 cand AS (SELECT konto, datum, verwendungszweck, betrag, seq FROM ledger WHERE seq % 2 = 1 OR seq % 3 = 0 UNION ALL SELECT konto, datum, '  ' || upper(verwendungszweck), betrag, seq + 1000000000 FROM ledger WHERE seq % 9 = 0),
 k AS (SELECT *, lower(trim(verwendungszweck)) AS z, row_number() OVER (PARTITION BY konto, datum, lower(trim(verwendungszweck)), betrag ORDER BY seq) AS n FROM cand)
 SELECT * FROM old UNION ALL SELECT konto, datum, verwendungszweck, betrag FROM k WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.konto = k.konto AND o.datum = k.datum AND o.betrag = k.betrag AND lower(o.verwendungszweck) = k.z)"""
)
def append_merge(spark, d):
    rows = ledger(spark, d).select("konto", "datum", "verwendungszweck", "betrag", "seq")
    again = rows.where("seq % 9 = 0").withColumn("verwendungszweck", F.concat(F.lit("  "), F.upper("verwendungszweck"))).withColumn("seq", F.col("seq") + 1_000_000_000)
    return merge.append_merge(rows.where("seq % 2 = 0").drop("seq"), rows.where("seq % 2 = 1 or seq % 3 = 0").unionByName(again), ["seq"])


# --- dates, cadence, recurring -------------------------------------------------------------------------------------


@query(
    LEDGER_SQL
    + """, r AS (SELECT kunde, seq, datum, day(datum) AS d, month(datum) AS m, CASE WHEN seq % 5 = 0 THEN year(datum) END AS y, min(year(datum)) OVER (PARTITION BY kunde) AS base FROM ledger),
 a AS (SELECT *, count(y) OVER (PARTITION BY kunde ORDER BY datum, seq) AS g, lag(m) OVER (PARTITION BY kunde ORDER BY datum, seq) AS pm FROM r),
 b AS (SELECT *, CASE WHEN y IS NULL AND pm - m >= 6 THEN 1 ELSE 0 END AS up FROM a),
 c AS (SELECT kunde, seq, d, m, coalesce(max(y) OVER (PARTITION BY kunde, g), base) + sum(up) OVER (PARTITION BY kunde, g ORDER BY datum, seq ROWS UNBOUNDED PRECEDING) AS jahr FROM b)
 SELECT kunde, seq, try_cast(printf('%04d-%02d-%02d', CAST(jahr AS BIGINT), m, d) AS DATE) AS datum FROM c"""
)
def smart_year_rollover(spark, d):
    rows = ledger(spark, d).select("kunde", "seq", F.col("datum").alias("_d"), F.dayofmonth("datum").alias("day"), F.month("datum").alias("month"), F.when(F.col("seq") % 5 == 0, F.year("datum")).alias("year"), F.min(F.year("datum")).over(Window.partitionBy("kunde")).alias("jahr"))
    return dates.smart_year(rows, ["kunde"], ["_d", "seq"]).select("kunde", "seq", "datum")


_NEAREST = "CASE WHEN m IS NULL THEN 'unregelmaessig' ELSE (SELECT CASE WHEN min(abs(m - d) / d) <= 0.35 THEN arg_min(name, abs(m - d) / d + i * 1e-12) ELSE 'unregelmaessig' END FROM (VALUES (7, 'woechentlich', 0), (14, 'zweiwoechentlich', 1), (30, 'monatlich', 2), (61, 'zweimonatlich', 3), (91, 'vierteljaehrlich', 4), (182, 'halbjaehrlich', 5), (365, 'jaehrlich', 6)) AS b(d, name, i)) END"
_GAPS = """, gaps AS (SELECT *, CASE WHEN g > 0 THEN g END AS days FROM (SELECT *, datum - lag(datum) OVER (PARTITION BY konto ORDER BY datum, seq) AS g FROM paced)),
 grp AS (SELECT konto, median(days) AS m, count(datum) AS n FROM gaps GROUP BY konto)"""


@query(CADENCE_SQL + _GAPS + f" SELECT konto, CASE WHEN n = 1 THEN 'einmalig/unklar' ELSE {_NEAREST} END AS turnus FROM grp")
def cadence_label(spark, d):
    return cadence.group_cadence(cadence.intervals(cadence_ledger(spark, d), ["konto"]), ["konto"])


@query(
    CADENCE_SQL
    + _GAPS
    + f""", reg AS (SELECT gaps.konto, count(days) AS k, bool_and(days IS NULL OR abs(days - m) <= 0.35 * m) AS even FROM gaps JOIN grp ON gaps.konto = grp.konto GROUP BY gaps.konto),
 agg AS (SELECT konto, count(*) AS anzahl, min(datum) AS erster, max(datum) AS letzter, CAST(sum(betrag) AS DECIMAL(18,2)) AS summe, max(abs(betrag)) > min(abs(betrag)) AS schwankung, min(kunde) AS kunde FROM paced GROUP BY konto),
 art AS (SELECT konto, art FROM (SELECT konto, art, row_number() OVER (PARTITION BY konto ORDER BY count(*) DESC, min(seq)) AS n FROM paced GROUP BY konto, art) WHERE n = 1),
 nm AS (SELECT konto, {_NEAREST} AS turnus FROM grp)
 SELECT agg.konto, 'ref:mandat' || agg.konto AS schluessel, 'Kunde ' || kunde AS empfaenger, art.art, nm.turnus, anzahl, erster, letzter, CAST({_share('summe', 'anzahl')} AS DECIMAL(18,2)) AS schnitt, summe,
        CASE WHEN anzahl >= 3 AND k >= 2 AND even THEN 'SICHER' WHEN anzahl >= 3 AND k = 1 AND nm.turnus <> 'unregelmaessig' THEN 'WAHRSCHEINLICH' END AS klassifikation, schwankung
 FROM agg JOIN reg ON agg.konto = reg.konto JOIN art ON agg.konto = art.konto JOIN nm ON agg.konto = nm.konto"""
)
def recurring_detect(spark, d):
    return recurring.recurring_groups(cadence_ledger(spark, d), all_groups=True).drop("seq")


@query(
    f"""WITH w AS (SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS b, lag(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS v FROM lineitem)
 SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN b > v THEN 'Preiserhoehung: ' || {_german('v')} || ' -> ' || {_german('b')} WHEN b < v THEN 'Betragsaenderung: ' || {_german('v')} || ' -> ' || {_german('b')} END AS vermerk FROM w"""
)
def price_change_note(spark, d):
    b = F.col("l_extendedprice").cast(S.MONEY)
    by = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", cadence.price_note(b, F.lag(b).over(by)).alias("vermerk"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS n FROM events GROUP BY user_id, event_type) WHERE n = 1")
def mode_first_seen(spark, d):
    return recurring.most_frequent(table(spark, d, "events"), ["user_id"], "event_type", "event_id", "event_type")


# --- fields --------------------------------------------------------------------------------------------------------


@query(LEDGER_SQL + " SELECT seq, CASE seq % 6 WHEN 0 THEN 'LS' WHEN 1 THEN 'UEW' WHEN 2 THEN 'KA' WHEN 3 THEN 'GUT' WHEN 4 THEN 'LOHN' ELSE 'SONST' END AS art FROM ledger")
def type_prefix(spark, d):
    return ledger(spark, d).select("seq", fields.booking_type(F.col("verwendungszweck")).alias("art"))


@query(
    LEDGER_SQL
    + " SELECT seq, CASE seq % 6 WHEN 0 THEN 'R' || seq WHEN 1 THEN 'R' || seq WHEN 4 THEN 'L' || seq ELSE '' END AS referenz, CASE seq % 6 WHEN 0 THEN 'M' || kunde || '00' ELSE '' END AS mandatsref, CASE seq % 6 WHEN 0 THEN 'DE98ZZZ' || kunde ELSE '' END AS glaeubiger_id, CASE seq % 6 WHEN 1 THEN 'VS 91' || seq || '-8' WHEN 3 THEN 'Kundennummer 77' || kunde || CASE WHEN kunde >= 100000 THEN '; Kundennummer 77' || kunde ELSE '' END WHEN 4 THEN 'KR-11' || kunde || '-5' WHEN 2 THEN CASE WHEN seq >= 1000000 THEN 'Sommer ' || seq ELSE '' END ELSE '' END AS vertragsnr FROM ledger"
)
def booking_fields(spark, d):
    got = fields.booking_fields(F.col("verwendungszweck"))
    return ledger(spark, d).select("seq", *(got[c].alias(c) for c in ("referenz", "mandatsref", "glaeubiger_id", "vertragsnr")))


@query(
    LEDGER_SQL
    + " SELECT seq, CASE seq % 6 WHEN 0 THEN 'stadtwerke neustadt abschlag' WHEN 1 THEN 'hausverwaltung lindner' WHEN 2 THEN 'backhaus sommer' WHEN 3 THEN 'erstattung' WHEN 4 THEN 'werkstatt amsel' ELSE 'vereinsbeitrag tsv adler' END AS schluessel, CASE seq % 6 WHEN 0 THEN 'lastschrift stadtwerke neustadt abschlag' WHEN 1 THEN 'euro ueberweisung hausverwaltung lindner' WHEN 2 THEN 'kartenzahlung girocard backhaus sommer' WHEN 3 THEN 'gutschrift erstattung kundennummer svwz' WHEN 4 THEN 'lohn gehalt werkstatt amsel' ELSE 'dauerauftrag vereinsbeitrag tsv adler' END AS gruppe FROM ledger"
)
def payee_keys(spark, d):
    z = F.col("verwendungszweck")
    return ledger(spark, d).select("seq", fields.payee_key(z).alias("schluessel"), fields.group_key(z).alias("gruppe"))


@query(LEDGER_SQL + " SELECT seq, CASE WHEN kategorie = 'Umbuchung' THEN 'UMBUCHUNG' WHEN betrag >= 0 THEN 'Einnahme' ELSE 'Ausgabe' END AS typ FROM ledger")
def booking_kinds(spark, d):
    return ledger(spark, d).select("seq", fields.booking_kind(F.col("kategorie"), F.col("betrag")).alias("typ"))


@query("SELECT o_orderkey AS seq, " + _german("CAST(o_totalprice AS DECIMAL(18,2))") + " AS text, CAST(o_totalprice AS DECIMAL(18,2)) AS betrag FROM orders")
def german_amount_roundtrip(spark, d):
    text = money.german(F.col("o_totalprice"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), text.alias("text"), money.amount_of(text).alias("betrag"))


@query("WITH t AS (SELECT o_orderkey AS seq, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders) SELECT seq, CAST(1 AS BIGINT) AS nr, -p AS betrag, true AS sicher FROM t UNION ALL SELECT seq, 2, CAST(7.5 AS DECIMAL(18,2)), false FROM t UNION ALL SELECT seq, 3, CAST(-3.25 AS DECIMAL(18,2)), true FROM t UNION ALL SELECT seq, 4, p, true FROM t")
def amount_tokens(spark, d):
    g = money.german(F.col("o_totalprice"))
    line = F.concat(F.lit("12.03. Rechnung "), g, F.lit(" S dann 7,50 EUR und -3,25 zuletzt "), g, F.lit(" H"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.posexplode(money.amounts(line)).alias("nr", "a"))
    return rows.select("seq", (F.col("nr") + 1).cast("long").alias("nr"), F.col("a.v").alias("betrag"), F.col("a.explicit").alias("sicher"))


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS datum, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS zahl FROM orders")
def cell_decoding(spark, d):
    o = table(spark, d, "orders")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("2025-02-31")
    number = F.when(F.col("o_orderkey") % 3 == 0, money.german(F.col("o_totalprice"))).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice").cast(S.MONEY).cast("string")).otherwise("n/a")
    rows = o.select("o_orderkey", date.alias("Datum"), number.alias("Betrag"), F.lit("x").alias("Zweck"), F.col("o_orderkey").cast("string").alias("Kontonummer"))
    got = rows.select(F.col("o_orderkey").alias("seq"), F.try_to_date(F.substring("Datum", 1, 10), "yyyy-MM-dd").alias("datum"), readers._number(F.col("Betrag")).alias("zahl"))
    return got


@query(
    "SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS konto, CAST(o_orderdate AS DATE) AS datum, CASE WHEN o_orderkey % 5 = 0 THEN 'Kunde ' || o_custkey ELSE 'Zweck ' || o_orderkey END AS verwendungszweck, 'Kunde ' || o_custkey AS empfaenger, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS betrag, 'OK' AS status, 'unkategorisiert' AS kategorie FROM orders"
)
def journal_import(spark, d):
    l = ledger(spark, d)  # noqa: E741
    rows = l.select(F.col("konto").alias("Kontonummer"), F.col("datum").cast("string").alias("Datum"), F.when(F.col("seq") % 5 != 0, F.concat(F.lit("Zweck "), F.col("seq").cast("string"))).alias("Verwendungszweck_voll"), F.concat(F.lit("Kunde "), F.col("kunde").cast("string")).alias("Empfänger"), F.when(F.col("betrag") >= 0, F.col("betrag").cast("string")).alias("Einnahme"), F.when(F.col("betrag") < 0, F.col("betrag").cast("string")).alias("Ausgabe"), F.lit("egal").alias("Notiz"))
    return readers.journal_bookings(rows).select("konto", "datum", "verwendungszweck", "empfaenger", "betrag", "status", "kategorie")


@query(LEDGER_SQL + " SELECT konto, datum, verwendungszweck, betrag, 'OHNE_SALDO_PRUEFUNG' AS status, 'unkategorisiert' AS kategorie, 'Ausgabe' AS typ, '' AS vermerk, false AS vorzeichen_unsicher FROM ledger")
def state_decoding(spark, d):
    part = ledger(spark, d).select("konto", F.col("datum").cast("string").alias("datum"), "verwendungszweck", F.col("betrag").cast("string").alias("betrag"))
    return readers.decoded_bookings(part).select("konto", "datum", "verwendungszweck", "betrag", "status", "kategorie", "typ", "vermerk", "vorzeichen_unsicher")


# --- categories ----------------------------------------------------------------------------------------------------


@query(LEDGER_SQL + " SELECT DISTINCT verwendungszweck FROM ledger")
def open_purposes(spark, d):
    return categorize.open_purposes(ledger(spark, d).withColumn("kategorie", F.lit("")))


@query(LEDGER_SQL + " SELECT seq, CASE WHEN seq % 4 = 0 THEN kategorie WHEN verwendungszweck LIKE 'LOHN%' THEN 'Sonstiges' WHEN verwendungszweck LIKE 'Dauer%' THEN 'Fixkosten' ELSE 'unkategorisiert' END AS kategorie FROM ledger")
def category_lookup(spark, d):
    rows = ledger(spark, d).withColumn("kategorie", F.when(F.col("seq") % 4 == 0, F.col("kategorie")).otherwise(""))
    open_ = categorize.open_purposes(rows)
    named = open_.withColumn("kategorie", F.when(F.startswith("verwendungszweck", F.lit("LOHN")), "Sonstiges").when(F.startswith("verwendungszweck", F.lit("Dauer")), "Fixkosten"))
    return categorize.apply_categories(rows, named.where("kategorie is not null")).select("seq", "kategorie")


@query("SELECT o_orderkey AS seq, CAST(o_orderkey % 10 AS BIGINT) AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'Tanken' ELSE 'Fixkosten' END AS kategorie FROM orders")
def model_answers(spark, d):
    i = (F.col("o_orderkey") % 10).cast("string")
    listed = F.concat(F.lit('[{"index": '), i, F.lit(', "kategorie": "FIXKOSTEN"}, {"i": 3, "kategorie": "Quatsch"}]'))
    named = F.concat(F.lit('{"ergebnis": [{"i": '), i, F.lit(', "kategorie": "tanken"}]}'))
    answer = F.when(F.col("o_orderkey") % 2 == 0, named).otherwise(listed)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.explode(categorize.answer_categories(answer)).alias("a"))
    return rows.select("seq", F.col("a.i").cast("long").alias("i"), F.col("a.kategorie").alias("kategorie"))


# --- masking -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS seq, 'Von DE**...' || right(lpad(CAST(o_custkey AS VARCHAR), 18, '0'), 4) || ' an DE**...' || right(lpad(CAST(o_orderkey AS VARCHAR), 18, '0'), 4) || ' BIC: BIC*** und BIC*** fertig' AS text FROM orders")
def mask_accounts(spark, d):
    digits = lambda c: F.lpad(F.col(c).cast("string"), 18, "0")
    text = F.concat(F.lit("Von DE12"), digits("o_custkey"), F.lit(" an DE34"), digits("o_orderkey"), F.lit(" BIC: GENODEF1XYZ und COBADEFF7XX fertig"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), masking.mask_bic(masking.mask_iban(text)).alias("text"))


@query(LEDGER_SQL + " SELECT count_if(seq % 7 = 0) AS treffer, count(*) AS anzahl, count_if(seq % 7 = 0) >= greatest(1, count(*) // 5) AS anonymisiert FROM ledger")
def masked_input_check(spark, d):
    hidden = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("[NAME] "), "verwendungszweck")).otherwise(F.col("verwendungszweck"))
    return control.looks_masked(ledger(spark, d).withColumn("verwendungszweck", hidden))


@query("SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN '[NAME]' WHEN 1 THEN 'Stadtwerke Neustadt' ELSE 'Miete [NAME]' END AS text FROM orders")
def mask_payees(spark, d):
    text = F.get(F.array(F.lit("Walburga Ziegenhals"), F.lit("Stadtwerke Neustadt"), F.lit("Miete Walburga Ziegenhals")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), masking.mask_text(text, field=True).alias("text"))


@query(LEDGER_SQL + " SELECT seq, '****' || right(konto, 4) AS konto, '[NAME]' AS empfaenger, betrag, 'Miete [NAME] fuer Haus ' || seq AS verwendungszweck FROM ledger")
def mask_bookings(spark, d):
    rows = ledger(spark, d).withColumn("empfaenger", F.lit("Walburga Ziegenhals")).withColumn("verwendungszweck", F.concat(F.lit("Miete Walburga Ziegenhals fuer Haus "), F.col("seq").cast("string")))
    return masking.masked_bookings(rows).select("seq", "konto", "empfaenger", "betrag", "verwendungszweck")


# --- statement texts -----------------------------------------------------------------------------------------------

_STATEMENT = LEDGER_SQL + """, s AS (SELECT kunde || '-' || year(datum) AS quelle_pdf, kunde, year(datum) AS jahr, count(*) AS anzahl, CAST(sum(betrag) AS DECIMAL(18,2)) AS summe FROM ledger GROUP BY kunde, year(datum)),
 t AS (SELECT *, 'DE127509' || lpad(CAST(kunde AS VARCHAR), 12, '0') || '00' AS konto, CASE WHEN kunde % 11 = 0 THEN NULL ELSE CAST(1000 + summe + CASE WHEN kunde % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) END AS saldo_neu FROM s)"""
_STATUS = "CASE WHEN saldo_neu IS NULL THEN 'OHNE_SALDO_PRUEFUNG' WHEN kunde % 7 = 0 THEN 'PRUEFEN' ELSE 'OK' END AS status, CAST(CASE WHEN saldo_neu IS NOT NULL AND kunde % 7 = 0 THEN -1 ELSE 0 END AS DECIMAL(18,2)) AS saldo_differenz"


@query(_STATEMENT + f" SELECT quelle_pdf, konto, CAST(jahr AS INT) AS jahr, 'LIGA BANK' AS bank_profil, CAST(1000 AS DECIMAL(18,2)) AS saldo_alt, saldo_neu, summe, anzahl, {_STATUS} FROM t")
def statement_control(spark, d):
    got = statements.parse_statements(statement_texts(spark, d)).statements
    return got.select("quelle_pdf", "konto", "jahr", "bank_profil", "saldo_alt", "saldo_neu", "summe", "anzahl", "status", "saldo_differenz")


@query(_STATEMENT + ", x AS (SELECT l.*, t.konto AS iban FROM ledger l JOIN t ON l.kunde = t.kunde AND year(l.datum) = t.jahr) SELECT kunde || '-' || year(datum) AS quelle_pdf, iban AS konto, datum, betrag, 'LASTSCHRIFT PN:931 Firma Kunde ' || kunde || ' EREF: R' || seq AS verwendungszweck, false AS vorzeichen_unsicher FROM x")
def booking_line_parse(spark, d):
    got = statements.parse_statements(statement_texts(spark, d)).bookings
    return got.select("quelle_pdf", "konto", "datum", "betrag", "verwendungszweck", "vorzeichen_unsicher")


@query(_STATEMENT + ", x AS (SELECT l.* FROM ledger l JOIN t ON l.kunde = t.kunde AND year(l.datum) = t.jahr) SELECT kunde || '-' || year(datum) AS quelle_pdf, datum, betrag, 'LASTSCHRIFT PN:931 Firma Kunde ' || kunde || ' EREF: R' || seq AS verwendungszweck FROM x")
def column_zip_parse(spark, d):
    got = statements.parse_statements(statement_texts(spark, d, apart=True)).bookings
    return got.select("quelle_pdf", "datum", "betrag", "verwendungszweck")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS quelle_pdf, CASE o_orderkey % 4 WHEN 0 THEN 'DKB' WHEN 1 THEN 'Sparkasse' WHEN 2 THEN 'ING' END AS bank, CASE WHEN o_orderkey % 2 = 0 THEN 'DE12' || lpad(CAST(o_custkey AS VARCHAR), 18, '0') ELSE lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS konto, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2024 WHEN o_orderkey % 3 = 1 THEN 2023 ELSE 2019 END AS INT) AS jahr FROM orders")
def head_extraction(spark, d):
    digits = F.lpad(F.col("o_custkey").cast("string"), 18, "0")
    bank = F.get(F.array(F.lit("Deutsche Kreditbank"), F.lit("Stadtsparkasse"), F.lit("Rechnung ing nord"), F.lit("Haus")), (F.col("o_orderkey") % 4).cast("int"))
    account = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("IBAN DE12"), digits)).otherwise(F.concat(F.lit("Kontonummer: "), F.right(digits, F.lit(8))))
    year = F.get(F.array(F.lit("Auszug Nr. 3/2024"), F.lit("Kontostand vom 1.1.2018 Abrechnung vom 2.3.2023"), F.lit("seit 2019")), (F.col("o_orderkey") % 3).cast("int"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias(lines.DOC), F.concat_ws("\n", bank, account, year).alias("ocr_text"))
    named = headers.matched_profile(docs, readers.bank_profiles(spark))
    return docs.join(named, lines.DOC, "left").select(lines.DOC, F.col("profile.name").alias("bank"), headers.account_of(F.col("ocr_text")).alias("konto"), headers.base_year_of(F.col("ocr_text")).alias("jahr"))


_PARSED = _STATEMENT + """, b AS (SELECT l.*, t.quelle_pdf, t.konto AS iban, t.saldo_neu, dense_rank() OVER (ORDER BY t.quelle_pdf) AS rang, row_number() OVER (PARTITION BY t.quelle_pdf ORDER BY l.datum, l.seq) AS n
   FROM ledger l JOIN t ON l.kunde = t.kunde AND year(l.datum) = t.jahr),
 p AS (SELECT iban AS konto, datum, 'LASTSCHRIFT PN:931 Firma Kunde ' || kunde || ' EREF: R' || seq AS verwendungszweck, betrag,
   CASE WHEN saldo_neu IS NULL THEN 'OHNE_SALDO_PRUEFUNG' WHEN kunde % 7 = 0 THEN 'PRUEFEN' ELSE 'OK' END AS status,
   CAST(CASE WHEN saldo_neu IS NOT NULL AND kunde % 7 = 0 THEN -1 ELSE 0 END AS DECIMAL(18,2)) AS auszug_differenz, quelle_pdf, rang * 4294967296 + 2 * n + 2 AS seq, seq AS schluessel FROM b)"""
_BLANK = "'' AS mandatsref, '' AS glaeubiger_id, '' AS vertragsnr, '' AS turnus, '' AS vermerk, false AS vorzeichen_unsicher, 'unkategorisiert' AS kategorie"


@query(_PARSED + f" SELECT konto, datum, verwendungszweck, betrag, status, CASE WHEN betrag >= 0 THEN 'Einnahme' ELSE 'Ausgabe' END AS typ, 'LS' AS art, 'Firma Kunde' AS empfaenger, 'R' || schluessel AS referenz, {_BLANK}, auszug_differenz, quelle_pdf, CAST(seq AS BIGINT) AS seq FROM p")
def full_run(spark, d):
    """Statement texts to analysed bookings: parse, control, merge into an empty state, enrich."""
    parsed = statements.parse_statements(statement_texts(spark, d))
    return statements.analysed(statements.as_bookings(parsed.bookings))


_PAYEES = """, who AS (SELECT *, CASE kunde % 3 WHEN 0 THEN 'Nordwerk ' || kunde || ' GmbH' WHEN 1 THEN 'Walburga Ziegenhals' ELSE 'Krankenkasse Walburga Ziegenhals' END AS payee FROM paced)"""


@query(
    CADENCE_SQL
    + _GAPS
    + f""", reg AS (SELECT gaps.konto, count(days) AS k, bool_and(days IS NULL OR abs(days - m) <= 0.35 * m) AS even FROM gaps JOIN grp ON gaps.konto = grp.konto GROUP BY gaps.konto),
 agg AS (SELECT konto, count(*) AS anzahl, min(datum) AS erster, max(datum) AS letzter, CAST(sum(betrag) AS DECIMAL(18,2)) AS summe, max(abs(betrag)) > min(abs(betrag)) AS schwankung, min(kunde) AS kunde FROM paced GROUP BY konto),
 art AS (SELECT konto, art FROM (SELECT konto, art, row_number() OVER (PARTITION BY konto ORDER BY count(*) DESC, min(seq)) AS n FROM paced GROUP BY konto, art) WHERE n = 1),
 nm AS (SELECT konto, {_NEAREST} AS turnus FROM grp)
 SELECT '****' || right(agg.konto, 4) AS konto, CASE kunde % 3 WHEN 0 THEN 'Nordwerk ' || kunde || ' GmbH' ELSE 'Krankenkasse [NAME] (Ref …' || right(agg.konto, 4) || ')' END AS empfaenger, art.art, nm.turnus, anzahl, erster, letzter,
        CAST({_share('summe', 'anzahl')} AS DECIMAL(18,2)) AS schnitt, summe, CASE WHEN k >= 2 AND even THEN 'SICHER' ELSE 'WAHRSCHEINLICH' END AS klassifikation, CASE WHEN schwankung THEN 'ja' ELSE 'nein' END AS schwankung
 FROM agg JOIN reg ON agg.konto = reg.konto JOIN art ON agg.konto = art.konto JOIN nm ON agg.konto = nm.konto
 WHERE kunde % 3 <> 1 AND anzahl >= 3 AND (k >= 2 AND even OR k = 1 AND nm.turnus <> 'unregelmaessig')"""
)
def masked_sheets(spark, d):
    """The masked recurring sheet: firms keep their names, names with a telling word get an anchor, bare names have no group."""
    rows = cadence_ledger(spark, d)
    kunde = F.col("kunde")
    payee = F.when(kunde % 3 == 0, F.concat(F.lit("Nordwerk "), kunde.cast("string"), F.lit(" GmbH"))).when(kunde % 3 == 1, "Walburga Ziegenhals").otherwise("Krankenkasse Walburga Ziegenhals")
    return statements.sheets(rows.withColumn("empfaenger", payee), masked=True)["Wiederkehrend"]


@query(_PARSED + f" SELECT konto, datum, verwendungszweck, betrag, status, 'Ausgabe' AS typ, '' AS art, '' AS empfaenger, '' AS referenz, {_BLANK}, auszug_differenz, quelle_pdf, CAST(seq AS BIGINT) AS seq FROM p")
def append_stream(spark, d):
    """Statement texts appended to stored bookings as a stream, twice; the second run adds nothing."""
    from kontolith.plans.cuts import shared_dir
    from kontolith.sources.readers import read_state
    from kontolith.streaming.append import merge_batch

    place = f"{shared_dir(spark)}/kontolith-ledger/stream-{uuid.uuid4().hex}"
    statement_texts(spark, d).write.parquet(f"{place}/in")
    for n in range(2):
        stream = spark.readStream.schema(S.STATEMENT_TEXT).parquet(f"{place}/in")
        stream.writeStream.foreachBatch(merge_batch(f"{place}/state")).option("checkpointLocation", f"{place}/offsets-{n}").trigger(availableNow=True).start().awaitTermination()
    return read_state(spark, f"{place}/state")


# --- other statement layouts, and enrichment of whole ledgers --------------------------------------------------------


def _texts(spark, d, *parts) -> DataFrame:
    """A statement per order; ``{p}`` in a part stands for the order's price."""
    whole = F.replace(F.lit("\n".join(parts)), F.lit("{p}"), money.german(F.col("o_totalprice")))
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias(lines.DOC), whole.alias("ocr_text"))


_ORDER = "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS quelle_pdf, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)"


@query(_ORDER + " SELECT quelle_pdf, p AS saldo_alt, CAST(0 AS DECIMAL(18,2)) AS saldo_neu, CAST(-3 AS DECIMAL(18,2)) AS summe, CAST(2 AS BIGINT) AS anzahl, CASE WHEN p - 3 = 0 THEN 'OK' ELSE 'PRUEFEN' END AS status, CAST(p - 3 AS DECIMAL(18,2)) AS saldo_differenz FROM o")
def bare_old_balance(spark, d):
    """The old balance of a page whose columns came apart, from its first bare credit."""
    docs = _texts(spark, d, "Haus", "01.02.", "02.02.", "03.02.", "LASTSCHRIFT A", "LASTSCHRIFT B", "{p} H", "1,00 S", "2,00 S", "neuer Kontostand 0,00 H")
    return statements.parse_statements(docs).statements.select("quelle_pdf", "saldo_alt", "saldo_neu", "summe", "anzahl", "status", "saldo_differenz")


_ROWS = ("Haus", "Auszug vom 1.2.2025", "alter Kontostand 0,00 H", "01.02. KARTENZAHLUNG PN:1 {p} 5", "02.02. Einkauf {p}", "03.02. ohne Betrag", "04.02. Lohn 7,00 h", "neuer Kontostand 8,00 H")


@query(
    _ORDER
    + " SELECT quelle_pdf, DATE '2025-02-01' AS datum, 'KARTENZAHLUNG PN:1' AS verwendungszweck, -p AS betrag, false AS vorzeichen_unsicher, 'PRUEFEN' AS status, CAST(-1 AS DECIMAL(18,2)) AS auszug_differenz FROM o UNION ALL SELECT quelle_pdf, DATE '2025-02-02', 'Einkauf', p, true, 'PRUEFEN', CAST(-1 AS DECIMAL(18,2)) FROM o UNION ALL SELECT quelle_pdf, DATE '2025-02-04', 'Lohn', CAST(7 AS DECIMAL(18,2)), false, 'PRUEFEN', CAST(-1 AS DECIMAL(18,2)) FROM o"
)
def sign_repair(spark, d):
    """A misread sign is repaired, a missing one is told, a line without amount is left out, the statement's status reaches each booking."""
    return statements.parse_statements(_texts(spark, d, *_ROWS)).bookings.select("quelle_pdf", "datum", "verwendungszweck", "betrag", "vorzeichen_unsicher", "status", "auszug_differenz")


@query(_ORDER + " SELECT quelle_pdf, CAST(3 AS BIGINT) AS anzahl, CAST(1 AS BIGINT) AS n, '03.02. ohne Betrag  [betrag_fehlt]' AS zeile, CAST(7 AS DECIMAL(18,2)) AS summe FROM o")
def incomplete_report(spark, d):
    """The control report of statements with a line that lacks its amount."""
    report = control.control_report(statements.parse_statements(_texts(spark, d, *_ROWS)).statements)
    return report.select("quelle_pdf", "anzahl", F.col("n_unvollstaendig").cast("long").alias("n"), F.col("unvollstaendige")[0].alias("zeile"), "summe")


@query(_ORDER + " SELECT quelle_pdf, CAST(-5 AS DECIMAL(18,2)) AS betrag, 'Kauf' AS verwendungszweck FROM o UNION ALL SELECT quelle_pdf, p, 'Lohn' FROM o UNION ALL SELECT quelle_pdf, CAST(-1 AS DECIMAL(18,2)), 'Kauf' FROM o")
def running_balance(spark, d):
    """Rows with a running balance: the amount is the last but one."""
    docs = _texts(spark, d, "Haus", "01.02. Kauf 5,00 S 95,00 H", "02.02. Lohn {p} H 105,00 H", "03.02. Kauf 1,00 S 104,00 H")
    return statements.parse_statements(docs).bookings.select("quelle_pdf", "betrag", "verwendungszweck")


@query(_ORDER + " SELECT quelle_pdf, 'OK' AS status, CAST(2 AS BIGINT) AS anzahl, p AS saldo_neu, CAST(p - 10 AS DECIMAL(18,2)) AS summe FROM o")
def carried_pages(spark, d):
    """Two pages with carried balances, page numbers and noise before the day."""
    docs = _texts(spark, d, "Haus", "Auszug vom 1.2.2025", "alter Kontostand 10,00 H", "907.02. 07.02. Miete 10,00 S", "Übertrag auf Blatt 2 0,00 H", "===SEITENENDE===", "Seite 2", "Übertrag von Blatt 1 0,00 H", "08.02. Lohn {p} H", "Werk Sued", "neuer Kontostand {p} H")
    return statements.parse_statements(docs).statements.select("quelle_pdf", "status", "anzahl", "saldo_neu", "summe")


@query(LEDGER_SQL + " SELECT seq, CASE seq % 6 WHEN 0 THEN 'Stadtwerke Neustadt Abschlag' WHEN 1 THEN 'Hausverwaltung Lindner' WHEN 2 THEN 'Backhaus Sommer' WHEN 3 THEN 'Erstattung' WHEN 4 THEN 'Werkstatt Amsel' ELSE 'Vereinsbeitrag TSV Adler' END AS empfaenger, CASE seq % 6 WHEN 0 THEN 'Stadtwerke Neustadt Abschlag' WHEN 1 THEN 'Hausverwaltung Lindner' WHEN 2 THEN 'Backhaus Sommer' WHEN 3 THEN 'Erstattung' WHEN 4 THEN 'Werkstatt Amsel' ELSE 'Vereinsbeitrag TSV Adler' END AS anzeige, array_to_string(string_split(verwendungszweck, ' ')[1:5], ' ') AS anfang FROM ledger")
def payee_names(spark, d):
    """Payee field, display name and the purpose's first words."""
    z = F.col("verwendungszweck")
    return ledger(spark, d).select("seq", fields.booking_fields(z)["empfaenger"].alias("empfaenger"), fields.payee_name(z).alias("anzeige"), fields.first_words(z, 5).alias("anfang"))


@query(
    CADENCE_SQL
    + f""", f AS (SELECT *, seq % 6 AS k, datum - lag(datum) OVER (PARTITION BY seq % 6 ORDER BY datum, seq) AS g, lag(betrag) OVER (PARTITION BY seq % 6 ORDER BY datum, seq) AS v FROM paced),
 grp AS (SELECT k, median(CASE WHEN g > 0 THEN g END) AS m, count(datum) AS n FROM f GROUP BY k), nm AS (SELECT k, CASE WHEN n = 1 THEN 'einmalig/unklar' ELSE {_NEAREST} END AS turnus FROM grp)
 SELECT seq, nm.turnus, CASE WHEN abs(betrag) > abs(v) THEN 'Preiserhoehung: ' || {_german('abs(v)')} || ' -> ' || {_german('abs(betrag)')} WHEN abs(betrag) < abs(v) THEN 'Betragsaenderung: ' || {_german('abs(v)')} || ' -> ' || {_german('abs(betrag)')} ELSE '' END AS vermerk FROM f JOIN nm ON f.k = nm.k"""
)
def cadence_and_prices(spark, d):
    """Cadence and price notes of fixed costs by purpose, across all accounts."""
    return cadence.cadence_and_prices(cadence_ledger(spark, d).withColumn("kategorie", F.lit(S.FIXED)).select(*(f.name for f in S.STATE))).select("seq", "turnus", "vermerk")


_BAND = "CAST(-100 - 30 * (kunde % 3) * (seq % 2) AS DECIMAL(18,2))"


@query(
    CADENCE_SQL
    + f""", x AS (SELECT konto, kunde, datum, seq, {_BAND} AS b FROM paced), gaps AS (SELECT *, CASE WHEN g > 0 THEN g END AS days FROM (SELECT *, datum - lag(datum) OVER (PARTITION BY konto ORDER BY datum, seq) AS g FROM x)),
 grp AS (SELECT konto, median(days) AS m FROM gaps GROUP BY konto), nm AS (SELECT konto, {_NEAREST} AS turnus FROM grp),
 reg AS (SELECT gaps.konto, count(days) AS k, coalesce(bool_and(days IS NULL OR abs(days - m) <= 0.35 * m), false) AS even FROM gaps JOIN grp ON gaps.konto = grp.konto GROUP BY gaps.konto),
 agg AS (SELECT konto, count(*) AS n, sum(abs(b)) AS s, min(abs(b)) AS lo, max(abs(b)) AS hi FROM x GROUP BY konto)
 SELECT agg.konto, 'emp:backhaus sommer' AS schluessel, 'Backhaus Sommer' AS empfaenger, n AS anzahl, CASE WHEN n >= 3 AND (n * hi - s) * 10 <= s AND (s - n * lo) * 10 <= s AND (k >= 2 AND even OR k = 1 AND turnus <> 'unregelmaessig') THEN CASE WHEN k >= 2 AND even THEN 'SICHER' ELSE 'WAHRSCHEINLICH' END END AS klassifikation
 FROM agg JOIN reg ON agg.konto = reg.konto JOIN nm ON agg.konto = nm.konto"""
)
def recurring_by_payee(spark, d):
    """Groups without a reference: by payee, with amounts in a band around their mean."""
    rows = cadence_ledger(spark, d).withColumn("betrag", (F.lit(-100) - 30 * (F.col("kunde") % 3) * (F.col("seq") % 2)).cast(S.MONEY))
    blank = {c: F.lit("") for c in ("mandatsref", "vertragsnr", "empfaenger")}
    named = rows.withColumns(blank).withColumn("verwendungszweck", F.lit("KARTENZAHLUNG girocard Backhaus Sommer 77"))
    return recurring.recurring_groups(named, all_groups=True).select("konto", "schluessel", "empfaenger", "anzahl", "klassifikation")


@query(LEDGER_SQL + " SELECT konto, count(*) AS zeilen FROM ledger GROUP BY konto")
def journal_sheets(spark, d):
    """The journal's sheets, one per account, as a workbook has them: rows of each."""
    rows = ledger(spark, d)
    return views.journal_sheets(rows).groupBy("konto").agg(F.count("*").alias("zeilen"))
