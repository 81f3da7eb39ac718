"""Sinks: a folder of sheets, the stored state, a small workbook file."""

from __future__ import annotations

import datetime
import re
import zipfile
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession


def write_sheets(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each sheet as a table under ``path``."""
    for name, df in sheets.items():
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")


def state_parts(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """Number, kind (``full`` or ``add``) and place of the state's whole parts, in order; what a run left unfinished is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    found = []
    for entry in store.listStatus(root):
        m = re.fullmatch(r"(\d{8})-(full|add)", entry.getPath().getName())
        if m and store.exists(hadoop.Path(entry.getPath(), "_SUCCESS")):
            found.append((int(m[1]), m[2], entry.getPath().toString()))
    return sorted(found)


def current_parts(spark: SparkSession, path: str) -> list[str]:
    """Places of the parts that are the state now: the last full one and what was added after it."""
    parts = state_parts(spark, path)
    last = max((n for n, kind, _ in parts if kind == "full"), default=0)
    return [place for n, _, place in parts if n >= last]


def write_state(bookings: DataFrame, path: str, add: bool = False) -> None:
    """Store ``bookings`` as the new state, or ``add`` them to it.

    Every run writes a folder of its own, which counts once Spark's committer has marked it whole; nothing is renamed or
    overwritten, so a run that ends anywhere leaves the state as it was. Parts older than the last full one but one go.
    """
    spark = bookings.sparkSession
    parts = state_parts(spark, path)
    n = max((n for n, _, _ in parts), default=0) + 1
    bookings.write.mode("overwrite").parquet(f"{path}/{n:08d}-{'add' if add else 'full'}")
    fulls = [k for k, kind, _ in parts if kind == "full"]
    if not add and fulls:
        hadoop = spark._jvm.org.apache.hadoop.fs
        store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for k, _, place in parts:
            if k < fulls[-1]:
                store.delete(hadoop.Path(place), True)


#: Cell styles by number (plain, head, money, date), column width.
STYLES = (
    '<numFmts count="2"><numFmt numFmtId="164" formatCode="#,##0.00"/><numFmt numFmtId="165" formatCode="DD.MM.YYYY"/></numFmts><fonts count="2"><font/><font><b/></font></fonts>'
    '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E1F2"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs>'
)
HEAD, MONEY, DATE = 1, 2, 3
_DAY_0 = datetime.date(1899, 12, 30)


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _cell(v, style: int = 0) -> str:
    """A cell; null and empty text leave it empty."""
    if v is None or v == "":
        return "<c/>"
    if isinstance(v, Decimal):
        return f'<c s="{MONEY}"><v>{v}</v></c>'
    if isinstance(v, datetime.date):
        return f'<c s="{DATE}"><v>{(v - _DAY_0).days}</v></c>'
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c><v>{v}</v></c>"
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def write_workbook(sheets: dict[str, DataFrame], path: str, max_rows: int = 100_000) -> None:
    """A workbook for reading by people, with fixed heads, filters and number formats; sheets over ``max_rows`` are an error, write those as tables."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        for i, name in enumerate(names, 1):
            columns, rows = sheets[name].columns, sheets[name].limit(max_rows + 1).collect()
            if len(rows) > max_rows:
                raise ValueError(f"sheet {name} has over {max_rows} rows")
            head = "".join(_cell(c, HEAD) for c in columns)
            body = f"<row>{head}</row>" + "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in rows)
            widths = "".join(f'<col min="{k}" max="{k}" width="{max(12, min(60, 2 + max([len(c), *(len(str(r[k - 1])) for r in rows[:200])])))}" customWidth="1"/>' for k, c in enumerate(columns, 1))
            fixed = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet {ns}>{fixed}<cols>{widths}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:{_column(len(columns) - 1)}{len(rows) + 1}"/></worksheet>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        hidden = lambda n: ' state="hidden"' if n.startswith("_") else ""
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}"{hidden(n)} r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{STYLES}</styleSheet>")
        pk = "http://schemas.openxmlformats.org/package/2006"
        listed = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pk}/relationships">{listed}<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pk}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{pk}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>',
        )
