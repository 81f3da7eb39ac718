"""``python -m kontolith run|dry-run|journal``: the three ways to run the engine.

run: parse the statement texts of a folder, merge them into stored bookings, analyse all, write state and sheets.
dry-run: parse and print the control report; nothing is written but the parsed texts and the shared folder's tables.
journal: analyse an existing journal (workbooks or CSV), without merge and reconciliation.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kontolith import schemas as S
from kontolith.config import load_settings
from kontolith.operators.control import control_report, looks_masked, status_counts
from kontolith.plans.cuts import cut
from kontolith.plans.statements import analysed, appended, parse_statements, reanalyse, sheets, workbook_sheets
from kontolith.sources.archive import archive_files, write_text_dump
from kontolith.sources.readers import bank_profiles, read_journal_csv, read_state, read_statement_texts, source_paths
from kontolith.sources.model import model_of
from kontolith.sources.sinks import write_sheets, write_state, write_workbook
from kontolith.sources.workbook import read_journal_workbooks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kontolith", description=__doc__.splitlines()[0])
    parser.add_argument("mode", choices=["run", "dry-run", "journal"])
    parser.add_argument("source", help="folder of statement texts, or of a journal")
    parser.add_argument("--out", default="kontolith-out")
    parser.add_argument("--settings")
    parser.add_argument("--workbook", action="store_true", help="also write workbooks, for few accounts")
    parser.add_argument("--archive", help="folder to which the statement texts move after a run")
    args = parser.parse_args(argv)
    spark, settings = SparkSession.builder.appName("kontolith").getOrCreate(), load_settings(args.settings)
    asked = {"batch": settings.batch, "retries": settings.retries, "parallel": settings.model_parallel}
    if args.mode == "journal":
        read = read_journal_csv if args.source.endswith(".csv") else read_journal_workbooks
        rows = cut(read(spark, args.source), "journal")
        if not rows.limit(1).count():
            return 1
        if looks_masked(rows).first().anonymisiert:
            print("the journal looks masked")
        done = reanalyse(rows, model_of(settings), **asked)
    else:
        texts = read_statement_texts(spark, args.source, settings.pattern)
        write_text_dump(texts, f"{args.out}/texts")
        parsed = parse_statements(texts, bank_profiles(spark, settings.profiles), settings.zero_is_balance)
        if args.mode == "dry-run":
            control_report(parsed.statements).show(truncate=False)
            status_counts(parsed.bookings).show()
            return 0
        state = read_state(spark, f"{args.out}/state")
        merged = cut(state.unionByName(appended(state, parsed.bookings)), "merged")
        done = analysed(merged, model_of(settings), **asked)
        write_state(done.select(*(f.name for f in S.STATE)), f"{args.out}/state")
    write_sheets(sheets(done), f"{args.out}/full")
    write_sheets(sheets(done, masked=True), f"{args.out}/masked")
    if args.workbook:
        for masked in (False, True):
            write_workbook(workbook_sheets(done, masked), f"{args.out}/{'masked' if masked else 'full'}.xlsx")
    status_counts(done).show()
    if args.archive and args.mode == "run":
        archive_files(spark, source_paths(spark, args.source, settings.pattern), args.archive)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
