"""Command line: python -m specmill --workbook FILE --sheet NAME --documents FOLDER --completer MODULE:FUNCTION --out TABLE [--log FOLDER] [--filled FOLDER] [--start ID]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from specmill.plans.pipeline import run
from specmill.session import materialize
from specmill.sources import results


def main(argv: list[str] | None = None) -> None:
    """Runs the comparison of one workbook, with a completer named as module:function."""
    p = argparse.ArgumentParser(prog="specmill")
    for name in ("workbook", "sheet", "documents", "out", "completer"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--log", default="", help="folder for what is told of each decision")
    p.add_argument("--filled", default="", help="folder for the filled copy of the workbook")
    p.add_argument("--start", "-s", default="", help="function id to start from")
    a = p.parse_args(argv)
    module, _, function = a.completer.partition(":")
    completer = getattr(__import__(module, fromlist=[function]), function)
    if not results.prerequisites_met(a.workbook, a.completer, lambda: [a.completer]):
        raise SystemExit(1)
    spark = SparkSession.builder.getOrCreate()
    made = materialize(run(spark, a.workbook, a.documents, completer, a.sheet, a.start), "results")
    results.save_table(made, a.out)
    if a.log:
        results.save_log(made, a.log)
    if a.filled:
        results.save_workbooks(made, a.filled, a.sheet).collect()


if __name__ == "__main__":
    main()
