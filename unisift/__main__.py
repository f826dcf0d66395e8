"""The command: `python -m unisift [options] [files]`. Exit code 1 if a finding fails, 2 for wrong options."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import engine
from .plans import report


def options(arguments: Sequence[str] | None = None) -> tuple[engine.Options, bool]:
    """Options of a command line and the environment, and whether colours are wanted."""
    parser = argparse.ArgumentParser("unisift", description="Find adversarial or suspicious Unicode in files.")
    parser.add_argument("files", nargs="*", help="files to scan; none: all files below the current folder")
    which = parser.add_mutually_exclusive_group()
    which.add_argument("--file-list", help="a file with a path in each line")
    which.add_argument("--all", action="store_true", help="scan all files below the current folder")
    parser.add_argument("--policy", help="policy file (YAML or JSON)")
    parser.add_argument("--base-sha", help="commit to compare with, for policies that look at changed lines only")
    parser.add_argument("--sarif-file", help="where to write a SARIF report")
    parser.add_argument("--exclude", action="append", default=[], metavar="GLOB", help="paths to leave out; may be given several times")
    parser.add_argument("--fail-on-warn", action="store_true", help="medium and low findings fail too")
    parser.add_argument("--no-annotations", action="store_true", help="don't print workflow commands")
    parser.add_argument("--no-color", action="store_true", help="print without colours")
    a = parser.parse_args(arguments)
    own = engine.Options(a.files, a.file_list, a.all, a.policy, a.base_sha, a.sarif_file, a.exclude, a.fail_on_warn, a.no_annotations)
    return own.with_environment(), not a.no_color and sys.stdout.isatty()


def main(arguments: Sequence[str] | None = None) -> int:
    chosen, colour = options(arguments)
    spark = SparkSession.builder.appName("unisift").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out = engine.run(spark, chosen)
    if not out.files_scanned:
        print("Warning: no files were scanned", file=sys.stderr)
    for row in out.findings.orderBy(*report.ORDER).select(report.rendered(colour).alias("text")).toLocalIterator():
        print(row.text, end="\n\n")
    print(out.summary())
    for row in out.annotations().toLocalIterator():
        print(row.annotation)
    if chosen.sarif_file:
        print(f"SARIF report written to: {chosen.sarif_file}")
    out.append_reports(os.environ)
    return out.exit_code


if __name__ == "__main__":
    sys.exit(main())
